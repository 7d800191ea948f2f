"""WARC archives: writing captures, and assembling transactions from what is read back.

A capture is three records: the request, the response (or a revisit, where another capture holds
the same payload) and metadata. Request and metadata name the response in WARC-Concurrent-To; a
revisit names its response in WARC-Refers-To and keeps the HTTP header, with the length of the
payload, but not the payload. Archives are written by Spark itself, one gzipped file for each task:
the end of a record, two line ends, is the separator between rows of text. They are read the same
way, cut where an end is followed by the next record's version line, record by record, so a task
holds one record at a time; what a payload holds that looks like such a cut is mended by
Content-Length.

Of captures with equal payloads of at least ``MIN_REVISIT`` bytes the one with the largest id is
the response and the others revisit it; captures that share this id are responses all. Null ids
count as the smallest. Null payloads are empty. Record ids are made of the id and the payload's
digest: captures repeated with both equal share their records' ids and are assembled one by one. An
empty table gives an empty archive.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import materialise, new_path

MIN_REVISIT = 1000
BROADCAST_ROWS = 200_000  # of digest, id: some 20 MB
DATE = "2025-01-01T00:00:00Z"
END = "\r\n\r\n"
VERSION = "WARC/1.1\r\n"
CUT = END + VERSION
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record_id(kind: str, id_: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.lit(kind), F.coalesce(id_.cast("string"), F.lit("?")), digest))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(kind: Column, record_id: Column, uri: Column, more: list[Column], content_type: str, block: Column, date: str) -> Column:
    """A record as text, without the end that follows it. Null lines of ``more`` are left out."""
    lines = F.concat_ws(
        "\r\n",
        F.concat(F.lit("WARC/1.1\r\nWARC-Type: "), kind),
        F.concat(F.lit("WARC-Record-ID: "), record_id),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        *more,
        F.lit(f"Content-Type: {content_type}"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    return F.concat(lines, F.lit(END), block)


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = DATE) -> None:
    """Write three records for every row of ``pages`` to gzipped archives under ``path``."""
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit(""))
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.regexp_replace(F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit("urn:none")), r"[\s\p{Cntrl}]", "%20").alias("uri"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    large = rows.where(F.octet_length("payload") >= MIN_REVISIT).groupBy("digest").agg(F.max("id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("digest").alias("d"), "first_id", F.lit(True).alias("same"))
    # only payloads that recur; the pages themselves are not shuffled while these are few. Written first:
    # beyond that the join meets two plain exchanges, and the rows of a hot payload can be split
    large = materialise(large, "payloads")
    few = large.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = rows.join(F.broadcast(large) if few else large, rows["digest"] == F.col("d"), "left")
    revisit = F.coalesce(F.col("same"), F.lit(False)) & ~F.col("id").eqNullSafe(F.col("first_id"))
    own = _record_id("response", F.col("id"), F.col("digest"))
    size = F.octet_length("payload").cast("string")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit(END))
    digest = F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"))
    about = F.concat(F.lit("WARC-Concurrent-To: "), own)
    refers = F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _record_id("response", F.col("first_id"), F.col("digest"))))
    profile = F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}"))
    request = F.concat(F.lit("GET "), F.col("uri"), F.lit(" HTTP/1.1" + END))
    fields = F.concat_ws("\r\n", F.concat(F.lit("captureId: "), F.col("id").cast("string")), F.concat(F.lit("payloadDigest: "), F.col("digest")))
    records = F.array(
        _record(F.lit("request"), _record_id("request", F.col("id"), F.col("digest")), F.col("uri"), [about], "application/http; msgtype=request", request, date),
        _record(F.when(revisit, "revisit").otherwise("response"), own, F.col("uri"), [digest, refers, profile], "application/http; msgtype=response", F.when(revisit, http).otherwise(F.concat(http, F.col("payload"))), date),
        _record(F.lit("metadata"), _record_id("metadata", F.col("id"), F.col("digest")), F.col("uri"), [about], "application/warc-fields", fields, date),
    )
    rows.select(F.explode(records).alias("value")).write.option("lineSep", END).option("compression", "gzip").text(path)


_RECORD = pa.schema([
    ("type", pa.string()), ("record_id", pa.string()), ("date", pa.string()), ("uri", pa.string()), ("concurrent_to", pa.string()), ("refers_to", pa.string()),
    ("header_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("fields", pa.map_(pa.string(), pa.string())), ("block", pa.binary()),
])
_DDL = "type string, record_id string, date string, uri string, concurrent_to string, refers_to string, header_digest string, payload_bytes bigint, payload_digest string, fields map<string,string>, block binary"


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(b":") for line in head.split(b"\r\n"))
    return {k.strip().decode("utf-8", "replace").lower(): v.strip().decode("utf-8", "replace") for k, c, v in pairs if c}


def _parsed(head: dict[str, str], block: bytes, keep: bool) -> tuple:
    kind, size, digest, fields = head.get("warc-type"), None, None, []
    stated = (head.get("warc-payload-digest") or "").removeprefix("sha1:") or None
    if kind in ("response", "revisit", "request"):
        http, _, body = block.partition(b"\r\n\r\n")
        if kind == "response":
            size, digest = len(body), hashlib.sha1(body).hexdigest()
        elif kind == "revisit":
            size, digest = int(_fields(http).get("content-length", 0)), stated
    elif kind == "metadata":
        fields = list(_fields(block).items())
    return (kind, head.get("warc-record-id"), head.get("warc-date"), head.get("warc-target-uri"), head.get("warc-concurrent-to"), head.get("warc-refers-to"), stated, size, digest, fields, block if keep else None)


def _records(batches: Iterator[pa.RecordBatch], keep: bool) -> Iterator[pa.RecordBatch]:
    cut, end, version = CUT.encode(), END.encode(), VERSION.encode()
    held, file = b"", None
    out: list[tuple] = []
    size = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _RECORD, strict=True)], schema=_RECORD)

    for rows in batches:
        for value, path in zip(rows.column(0), rows.column(1), strict=True):
            piece, path = value.as_py(), path.as_py()
            if path != file:
                if held:
                    raise ValueError(f"{file} ends within a record")
                file, piece = path, piece.removeprefix(version)
            if held:
                piece, held = held + cut + piece, b""
            head, _, rest = piece.partition(end)
            fields = _fields(head)
            length = int(fields.get("content-length", 0))
            if len(rest) < length:
                held = piece
                continue
            out.append(_parsed(fields, rest[:length], keep))
            size += length if keep else 0
            if len(out) >= 2000 or size > 1 << 24:
                yield batch()
                out, size = [], 0
    if held:
        raise ValueError(f"{file} ends within a record")
    if out:
        yield batch()


def read(spark: SparkSession, path: str, keep_blocks: bool = True) -> DataFrame:
    """One row for each record of the gzipped archives under ``path``, in their order."""
    lines = spark.read.option("lineSep", CUT).text(path).select(F.col("value").cast("binary"), F.col("_metadata.file_path"))
    return lines.mapInArrow(lambda batches: _records(batches, keep_blocks), _DDL)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: (record_id, type, response, request, metadata).

    Requests and metadata meet their response by concurrent-to; captures may lack either.
    """
    inner = ["type", "record_id", "date", "uri", "refers_to", "header_digest", "payload_bytes", "payload_digest", "block"]
    main = records.where(F.col("type").isin("response", "revisit")).select(*inner)
    other = records.where(F.col("concurrent_to").isNotNull()).dropDuplicates(["type", "concurrent_to"])
    request = other.where("type = 'request'").select(F.col("concurrent_to").alias("rc"), F.struct("record_id", "uri", "date", "block").alias("request"))
    metadata = other.where("type = 'metadata'").select(F.col("concurrent_to").alias("mc"), F.struct("record_id", "fields").alias("metadata"))
    joined = main.join(request, F.col("record_id") == F.col("rc"), "left").join(metadata, F.col("record_id") == F.col("mc"), "left")
    return joined.select("record_id", "type", F.struct(*inner[2:]).alias("response"), "request", "metadata")


def resolve(captures: DataFrame) -> DataFrame:
    """Captures with ``capture_id`` and, for revisits, ``refers_to_id``: the id of the response."""
    named = captures.withColumn("capture_id", F.col("metadata.fields").getItem("captureid"))
    wanted = named.where("type = 'revisit'").select(F.col("response.refers_to").alias("of")).distinct()
    target = named.where("type = 'response'").select(F.col("record_id").alias("of"), F.col("capture_id").alias("refers_to_id")).dropDuplicates(["of"])
    # written first: the join then meets two plain exchanges, and the revisits of a hot payload can be split
    target = materialise(target.join(wanted, "of", "left_semi"), "targets")
    revisits = named.where("type = 'revisit'").join(target, F.col("response.refers_to") == F.col("of"), "left").drop("of")
    return named.where("type = 'response'").withColumn("refers_to_id", F.lit(None).cast("string")).unionByName(revisits)


def round_trip(pages: DataFrame, id_col: str = "page_id", keep_blocks: bool = False, **columns) -> DataFrame:
    """Write the pages to archives in the shared folder and assemble the captures read back."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write(pages, path, id_col=id_col, **columns)
    records = read(spark, path, keep_blocks)
    # without blocks the records are light: archives are then read once, not for every join
    return resolve(assemble(records if keep_blocks else materialise(records, "records")))

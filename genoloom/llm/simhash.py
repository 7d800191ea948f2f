"""SimHash near-duplicates, found by an inverted index over positional bytes with count filtering.

A fingerprint has 64 bits; a bit is set where it is set in over half of the hashes of the text's
word shingles. Two fingerprints link at ``MAX_BITS`` = 3 or fewer differing bits, so at least
5 of their 8 bytes are equal in place: the guaranteed minimum of the count filter.

The index lists, for a position and a byte, the fingerprints that have this byte there. A single list
holds a 256th of all rows, so the index is cut into parts that lose no pair: the positions form two
halves of four, any 5 of the 8 leave 3 within one half, and a part holds the fingerprints that
agree in 3 given positions of a half. Within its part a pair has 3 shared bytes to begin with; the posting
lists of the 5 other positions are walked and every pair of a list is tallied once more. Pairs below
5 go, the rest are verified on all bits. A pair is judged only in the first part it shares.

Equal fingerprints are one node, so a group of copies is one entry however large it is.
Parts of more than ``LIST`` nodes are dealt into blocks, compared block by block in different
tasks. No task returns pairs: it returns a spanning forest of its links, fewer than its nodes,
and components over these forests lose no link.

Nulls and texts without words have fingerprint zero and link like any other. A text of fewer
words than a shingle has one shingle of all its words. Repeated rows are nodes of one group; null
ids never name a component unless all of its ids are null. Empty tables give empty tables.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .components import components
from .scratch import materialise
from .textbytes import buffers

BITS, BYTES, MAX_BITS = 64, 8, 3
MIN_SHARED = BYTES - MAX_BITS
KEY_BYTES = 3
LIST = 2048
SEED = 42
SHINGLE = 3


#: positions that a part agrees in: three of either half; any MIN_SHARED positions contain one of these
KEYS = [key for half in (range(4), range(4, BYTES)) for key in combinations(half, KEY_BYTES)]
_BYTE = [0xFF << (8 * i) for i in range(BYTES)]
_MASKS = [sum(_BYTE[i] for i in key) for key in KEYS]
#: by the set of equal bytes: the first key within it, or -1 below the guaranteed minimum
_FIRST = np.array([next((n for n, key in enumerate(KEYS) if all(m >> i & 1 for i in key)), -1) if m.bit_count() >= MIN_SHARED else -1 for m in range(256)])


def fingerprint_of(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of one UTF-8 text."""
    found = text.lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = min(shingle, len(found))
    n = len(found) - size + 1
    starts, ends = starts[:n].tolist(), ends[size - 1 :].tolist()
    digest, total = xxhash.xxh64_digest, np.zeros(BITS, np.int64)
    for lo in range(0, n, 1 << 15):
        hashed = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[lo : lo + (1 << 15)], ends[lo : lo + (1 << 15)], strict=True)])
        bits = np.unpackbits(np.frombuffer(hashed, np.uint8).reshape(-1, BYTES), axis=1)
        total += bits.sum(axis=0, dtype=np.uint16)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big", signed=True)


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint of a text column, as a signed long of the same 64 bits."""

    @arrow_udf("bigint")
    def simhash(texts: pa.Array) -> pa.Array:
        data, offsets = buffers(texts)
        view = memoryview(data)
        return pa.array([fingerprint_of(bytes(view[a:b]), shingle) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.int64())

    return simhash(text.cast("string"))


def _tally(columns: np.ndarray, key: int) -> np.ndarray:
    """Shared positional bytes of each pair of a part, from the posting lists of its other positions."""
    n = len(columns)
    shared = np.full((n, n), KEY_BYTES, np.uint8)
    for position in set(range(BYTES)) - set(KEYS[key]):
        order = np.argsort(columns[:, position], kind="stable")
        values = columns[order, position]
        for posting in np.split(order, np.flatnonzero(values[1:] != values[:-1]) + 1):
            if len(posting) > 1:
                shared[np.ix_(posting, posting)] += 1
    return shared


def _forest(nodes: np.ndarray, side: np.ndarray, key: int) -> list[tuple[int, int]]:
    """Links that span what the pairs of this part link; in a block of two sides, across them."""
    columns = np.ascontiguousarray(nodes).view(np.uint8).reshape(-1, BYTES)
    bits = np.ascontiguousarray(nodes).view(np.uint64)
    enough = _tally(columns, key) >= MIN_SHARED
    root = np.arange(len(nodes))
    edges: list[tuple[int, int]] = []
    for at in np.flatnonzero(enough.sum(axis=1) > 1).tolist():
        near = np.flatnonzero(enough[at, at + 1 :]) + at + 1
        if side[at]:
            near = near[side[near] != side[at]]
        near = near[root[near] != root[at]]
        differ = bits[near] ^ bits[at]
        near = near[np.bitwise_count(differ) <= MAX_BITS]
        equal = np.packbits(columns[near] == columns[at], axis=1, bitorder="little").ravel()
        near = near[_FIRST[equal] == key]
        if len(near):
            joined, first = np.unique(root[near], return_index=True)
            edges += [(int(nodes[at]), int(nodes[x])) for x in near[first]]
            root[np.isin(root, joined)] = root[at]
    return edges


_EDGE = pa.struct([("u", pa.int64()), ("v", pa.int64())])


def _links(keys: pa.Array, postings: pa.Array) -> pa.Array:
    offsets = postings.offsets.to_numpy()
    members = postings.values
    nodes, side = members.field("fp").to_numpy(zero_copy_only=False), members.field("side").to_numpy(zero_copy_only=False)
    return pa.array([[{"u": u, "v": v} for u, v in _forest(nodes[a:b], side[a:b], k)] for a, b, k in zip(offsets[:-1], offsets[1:], keys.to_pylist(), strict=True)], pa.list_(_EDGE))


def links(fingerprints: DataFrame) -> DataFrame:
    """(u, v): links between different fingerprints of column ``fp``, enough to span them all."""
    index = fingerprints.select("fp").distinct().select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)) for m in _MASKS])).alias("key", "value"))
    lists = index.groupBy("key", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / LIST).cast("int")
    dealt = index.join(lists, ["key", "value"]).withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).cast("int")
    postings = dealt.groupBy("key", "value", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b")).agg(F.collect_list(F.struct("fp", side.alias("side"))).alias("posting"))
    return postings.where(F.size("posting") > 1).select(F.explode(arrow_udf(_links, "array<struct<u:bigint,v:bigint>>")("key", "posting")).alias("e")).select("e.u", "e.v")


def classes(fingerprints: DataFrame) -> DataFrame:
    """(fp, root) for every distinct fingerprint: the smallest one it can reach by links."""
    nodes = fingerprints.select("fp").distinct()
    found = components(links(fingerprints))
    return nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp, fingerprint, component_id) of every row."""
    rows = materialise(docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col), shingle).alias("fp")), "fingerprints")
    nodes = rows.groupBy("fp").agg(F.min("id").alias("first_id"))
    rooted = materialise(classes(nodes).join(nodes, "fp"), "classes")
    # written first, and only for classes of several fingerprints: the join below then meets two plain
    # exchanges, whose large partitions Spark can split
    least = rooted.groupBy("root").agg(F.min("first_id").alias("least_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    least = materialise(least, "least")
    named = rooted.join(least, "root", "left").select("fp", F.coalesce("least_id", "first_id").alias("component_id"))
    return rows.join(named, "fp").select(F.col("id").alias(id_col), "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row of each group stays, whole: that with the smallest id (null last), then text hash.

    The groups are found on (id, text hash, fingerprint) alone; texts are read again only to leave
    out the rows that go, by an anti-join that Spark broadcasts where what goes is small. Rows that
    repeat one id and one text leave a single row, the first by a hash of all its columns.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    key = {"__id": F.col(f"`{id_col}`"), "__hash": F.xxhash64(F.col(f"`{text_col}`").cast("string"))}
    rows = materialise(docs.select(*[c.alias(n) for n, c in key.items()], fingerprint(F.col(f"`{text_col}`"), shingle).alias("fp")), "fingerprints")
    order = F.struct(F.col("__id").isNull().alias("null_id"), "__id", "__hash")
    # equal hashes have equal fingerprints; grouped and joined by different keys, on two plain exchanges,
    # the rows of a large group of copies can be split
    counted = rows.groupBy("__id", "__hash").agg(F.min("fp").alias("fp"), F.count(F.lit(1)).alias("n"))
    keyed = materialise(counted.join(materialise(classes(rows), "classes"), "fp").select("root", "n", order.alias("k")), "keyed")
    least = keyed.groupBy("root").agg(F.min("k").alias("least"), F.count(F.lit(1)).alias("members")).where("members > 1").drop("members")
    least = materialise(least, "least")
    stays = F.col("least").isNull() | (F.col("k") == F.col("least"))
    judged = materialise(keyed.join(least, "root", "left").select("n", "k.__id", "k.__hash", stays.alias("stays")), "judged")
    marked = docs.withColumns({f"__doc{n}": c for n, c in key.items()})

    def rows_of(t: DataFrame):
        return marked["__doc__id"].eqNullSafe(t["__id"]) & (marked["__doc__hash"] == t["__hash"])

    gone, repeated = judged.where("not stays"), judged.where("stays and n > 1")
    kept = marked.join(gone, rows_of(gone), "left_anti")
    if repeated.isEmpty():
        return kept.select(*columns)
    many = kept.join(repeated, kept["__doc__id"].eqNullSafe(repeated["__id"]) & (kept["__doc__hash"] == repeated["__hash"]), "left_semi")
    alone = kept.join(repeated, kept["__doc__id"].eqNullSafe(repeated["__id"]) & (kept["__doc__hash"] == repeated["__hash"]), "left_anti")
    row = F.struct(*columns)
    once = many.groupBy("__doc__id", "__doc__hash").agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias("row"))
    return alone.select(*columns).unionByName(once.select("row.*"))

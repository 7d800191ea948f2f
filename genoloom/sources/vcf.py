"""VCF files: headers on the driver, records as a DataFrame with an explicit schema."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from genoloom.functions import contigs as C
from genoloom.functions import variant as V

from . import files

_LINE = re.compile(r"^##(\w+)=<(.*)>$")
_FIELD = re.compile(r'(\w+)=("(?:[^"\\]|\\.)*"|[^,]*)')
COLUMNS = ["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO"]


@dataclass
class Header:
    """The ``##`` lines in their order, and the samples."""

    lines: list[str] = field(default_factory=list)
    samples: list[str] = field(default_factory=list)

    @staticmethod
    def parse(line: str) -> tuple[str, dict[str, str]] | None:
        """(kind, fields) of a definition line; quotes are taken off."""
        if not (m := _LINE.match(line)):
            return None
        return m[1], {k: v[1:-1] if v.startswith('"') else v for k, v in _FIELD.findall(m[2])}

    def definitions(self, kind: str) -> dict[str, dict[str, str]]:
        found = (self.parse(x) for x in self.lines)
        return {d["ID"]: d for k, d in filter(None, found) if k == kind and "ID" in d}

    @property
    def contigs(self) -> list[str]:
        return list(self.definitions("contig"))

    def define(self, kind: str, id_: str, number: str = "1", type_: str = "String", description: str = "") -> Header:
        """With a definition, after those of its kind; one that is there stays."""
        if id_ in self.definitions(kind):
            return self
        what = f'ID={id_},Description="{description}"' if kind == "FILTER" else f'ID={id_},Number={number},Type={type_},Description="{description}"'
        at = max((i for i, x in enumerate(self.lines) if x.startswith(f"##{kind}=")), default=max((i for i, x in enumerate(self.lines) if x.startswith(("##INFO=", "##FORMAT=", "##FILTER=", "##fileformat"))), default=-1))
        return replace(self, lines=[*self.lines[: at + 1], f"##{kind}=<{what}>", *self.lines[at + 1 :]])

    def drop(self, kind: str, ids) -> Header:
        gone = set(ids)
        return replace(self, lines=[x for x in self.lines if not ((d := self.parse(x)) and d[0] == kind and d[1].get("ID") in gone)])

    def stamp(self, command: str, arguments: str = "", version: str = "dev", now: datetime | None = None) -> Header:
        """With the date and what was run."""
        date = (now or datetime.now(UTC)).strftime("%Y%m%d")
        lines = [x for x in self.lines if not x.startswith("##fileDate=")]
        return replace(self, lines=[*lines, f"##fileDate={date}", f"##genoloom_{command}Command={arguments}", f"##genoloom_{command}Version={version}"])

    def text(self) -> list[str]:
        return [*self.lines, "\t".join([*COLUMNS, *(["FORMAT", *self.samples] if self.samples else [])])]

    def sample_index(self, name: str) -> int:
        """Place of a sample by name or 1-based number."""
        if name in self.samples:
            return self.samples.index(name)
        if name.isdigit() and 1 <= int(name) <= len(self.samples):
            return int(name) - 1
        raise ValueError(f"no such sample: {name} (there are {', '.join(self.samples) or 'none'})")

    def union(self, other: Header, add_contigs: bool = True, same_samples: bool = True) -> Header:
        """With the definitions that only the other has; the first of an ID wins."""
        extra = [s for s in other.samples if s not in self.samples]
        if same_samples and extra:
            raise ValueError(f"extra sample: {', '.join(extra[:6])}")
        out = self
        for line in other.lines:
            d = self.parse(line)
            if d and "ID" in d[1]:
                if d[1]["ID"] in out.definitions(d[0]) or (d[0] == "contig" and not add_contigs):
                    continue
                at = max((i for i, x in enumerate(out.lines) if x.startswith(f"##{d[0]}=")), default=len(out.lines) - 1)
                out = replace(out, lines=[*out.lines[: at + 1], line, *out.lines[at + 1 :]])
            elif line not in out.lines and not line.startswith("##file"):
                out = replace(out, lines=[*out.lines, line])
        return out

    def looks_like_gvcf(self) -> bool:
        return any(x.startswith("##GVCFBlock") for x in self.lines) or "NON_REF" in self.definitions("ALT")


@dataclass
class Vcf:
    """A header and its records; a step takes one and returns another."""

    header: Header
    records: DataFrame


def read_header(spark: SparkSession, path: str) -> Header:
    header = Header()
    for line in files.head(spark, path):
        if line.startswith("##"):
            header.lines.append(line)
        elif line.startswith("#CHROM"):
            header.samples = line.split("\t")[9:]
            return header
        else:
            break
    raise ValueError(f"{path} has no #CHROM line")


def _info(raw: Column) -> Column:
    entries = F.filter(F.split(raw, ";"), lambda x: ~x.isin("", "."))
    return F.transform(entries, lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.when(F.instr(x, "=") > 0, F.substring(x, F.instr(x, "=") + 1, F.length(x))).alias("v")))


def parse(lines: DataFrame, contigs: list[str] | None = None, more: list[str] = ()) -> DataFrame:
    """Records of (rec_idx, value) lines, and ``more`` of their columns."""
    parts = F.split("value", "\t", 10)  # the samples stay one text
    at = lambda i: F.get(F.col("__p"), F.lit(i))
    rows = lines.where(~F.startswith("value", F.lit("#")) & (F.col("value") != "")).select("rec_idx", "value", parts.alias("__p"), *more)
    known = F.array(*[F.lit(c) for c in contigs]) if contigs else None
    alts = F.when(at(4) == ".", F.expr("cast(array() as array<string>)")).otherwise(F.split(at(4), ","))
    return rows.select(
        "rec_idx",
        (F.nullif(F.array_position(known, at(0)), F.lit(0)) - 1 if known is not None else F.lit(None)).cast("int").alias("contig_idx"),
        at(0).alias("chrom"),
        at(1).try_cast("int").alias("pos"),
        at(2).alias("id"),
        at(3).alias("ref"),
        alts.alias("alts"),
        at(5).try_cast("double").alias("qual"),
        at(5).alias("qual_raw"),
        F.when(at(6).isin(".", ""), F.expr("cast(array() as array<string>)")).otherwise(F.split(at(6), ";")).alias("filters"),
        _info(at(7)).alias("info"),
        F.coalesce(F.split(at(8), ":"), F.expr("cast(array() as array<string>)")).alias("format_keys"),
        F.transform(F.coalesce(F.split(at(9), "\t"), F.expr("cast(array() as array<string>)")), lambda s: F.split(s, ":")).alias("samples"),
        F.col("value").alias("raw"),
        *more,
    )


def read(spark: SparkSession, path: str, region: str | None = None) -> Vcf:
    """A file, or what overlaps ``chrom`` or ``chrom:start-end`` (1-based, with both ends)."""
    header = read_header(spark, path)
    vcf = Vcf(header, parse(files.lines(spark, path), header.contigs))
    return in_region(vcf, region) if region else vcf


def read_chunks(spark: SparkSession, first: str) -> list[str]:
    """BASE.1.vcf.gz, BASE.2.vcf.gz and so on, as far as they go."""
    m = re.match(r"^(.*)\.1(\.vcf(?:\.gz)?)$", first)
    if not m:
        raise ValueError(f"{first} is not the first of a series")
    out, n = [], 1
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while True:
        path = f"{m[1]}.{n}{m[2]}"
        where = jvm.org.apache.hadoop.fs.Path(path)
        if not where.getFileSystem(conf).exists(where):
            return out
        out.append(path)
        n += 1


def read_series(spark: SparkSession, paths: list[str]) -> Vcf:
    """The files of a series (``read_chunks``) in one pass, under the header of the first; ``part`` counts them from 0."""
    header = read_header(spark, paths[0])
    text = spark.read.text(paths).select(F.monotonically_increasing_id().alias("rec_idx"), "value", F.col("_metadata.file_name").alias("name"))
    part = (F.regexp_extract("name", r"\.(\d+)\.vcf(?:\.gz)?$", 1).cast("int") - 1).alias("part")
    return Vcf(header, parse(text.select("rec_idx", "value", part), header.contigs, ["part"]))


def number(key: str) -> Column:
    """An INFO value as a whole number."""
    v = F.try_element_at(F.filter("info", lambda e: e["k"] == key), F.lit(1))["v"]
    return F.try_element_at(F.split(v, ","), F.lit(1)).try_cast("int")


def reference_end() -> Column:
    """The last reference base of a record."""
    return V.ref_end(F.col("pos"), F.col("ref"), number("END"), number("SVLEN"))


def parse_region(region: str) -> tuple[str, int | None, int | None]:
    m = re.match(r"^([^:]+)(?::(\d+)(?:-(\d+))?)?$", region)
    if not m:
        raise ValueError(f"{region} is no region")
    start = int(m[2]) if m[2] else None
    return m[1], start, int(m[3]) if m[3] else start


def in_region(vcf: Vcf, region: str) -> Vcf:
    chrom, start, end = parse_region(region)
    test = C.canonical(F.col("chrom")) == C.canonical(F.lit(chrom))
    if start is not None:
        test = test & (F.col("pos") <= end) & (reference_end() >= start)
    return Vcf(vcf.header, vcf.records.where(test))


def line() -> Column:
    """A record as text: as it was read, or built anew where a step has cleared ``raw``."""
    qual = F.when(F.col("qual_raw") == ".", ".").otherwise(F.regexp_replace("qual_raw", r"\.0+$", ""))
    info = F.array_join(F.transform("info", lambda e: F.concat_ws("=", e["k"], e["v"])), ";")
    # the FORMAT of a rebuilt record goes by its keys; what a sample lacks at its end is trimmed
    samples = F.transform("samples", lambda s: F.array_join(s, ":"))
    start = F.concat_ws(
        "\t", "chrom", F.col("pos").cast("string"), "id", "ref", F.when(F.size("alts") > 0, F.array_join("alts", ",")).otherwise("."), qual,
        F.when(F.size("filters") > 0, F.array_join("filters", ";")).otherwise("."), F.when(info == "", ".").otherwise(info),
    )
    built = F.when(F.size("samples") > 0, F.concat_ws("\t", start, F.array_join("format_keys", ":"), F.array_join(samples, "\t"))).otherwise(start)
    return F.coalesce("raw", built)


def changed(records: DataFrame, **columns: Column) -> DataFrame:
    """Records with other columns, to be written anew where any of them differs."""
    out = records.withColumns({f"__new_{k}": v for k, v in columns.items()})
    same = F.lit(True)
    for k in columns:
        same = same & F.col(k).eqNullSafe(F.col(f"__new_{k}"))
    out = out.withColumn("raw", F.when(same, F.col("raw")))
    return out.withColumns({k: F.col(f"__new_{k}") for k in columns}).drop(*[f"__new_{k}" for k in columns])


def text(vcf: Vcf, ordered: bool = True) -> Iterator[str]:
    """The lines of a file."""
    yield from vcf.header.text()
    rows = vcf.records.orderBy("rec_idx") if ordered else vcf.records
    for r in rows.select(line().alias("line")).toLocalIterator():
        yield r["line"]


def write(vcf: Vcf, path: str, tbi: bool = False, ordered: bool = True) -> None:
    """Write one local file; ``tbi`` indexes it, which takes the lines through the driver."""
    if tbi:
        write_text(text(vcf, ordered), path, tbi)
        return
    rows = vcf.records.orderBy("rec_idx") if ordered else vcf.records
    files.write_table(rows.select(line().alias("line")), path, vcf.header.text())


def write_series(vcf: Vcf, base: str) -> None:
    """Write records with ``chunk`` to BASE.1.vcf.gz, BASE.2.vcf.gz and so on, all in one pass where tasks share the folder."""
    spark, name = vcf.records.sparkSession, lambda n: f"{base}.{n}.vcf.gz"
    files.refuse_remote(base)
    if files.shared(spark, base):
        files.write_each(vcf.records.select(F.col("chunk").cast("long").alias("nth"), F.col("rec_idx").alias("place"), line().alias("line")), name, vcf.header.text())
        return
    for r in vcf.records.select("chunk").distinct().collect():
        write(Vcf(vcf.header, vcf.records.where(F.col("chunk") == r["chunk"])), name(r["chunk"]))


def write_text(lines: Iterator[str], path: str, tbi: bool = False) -> None:
    """Lines of a VCF to one local file; ``tbi`` indexes it."""

    def place(x: str):
        if x.startswith("#"):
            return None
        p = x.split("\t", 8)
        end = re.search(r"(?:^|;)END=(\d+)", p[7])
        start = int(p[1]) - 1
        return p[0], start, max(start + len(p[3]), int(end[1]) if end else 0)

    files.write_lines(path, lines, files.Tabix((1, 2, 0), False, preset=2) if tbi else None, place)


def check(vcf: Vcf) -> int:
    """The number of records; raises at the first that cannot be read."""
    n = len(vcf.header.samples)
    bad = vcf.records.where(F.col("pos").isNull() | F.col("ref").isNull() | (F.col("qual").isNull() & (F.col("qual_raw") != ".")) | (F.size("samples") != n)).orderBy("rec_idx").select("raw").limit(1).collect()
    if bad:
        raise ValueError(f"record cannot be read: {bad[0]['raw'][:200]}")
    return vcf.records.count()

"""Annotators of variant records: each is a step that takes a Vcf and returns another, in order."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genoloom.functions import contigs as C
from genoloom.functions import genotype as G
from genoloom.functions import sequence as S
from genoloom.functions import variant as V
from genoloom.sources.vcf import Vcf, changed, reference_end

from . import genotypes
from .filters import has_info, info, passes, sample_value
from .range_join import overlap_join

Step = Callable[[Vcf], Vcf]


def chain(vcf: Vcf, steps: list[Step]) -> Vcf:
    """All steps in their order; later ones see what earlier ones wrote."""
    return reduce(lambda v, step: step(v), steps, vcf)


def add_info(vcf: Vcf, entries: dict[str, Column], kinds: dict[str, tuple[str, str, str]], flags: tuple[str, ...] = ()) -> Vcf:
    """Records with INFO entries, where their values are not null (for flags: true), and definitions."""
    header = vcf.header
    for k in entries:
        number, type_, text = kinds.get(k, (".", "String", k))
        header = header.define("INFO", k, number, type_, text)
    new = [F.when(F.coalesce(v, F.lit(False)), F.struct(F.lit(k).alias("k"), F.lit(None).cast("string").alias("v"))) if k in flags else F.when(v.isNotNull(), F.struct(F.lit(k).alias("k"), v.cast("string").alias("v"))) for k, v in entries.items()]
    return Vcf(header, changed(vcf.records, info=F.concat("info", F.array_compact(F.array(*new)))))


def add_format(vcf: Vcf, key: str, values: Callable[[Column, Column], Column], kind: tuple[str, str, str], sample: int | None = None) -> Vcf:
    """Records with one more FORMAT value of each sample (or of one), from (values, number)."""
    header = vcf.header.define("FORMAT", key, *kind)
    n = F.size("format_keys")
    # a value goes to its place: shorter lists of values are filled up to it
    put = lambda s, v: F.when(v.isNotNull(), F.concat(s, F.array_repeat(F.lit("."), F.greatest(n - F.size(s), F.lit(0))), F.array(v))).otherwise(s)
    new = F.transform("samples", lambda s, i: put(s, values(s, i)) if sample is None else F.when(i == sample, put(s, values(s, i))).otherwise(s))
    longer = F.exists(new, lambda s: F.size(s) > n)
    return Vcf(header, changed(vcf.records, samples=F.when(longer, new).otherwise(F.col("samples")), format_keys=F.when(longer, F.concat("format_keys", F.array(F.lit(key)))).otherwise(F.col("format_keys"))))


def _first_alt() -> Column:
    return F.try_element_at("alts", F.lit(1))


def auto_id(vcf: Vcf) -> Vcf:
    """IDs made of contig, position and alleles."""
    return Vcf(vcf.header, changed(vcf.records, id=F.concat_ws("-", C.to_ensembl(F.col("chrom")), F.col("pos").cast("string"), "ref", F.array_join("alts", ","))))


def tag(key: str, value: str | None = None) -> Step:
    """A constant, or a flag."""
    return lambda vcf: add_info(vcf, {key: F.lit(value) if value is not None else F.lit(True)}, {key: ("0" if value is None else "1", "Flag" if value is None else "String", "Added tag")}, (key,) if value is None else ())


def indel(vcf: Vcf) -> Vcf:
    """Insertions and deletions with their lengths; the length of an indel is negative for deletions."""
    alt = _first_alt()
    by = F.when(~alt.startswith("<") & ~V.is_breakend(alt), F.length(alt) - F.length("ref"))
    entries = {"CG_INSERT": by > 0, "CG_INSLEN": F.when(by > 0, by), "CG_DELETE": by < 0, "CG_DELLEN": F.when(by < 0, -by), "CG_INDELLEN": F.when(by != 0, by)}
    kinds = {"CG_INSERT": ("0", "Flag", "Insertion"), "CG_INSLEN": ("1", "Integer", "Inserted bases"), "CG_DELETE": ("0", "Flag", "Deletion"), "CG_DELLEN": ("1", "Integer", "Deleted bases"), "CG_INDELLEN": ("1", "Integer", "Length of the indel")}
    return add_info(vcf, entries, kinds, ("CG_INSERT", "CG_DELETE"))


def tstv(vcf: Vcf) -> Vcf:
    """TS or TV of single-base changes."""
    cls = V.tstv(F.col("ref"), _first_alt())
    return add_info(vcf, {"CG_TSTV": F.when(cls == -1, "TS").when(cls == 1, "TV")}, {"CG_TSTV": ("1", "String", "Transition or transversion")})


def dosage(vcf: Vcf) -> Vcf:
    """Alternate alleles of each sample."""
    return add_format(vcf, "CG_DS", lambda s, i: F.coalesce(G.dosage(sample_value(s, "GT")).cast("string"), F.lit(".")), ("1", "Integer", "Alternate allele dosage"))


def _sac(s: Column) -> Column:
    return F.transform(F.split(sample_value(s, "SAC"), ","), lambda x: x.try_cast("double"))


def vaf(vcf: Vcf) -> Vcf:
    """The share of alternate reads, from the strand counts SAC."""

    def of(s: Column, i: Column) -> Column:
        a = _sac(s)
        total = F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
        return F.try_divide(total - F.get(a, F.lit(0)) - F.get(a, F.lit(1)), total).cast("string")

    return add_format(vcf, "CG_VAF", of, ("1", "Float", "Share of alternate reads"))


def minor_strand(vcf: Vcf) -> Vcf:
    """The share of alternate reads on the strand with fewer of them."""

    def of(s: Column, i: Column) -> Column:
        a = _sac(s)
        f, r = F.get(a, F.lit(2)), F.get(a, F.lit(3))
        return F.try_divide(F.least(f, r), f + r).cast("string")

    return add_format(vcf, "CG_SBPCT", of, ("1", "Float", "Share of the minor strand"))


def fisher(a: int, b: int, c: int, d: int) -> float:
    """The two-sided exact test of a 2 x 2 table, as a Phred score."""
    g = math.lgamma
    row, col, n = a + b, a + c, a + b + c + d
    log_p = lambda x: g(row + 1) - g(x + 1) - g(row - x + 1) + g(n - row + 1) - g(col - x + 1) - g(n - row - col + x + 1) + g(col + 1) + g(n - col + 1) - g(n + 1)
    own = log_p(a)
    total = sum(math.exp(p) for x in range(max(0, row + col - n), min(row, col) + 1) if (p := log_p(x)) <= own + 1e-7)
    return 0.0 - 10 * math.log10(min(1.0, total))


def fisher_strand(vcf: Vcf) -> Vcf:
    """Strand bias of each sample by Fisher's exact test of SAC."""

    def scored(counts: pa.Array) -> pa.Array:
        out = []
        for row in counts.to_pylist():
            out.append([None if x is None or len(x) < 4 or None in x[:4] else f"{fisher(*map(int, x[:4])):.3f}" for x in row or []])
        return pa.array(out, pa.list_(pa.string()))

    from pyspark.sql.functions import arrow_udf

    sac = F.transform("samples", lambda s: F.transform(F.split(sample_value(s, "SAC"), ","), lambda x: x.try_cast("int")))
    scoredf = vcf.records.withColumn("__fsb", arrow_udf(scored, "array<string>")(sac))
    out = add_format(Vcf(vcf.header, scoredf), "CG_FSB", lambda s, i: F.get(F.col("__fsb"), i), ("1", "Float", "Phred-scaled strand bias"))
    return Vcf(out.header, out.records.drop("__fsb"))


def copy_logratio(somatic: str, germline: str, somatic_total: float = 1.0, germline_total: float = 1.0) -> Step:
    """log2 of the somatic over the germline depth of AD, each over its library's size."""

    def step(vcf: Vcf) -> Vcf:
        depth = lambda n: F.aggregate(F.transform(F.split(sample_value(F.get("samples", F.lit(vcf.header.sample_index(n))), "AD"), ","), lambda x: x.try_cast("double")), F.lit(0.0), lambda x, y: x + y)
        ratio = F.try_divide(depth(somatic) / somatic_total, depth(germline) / germline_total)
        return add_info(vcf, {"CG_CNLR": F.when(ratio > 0, F.round(F.log2(ratio), 6))}, {"CG_CNLR": ("1", "Float", "Copy number log ratio")})

    return step


COORDINATES = ("__chrom", "__pos", "__end")


def at_coordinates(vcf: Vcf, chrom: str | None = None, pos: str | None = None, end: str | None = None) -> Vcf:
    """Records that annotators of spans look up by INFO values instead of their own place, where these are there."""
    value = lambda key, kind: F.try_element_at(F.split(info(key), ","), F.lit(1)).try_cast(kind)
    start = F.coalesce(value(pos, "int"), F.col("pos")) if pos else F.col("pos")
    # a position of its own ends there unless an end is given
    last = F.when(start == F.col("pos"), reference_end()).otherwise(start)
    new = (F.coalesce(info(chrom), F.col("chrom")) if chrom else F.col("chrom"), start, F.coalesce(value(end, "int"), last) if end else last)
    return Vcf(vcf.header, vcf.records.withColumns(dict(zip(COORDINATES, new, strict=True))))


def own_coordinates(vcf: Vcf) -> Vcf:
    return Vcf(vcf.header, vcf.records.drop(*COORDINATES))


def _named(chrom: Column, convert: bool) -> Column:
    return C.canonical(chrom) if convert else chrom


def _spans(vcf: Vcf, extend: int = 0, convert: bool = True) -> DataFrame:
    chrom, pos, end = (F.col(c) for c in COORDINATES) if "__pos" in vcf.records.columns else (F.col("chrom"), F.col("pos"), reference_end())
    return vcf.records.select("rec_idx", _named(chrom, convert).alias("vc"), (pos - 1 - extend).alias("vs"), (end + extend).alias("ve"), "ref", "alts")


def _joined(vcf: Vcf, found: DataFrame, then: Callable[[Vcf], Vcf]) -> Vcf:
    """Records joined with found (idx, …), given to ``then``, and freed of what was joined."""
    out = then(Vcf(vcf.header, vcf.records.join(found, vcf.records["rec_idx"] == found["idx"], "left")))
    return Vcf(out.header, out.records.drop(*found.columns))


def bed(key: str, regions: DataFrame, flag: bool = False, numeric: bool = False, sample: str | None = None, convert: bool = True) -> Step:
    """Names of the regions (chrom, start, end, name) that overlap; a flag; or a value of one sample.

    ``convert`` matches contigs across naming schemes.
    """

    def step(vcf: Vcf) -> Vcf:
        r = regions.select(_named(F.col("chrom"), convert).alias("rc"), "start", "end", F.col("name").alias("rname"))
        pairs = overlap_join(_spans(vcf, 0, convert), r, ("vc", "vs", "ve"), ("rc", "start", "end"))
        found = pairs.groupBy(F.col("rec_idx").alias("idx")).agg(F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("start", "end", "rname"))), lambda x: x["rname"])), ",").alias("hit"))
        if sample is not None:
            at = vcf.header.sample_index(sample)
            return _joined(vcf, found, lambda v: add_format(v, key, lambda s, i: F.col("hit"), (".", "String", key), at))
        kind = ("0", "Flag", key) if flag else (".", "Float" if numeric else "String", key)
        return _joined(vcf, found, lambda v: add_info(v, {key: F.col("hit").isNotNull() if flag else F.col("hit")}, {key: kind}, (key,) if flag else ()))

    return step


def table(key: str, rows: DataFrame, value: str, alt: str | None = None, ref: str | None = None, mode: str = "collapse", extend: int = 0, numeric: bool = False, sample: str | None = None, convert: bool = True) -> Step:
    """A column of annotation rows (chrom, start, end, …) that overlap, and agree in alleles where asked.

    ``mode`` is collapse (all different values), first or max.
    """

    def step(vcf: Vcf) -> Vcf:
        t = rows.select(_named(F.col("chrom"), convert).alias("tc"), F.col("start").alias("ts"), F.col("end").alias("te"), F.col(value).cast("string").alias("tv"), (F.col(alt) if alt else F.lit(None)).alias("ta"), (F.col(ref) if ref else F.lit(None)).alias("tr"))
        pairs = overlap_join(_spans(vcf, extend, convert), t, ("vc", "vs", "ve"), ("tc", "ts", "te"))
        if alt:
            pairs = pairs.where(F.array_contains("alts", F.col("ta")))
        if ref:
            pairs = pairs.where(F.col("ref") == F.col("tr"))
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("ts", "te", "tv"))), lambda x: x["tv"])
        best = {"collapse": F.array_join(F.array_distinct(ordered), ","), "first": F.element_at(ordered, 1), "max": F.max_by("tv", F.col("tv").try_cast("double"))}[mode]
        found = pairs.groupBy(F.col("rec_idx").alias("idx")).agg(best.alias("hit"))
        if sample is not None:
            at = vcf.header.sample_index(sample)
            return _joined(vcf, found, lambda v: add_format(v, key, lambda s, i: F.col("hit"), (".", "String", key), at))
        return _joined(vcf, found, lambda v: add_info(v, {key: F.col("hit")}, {key: (".", "Float" if numeric else "String", key)}))

    return step


def from_vcf(key: str, source: Vcf, field: str | None = None, exact: bool = True, passing: bool = False, unique: bool = False, convert: bool = True) -> Step:
    """An INFO value of another file's record of the same alleles; a flag without ``field``; ``@ID`` the ID."""

    def step(vcf: Vcf) -> Vcf:
        s = source.records.where(passes()) if passing else source.records
        alts = F.explode("alts") if exact else F.lit(None).cast("string")
        s = s.select(_named(F.col("chrom"), convert).alias("sc"), F.col("pos").alias("sp"), F.col("ref").alias("sr"), alts.alias("sa"), F.col("id").alias("sid"), (info(field) if field and field != "@ID" else F.lit("1")).alias("sv"), F.col("rec_idx").alias("so"))
        v = vcf.records.select("rec_idx", _named(F.col("chrom"), convert).alias("vc"), F.col("pos").alias("vp"), F.col("ref").alias("vr"), "alts")
        on = (F.col("vc") == F.col("sc")) & (F.col("vp") == F.col("sp"))
        if exact:
            v = v.withColumn("va", F.explode("alts"))
            on = on & (F.col("vr") == F.col("sr")) & (F.col("va") == F.col("sa"))
        what = F.col("sid") if field == "@ID" else F.col("sv")
        listed = F.transform(F.array_sort(F.collect_list(F.struct("so", what.alias("x")))), lambda x: x["x"])
        listed = F.filter(F.array_distinct(listed) if unique or field in (None, "@ID") else listed, lambda x: x.isNotNull())
        found = v.join(s, on).groupBy(F.col("rec_idx").alias("idx")).agg(listed.alias("xs")).select("idx", F.when(F.size("xs") > 0, F.array_join("xs", ",")).alias("hit"))
        if field == "@ID":
            return _joined(vcf, found, lambda x: Vcf(x.header, changed(x.records, id=F.coalesce(F.nullif("hit", F.lit(".")), "id"))))
        flag = field is None
        return _joined(vcf, found, lambda x: add_info(x, {key: F.col("hit").isNotNull() if flag else F.col("hit")}, {key: ("0" if flag else ".", "Flag" if flag else "String", key)}, (key,) if flag else ()))

    return step


def in_file(key: str, of: str, values: DataFrame, column: str | None = None, csv: bool = False) -> Step:
    """A flag where an INFO value is listed (in the first column), or the listed value of ``column``."""

    def step(vcf: Vcf) -> Vcf:
        listed = values.select(F.col(values.columns[0]).cast("string").alias("lv"), (F.col(column).cast("string") if column else F.lit("1")).alias("lx"))
        parts = F.explode(F.split(info(of), ",") if csv else F.array(info(of)))
        v = vcf.records.where(has_info(of)).select("rec_idx", parts.alias("part"))
        found = v.join(listed, v["part"] == listed["lv"]).groupBy(F.col("rec_idx").alias("idx")).agg(F.array_join(F.array_sort(F.collect_set("lx")), ",").alias("hit"))
        flag = column is None
        return _joined(vcf, found, lambda x: add_info(x, {key: F.col("hit").isNotNull() if flag else F.col("hit")}, {key: ("0" if flag else ".", "Flag" if flag else "String", key)}, (key,) if flag else ()))

    return step


def flanking(contigs: DataFrame, size: int = 1) -> Step:
    """The bases around a single-base change, and the change written from its pyrimidine.

    ``contigs`` is (contig, seq); bases are looked up in chunks of a contig.
    """

    def step(vcf: Vcf) -> Vcf:
        from .intervals import to_fasta

        snv = vcf.records.where(V.is_snv(F.col("ref"), F.col("alts")))
        at = snv.select("chrom", (F.col("pos") - 1 - size).alias("start"), (F.col("pos") + size).alias("end"), F.col("rec_idx").cast("string").alias("name"), F.lit("+").alias("strand"))
        around = to_fasta(at.where("start >= 0"), contigs, stranded=False, ordered=False).select(F.substring_index("name", "|", 1).cast("long").alias("idx"), F.col("seq").alias("hit"))
        entries = {"CG_FLANKING": F.col("hit"), "CG_FLANKING_SUB": F.when(F.col("hit").isNotNull(), S.flanking(F.col("hit"), F.col("ref"), _first_alt()))}
        kinds = {"CG_FLANKING": ("1", "String", "Bases around the variant"), "CG_FLANKING_SUB": ("1", "String", "Substitution in its context")}
        return _joined(vcf, around.where(F.length("hit") == 2 * size + 1), lambda x: add_info(x, entries, kinds))

    return step


def genes(features: DataFrame, prefix: str = "", required_tags: tuple[str, ...] = (), convert: bool = True) -> Step:
    """Genes, strands, biotypes and regions of GTF features (chrom, start, end, feature, gene_id, gene_name, biotype, strand, tags)."""

    def step(vcf: Vcf) -> Vcf:
        g = features
        for t in required_tags:
            g = g.where(F.array_contains("tags", t))
        g = g.select(_named(F.col("chrom"), convert).alias("gc"), F.col("start").alias("gs"), F.col("end").alias("ge"), "feature", "gene_id", "gene_name", "biotype", "strand")
        pairs = overlap_join(_spans(vcf, 0, convert), g, ("vc", "vs", "ve"), ("gc", "gs", "ge"))
        joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
        has = lambda f: F.max((F.col("feature") == f).cast("int")) == 1
        region = F.when(has("CDS"), "CODING").when(has("five_prime_utr"), "UTR5").when(has("three_prime_utr"), "UTR3").when(has("exon"), "NONCODING").otherwise("INTRON")
        found = pairs.groupBy(F.col("rec_idx").alias("idx")).agg(joined("gene_name").alias("g1"), joined("gene_id").alias("g2"), joined("strand").alias("g3"), joined("biotype").alias("g4"), region.alias("g5"))
        entries = {f"{prefix}{k}": F.col(c) for k, c in {"GENE": "g1", "GENEID": "g2", "STRAND": "g3", "BIOTYPE": "g4", "REGION": "g5"}.items()}
        return _joined(vcf, found, lambda x: add_info(x, entries, {}))

    return step


def distance(vcf: Vcf) -> Vcf:
    """The distance to the nearest variant of the contig."""
    near = genotypes.nearest_variant(vcf.records.select(F.col("rec_idx").alias("rec_id"), "chrom", "pos")).select(F.col("rec_id").alias("idx"), F.col("vardist").alias("hit"))
    return _joined(vcf, near, lambda x: add_info(x, {"CG_VARDIST": F.col("hit")}, {"CG_VARDIST": ("1", "Integer", "Distance to the nearest variant")}))

"""Whole record sets: order, chunks, concatenation, merging and what their fields hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genoloom.functions import genotype as G


RANGE = 1 << 20


def _range(order: str, span: int) -> Column:
    """The range of an order that counts within parts of a file: as many as the file needs."""
    return F.floor(F.col(order) / span)


def dense_index(records: DataFrame, order: str = "rec_idx", span: int = RANGE) -> DataFrame:
    """Records with ``rec_no``, counted from 0 in their order, range by range."""
    ranged = records.withColumn("__range", _range(order, span))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    starts = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    within = Window.partitionBy("__range").orderBy(order)
    return ranged.withColumn("__row", F.row_number().over(within)).join(starts, "__range").withColumn("rec_no", F.col("__before") + F.col("__row") - 1).drop("__range", "__row", "__before")


def chunks(records: DataFrame, size: int, order: str = "rec_idx") -> DataFrame:
    """Records with ``chunk``, from 1, of ``size`` records each in their order."""
    if size < 1:
        raise ValueError("a chunk holds at least one record")
    return dense_index(records, order).withColumn("chunk", (F.floor(F.col("rec_no") / size) + 1).cast("long"))


def field_census(genotypes: DataFrame, min_dp: int, keys: tuple[str, ...] = ("chrom",)) -> DataFrame:
    """Genotypes, those with a depth, without a call, and below a depth."""
    return genotypes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("genotypes"),
        F.count("dp").alias("with_dp"),
        F.count_if(~G.has_call(F.col("gt"))).alias("no_call"),
        F.count_if(F.col("dp") < min_dp).alias("below"),
    )


def check_sorted(records: DataFrame, span: int = RANGE) -> None:
    """Raise where a position falls within a contig, or a contig is met again after another.

    Neighbours are compared within ranges of the order; the first of a range looks at the last record
    before it, so no task orders a whole file.
    """
    part = F.col("file_no") if "file_no" in records.columns else F.lit(0)
    ranged = records.select(part.alias("part"), "rec_idx", "chrom", "pos", _range("rec_idx", span).alias("range"))
    ends = ranged.groupBy("part", "range").agg(F.max_by(F.struct("chrom", "pos"), "rec_idx").alias("last"))
    ends = ends.select(F.col("part").alias("p"), F.col("range").alias("r"), F.lag("last").over(Window.partitionBy("part").orderBy("range")).alias("before"))
    w = Window.partitionBy("part", "range").orderBy("rec_idx")
    seen = ranged.withColumn("prior", F.lag(F.struct("chrom", "pos")).over(w)).join(ends, (F.col("part") == F.col("p")) & (F.col("range") == F.col("r")))
    seen = seen.select("chrom", "pos", F.coalesce("prior", "before").alias("prior"))
    falls = (F.col("chrom") == F.col("prior.chrom")) & (F.col("pos") < F.col("prior.pos"))
    starts = F.col("prior").isNull() | (F.col("chrom") != F.col("prior.chrom"))
    told = seen.groupBy("chrom").agg(F.min(F.when(falls, F.struct("pos", F.col("prior.pos").alias("after")))).alias("bad"), F.count_if(starts).alias("starts"))
    for r in told.where("bad is not null or starts > 1").orderBy(F.col("bad").isNull()).limit(1).collect():
        if r["bad"]:
            raise ValueError(f"records are not sorted: {r['chrom']}:{r['bad']['pos']} follows {r['bad']['after']}")
        raise ValueError(f"records are not sorted: {r['chrom']} is met again after another contig")


def concat(parts: list[DataFrame], contigs: list[str]) -> DataFrame:
    """Records of all parts in the order of contigs and positions; equal positions in two parts are an error."""
    every = None
    for n, df in enumerate(parts):
        one = df.withColumn("part", F.lit(n))
        every = one if every is None else every.unionByName(one, allowMissingColumns=True)
    return in_order(every, contigs)


def in_order(every: DataFrame, contigs: list[str]) -> DataFrame:
    """Records of all parts (``part``) in the order of contigs and positions; equal positions in two parts are an error."""
    known = F.array(*[F.lit(c) for c in contigs])
    every = every.withColumn("contig_idx", F.array_position(known, F.col("chrom")) - 1)
    unknown = every.where("contig_idx < 0").select("chrom").limit(1).collect()
    if unknown:
        raise ValueError(f"contig {unknown[0]['chrom']} is not in the header")
    twice = every.groupBy("chrom", "pos").agg(F.countDistinct("part").alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"inputs have overlapping positions at {twice[0]['chrom']}:{twice[0]['pos']}")
    return every.orderBy("contig_idx", "pos", "part", "rec_idx")


def merge(primary: DataFrame, others: list[DataFrame]) -> DataFrame:
    """Records of several annotations of the same variants in the same order, as one.

    The first with an ID gives it; FILTER codes are united; INFO and FORMAT keys that the records
    before lack are appended.
    """
    out = dense_index(primary)
    for df in others:
        n = dense_index(df).select("rec_no", *[F.col(c).alias(f"o_{c}") for c in ("chrom", "pos", "ref", "alts", "id", "filters", "info", "format_keys", "samples")])
        both = out.join(n, "rec_no", "full_outer")
        same = F.col("chrom").eqNullSafe(F.col("o_chrom")) & F.col("pos").eqNullSafe(F.col("o_pos")) & F.col("ref").eqNullSafe(F.col("o_ref")) & F.col("alts").eqNullSafe(F.col("o_alts"))
        bad = both.where(~same).select(F.coalesce("chrom", "o_chrom").alias("c"), F.coalesce("pos", "o_pos").alias("p")).limit(1).collect()
        if bad:
            raise ValueError(f"variants are out of order at {bad[0]['c']}:{bad[0]['p']}")
        keys = F.transform("info", lambda e: e["k"])
        new_info = F.filter("o_info", lambda e: ~F.array_contains(keys, e["k"]))
        fresh = F.array_except("o_format_keys", "format_keys")
        named = F.filter("filters", lambda f: ~f.isin("PASS", "."))
        o_named = F.filter("o_filters", lambda f: ~f.isin("PASS", "."))
        codes = F.array_union(named, o_named)
        # a sample's values may be trimmed at their end: they are filled up to its keys
        full = lambda s, keys: F.concat(s, F.array_repeat(F.lit("."), F.size(keys) - F.size(s)))
        n_new = F.size(fresh)
        at = F.transform(fresh, lambda k: F.array_position("o_format_keys", k).cast("int"))
        theirs = F.transform("o_samples", lambda s: full(s, F.col("o_format_keys")))
        both = both.withColumns({"__at": at, "__own": F.transform("samples", lambda s: full(s, F.col("format_keys"))), "__theirs": theirs})
        samples = F.when(n_new > 0, F.zip_with("__own", "__theirs", lambda a, b: F.concat(a, F.transform("__at", lambda i: F.element_at(b, i))))).otherwise(F.col("samples"))
        out = both.withColumns({
            "id": F.when(F.col("id") == ".", F.col("o_id")).otherwise(F.col("id")),
            "filters": F.when(F.size(codes) > 0, codes).otherwise(F.col("filters")),
            "info": F.concat("info", new_info),
            "samples": samples,
            "format_keys": F.concat("format_keys", fresh),
            "raw": F.lit(None).cast("string"),
        }).select(*out.columns)
    return out.orderBy("rec_no").drop("rec_no")

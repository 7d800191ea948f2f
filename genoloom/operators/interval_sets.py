"""Set algebra of intervals by a sweep over their ends, in bins of the contig.

Intervals are cut at bins, so a contig is swept by many tasks; only what touches an edge of a bin
is looked at again to be joined with its neighbour.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .range_join import overlap_join

BIN = 1 << 20
MODES = ("inter", "union", "sub", "exclusive", "xor")


def _keep(mode: str) -> Column:
    a, b = F.col("in_a") > 0, F.col("in_b") > 0
    return {"inter": a & b, "union": a | b, "sub": a & ~b, "exclusive": a != b, "xor": a != b}[mode]


def _islands(segments: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """Segments joined where at most ``gap`` bases lie between them."""
    order = Window.partitionBy(*keys).orderBy("start", "end")
    new = F.when(F.col("start") > F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)) + gap, 1).otherwise(0)
    numbered = segments.withColumn("__new", new).withColumn("__island", F.sum("__new").over(order))
    return numbered.groupBy(*keys, "__island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__island")


def combine(a: DataFrame, b: DataFrame, mode: str, stranded: bool = True, flanking: int = 0, bin_size: int = BIN) -> DataFrame:
    """(chrom[, strand], start, end) of the bases in both, either, only a, or only one of two sets.

    a and b have chrom, start, end and, where ``stranded``, strand. ``flanking`` joins results of a
    union with at most so many bases between them; touching ones are always joined.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    if flanking and mode != "union":
        raise ValueError("flanking goes with union only")
    if flanking >= bin_size:
        bin_size = 2 * flanking
    keys = ["chrom", "strand"] if stranded else ["chrom"]
    size = F.lit(bin_size).cast("long")
    both = a.select(*keys, "start", "end", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select(*keys, "start", "end", F.lit(0).alias("a"), F.lit(1).alias("b"))).where("end > start")
    cut = both.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("end") - 1) / size))))
    cut = cut.withColumns({"start": F.greatest(F.col("start"), F.col("bin") * size), "end": F.least(F.col("end"), (F.col("bin") + 1) * size)})
    ends = cut.select(*keys, "bin", F.explode(F.array(F.struct(F.col("start").alias("pos"), F.col("a").alias("a"), F.col("b").alias("b")), F.struct(F.col("end").alias("pos"), (-F.col("a")).alias("a"), (-F.col("b")).alias("b")))).alias("e"))
    steps = ends.groupBy(*keys, "bin", F.col("e.pos").alias("start")).agg(F.sum("e.a").alias("a"), F.sum("e.b").alias("b"))
    order = Window.partitionBy(*keys, "bin").orderBy("start")
    segments = steps.withColumns({"in_a": F.sum("a").over(order), "in_b": F.sum("b").over(order), "end": F.lead("start").over(order)}).where(F.col("end").isNotNull() & _keep(mode))
    islands = _islands(segments.select(*keys, "bin", "start", "end"), [*keys, "bin"], flanking)
    edge = (F.col("start") - F.col("bin") * size <= flanking) | ((F.col("bin") + 1) * size - F.col("end") <= flanking)
    joined = _islands(islands.where(edge).drop("bin"), keys, flanking)
    return islands.where(~edge).drop("bin").unionByName(joined).select(*keys, "start", "end")


def decorate(result: DataFrame, a: DataFrame, b: DataFrame, stranded: bool = True, delim: str = "|", label_a: str | None = None, label_b: str | None = None, score: str = "zero") -> DataFrame:
    """The result with name and score of the intervals that contribute; ``score`` is zero, sum or count.

    Names stand in the order of the sets, then of position, each once; labels stand for all names
    of a set.
    """
    parts = []
    for n, (df, label) in enumerate(((a, label_a), (b, label_b))):
        name = F.lit(label) if label else F.coalesce("name", F.lit(""))
        parts.append(df.select(F.col("chrom").alias("s_chrom"), F.col("start").alias("s_start"), F.col("end").alias("s_end"), (F.col("strand") if stranded else F.lit("+")).alias("s_strand"), F.lit(n).alias("s_set"), name.alias("s_name"), F.coalesce("score", F.lit(0.0)).cast("double").alias("s_score")))
    source = parts[0].unionByName(parts[1])
    keyed = result
    if not stranded:
        keyed = keyed.withColumn("strand", F.lit("+"))
    pairs = overlap_join(keyed, source, ("chrom", "start", "end"), ("s_chrom", "s_start", "s_end")).where(F.col("strand") == F.col("s_strand"))
    items = F.array_sort(F.collect_list(F.struct("s_set", "s_start", "s_end", "s_name")))
    names = F.filter(F.array_distinct(F.transform(items, lambda x: x["s_name"])), lambda x: x != "")
    value = {"zero": F.lit(0.0), "sum": F.sum("s_score"), "count": F.count(F.lit(1)).cast("double")}[score]
    return pairs.groupBy("chrom", "start", "end", "strand").agg(F.array_join(names, delim).alias("name"), value.alias("score")).select("chrom", "start", "end", "name", "score", "strand")

"""Summaries of variants, intervals, reads and sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genoloom.functions import sequence as S
from genoloom.functions import variant as V

from .filters import has_info, info, passes


def variant_totals(records: DataFrame, passing_only: bool = False) -> DataFrame:
    """One row: total, filtered, passing, and SNVs, indels, reference-only, Ts and Tv of those counted."""
    ref, alts = F.col("ref"), F.col("alts")
    use = passes() if passing_only else F.lit(True)
    first = F.try_element_at(V.real_alts(alts), F.lit(1))
    snv = V.is_snv(ref, alts)
    return records.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(~passes()).alias("filtered"),
        F.count_if(passes()).alias("passing"),
        F.count_if(use & snv).alias("snv"),
        F.count_if(use & V.is_indel(ref, alts)).alias("indel"),
        F.count_if(use & (F.size(V.real_alts(alts)) == 0)).alias("ref_only"),
        F.count_if(use & snv & V.is_transition(ref, first)).alias("ts"),
        F.count_if(use & snv & V.is_transversion(ref, first)).alias("tv"),
    )


def filter_counts(records: DataFrame) -> DataFrame:
    """(code, n) of every filter code."""
    codes = F.explode(F.filter("filters", lambda x: ~x.isin("PASS", ".", "")))
    return records.select(codes.alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def info_tally(records: DataFrame, key: str) -> DataFrame:
    """(value, n) of an INFO key; records without it count as ``*missing*``."""
    value = F.when(has_info(key), F.coalesce(info(key), F.lit(""))).otherwise("*missing*")
    return records.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n"))


def ratio(ts: Column, tv: Column) -> Column:
    """Ts/Tv as text; ``-`` without transversions."""
    return F.when(tv == 0, "-").otherwise((ts / tv).cast("string"))


def discrete_median(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The value at which the running count first exceeds half; the maximum if some count is just half."""
    counts = values.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys)
    summed = counts.withColumns({"upto": F.sum("n").over(w.orderBy(value)), "all": F.sum("n").over(w)})
    half = F.col("all") / 2
    return summed.groupBy(*keys).agg(F.when(F.max((F.col("upto") == half).cast("int")) == 1, F.max(value)).otherwise(F.min(F.when(F.col("upto") > half, F.col(value)))).alias("median"))


def interval_totals(intervals: DataFrame) -> DataFrame:
    """One row: regions, bases, mean, median, max and min of the sizes; negative sizes are ignored."""
    sized = intervals.withColumn("__size", (F.col("end") - F.col("start")).cast("long")).where("__size >= 0")
    totals = sized.agg(F.count(F.lit(1)).alias("regions"), F.sum("__size").alias("bases"), F.avg("__size").alias("mean_size"), F.max("__size").alias("max_size"), F.min("__size").alias("min_size"))
    middle = discrete_median(sized.withColumn("__all", F.lit(1)), ["__all"], "__size").select("median")
    return totals.withColumn("__all", F.lit(1)).join(middle.withColumn("__all", F.lit(1)), "__all", "left").select("regions", "bases", "mean_size", F.col("median").alias("median_size"), "max_size", "min_size")


def reads_profile(reads: DataFrame) -> DataFrame:
    """One row of counts over reads (flag, ref_name, mapq, cigar, qual, nh, ih).

    Flags are tallied over all reads; only first-of-pair reads that are no duplicate, failed or
    supplementary alignment are profiled.
    """
    f = F.col("flag")
    second = S.flag(f, "paired") & ~S.flag(f, "first")
    use = ~second & ~S.flag(f, "duplicate") & ~S.flag(f, "qcfail") & ~S.flag(f, "supplementary")
    mapped = ~S.flag(f, "unmapped")
    one = S.unique(F.col("nh"), F.col("ih"), F.col("mapq"))
    return reads.agg(
        F.count_if(use).alias("reads"),
        F.count_if(use & mapped).alias("mapped"),
        F.count_if(use & ~mapped).alias("unmapped"),
        F.count_if(use & mapped & ~one).alias("multiple"),
        F.count_if(use & mapped & one).alias("unique_reads"),
        F.coalesce(F.sum(F.when(use & mapped, S.read_bases(F.col("cigar")))), F.lit(0)).cast("long").alias("bases"),
        *([F.coalesce(F.sum(F.when(use & mapped, S.high_bases(F.col("cigar"), F.col("qual")))), F.lit(0)).cast("long").alias("q30_bases")] if "qual" in reads.columns else []),
        *[F.count_if(S.flag(f, name)).alias(f"flag_{name}") for name in S.FLAGS],
    )


def reads_by_reference(reads: DataFrame) -> DataFrame:
    """(ref_name, n) of mapped reads that are profiled."""
    return profiled(reads).where(~S.flag(F.col("flag"), "unmapped")).groupBy("ref_name").agg(F.count(F.lit(1)).alias("n"))


def tag_tally(reads: DataFrame, value: Column, numeric: bool = False) -> DataFrame:
    """(value, n) over the reads that are profiled, in order of the values; the missing ones last."""
    counted = profiled(reads).groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    key = F.col("value").try_cast("double") if numeric else F.col("value")
    return counted.orderBy(F.col("value").isNull(), key, "value").select(F.coalesce("value", F.lit("missing")).alias("value"), "n")


def profiled(reads: DataFrame) -> DataFrame:
    """First-of-pair (or unpaired) reads that are no duplicate, failed or supplementary alignment."""
    f = F.col("flag")
    second = S.flag(f, "paired") & ~S.flag(f, "first")
    return reads.where(~second & ~S.flag(f, "duplicate") & ~S.flag(f, "qcfail") & ~S.flag(f, "supplementary"))


def median_insert(reads: DataFrame) -> DataFrame:
    """One row: the median of |insert_len| of proper pairs on one contig, whole; null once any read has gaps."""
    gap = F.max(F.col("cigar").contains("N").cast("int"))
    same = (F.col("ref_next") == "=") | (F.col("ref_next") == F.col("ref_name"))
    proper = S.flag(F.col("flag"), "proper") & same
    return profiled(reads).agg(F.when(F.coalesce(gap, F.lit(0)) == 0, F.floor(F.percentile(F.when(proper, F.abs("insert_len")), 0.5))).alias("median_insert"))

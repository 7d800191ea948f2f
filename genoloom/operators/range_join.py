"""Joins of overlapping intervals, by bins: an equi-join that Spark can hash, sort and split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BIN = 16_384


def bins(start: Column, end: Column, size: int) -> Column:
    """The bins that [start, end) touches; an empty interval touches the bin of its start."""
    return F.sequence(F.floor(start / size), F.floor(F.greatest(start, end - 1) / size))


def overlap_join(left: DataFrame, right: DataFrame, left_on: tuple[str, str, str], right_on: tuple[str, str, str], how: str = "inner", bin_size: int = BIN, extend: int = 0) -> DataFrame:
    """Pairs of rows with equal contigs whose half-open intervals overlap, each pair once.

    A pair is kept in the first bin that both touch. ``how`` is inner, left, left_semi or
    left_anti; column names of both sides must differ. ``extend`` widens the left side.
    """
    lc, ls, le = left_on
    rc, rs, re = right_on
    if how != "inner":
        # what an interval overlaps depends on the interval alone: different ones are joined, and rows
        # meet the answer by their own columns, which no retried task can change
        spans = left.select(F.col(lc).alias("__lc"), F.col(ls).alias("__ls"), F.col(le).alias("__le")).distinct()
        pairs = overlap_join(spans, right, ("__lc", "__ls", "__le"), right_on, "inner", bin_size, extend)
        if how in ("left_semi", "left_anti"):
            return left.join(pairs.select("__lc", "__ls", "__le").distinct(), _same(left_on), how)
        return left.join(pairs, _same(left_on), "left").drop("__lc", "__ls", "__le")
    start, end = F.greatest(F.col(ls) - extend, F.lit(0)), F.col(le) + extend
    a = left.withColumns({"__s": start, "__e": end}).withColumn("__bin", F.explode(bins(F.col("__s"), F.col("__e"), bin_size))).withColumn("__b0", F.floor(F.col("__s") / bin_size))
    b = right.withColumn("__rbin", F.explode(bins(F.col(rs), F.col(re), bin_size))).withColumn("__rb0", F.floor(F.col(rs) / bin_size))
    on = (F.col(lc) == F.col(rc)) & (F.col("__bin") == F.col("__rbin")) & (F.col("__s") < F.col(re)) & (F.col("__e") > F.col(rs)) & (F.greatest("__b0", "__rb0") == F.col("__bin"))
    return a.join(b, on).drop("__s", "__e", "__bin", "__b0", "__rbin", "__rb0")


def _same(left_on: tuple[str, str, str]) -> Column:
    lc, ls, le = left_on
    return (F.col(lc) == F.col("__lc")) & (F.col(ls) == F.col("__ls")) & (F.col(le) == F.col("__le"))


def collapse_overlaps(left: DataFrame, right: DataFrame, left_on: tuple[str, str, str], right_on: tuple[str, str, str], aggregates: dict[str, Column], bin_size: int = BIN, extend: int = 0) -> DataFrame:
    """Each left row once, with aggregates over the columns of the right rows that overlap it."""
    spans = left.select(*[F.col(c).alias(k) for c, k in zip(left_on, ("__lc", "__ls", "__le"), strict=True)]).distinct()
    pairs = overlap_join(spans, right, ("__lc", "__ls", "__le"), right_on, "inner", bin_size, extend)
    sums = pairs.groupBy("__lc", "__ls", "__le").agg(*[v.alias(k) for k, v in aggregates.items()])
    return left.join(sums, _same(left_on), "left").drop("__lc", "__ls", "__le")

"""Callable runs: consecutive catalogued sites at which a sample was observed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genoloom.functions import genotype as G

BANDS = [10, 20, 50]


def is_callable(gt: Column, dp: Column, min_dp: int) -> Column:
    """A call of sufficient depth."""
    return G.has_call(gt) & F.coalesce(dp >= min_dp, F.lit(False))


def number_records(records: DataFrame, shard_sites: int | None = None) -> DataFrame:
    """(chrom, rec_id, pos) with rec_no, the place in the chromosome, and the shard.

    Records are counted by position ranges first, so that no task orders a whole chromosome.
    """
    span = 1 << 20
    ranged = records.select("chrom", "rec_id", "pos").distinct().withColumn("__range", F.floor(F.col("pos") / span))
    sizes = ranged.groupBy("chrom", "__range").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("chrom").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    within = Window.partitionBy("chrom", "__range").orderBy("pos", "rec_id")
    numbered = ranged.withColumn("__row", F.row_number().over(within)).join(starts, ["chrom", "__range"])
    rec_no = (F.col("__before") + F.col("__row")).alias("rec_no")
    shard = F.floor((F.col("__before") + F.col("__row") - 1) / shard_sites) if shard_sites else F.lit(0)
    return numbered.select("chrom", "rec_id", "pos", rec_no, shard.cast("int").alias("shard"))


def callable_runs(genotypes: DataFrame, min_dp: int = 10, bands: list[int] | None = None, shard_sites: int | None = None, records: DataFrame | None = None) -> DataFrame:
    """(sample_id, chrom, start_pos, end_pos, n_sites, min_dp) of (rec_id, chrom, pos, sample_id, gt, dp).

    A run ends at a record that is not callable, at a change of depth band, of chromosome or of
    shard. ``bands`` of None or nothing makes one band. ``records`` (rec_id, chrom, pos) are those that
    count, where not all have a genotype.
    """
    numbers = number_records(genotypes if records is None else records, shard_sites)
    seen = genotypes.where(is_callable(F.col("gt"), F.col("dp"), min_dp)).select("chrom", "rec_id", "sample_id", "dp").join(numbers, ["chrom", "rec_id"])
    seen = seen.withColumn("band", G.depth_band(F.col("dp"), bands) if bands else F.lit(0))
    keys = ["sample_id", "chrom", "shard", "band"]
    island = F.col("rec_no") - F.row_number().over(Window.partitionBy(*keys).orderBy("rec_no"))
    return (
        seen.withColumn("island", island).groupBy(*keys, "island")
        .agg(F.min("pos").alias("start_pos"), F.max("pos").alias("end_pos"), F.count(F.lit(1)).alias("n_sites"), F.min("dp").alias("min_dp"))
        .select("sample_id", "chrom", "start_pos", "end_pos", "n_sites", "min_dp")
    )

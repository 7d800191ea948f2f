"""Variant files as they arrive: the same column expressions over a stream of lines.

The engine's filters and counts are expressions over records, so a folder that files are dropped
into can be read as a stream; totals are kept by Spark's state store and survive a restart from the
checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoloom.operators import filters
from genoloom.sources import vcf


def read(spark: SparkSession, folder: str, contigs: list[str] | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """Records of all VCF files that come into a folder; they have no order among each other."""
    reader = spark.readStream
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return vcf.parse(reader.text(folder).select(F.lit(0).cast("long").alias("rec_idx"), "value"), contigs)


def passing(records: DataFrame, chain: list[filters.Filter]) -> DataFrame:
    """Records that pass a chain of filters, as they arrive."""
    return filters.apply(records, chain, "passing")


def counts_by_contig(records: DataFrame) -> DataFrame:
    """Running totals of each contig: records, passing ones, and the span seen so far."""
    return records.groupBy("chrom").agg(F.count(F.lit(1)).alias("records"), F.count_if(filters.passes()).alias("passing"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


def start(df: DataFrame, checkpoint: str, sink, mode: str = "append"):
    """Give every batch to ``sink(batch, number)``; a batch is repeated whole after a failure."""
    return df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink).start()

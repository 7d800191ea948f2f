"""Tables written to the folder all executors share, in place of checkpoints in memory.

A written table is columnar and compressed, cuts the lineage and survives the loss of any
executor. The folder is ``spark.checkpoint.dir``. Only in a single process, as in tests, a folder is
made where that is unset; on a cluster a machine's own folder would lose rows, so there it is an error.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, SparkSession] = {}
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='genoloom-')}"
        spark.conf.set("spark.checkpoint.dir", base)
        _written[base] = spark
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; removed when the driver ends."""
    path = f"{shared_dir(spark)}/genoloom-{name}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def materialise(df: DataFrame, name: str, partition_by: str | None = None, drop: DataFrame | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back; then delete the table ``drop``.

    Only a table that nothing but ``df`` still reads may be dropped, as the one before in a loop.
    """
    path = new_path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    if drop is not None and drop in _paths:
        remove(df.sparkSession, _paths.pop(drop))
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)
    _written.pop(path, None)


@atexit.register
def _clean() -> None:
    for path, spark in reversed(list(_written.items())):
        try:
            if spark.sparkContext._jsc is not None:
                remove(spark, path)
        except Exception:  # the JVM may be gone by now
            break

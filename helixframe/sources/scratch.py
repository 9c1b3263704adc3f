"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Rows that a partition of a shuffle gets on the average, at most.
ROWS = 1 << 17
#: Bytes up to which partitions are joined after a shuffle, and of a file that one task reads; the defaults fit tasks with more memory.
READ = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m", "spark.sql.files.maxPartitionBytes": "32m"}
#: The sessions' folders, by application.
_FOLDERS: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """This session's own folder under ``spark.checkpoint.dir``; deleted when the driver's process ends.

    A folder under the warehouse where the session has none and runs in one process; a
    cluster without the setting is refused.
    """
    context = spark.sparkContext
    if context.applicationId not in _FOLDERS:
        top = context.getConf().get("spark.checkpoint.dir", None)
        if not top:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            top = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        _FOLDERS[context.applicationId] = f"{top.rstrip('/')}/tables-{context.applicationId}"
        atexit.register(_discard, spark, _FOLDERS[context.applicationId])
    return _FOLDERS[context.applicationId]


def _discard(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone already
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def spread(spark: SparkSession, rows: int) -> None:
    """Deal the shuffles of tables of so many rows into partitions of ``ROWS``, so that no task has more to sort as tables grow.

    Adaptive execution joins those that turn out small. Sizes that the session was given are kept.
    """
    given = spark.conf.getAll
    for name, size in READ.items():
        if name not in given:
            spark.conf.set(name, size)
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    if -(-rows // ROWS) > max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(given.get(name, 0))):
        spark.conf.set(name, -(-rows // ROWS))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read again: lineage ends, lost executors do no harm."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)  # a third smaller than the default
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where tables go if the cluster names no shared folder (single machines, tests).
FALLBACK_CHECKPOINTS = "/tmp/checkpoints"
#: Rows of a few numbers each that may be broadcast.
BROADCAST_ROWS = 200_000
#: A key that holds more than this share of a table's rows is joined by broadcast: 10,000 keys at most.
HOT_SHARE = 1 / 10_000
#: Spark deletes a plan's shuffle files when it ends, not when the driver next collects garbage.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, else the context's own
    checkpoint folder. Only a local master may do without either."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = FALLBACK_CHECKPOINTS
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, so that lost executors cost no recomputation.

    The plan that made it runs once, its shuffle files go as soon as the table stands, and
    later plans read the columns they need. ``spent`` deletes the table.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def spent(*tables: DataFrame) -> None:
    """Deletes tables that ``cut`` wrote; nothing may read them afterwards."""
    for t in tables:
        path = getattr(t, "_cut_path", None)
        if path:
            jvm = t.sparkSession.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def held(df: DataFrame) -> DataFrame:
    """A small ``df`` that a lazy result still reads: checkpointed, so that Spark's own cleaner
    removes it with the last plan that uses it (``spark.cleaner.referenceTracking.cleanCheckpoints``)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written ``df`` with a hint to broadcast it if it has no more than ``rows`` rows; else Spark shuffles."""
    return F.broadcast(df) if df.count() <= rows else df


def meet(rows: DataFrame, keys: DataFrame, on: str, total: int) -> DataFrame:
    """The inner join of ``rows`` (``total`` of them) with ``keys``, a row for each value of ``on``.

    ``keys`` has a column ``n``, how many of ``rows`` have the value. The frequent ones are
    broadcast, so no task gets all rows of a value; the others are shuffled. ``n`` is left out.
    Both are read twice and should be written tables.
    """
    hot = F.col("n") > total * HOT_SHARE
    few = F.broadcast(keys.where(hot).drop("n"))
    return rows.join(few, on).unionByName(rows.join(few.select(on), on, "left_anti").join(keys.where(~hot).drop("n"), on))


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt over all cores by ``key`` if it is so small that its splits may not fill them
    (a file of one row group is one task, however many cores there are); a table of more
    bytes than a split for each core is left as it is read."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    if df._jdf.queryExecution().analyzed().stats().sizeInBytes() >= cores * split:
        return df
    return df.repartition(cores, key)

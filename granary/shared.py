"""The folder that driver and executors share, and tables kept there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Where it is unset, a local master gets a temporary folder of its own; on a cluster that
    is an error, since executors would not see each other's files.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    path = spark.conf.get("granary.shared.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="granary-")
    spark.conf.set("granary.shared.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later reads survive lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def removed(*tables: DataFrame) -> None:
    """Delete stored tables that nothing will read again: all that came of them is stored itself."""
    for table in tables:
        p = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        p.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def broadcast_if_small(df: DataFrame, row_bytes: int | Column, limit: int = 32 << 20) -> DataFrame:
    """A broadcast of ``df``, a stored table, if its rows fit the limit; else the plain table, for a sorted join.

    ``row_bytes`` is the size of a row, a number or, where rows differ, an expression.
    """
    size = df.agg(F.sum(row_bytes if isinstance(row_bytes, Column) else F.lit(row_bytes).cast("long"))).first()[0] or 0
    return F.broadcast(df) if size <= limit else df


def bounded_batches(spark: SparkSession, size: str = "8m") -> None:
    """Arrow batches of at most ``size`` bytes from now on in this session, unless it has a limit of its own.

    Spark's default of 64 MB is held several times over, in the executor and its Python worker.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, "67108864b") in ("64MB", "67108864", "67108864b"):
        spark.conf.set(key, size)


def spread(df: DataFrame) -> DataFrame:
    """A table that lies in fewer parts than there are cores, such as one file of one row group, dealt out to all cores; others as they lie."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df

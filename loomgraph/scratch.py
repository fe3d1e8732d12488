"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a local session without it gets a temporary one, a cluster must name one that all can read."""
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("loomgraph.scratch.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="loomgraph-")
        spark.conf.set("loomgraph.scratch.dir", configured)
    return configured.rstrip("/")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: short lineage, computed once.

    The shuffles behind it are of no more use once it is written, so Spark deletes their files then.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomgraph/{label}-{uuid.uuid4().hex}"
    with shuffles_freed(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what ``stored`` or ``bucketed`` wrote, once all that is made of it is itself stored."""
    spark = df.sparkSession
    if hasattr(df, "table_name"):
        spark.sql(f"DROP TABLE IF EXISTS {df.table_name}")
        return
    path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bucketed(df: DataFrame, label: str, *columns: str) -> DataFrame:
    """``df`` as a table of its own in the warehouse, bucketed by ``columns``: grouping and joining by them needs no shuffle of it."""
    spark = df.sparkSession
    name = f"loomgraph_{label}_{uuid.uuid4().hex}"
    with shuffles_freed(spark):
        df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), *columns).format("parquet").saveAsTable(name)
    out = spark.table(name)
    out.table_name = name
    return out


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Within it, an action's shuffle files go when it ends."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before or "false")

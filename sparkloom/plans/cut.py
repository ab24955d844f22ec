"""Cutting lineage in iterative plans, and broadcasts of checked size."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a narrow table is broadcast; beyond, it is joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where that is unset, a local session takes a folder below its warehouse; a cluster's would be one machine's own, so there it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return (named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints").rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own below the shared one, not made yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever file system it is."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` read from files in the shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` read from compressed files in the shared folder, and their path, which is to be removed once it is read; for tables with many narrow rows."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def tidy(spark: SparkSession) -> None:
    """Lets Spark delete the checkpoints and shuffled files of tables that nothing holds any more, which it does when the driver's memory is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has ``rows`` rows at most; it is counted, so it should be cut before."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df

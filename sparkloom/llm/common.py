"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that a Python worker unpacks at a time; one longer text makes a slice of its own.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``sf_dir``, read by Spark alone so that any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of ``batch`` whose texts in ``column`` take about ``limit`` bytes together."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes + 64) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def release() -> None:
    """Gives memory that a worker no longer uses back to the system; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_rows(df: DataFrame, text: str, make: Callable[[], Callable[[pa.RecordBatch, list[str | None]], pa.RecordBatch]]) -> DataFrame:
    """``df`` with each slice replaced by what ``make()``'s function returns for it and its texts; columns stay the same."""
    at = df.columns.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch, at):
                yield work(part, part.column(at).to_pylist())
            release()

    return df.mapInArrow(run, df.schema)


def map_texts(
    df: DataFrame,
    columns: list[str],
    text: str,
    make: Callable[[], Callable[[pa.RecordBatch, list[str]], dict]],
    schema: T.StructType,
) -> DataFrame:
    """Rows computed from the texts of ``df``, one or more for each row, by a Python function over bounded slices.

    ``make()`` runs once in each task and returns ``f(slice, texts)``, which maps the slice of ``columns`` and its
    texts (null is "") to a value list for each field of ``schema``.
    """
    at = columns.index(text)
    names = schema.fieldNames()
    arrow = arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch, at):
                texts = [x or "" for x in part.column(at).to_pylist()]
                out = work(part, texts)
                arrays = [
                    out[n] if isinstance(out[n], pa.Array) else pa.array(out[n], type=arrow.field(n).type)
                    for n in names
                ]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)
                del arrays, out, texts
            release()

    return df.select(*columns).mapInArrow(run, schema)


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, a local session, as in tests, takes one below its warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return (named or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints").rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` cut off from its lineage by files in the shared folder, so that lost executors cost no more than a read."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has ``rows`` rows at most; it is counted, so it should be cut before."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def give_back(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle and checkpoint files of frames that are gone, which it does once both garbage collectors ran."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` written as Parquet in the shared folder and read again, and the folder, which ``remove`` deletes."""
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever file system it is."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unsigned_hex(column):
    """A long as 16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))

"""A cache of vectors by the texts' SHA-256, shared by jobs that may write to it at the same time."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.cut import remove


class VectorCache:
    """``path/runs/run=<id>/prefix=<two digits>/`` holds ``key, vector``: one run for each append, parted by the keys' first digits.

    An append is written aside and moved into place whole, so readers see all of it or nothing, and a job that fails leaves
    nothing behind that is read. Two jobs may add the same key; the run of the least name is the one that counts, for all readers.
    Moving a folder is one step in HDFS and local file systems; in a store that copies files instead, readers may see a part of an append.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def runs(self) -> DataFrame:
        """``key, vector, run, prefix`` as they were appended."""
        schema = "key string, vector array<double>, run string, prefix string"
        place, fs = self._fs(f"{self.path}/runs")
        if not fs.exists(place):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/runs")

    def vectors(self) -> DataFrame:
        """``key, vector, prefix``: each key once."""
        first = self.runs().groupBy("prefix", "key").agg(F.min_by("vector", "run").alias("vector"))
        return first.select("key", "vector", "prefix")

    def append(self, computed: DataFrame) -> None:
        """Adds ``computed (key, vector)``; rows without a vector are left out, repeated keys are taken once."""
        name = uuid.uuid4().hex
        aside = f"{self.path}/_aside/{name}"
        rows = computed.where("key IS NOT NULL AND vector IS NOT NULL").select("key", F.col("vector").cast("array<double>").alias("vector")).dropDuplicates(["key"])
        rows.withColumn("prefix", F.left("key", F.lit(2))).repartition("prefix").write.partitionBy("prefix").parquet(aside)
        runs, fs = self._fs(f"{self.path}/runs")
        fs.mkdirs(runs)
        if not fs.rename(self._fs(aside)[0], self._fs(f"{self.path}/runs/run={name}")[0]):
            raise RuntimeError(f"{aside} could not be moved into place")

    def with_vectors(self, texts: DataFrame, text: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """``texts`` with ``key`` and ``vector``; vectors that are missing are computed once for each text, and kept.

        ``compute`` maps ``key, text`` to ``key, vector``. Texts meet the cache by prefix and key. A null text has neither key nor vector.
        """
        keyed = texts.withColumn("key", F.sha2(F.col(text), 256)).withColumn("prefix", F.left("key", F.lit(2)))
        wanted = keyed.where("key IS NOT NULL").groupBy("prefix", "key").agg(F.first(text).alias("text"))
        missing = wanted.join(self.runs().select("prefix", "key").distinct(), ["prefix", "key"], "left_anti").select("key", "text")
        if missing.limit(1).count():
            self.append(compute(missing))
        return keyed.join(self.vectors(), ["prefix", "key"], "left").drop("prefix")

    def compact(self) -> None:
        """Puts all runs into one; not while others write."""
        old = [r["run"] for r in self.runs().select("run").distinct().collect()]
        if len(old) > 1:
            self.append(self.vectors())
            for run in old:
                remove(self.spark, f"{self.path}/runs/run={run}")

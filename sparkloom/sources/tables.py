"""Readers and writers: tables, text trees, JSON lines, manifests, upserts and bulk payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name``; filters and columns are pushed down by Spark."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_tree(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".md", ".txt")) -> DataFrame:
    """Whole files below ``path``: ``path, content``, in no order; each file once."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*").text(path, wholetext=True)
    files = files.select(F.input_file_name().alias("path"), F.col("value").alias("content"))
    wanted = F.lit(False)
    for s in suffixes:
        wanted = wanted | F.lower("path").endswith(s)
    return files.where(wanted).dropDuplicates(["path"])


def memory_document(spark: SparkSession, content: str, title: str, specialty: str | None = None) -> DataFrame:
    """One document handed over in memory."""
    return spark.createDataFrame([(title, content, specialty)], "title string, content string, specialty string")


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines with a fixed schema; blank and malformed lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def evaluation_rows(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines of questions to evaluate; lines without a ``query``, null or blank, are left out with the malformed ones."""
    return json_lines(spark, path, schema).where("query IS NOT NULL AND trim(query) <> ''")


def not_yet_ingested(found: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose normalised key is not known yet."""
    return found.join(known.select(key).distinct(), key, "left_anti")


def replace_by_source(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` without the rows of sources that come again, and ``new``."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def upsert(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of rows with the same keys, the first by ``order`` (latest wins when that is descending)."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__nth", nth).where("__nth = 1").drop("__nth")


def bulk_payload(rows: DataFrame, id_col: str, index: str) -> DataFrame:
    """Two lines for each row, an index action and the document, as one string with line ends."""
    action = F.to_json(F.struct(F.struct(F.lit(index).alias("_index"), F.col(id_col).cast("string").alias("_id")).alias("index")))
    body = F.to_json(F.struct(*[F.col(c) for c in rows.columns]))
    return rows.select(id_col, F.concat(action, F.lit("\n"), body, F.lit("\n")).alias("payload"))


def cached_vectors(texts: DataFrame, cache: DataFrame, text_col: str = "text") -> DataFrame:
    """Each text with its vector from ``cache (key, vector)``, null where it must be computed."""
    keyed = texts.withColumn("key", F.sha2(F.col(text_col), 256))
    return keyed.join(cache, "key", "left")

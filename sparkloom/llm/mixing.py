"""Mixing sources to target weights by Poisson replication.

Each source has a target rate, the mean number of times that one of its documents is to occur. A document's number of
copies is the inverse of the Poisson distribution function at a uniform number hashed from a seed and its id, so it
depends on no other row. Copies are exploded and shuffled globally by the hash of seed, id and copy.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, shuffle_partitions

#: Sources up to which their table is broadcast; its rows hold at most some hundred numbers. Beyond, rows are joined.
BROADCAST_SOURCES = 10_000
#: Tasks over which each source's rows are spread where sources are joined.
SALTS = 16
#: The largest mean that is inverted at once; a higher one is the sum of equal parts, each with a hash of its own.
PART_MEAN = 32.0
#: A uniform number is made of so many hexadecimal digits of a hash.
DIGITS = 13


def poisson_cdf(mean: float) -> list[float]:
    """P(X <= k) for k = 0, 1, ... up to where the rest is below 1e-17."""
    if mean <= 0:
        return [1.0]
    total, out, k = 0.0, [], 0
    while True:
        p = math.exp(-mean + k * math.log(mean) - math.lgamma(k + 1))
        total += p
        out.append(total)
        k += 1
        if k > mean and p < 1e-17:
            return out


def rates(sizes: DataFrame, weights: dict[str, float] | None, temperature: float, epochs: float) -> DataFrame:
    """``source, size`` with ``rate, parts, cdf``. The mixture has ``epochs`` times the size of all sources.

    ``weights`` are the shares that sources are to have of it (others get none; they need not sum to one); without
    them, shares are in proportion to size ** temperature. Sources of size 0 keep the rate 0.
    """
    wanted = F.pow(F.col("size").cast("double"), temperature)
    if weights is not None:
        table = [(k, float(v)) for k, v in weights.items()]
        given = sizes.sparkSession.createDataFrame(table, "source string, weight double")
        wanted = F.coalesce("weight", F.lit(0.0))
        sizes = sizes.join(F.broadcast(given), "source", "left")
    sizes = sizes.withColumn("wanted", F.when(F.col("size") > 0, wanted).otherwise(0.0))
    total = sizes.agg(F.sum("wanted").alias("all_wanted"), F.sum("size").cast("double").alias("all_size"))
    rate = F.when(F.col("size") > 0, epochs * F.col("all_size") * (F.col("wanted") / F.col("all_wanted")) / F.col("size")).otherwise(0.0)
    rated = sizes.crossJoin(F.broadcast(total)).select("source", "size", F.coalesce(rate, F.lit(0.0)).alias("rate"))
    rated = rated.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART_MEAN)).cast("int"))

    @F.udf("array<double>")
    def cdf(mean):
        return poisson_cdf(mean)

    return rated.withColumn("cdf", cdf(F.col("rate") / F.col("parts")))


def uniform(seed: int, key, part):
    """A number in (0, 1) from the hash of seed, key and part."""
    digits = F.left(F.md5(F.concat_ws(":", F.lit(str(seed)), key, part.cast("string"))), F.lit(DIGITS))
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(16**DIGITS)


def mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    temperature: float = 0.5,
    epochs: float = 1.0,
    seed: int = 42,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """All columns of ``docs`` with ``rate, copy (from 1), mix_key``, replicated and in random order.

    Rows are spread over partitions by ``mix_key`` and sorted by it inside, so any part of the output is a random
    sample. Sizes are bytes of text. A null source is a source of its own, a null text has size 0, a null id counts as
    the text's hash; repeated rows get equal numbers of copies each; an empty table gives an empty one. Columns of
    ``docs`` named like the new ones are replaced.
    """
    own = docs.drop("rate", "copy", "mix_key").columns
    rows = docs.select(
        F.struct(*own).alias("row"),
        F.col(source_col).cast("string").alias("own_source"),
        F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("size"),
        F.coalesce(F.col(id_col).cast("string"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("key"),
    )
    sizes = rows.groupBy(F.col("own_source").alias("source")).agg(F.sum("size").alias("size"))
    table = checkpoint(rates(sizes, weights, temperature, epochs)).drop("size")
    same = F.col("own_source").eqNullSafe(F.col("source"))
    if table.count() <= BROADCAST_SOURCES:
        joined = rows.join(F.broadcast(table), same)
    else:
        # a source's rows are dealt to several tasks, as one source may hold a third of them
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
        table = table.withColumn("own_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.join(table, same & (F.col("salt") == F.col("own_salt")))
    numbers = F.transform(F.sequence(F.lit(1), F.col("parts")), lambda p: uniform(seed, F.col("key"), p))
    drawn = F.transform(numbers, lambda u: F.size(F.filter("cdf", lambda c: c <= u)))
    joined = joined.withColumn("copies", F.aggregate(drawn, F.lit(0), lambda a, b: a + b)).where("copies > 0")
    out = joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    order = F.left(F.md5(F.concat_ws(":", F.lit(f"{seed}:order"), F.col("key"), F.col("copy").cast("string"))), F.lit(16))
    out = out.select("row.*", "rate", "copy", order.alias("mix_key"))
    return out.repartition(shuffle_partitions(docs.sparkSession), "mix_key").sortWithinPartitions("mix_key")


def mix_sql(temperature: float = 0.5, seed: int = 42) -> str:
    """DuckDB SQL for ``mix`` over ``documents`` without given weights, for rates up to ``PART_MEAN``."""
    return f"""
    WITH s AS (SELECT source, sum(octet_length(encode(text)))::DOUBLE AS size FROM documents GROUP BY source),
    w AS (SELECT *, pow(size, {temperature}) AS wanted FROM s),
    r AS (SELECT source, (SELECT sum(size) FROM w) * (wanted / (SELECT sum(wanted) FROM w)) / size AS rate FROM w),
    t AS (SELECT source, rate, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS p FROM r, range(0, 120) AS g(k)),
    c AS (SELECT source, any_value(rate) AS rate, list(cum) AS cdf FROM
      (SELECT source, rate, sum(p) OVER (PARTITION BY source ORDER BY k) AS cum FROM t) GROUP BY source),
    d AS (SELECT doc_id, d.source, rate, octet_length(encode(text)) AS n_bytes, len(list_filter(cdf, lambda x: x <=
      (('0x' || left(md5('{seed}:' || doc_id || ':1'), {DIGITS}))::BIGINT + 0.5) / {16**DIGITS}.0::DOUBLE)) AS n
      FROM documents d JOIN c ON d.source = c.source)
    SELECT doc_id, source, round(rate, 6) AS rate, n_bytes, copy::INT AS copy,
      left(md5('{seed}:order:' || doc_id || ':' || copy), 16) AS mix_key
    FROM (SELECT *, unnest(range(1, n + 1)) AS copy FROM d WHERE n > 0)
    """

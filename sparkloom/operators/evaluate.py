"""Offline evaluation: ranked lists, agreement, token overlap, confusion and clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.rank import global_rank


def ranking_metrics(rows: DataFrame, qid: str, rank: str, gain: str, total: str, k: int) -> DataFrame:
    """Precision, recall, F1, average precision, reciprocal rank and NDCG of each query's first k results.

    ``gain`` above 0 is relevant; ``total`` is the number of relevant documents there are. The ideal order is that of the
    retrieved list.
    """
    top = rows.where(F.col(rank) <= k).withColumn("rel", (F.col(gain) > 0).cast("int"))
    w = Window.partitionBy(qid).orderBy(rank)
    best = Window.partitionBy(qid).orderBy(F.desc(gain), rank)
    top = top.withColumn("seen", F.sum("rel").over(w)).withColumn("ideal", F.row_number().over(best))
    found = top.groupBy(qid).agg(
        F.sum("rel").alias("hits"),
        F.first(total).alias("total"),
        F.sum(F.col("rel") * F.col("seen") / F.col(rank)).alias("ap"),
        F.min(F.when(F.col("rel") == 1, F.col(rank))).alias("first"),
        F.sum(F.col(gain) / F.log2(F.col(rank) + 1)).alias("dcg"),
        F.sum(F.col(gain) / F.log2(F.col("ideal") + 1)).alias("idcg"),
    )
    p, r = F.col("hits") / k, F.col("hits") / F.greatest(F.lit(1), F.col("total"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return found.select(
        qid,
        F.round(p, 6).alias("precision"),
        F.round(r, 6).alias("recall"),
        F.round(zero(2 * p * r / F.nullif(p + r, F.lit(0.0))), 6).alias("f1"),
        F.round(F.col("ap") / F.greatest(F.lit(1), F.col("total")), 6).alias("ap"),
        F.round(zero(1 / F.col("first")), 6).alias("rr"),
        F.round(zero(F.col("dcg") / F.nullif(F.col("idcg"), F.lit(0.0))), 6).alias("ndcg"),
    )


def kappa(rows: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """Cohen's kappa of two binary raters; null without rows or where chance agreement is 1."""
    s = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg((F.col(a) == F.col(b)).cast("int")).alias("po"), F.avg(F.col(a)).alias("pa"), F.avg(F.col(b)).alias("pb")
    )
    pe = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    return s.select(*by, "n", F.round((F.col("po") - pe) / F.nullif(1 - pe, F.lit(0.0)), 6).alias("kappa"))


def token_f1(a: Column, b: Column) -> Column:
    """F1 of two token sets."""
    both = F.size(F.array_intersect(a, b))
    p, r = both / F.nullif(F.size(a), F.lit(0)), both / F.nullif(F.size(b), F.lit(0))
    return F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0))


def nearest_rank(value: str, share: float) -> Column:
    """The smallest value with at least that share at or below it."""
    return F.expr(f"percentile_disc({share}) within group (order by {value})")


def confusion(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """Counts by truth and guess."""
    return rows.groupBy(truth, guess).agg(F.count("*").alias("n"))


def class_scores(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """Precision, recall and F1 of each class."""
    cells = confusion(rows, truth, guess)
    right = cells.where(F.col(truth) == F.col(guess)).select(F.col(truth).alias("label"), F.col("n").alias("tp"))
    true = cells.groupBy(F.col(truth).alias("label")).agg(F.sum("n").alias("n_true"))
    said = cells.groupBy(F.col(guess).alias("label")).agg(F.sum("n").alias("n_said"))
    both = true.join(said, "label", "full").join(right, "label", "left").fillna(0)
    p, r = F.col("tp") / F.nullif(F.col("n_said"), F.lit(0)), F.col("tp") / F.nullif(F.col("n_true"), F.lit(0))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return both.select("label", "tp", "n_true", "n_said", zero(p).alias("p"), zero(r).alias("r"), zero(2 * p * r / F.nullif(p + r, F.lit(0.0))).alias("f1"))


def cluster_quality(rows: DataFrame, truth: str, cluster: str, beta: float = 1.0) -> DataFrame:
    """Purity, NMI (by the mean of the entropies), Rand index and best-match F of a clustering, from cell counts."""
    cell = rows.groupBy(F.col(truth).alias("t"), F.col(cluster).alias("c")).agg(F.count("*").alias("n"))
    t = cell.groupBy("t").agg(F.sum("n").alias("nt"))
    c = cell.groupBy("c").agg(F.sum("n").alias("nc"), F.max("n").alias("top"))
    n = cell.agg(F.sum("n").alias("total"))
    pairs = lambda x: F.col(x) * (F.col(x) - 1) / 2
    plogp = lambda x: -(F.col(x) / F.col("total")) * F.ln(F.col(x) / F.col("total"))
    ts = t.crossJoin(F.broadcast(n)).agg(F.sum(plogp("nt")).alias("ht"), F.sum(pairs("nt")).alias("pt"))
    cs = c.crossJoin(F.broadcast(n)).agg(F.sum(plogp("nc")).alias("hc"), F.sum(pairs("nc")).alias("pc"), F.sum("top").alias("top"))
    full = cell.join(t, "t").join(c, "c").crossJoin(F.broadcast(n))
    p, r = F.col("n") / F.col("nc"), F.col("n") / F.col("nt")
    full = full.withColumn("f", (1 + beta**2) * p * r / (beta**2 * p + r))
    mi = full.agg(
        F.sum(F.col("n") / F.col("total") * F.ln(F.col("n") * F.col("total") / (F.col("nt") * F.col("nc")))).alias("mi"), F.sum(pairs("n")).alias("same"), F.first("total").alias("total")
    )
    best = full.groupBy("t").agg(F.max("f").alias("f"), F.first("nt").alias("nt"), F.first("total").alias("total")).agg(F.sum(F.col("nt") / F.col("total") * F.col("f")).alias("f"))
    all_ = mi.crossJoin(ts).crossJoin(cs).crossJoin(best)
    rand = (pairs("total") + 2 * F.col("same") - F.col("pt") - F.col("pc")) / pairs("total")
    return all_.select(
        F.round(F.col("top") / F.col("total"), 6).alias("purity"),
        F.round(2 * F.col("mi") / F.nullif(F.col("ht") + F.col("hc"), F.lit(0.0)), 6).alias("nmi"),
        F.round(rand, 6).alias("rand"),
        F.round("f", 6).alias("f"),
    )


def heaps_zipf(docs: DataFrame, tokens: Column, order: str) -> DataFrame:
    """``log10(vocabulary) = a + b log10(tokens)`` fitted over documents in order.

    A term is new where it first stands, so the vocabulary so far is a running sum of first places. Running sums over
    the documents, one number each, are made within ranges of the order and then shifted by the ranges before.
    """
    long = docs.select(order, F.explode(tokens).alias("term"))
    first = long.groupBy("term").agg(F.min(order).alias(order), F.count("*").alias("cf"))
    fresh = first.groupBy(order).agg(F.count("*").alias("fresh"))
    sizes = docs.select(order, F.size(tokens).alias("n")).join(fresh, order, "left").fillna({"fresh": 0})
    bounds = sizes.agg(F.percentile_approx(order, [i / 64 for i in range(1, 64)], 10_000)).first()[0] or []
    part = F.lit(0)
    for b in sorted(set(bounds)):
        part = part + (F.col(order) >= b).cast("int")
    sizes = sizes.withColumn("part", part)
    w = Window.partitionBy("part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    run = sizes.withColumn("t", F.sum("n").over(w)).withColumn("v", F.sum("fresh").over(w))
    # at most 64 ranges
    ends = sizes.groupBy("part").agg(F.sum("n").alias("tn"), F.sum("fresh").alias("vn"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("part", F.coalesce(F.sum("tn").over(before), F.lit(0)).alias("t0"), F.coalesce(F.sum("vn").over(before), F.lit(0)).alias("v0"))
    points = run.join(F.broadcast(ends), "part").select(F.log10(F.col("t") + F.col("t0")).alias("x"), F.log10(F.col("v") + F.col("v0")).alias("y"))
    points = points.where("x is not null and y is not null")
    return points.agg(F.round(F.regr_slope("y", "x"), 5).alias("heaps_b"), F.round(F.regr_intercept("y", "x"), 5).alias("heaps_a"), F.count("*").alias("points"))


def zipf_ranks(docs: DataFrame, tokens: Column) -> DataFrame:
    """``rank, term, cf, product`` of every term, most frequent first, ties by term; ``product`` is rank * cf.

    Ranks are global, from ranges of the order and the sizes of those before (``plans.rank``).
    """
    counts = docs.select(F.explode(tokens).alias("term")).groupBy("term").agg(F.count("*").alias("cf"))
    ranked = global_rank(counts, [F.desc("cf"), F.asc("term")])
    return ranked.select("rank", "term", "cf", (F.col("rank") * F.col("cf")).alias("product"))


def zipf_fit(ranks: DataFrame, top: int = 25) -> DataFrame:
    """Mean and deviation (of the whole population) of rank * cf, over the ``top`` terms and over all: one row."""
    head = F.when(F.col("rank") <= top, F.col("product"))
    return ranks.agg(
        F.count("*").alias("terms"), F.avg(head).alias("top_mean"), F.stddev_pop(head).alias("top_deviation"), F.avg("product").alias("mean"), F.stddev_pop("product").alias("deviation")
    )


def acceptance(summary: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """``summary`` with ``failures``: for each threshold in order what is missing, is no number, or stays below its least value.

    A metric that ``summary`` has no column for, or that is null, is missing.
    """
    found = []
    for metric, least in thresholds.items():
        if metric not in summary.columns:
            found.append(F.lit(f"{metric}:missing"))
            continue
        value = F.col(metric).cast("string").try_cast("double")
        below = F.format_string(f"{metric}:%.4f<{least:.4f}", value)
        invalid = F.when(value.isNull(), f"{metric}:invalid").when(value < least, below)
        found.append(F.when(F.col(metric).isNull(), f"{metric}:missing").otherwise(invalid))
    return summary.withColumn("failures", F.array_compact(F.array(*found)) if found else F.array().cast("array<string>"))

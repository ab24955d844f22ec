"""Choice of k, divisive clusters and global ranks against plain forms in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import cluster_rounds as R
from sparkloom.plans.rank import global_rank


def unit(x):
    n = np.linalg.norm(x, axis=-1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def k_means(u, k, rounds=20):
    """K-means of unit vectors, one number of clusters at a time: the sum of squared distances."""
    c = u[[i * len(u) // k for i in range(k)]]
    for _ in range(rounds):
        near = ((u[:, None] - c[None]) ** 2).sum(2).argmin(1)
        new = np.stack([unit(u[near == j].mean(0)) if (near == j).any() else c[j] for j in range(k)])
        moved, c = np.abs(new - c).max(), new
        if moved < 1e-12:
            break
    return float(((u - c[near]) ** 2).sum())


def splits(u, k, iterations=4):
    """Divisive clusters with all pairs written out."""
    sims = u @ u.T
    clusters = [list(range(len(u)))]
    while len(clusters) < k:
        spread = [1 - np.mean([sims[i, j] for i in m for j in m if i < j]) if len(m) > 1 else -9 for m in clusters]
        at = next(i for i, s in enumerate(spread) if s >= max(spread) - 1e-12)
        m = clusters.pop(at)
        if len(m) < 2:
            break
        a, b = u[m[0]], u[max(m[1:], key=lambda i: round(sims[m[0], i], 12))]
        for _ in range(iterations):
            left, right = [i for i in m if u[i] @ a >= u[i] @ b], [i for i in m if u[i] @ a < u[i] @ b]
            if not left or not right:
                half = max(1, len(m) // 2)
                left, right = m[:half], m[half:]
                break
            a, b = unit(u[left].mean(0)), unit(u[right].mean(0))
        clusters += [left, right]
    owner = np.zeros(len(u), int)
    for n, m in enumerate(sorted(clusters, key=min)):
        owner[m] = n
    return owner


def made(seed, n, d):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(5, d))[rng.integers(0, 5, n)] + 0.4 * rng.normal(size=(n, d))


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "key long, v array<double>").withColumn("nth", F.lit("clash")).repartition(5)


@pytest.mark.parametrize("seed", [1, 2])
def test_choice_of_k_equals_the_slow_form(spark, seed):
    x = made(seed, 120, 6)
    got = {r["k"]: r for r in R.choose_k(frame(spark, x), "key", "v", vocabulary=2).collect()}
    for k in range(3, 9):
        assert got[k]["rss"] == pytest.approx(k_means(unit(x), k), rel=1e-9)
        assert got[k]["aic"] == pytest.approx(got[k]["rss"] + 4 * k)
    assert [k for k, r in got.items() if r["chosen"]] == [min(got, key=lambda k: (got[k]["aic"], k))]
    assert R.choose_k(frame(spark, x).limit(0), "key", "v", 2).collect() == []
    assert [r["k"] for r in R.choose_k(frame(spark, x).where("key < 2"), "key", "v", 2).collect()] == [2]


@pytest.mark.parametrize("seed, k", [(3, 4), (4, 7)])
def test_divisive_clusters_equal_all_pairs(spark, seed, k):
    x = made(seed, 90, 5)
    got = {r["key"]: r["cluster"] for r in R.divisive(frame(spark, x), "key", "v", k).collect()}
    assert [got[i] for i in range(90)] == splits(unit(x), k).tolist()


def test_divisive_clusters_of_equal_vectors(spark):
    """All members alike leave one side empty, so halves are cut by key; more clusters than rows end early."""
    x = np.ones((7, 3))
    got = {r["key"]: r["cluster"] for r in R.divisive(frame(spark, x), "key", "v", 3).collect()}
    assert [got[i] for i in range(7)] == splits(unit(x), 3).tolist()
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, 0.0])], "key long, v array<double>")
    assert {r["key"] for r in R.divisive(rows, "key", "v", 9).collect()} == {1, 3, 4}
    assert R.divisive(rows.limit(0), "key", "v", 2).collect() == []


def test_global_rank(spark):
    rows = spark.range(0, 1000, 1, 7).select(((F.col("id") * 37) % 101).alias("x"), "id", F.lit("clash").alias("__part"))
    got = global_rank(rows.drop("__part"), [F.desc("x"), F.asc("id")]).collect()
    wanted = sorted(((i * 37) % 101, i) for i in range(1000))
    wanted = {i: n + 1 for n, (x, i) in enumerate(sorted(wanted, key=lambda p: (-p[0], p[1])))}
    assert {r["id"]: r["rank"] for r in got} == wanted
    assert global_rank(rows.drop("__part").limit(0), [F.asc("id")]).collect() == []

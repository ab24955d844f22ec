"""Choosing the number of clusters and divisive clustering, in rounds of one pass over the vectors each.

Only centroids and sums, whose number is fixed by the clusters, reach the driver; vectors are made unit length and written once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.cut import checkpoint
from ..plans.rank import global_rank


def unit_vectors(vectors: DataFrame, key: str, vec: str) -> DataFrame:
    """``key, u`` of vectors at unit length, in order of their keys, with their places ``nth`` from 0; null vectors are left out, zero ones stay zero."""
    own = vectors.select(key, F.col(vec).cast("array<double>").alias("v")).where("v IS NOT NULL")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    rows = own.withColumn("__n", F.greatest(norm, F.lit(1e-300))).select(key, F.transform("v", lambda x: x / F.col("__n")).alias("u"))
    return checkpoint(global_rank(rows, [F.asc(key)], "nth").withColumn("nth", F.col("nth") - 1))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sums(units: DataFrame, per_batch: Callable[[np.ndarray, np.ndarray], Iterator[tuple[int, int, int, np.ndarray, int]]]) -> dict[tuple[int, int], tuple[int, np.ndarray, int]]:
    """For each (run, cluster) its size, the sum of its vectors and its least place; added up within tasks, then in a shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            for a, b, n, total, least in per_batch(_matrix(batch.column("u")), batch.column("nth").to_numpy()):
                if (a, b) in held:
                    own = held[a, b]
                    held[a, b] = [own[0] + n, own[1] + total, min(own[2], least)]
                else:
                    held[a, b] = [n, total, least]
        rows = [(a, b, n, total.tolist(), least) for (a, b), (n, total, least) in held.items()]
        columns = list(zip(*rows)) if rows else [[]] * 5
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["run", "cluster", "n", "total", "least"])

    told = units.select("u", "nth").mapInArrow(run, "run int, cluster int, n long, total array<double>, least long")
    long = told.select("run", "cluster", "n", "least", F.posexplode("total").alias("i", "x"))
    cells = long.groupBy("run", "cluster", "i").agg(F.sum("x").alias("x"), F.sum("n").alias("n"), F.min("least").alias("least"))
    rows = cells.groupBy("run", "cluster").agg(F.first("n").alias("n"), F.first("least").alias("least"), F.array_sort(F.collect_list(F.struct("i", "x"))).alias("t"))
    return {(r["run"], r["cluster"]): (r["n"], np.array([t["x"] for t in r["t"]]), r["least"]) for r in rows.collect()}  # a row for each cluster


def _unit(v: np.ndarray) -> np.ndarray:
    norm = float(np.sqrt(v @ v))
    return v / norm if norm > 0 else v


def choose_k(vectors: DataFrame, key: str, vec: str, vocabulary: int, least: int = 3, most: int = 8, rounds: int = 20) -> DataFrame:
    """K3: ``k, rss, aic, chosen`` for every number of clusters from ``least`` to ``most``: k-means of unit vectors, AIC = RSS + 2 * vocabulary * k.

    All numbers are carried through the same passes: a round is one pass over the vectors for all of them, and ends for one whose
    centroids stand still. Seeds are the vectors at places i * n / k in the order of ``key``; a vector goes to the nearest centroid, ties
    to the first; centroids are means at unit length, empty clusters keep theirs. RSS is the sum of squared distances to the last
    centroids. Numbers beyond the vectors' are cut down to it; the least AIC wins, ties go to the smaller number. An empty table has no rows.
    """
    spark = vectors.sparkSession
    units = unit_vectors(vectors, key, vec)
    n = units.count()
    low = max(1, min(least, n))
    wanted = list(range(low, max(low, min(most, n)) + 1)) if n else []
    places = {k: [i * n // k for i in range(k)] for k in wanted}
    seeds = {r["nth"]: np.array(r["u"]) for r in units.where(F.col("nth").isin(sorted({p for x in places.values() for p in x}))).collect()} if wanted else {}
    centres = {k: np.stack([seeds[p] for p in places[k]]) for k in wanted}
    rss: dict[int, float] = {}
    moving = list(wanted)
    for _ in range(max(1, rounds)):
        if not moving:
            break
        shared = spark.sparkContext.broadcast({k: centres[k] for k in moving})

        def assign(u: np.ndarray, nth: np.ndarray):
            for k, c in shared.value.items():
                near = ((c * c).sum(1) - 2 * (u @ c.T)).argmin(1)
                for j in np.unique(near).tolist():
                    yield k, j, int((near == j).sum()), u[near == j].sum(0), int(nth[near == j].min())

        sums = _sums(units, assign)
        still = []
        for k in moving:
            new = centres[k].copy()
            cost = 0.0
            for j in range(k):
                if (k, j) in sums:
                    size, total, _ = sums[k, j]
                    new[j] = _unit(total / size)
                    cost += size * (1 + float(new[j] @ new[j])) - 2 * float(total @ new[j])
            rss[k] = cost
            if np.abs(new - centres[k]).max() > 1e-12:
                still.append(k)
            centres[k] = new
        moving = still
    costs = [(k, rss[k], rss[k] + 2.0 * vocabulary * k) for k in wanted]
    best = min(costs, key=lambda c: (c[2], c[0]))[0] if costs else None
    return spark.createDataFrame([(k, r, a, k == best) for k, r, a in costs], "k int, rss double, aic double, chosen boolean")


#: A split: the cluster that is split, the two centroids (or the place up to which rows stay), and the number of the part that leaves.
Split = tuple[int, np.ndarray | None, np.ndarray | None, int, int]


def _owners(u: np.ndarray, nth: np.ndarray, splits: list[Split]) -> np.ndarray:
    owner = np.zeros(len(u), np.int64)
    for cluster, a, b, border, new in splits:
        own = np.flatnonzero(owner == cluster)
        leaves = nth[own] > border if a is None else u[own] @ a < u[own] @ b
        owner[own[leaves]] = new
    return owner


def divisive(vectors: DataFrame, key: str, vec: str, k: int, iterations: int = 4) -> DataFrame:
    """K5: ``key, cluster`` by splitting the cluster of widest spread until there are ``k``.

    Spread is one less the mean similarity of all pairs, which the sum of a cluster's vectors tells; ties go to the cluster that has been
    one for longest. A cluster is split about its first member by key and the member most similar to that one, in ``iterations``
    rounds of assigning members to the nearer centroid, ties to the first, and taking means at unit length. If one side is empty, the
    first half by key stays. Clusters are numbered by their first members. A split costs ``iterations`` passes and one to find the
    second seed; what is carried is a decision for each split, so nothing is written. Null vectors are left out, zero ones belong anywhere.
    """
    spark = vectors.sparkSession
    units = unit_vectors(vectors, key, vec)
    n = units.count()
    if not n:
        return units.select(key, F.lit(0).alias("cluster"))
    splits: list[Split] = []
    ones = _sums(units, lambda u, nth: iter([(0, 0, len(u), u.sum(0), int(nth.min()))]))[0, 0]
    # clusters in the order in which they came to be
    order: list[int] = [0]
    known: dict[int, tuple[int, np.ndarray, int]] = {0: ones}

    def within(cluster: int, more: list[Split]):
        fixed = spark.sparkContext.broadcast((list(splits), cluster, more))

        def sides(u: np.ndarray, nth: np.ndarray):
            before, own, then = fixed.value
            mine = _owners(u, nth, before) == own
            side = _owners(u[mine], nth[mine], [(0, *s[1:4], 1) for s in then])
            for j in np.unique(side).tolist():
                yield 0, j, int((side == j).sum()), u[mine][side == j].sum(0), int(nth[mine][side == j].min())

        return _sums(units, sides)

    while len(order) < min(k, n):
        spread = {}
        for c in order:
            size, total, _ = known[c]
            if size > 1:
                spread[c] = 1 - (float(total @ total) - size) / (size * (size - 1))
        if not spread:
            break
        widest = max(spread.values())
        cluster = next(c for c in order if c in spread and spread[c] >= widest - 1e-12)
        size, _, first = known[cluster]
        seed = np.array(units.where(F.col("nth") == first).select("u").first()[0])
        fixed = spark.sparkContext.broadcast((list(splits), cluster, seed, first))

        def nearest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            before, own, a, at = fixed.value
            for batch in batches:
                u, nth = _matrix(batch.column("u")), batch.column("nth").to_numpy()
                near = np.flatnonzero((_owners(u, nth, before) == own) & (nth != at)) if len(u) else []
                if len(near):
                    sims = u[near] @ a
                    best = near[np.lexsort((nth[near], -sims))[0]]
                    yield pa.RecordBatch.from_arrays([pa.array([float(u[best] @ a)]), pa.array([int(nth[best])])], names=["s", "nth"])

        second = units.select("u", "nth").mapInArrow(nearest, "s double, nth long").orderBy(F.desc(F.round("s", 12)), "nth").first()["nth"]
        a, b = seed, np.array(units.where(F.col("nth") == second).select("u").first()[0])
        new = len(splits) + 1
        split: Split = (cluster, a, b, 0, new)
        for round_ in range(max(1, iterations)):
            split = (cluster, a, b, 0, new)
            sides = within(cluster, [split])
            if (0, 0) not in sides or (0, 1) not in sides:
                half = max(1, size // 2)
                mine = spark.sparkContext.broadcast((list(splits), cluster))

                def members(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                    for batch in batches:
                        if batch.num_rows:
                            nth = batch.column("nth").to_numpy()
                            yield pa.RecordBatch.from_arrays([pa.array(nth[_owners(_matrix(batch.column("u")), nth, mine.value[0]) == mine.value[1]])], names=["nth"])

                ranked = global_rank(units.select("u", "nth").mapInArrow(members, "nth long"), [F.asc("nth")])
                split = (cluster, None, None, int(ranked.where(F.col("rank") == half).first()["nth"]), new)
                sides = within(cluster, [split])
                break
            a, b = (_unit(sides[0, j][1] / sides[0, j][0]) for j in (0, 1))
        splits.append(split)
        known[cluster], known[new] = sides[0, 0], sides[0, 1]
        order.remove(cluster)
        order += [cluster, new]
    names = {c: i for i, c in enumerate(sorted(order, key=lambda c: known[c][2]))}
    told = spark.sparkContext.broadcast((splits, np.array([names[c] for c in range(len(order))])))
    kind = units.schema[key].dataType.simpleString()

    def label(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, name = told.value
        for batch in batches:
            if batch.num_rows:
                owner = _owners(_matrix(batch.column("u")), batch.column("nth").to_numpy(), before)
                yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(name[owner], pa.int32())], names=[key, "cluster"])

    return units.select(key, "u", "nth").mapInArrow(label, f"`{key}` {kind}, cluster int")

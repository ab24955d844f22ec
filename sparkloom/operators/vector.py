"""Dense vectors: cosine, nearest neighbours, pooling, hash embeddings; fusion of ranked lists and feedback."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bind
from .relational import top_per_group
from .search import ranked_min_max


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column, clip: bool = True) -> Column:
    """V1, V3: cosine, 0 for a zero vector; clipped to 0..1 unless told otherwise."""
    raw = F.coalesce(dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0)), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)) if clip else raw


def nearest(asked: DataFrame, rows: DataFrame, qid: str, asked_vec: str, rid: str, row_vec: str, k: int, limit: int = 10_000) -> DataFrame:
    """V2, V7: each asked vector's k nearest rows of the same dimension by clipped cosine, ties by id; itself is left out.

    A stated set of asked vectors meets all rows. Up to ``limit`` of them are sent to all tasks, so rows are not shuffled; more
    are taken in blocks of that size, by a hash of their id. A batch of rows and the asked vectors are multiplied as matrices, and what is
    clearly worse than the k-th of the batch goes; the exact cosine of what is left decides. Other columns of ``asked`` and ``rows`` are kept.
    """
    n = asked.count()
    blocks = max(1, -(-n // limit))
    found = None
    for b in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64(qid), F.lit(blocks)) == b)
        near = _near(part, rows, qid, asked_vec, rid, row_vec, k)
        met = near.join(F.broadcast(part.withColumn("__q", F.xxhash64(F.struct(qid, asked_vec)))), "__q").drop("__q").where(F.col(qid) != F.col(rid))
        scored = met.withColumn("score", F.round(cosine(F.col(asked_vec), F.col(row_vec)), 6)).drop(asked_vec, row_vec)
        top = top_per_group(scored, [qid], [F.desc("score"), F.asc(rid)], k)
        found = top if found is None else found.unionByName(top)
    return found


#: Cells of a table of asked vectors by rows that a task fills at once.
CELLS = 1 << 22


def _near(asked: DataFrame, rows: DataFrame, qid: str, asked_vec: str, rid: str, row_vec: str, k: int) -> DataFrame:
    """``rows`` with the hash of an asked vector (``__q``) for each that a row may be among the k nearest of."""
    held: dict[int, tuple[list[int], list[np.ndarray]]] = {}
    seen: set[int] = set()
    for r in asked.select(F.xxhash64(F.struct(qid, asked_vec)).alias("h"), F.col(asked_vec).cast("array<double>").alias("v")).where("v IS NOT NULL").collect():
        names, vectors = held.setdefault(len(r["v"]), ([], []))
        if r["h"] in seen:
            continue
        seen.add(r["h"])
        names.append(r["h"])
        vectors.append(np.array([np.nan if x is None else x for x in r["v"]], float))
    spark = asked.sparkSession
    shared = spark.sparkContext.broadcast({size: (np.array(names), _unit(np.array(vectors).reshape(len(names), size))) for size, (names, vectors) in held.items()})
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", __q long"

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floors = {size: np.full(len(names), -1.0, np.float32) for size, (names, _) in shared.value.items()}
        for batch in batches:
            column = batch.column(row_vec)
            sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
            for size in np.unique(sizes[sizes >= 0]).tolist():
                if size not in shared.value:
                    continue
                names, vectors = shared.value[size]
                places = np.flatnonzero(sizes == size)
                own = column.take(pa.array(places)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(places), size)
                kept = _firsts(own, batch.column(rid).take(pa.array(places)), k + 1)
                places, own = places[kept], _unit(own[kept]).astype(np.float32)
                odd_rows = np.flatnonzero(~np.isfinite(own).all(1))
                own[odd_rows] = 0
                step = max(1, CELLS // max(1, len(places)))
                for first in range(0, len(names), step):
                    asked_ = vectors[first : first + step].astype(np.float32)
                    odd = np.flatnonzero(~np.isfinite(asked_).all(1))
                    asked_[odd] = 0
                    score, floor = asked_ @ own.T, floors[size][first : first + step]
                    np.maximum(score, 0, out=score)
                    # what is below the k-th so far goes (the k-th but for the asked row itself); products in 32 bits and six digits tell rows apart by 1e-5
                    near = score >= floor[:, None] - 2e-5
                    if len(places) > k + 1 and np.count_nonzero(near) > 3 * (k + 1) * len(near):
                        np.maximum(floor, np.minimum(1, np.partition(score, -(k + 1), axis=1)[:, -(k + 1)]), out=floor)
                        near = score >= floor[:, None] - 2e-5
                    near[:, odd_rows] = True
                    near[odd] = True
                    q, r = np.nonzero(near)
                    out = pa.Table.from_batches([batch]).take(pa.array(places[r])).append_column("__q", pa.array(names[first : first + step][q], pa.int64()))
                    yield from out.to_batches(max_chunksize=10_000)

    return rows.mapInArrow(meet, schema)


def _firsts(rows: np.ndarray, ids: pa.Array, most: int) -> np.ndarray:
    """Places of the rows that are among the ``most`` first ids of their equals: no query can have more of them, as ties go by id."""
    if not rows.shape[1]:
        return np.arange(len(rows))
    _, group = np.unique(np.ascontiguousarray(rows).view(np.dtype((np.void, rows.shape[1] * 8))).ravel(), return_inverse=True)
    if np.bincount(group).max(initial=0) <= most:
        return np.arange(len(rows))
    order = pc.sort_indices(pa.table({"g": group, "id": ids}), sort_keys=[("g", "ascending"), ("id", "ascending")]).to_numpy()
    g, code = group[order], pc.dictionary_encode(ids.take(pa.array(order))).indices.fill_null(-1).to_numpy(zero_copy_only=False)
    new = np.concatenate([[True], g[1:] != g[:-1]])
    step = np.cumsum(new | np.concatenate([[True], code[1:] != code[:-1]]))
    return np.sort(order[step - np.maximum.accumulate(np.where(new, step, 0)) < most])


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows at length 1; zero rows stay, and rows with a null have none."""
    length = np.sqrt((rows * rows).sum(1, keepdims=True))
    return np.divide(rows, length, out=np.where(np.isnan(length), np.nan, np.zeros_like(rows)), where=length > 0)


def fuse(a: DataFrame, b: DataFrame, qid: str, doc: str, wa: float, wb: float) -> DataFrame:
    """H1: weighted sum of two ranked lists (score, rank), each normalised by itself; weights are made to sum to one."""
    w = Window.partitionBy(qid)
    sides = [x.select(qid, doc, ranked_min_max(F.col("score"), F.col("rank"), w).alias(n)) for x, n in ((a, "sa"), (b, "sb"))]
    both = sides[0].join(sides[1], [qid, doc], "full")
    return both.select(qid, doc, ((wa * F.coalesce("sa", F.lit(0.0)) + wb * F.coalesce("sb", F.lit(0.0))) / (wa + wb)).alias("fused"))


def hybrid(keyword: DataFrame, vector: DataFrame | None, qid: str, doc: str, wk: float = 0.5, wv: float = 0.5) -> DataFrame:
    """H1, H2: both lists fused, or the keyword list alone, normalised, where there is no vector side or it weighs nothing."""
    if vector is None or wv <= 0:
        w = Window.partitionBy(qid)
        return keyword.select(qid, doc, ranked_min_max(F.col("score"), F.col("rank"), w).alias("fused"))
    return fuse(keyword, vector, qid, doc, wk, wv)


def feedback_terms(
    seeds: DataFrame, counts: DataFrame, asked: DataFrame, docs: DataFrame, qid: str, doc: str, seeds_per_query: int, k: int, beta: float = 0.75
) -> DataFrame:
    """H6: the k terms of each query's seeds with the highest beta * mean(1 + ln tf) * idf that the query lacks."""
    body = counts.groupBy(doc, "term").agg(F.sum("tf").alias("tf")).where(F.length("term") >= 3)
    used = seeds.join(body, doc).groupBy(qid, "term").agg((F.sum(1 + F.ln("tf")) / seeds_per_query).alias("mean_tf"))
    fresh = used.join(asked.select(qid, "term"), [qid, "term"], "left_anti")
    df = body.groupBy("term").agg(F.count("*").alias("df"))
    size = docs.agg(F.count("*").alias("n_docs"))
    scored = fresh.join(df, "term").crossJoin(F.broadcast(size))
    score = beta * F.col("mean_tf") * (F.ln((F.col("n_docs") + 1) / (F.col("df") + 1)) + 1)
    ranked = scored.select(qid, "term", F.round(score, 6).alias("score"))
    return top_per_group(ranked, [qid], [F.desc("score"), F.asc("term")], k, "n").drop("n")


def mean_pool(vectors: DataFrame, by: list[str], vec: str) -> DataFrame:
    """V5: the element-wise mean of each group's vectors, summed where they lie before anything is shuffled."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    dense = vectors.select(*by, array_to_vector(F.transform(vec, lambda x: x.cast("double"))).alias(vec))
    return dense.groupBy(*by).agg(Summarizer.mean(F.col(vec)).alias(vec)).select(*by, vector_to_array(vec).alias(vec))


def distance_score(distance: Column) -> Column:
    """V4: 1 / (1 + distance)."""
    return 1.0 / (1.0 + distance)


def hash_embedding(text: Column, size: int = 384) -> Column:
    """V6: the bytes of the text's SHA-256, repeated to ``size``, each as (b - 127.5) / 127.5."""
    places = F.sequence(F.lit(0), F.lit(size - 1))

    def byte(digest: Column, i: Column) -> Column:
        return F.conv(F.substring(digest, i % 32 * 2 + 1, F.lit(2)), 16, 10).cast("double")

    return bind(F.sha2(text, 256), lambda d: F.transform(places, lambda i: (byte(d, i) - 127.5) / 127.5))


def windows(text: Column, width: int = 2000, overlap: int = 240) -> Column:
    """V5: overlapping windows of a text."""
    step = width - overlap
    last = F.greatest(F.lit(0), F.ceil((F.length(text) - width) / step)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * step + 1, F.lit(width)))

"""Toxicity from the nearest labelled examples by exact TF-IDF cosine over block-max inverted indexes.

A bounded sample of labelled rows gives the examples. Terms are whole words and their beginnings, and all terms of the
examples are indexed; those that toxic examples hold significantly more often than others weigh more. The examples'
vectors lie in an inverted index whose postings are cut into blocks with their largest weight; a query opens blocks in
the order of their bounds until no unopened block can hold one of its nearest examples, which makes the search exact.
Votes of the nearest examples, weighted by distance, are calibrated by isotonic regression on labelled rows that are no
examples. The ids of the nearest examples are the evidence.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, map_rows, map_texts, release, slices

#: Labelled rows that are read at most: examples of the index, and of these the share kept apart for calibration.
SAMPLE = 4_000
CALIBRATION_SHARE = 4  # one of so many
#: Terms: beginnings of so many letters, and whole words.
BEGINNINGS = (5,)
#: A term is telling if toxic examples hold it so many times as often as others do, and significantly so.
LEAST_LIFT = 3.0
LEAST_G = 24.0
BOOST = 4.0
NEIGHBOURS = 15
BLOCK = 64
#: Terms kept as matrices, blocks that a query opens first, and queries answered together. None of them changes a result.
FREQUENT, OPENED, TOGETHER = 256, 8, 64
#: Weights are whole multiples of this (and fit 32 bits), so that sums of products are exact whatever their order.
UNIT = 2.0**-24
WORD = re.compile(r"\w{3,}")
#: Distance below which two examples count the same.
SOFTEN = 0.05


def terms(word: str) -> list[str]:
    """The terms of a lower-case word of three or more characters: beginnings, and the word with an end mark."""
    return [word[:n] for n in BEGINNINGS if n <= len(word)] + [word + "$"]


def term_hash(term: str) -> int:
    return xxhash.xxh64_intdigest(term.encode("utf-8", "surrogatepass"), 42)


def held_out(id_col: str) -> Column:
    """Rows whose labels are never learnt from: crc32 of the id as text is divisible by 5."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def g_statistic(a: np.ndarray, b: np.ndarray, n1: float, n0: float) -> np.ndarray:
    """Log-likelihood ratio of the counts a of n1 and b of n0 against equal rates."""

    def part(o, e):
        return np.where(o > 0, o * np.log(np.maximum(o, 1e-12) / e), 0.0)

    p = (a + b) / (n1 + n0)
    return 2 * (part(a, n1 * p) + part(b, n0 * p) + part(n1 - a, n1 * (1 - p)) + part(n0 - b, n0 * (1 - p)))


class Vectors:
    """Maps texts to TF-IDF vectors over all terms of the examples.

    ``keys`` are the terms' sorted 64-bit hashes and ``weights`` their inverse document frequencies, telling terms times
    ``1 + BOOST``. Terms that no example holds have the weight ``unseen`` and count in a vector's length alone.
    """

    def __init__(self, keys: np.ndarray, weights: np.ndarray, unseen: float) -> None:
        self.keys, self.weights, self.unseen = keys, weights, unseen
        self.kept: dict[str, tuple[int, ...]] = {}

    def learn(self, words: set[str]) -> None:
        """Looks up the terms of all these words at once."""
        fresh = [w for w in words if w not in self.kept]
        if len(self.kept) > 200_000:
            self.kept.clear()
            fresh = list(words)
        found = [terms(w) for w in fresh]
        hashes = np.fromiter((h for t in found for h in map(term_hash, t)), np.uint64)
        at = np.searchsorted(self.keys, hashes)
        if len(self.keys):
            at = np.where(self.keys[np.minimum(at, len(self.keys) - 1)] == hashes, at, -1)
        else:
            at = np.full(len(hashes), -1)
        at = at.tolist()
        i = 0
        for w, t in zip(fresh, found):
            self.kept[w] = tuple(at[i : i + len(t)])
            i += len(t)

    def vectors(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Terms and weights of unit length of each text, or None for a text without words."""
        counted = [Counter(WORD.findall(t.lower())) for t in texts]
        self.learn(set().union(*counted))
        return [self._vector(c) for c in counted]

    def _vector(self, counted: Counter[str]) -> tuple[np.ndarray, np.ndarray] | None:
        if not counted:
            return None
        of = [self.kept[w] for w in counted]
        at = np.fromiter(chain.from_iterable(of), np.int64)
        n = np.repeat(np.fromiter(counted.values(), np.float64, len(of)), [len(t) for t in of])
        outside = float(((1 + np.log(n[at < 0])) ** 2).sum()) * self.unseen**2
        n, at = n[at >= 0], at[at >= 0]
        found, place = np.unique(at, return_inverse=True)
        weight = (1 + np.log(np.bincount(place, n, len(found)))) * self.weights[found]
        length = np.sqrt((weight**2).sum() + outside)
        return found, np.rint(weight / length / UNIT) * UNIT if length else weight


def spans(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All places of the ranges begin[i] .. end[i], one range after the other."""
    n = end - begin
    return np.repeat(begin - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)


class Index:
    """Inverted index of example vectors, cut into blocks of ``BLOCK`` examples.

    The postings of the ``FREQUENT`` terms that most examples hold are kept as one matrix for each block, with each
    term's largest weight in it; all other postings are short and kept as lists. A query adds its lists first. What the
    frequent terms can add in a block at most bounds the block's cosines, and blocks are opened in the order of these
    bounds while they can still hold one of the nearest. Examples stand in the order of their most frequent terms, so
    that those of a language share blocks and other blocks' bounds stay low.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], labels: list[int], ids: list, size: int) -> None:
        n = len(vectors)
        held = np.bincount(np.concatenate([t for t, _ in vectors] or [np.zeros(0, np.int64)]), minlength=size)
        likeness = [tuple(t[np.lexsort((t, -held[t]))[:4]].tolist()) for t, _ in vectors]
        order = sorted(range(n), key=lambda i: likeness[i])
        self.labels, self.names = np.array([labels[i] for i in order], np.int64), [ids[i] for i in order]
        self.blocks = -(-n // BLOCK)
        self.frequent = np.full(size, -1, np.int32)
        often = np.lexsort((np.arange(size), -held))[:FREQUENT]
        self.frequent[often] = np.arange(len(often))
        self.dense = np.zeros((self.blocks * BLOCK, len(often)))
        terms_, rows, weights = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0)]
        for row, i in enumerate(order):
            t, w = vectors[i]
            at = self.frequent[t]
            self.dense[row, at[at >= 0]] = w[at >= 0]
            terms_.append(t[at < 0])
            weights.append(w[at < 0])
            rows.append(np.full(int((at < 0).sum()), row, np.int32))
        terms_ = np.concatenate(terms_)
        by_term = np.argsort(terms_, kind="stable")
        self.rows, self.weights = np.concatenate(rows)[by_term], np.concatenate(weights)[by_term]
        self.begin = np.searchsorted(terms_[by_term], np.arange(size + 1))
        self.block_max = self.dense.reshape(self.blocks, BLOCK, len(often)).max(1, initial=0.0)

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the k examples of highest cosine among those that share a weighty term, ties by place, and the cosines."""
        n, width = len(queries), self.blocks * BLOCK
        if not n or not width:
            return [(np.zeros(0, np.int64), np.zeros(0))] * n
        often = np.zeros((n, self.dense.shape[1]))
        places, values = [], []
        for q, (t, w) in enumerate(queries):
            at = self.frequent[t]
            often[q, at[at >= 0]] = w[at >= 0]
            t, w = t[at < 0], w[at < 0]
            a, b = self.begin[t], self.begin[t + 1]
            entry = spans(a, b)
            places.append(self.rows[entry] + q * width)
            values.append(np.repeat(w, b - a) * self.weights[entry])
        lists = np.bincount(np.concatenate(places), np.concatenate(values), n * width).reshape(n, self.blocks, BLOCK)
        bound = lists.max(2) + often @ self.block_max.T
        score = np.zeros((n, self.blocks, BLOCK))
        closed = np.ones((n, self.blocks), bool)
        least = np.zeros(n)
        first = np.sort(bound, 1)[:, max(0, self.blocks - OPENED)]
        for floor in (first, None):
            # the second time, all blocks that can still hold one of the k nearest
            chosen = closed & (bound >= (least if floor is None else floor)[:, None]) & (bound > 0)
            for block in np.flatnonzero(chosen.any(0)).tolist():
                q = np.flatnonzero(chosen[:, block])
                score[q, block] = lists[q, block] + often[q] @ self.dense[block * BLOCK : (block + 1) * BLOCK].T
            closed &= ~chosen
            flat = score.reshape(n, width)
            if k <= width:
                least = np.partition(flat, width - k, 1)[:, width - k]
        found = []
        for q in range(n):
            rows = np.flatnonzero((flat[q] >= least[q]) & (flat[q] > 0))
            rows = rows[np.lexsort((rows, -flat[q, rows]))[:k]]
            found.append((rows, flat[q, rows]))
        return found

    def votes(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[float, np.ndarray] | None]:
        """For each query the share of toxic among the nearest examples, weighted by closeness, and their places."""
        out: list[tuple[float, np.ndarray] | None] = []
        for i in range(0, len(queries), TOGETHER):
            for rows, cosine in self.nearest(queries[i : i + TOGETHER], k):
                w = 1 / (1 - np.minimum(cosine, 1) + SOFTEN)
                out.append((float((w * self.labels[rows]).sum() / w.sum()), rows) if len(rows) else None)
        return out


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps of the non-decreasing function nearest to the points, each shrunk a little to the overall rate."""
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    mean = float(y.mean()) if len(y) else 0.5
    pools: list[list[float]] = []
    for a, b in zip(x.tolist(), y.tolist()):
        pools.append([b, 1.0, a, a])
        while len(pools) > 1 and (pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1] or pools[-2][3] == pools[-1][2]):
            s, n, _, hi = pools.pop()
            pools[-1] = [pools[-1][0] + s, pools[-1][1] + n, pools[-1][2], hi]
    at = np.array([(p[2] + p[3]) / 2 for p in pools])
    value = np.array([(p[0] + mean) / (p[1] + 1) for p in pools])
    return at, np.maximum.accumulate(value) if len(value) else value


class Model:
    """Terms, index and calibration; its size is bounded by the sample, whatever the corpus."""

    def __init__(self, vectors: Vectors, index: Index, steps: tuple[np.ndarray, np.ndarray], bare: float) -> None:
        self.vectors, self.index, self.steps, self.bare = vectors, index, steps, bare

    def scores(self, texts: list[str]) -> list[tuple[float, list]]:
        """Calibrated probability of each text and the ids of its nearest examples."""
        none = np.zeros(0, np.int64), np.zeros(0)
        queries = [none if v is None else v for v in self.vectors.vectors(texts)]
        return [self._score(found) for found in self.index.votes(queries, NEIGHBOURS)]

    def _score(self, found: tuple[float, np.ndarray] | None) -> tuple[float, list]:
        if found is None:
            return self.bare, []
        vote, rows = found
        at, value = self.steps
        calibrated = float(np.interp(vote, at, value)) if len(at) else vote
        return min(1.0, max(0.0, 0.98 * calibrated + 0.02 * vote)), [self.index.names[i] for i in rows[:3].tolist()]


def sample_labelled(docs: DataFrame, labels: DataFrame, label: str, limit: int, id_col: str, text_col: str) -> DataFrame:
    """Up to ``limit`` labelled rows outside the held-out fold, chosen by a hash of their id: ``id, y, text, sign, apart``.

    ``sign`` is a hash that near copies mostly share; they are all apart for calibration or all examples. Of an id that several
    documents share, the one whose text has the least hash is taken.
    """
    learnt = labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1) & ~held_out(id_col))
    learnt = learnt.groupBy(F.col(id_col).alias("id")).agg(F.max(label).cast("int").alias("y"))
    chosen = learnt.orderBy(F.xxhash64("id", F.lit(7)), "id").limit(limit)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = rows.join(F.broadcast(chosen), "id").select("id", "y", "text", F.xxhash64("text").alias("hash"))
    found = found.join(found.groupBy("id").agg(F.min("hash").alias("hash")), ["id", "hash"], "left_semi").dropDuplicates(["id"]).drop("hash")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                signs = [signature(t) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(signs, pa.int64())], names=["id", "y", "text", "sign"])

    id_type = found.schema["id"].dataType.simpleString()
    signed = found.mapInArrow(sign, f"id {id_type}, y int, text string, sign long")
    return signed.withColumn("apart", F.pmod(F.xxhash64("sign"), F.lit(CALIBRATION_SHARE)) == 0)


def signature(text: str) -> int:
    """The least hash of the text's four-word shingles, which near copies mostly share."""
    words = text.lower().split()
    shingles = map(" ".join, zip(*(words[i:] for i in range(4)))) if len(words) > 4 else [" ".join(words)]
    return min(map(term_hash, shingles)) >> 1


def term_counts(texts: DataFrame) -> DataFrame:
    """``term (its hash), y, n, groups``: how many rows of each label hold a term, and how many of them without near copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                for y, text, sign in zip(*(part.column(i).to_pylist() for i in (1, 2, 3))):
                    held = {t for w in set(WORD.findall(text.lower())) for t in terms(w)}
                    hashes = np.fromiter(map(term_hash, held), np.uint64, len(held)).view(np.int64)
                    columns = [pa.array(hashes), pa.array(np.full(len(held), y, np.int32)), pa.array(np.full(len(held), sign, np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, names=["term", "y", "sign"])

    held = texts.select("id", "y", "text", "sign").mapInArrow(run, "term long, y int, sign long")
    once = held.groupBy("term", "y", "sign").agg(F.count("*").alias("n"))
    return once.groupBy("term", "y").agg(F.sum("n").alias("n"), F.count("*").alias("groups"))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", limit: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learns from at most ``limit`` labelled rows; only their terms and vectors reach the driver."""
    sample = checkpoint(sample_labelled(docs, labels, label, limit, id_col, text_col))
    examples = sample.where("not apart")
    sizes = {r["y"]: r for r in examples.groupBy("y").agg(F.count("*").alias("n"), F.countDistinct("sign").alias("groups")).collect()}
    n = sum(r["n"] for r in sizes.values())
    toxic = sizes[1]["n"] if 1 in sizes else 0
    rate = (toxic + 1) / (n + 2)
    if len(sizes) < 2:
        empty = Vectors(np.zeros(0, np.uint64), np.zeros(0), 1.0)
        return Model(empty, Index([], [], [], 0), (np.zeros(0), np.zeros(0)), rate if n else 0.0)
    counted = term_counts(examples).groupBy("term").agg(
        F.sum("n").alias("n"), *(F.sum(F.when(F.col("y") == y, F.col("groups")).otherwise(0)).alias(f"g{y}") for y in (0, 1))
    ).toArrow()
    keys, df, g0, g1 = (counted.column(i).to_numpy() for i in range(4))
    keys = np.ascontiguousarray(keys).view(np.uint64)
    n0, n1 = sizes[0]["groups"], sizes[1]["groups"]
    lift = ((g1 + 0.5) / (n1 + 1)) / ((g0 + 0.5) / (n0 + 1))
    telling = (lift >= LEAST_LIFT) & (g_statistic(g1.astype(float), g0.astype(float), n1, n0) >= LEAST_G)
    weights = np.log((1 + n) / (1 + df)) * np.where(telling, 1 + BOOST, 1.0)
    order = np.argsort(keys)
    vectors = Vectors(keys[order], weights[order], float(np.log(1 + n)))

    def vectorise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                got = vectors.vectors(part.column(2).to_pylist())
                columns = [
                    pa.array([None if v is None else v[i] for v in got], pa.list_(t))
                    for i, t in enumerate((pa.int32(), pa.float32()))
                ]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in (0, 1, 3)), *columns], names=["id", "y", "apart", "terms", "weights"])

    id_type = sample.schema["id"].dataType.simpleString()
    made = sample.select("id", "y", "text", "apart").mapInArrow(vectorise, f"id {id_type}, y int, apart boolean, terms array<int>, weights array<float>").toArrow()
    rows = [(i, y, a, None if t.as_py() is None else (t.values.to_numpy(), w.values.to_numpy())) for i, y, a, t, w in zip(
        *(made.column(c).to_pylist() for c in range(3)), made.column(3), made.column(4)
    )]
    rows.sort(key=lambda r: r[:2])
    del counted, made
    inside = [r for r in rows if r[3] is not None and not r[2]]
    index = Index([r[3] for r in inside], [r[1] for r in inside], [r[0] for r in inside], len(keys))
    asked = [(y, v) for _, y, a, v in rows if a and v is not None]
    votes = [(found[0], y) for (y, _), found in zip(asked, index.votes([v for _, v in asked], NEIGHBOURS)) if found is not None]
    bare = [y for _, y, _, v in rows if v is None]
    steps = isotonic(np.array([v for v, _ in votes]), np.array([y for _, y in votes], float))
    del rows, inside, asked
    release()
    return Model(vectors, index, steps, (sum(bare) + rate) / (len(bare) + 1))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, held_out, score, predicted, evidence (ids of the nearest examples)`` of every whole text.

    The score is the probability of the label 1. Every text that shares a term with an example has neighbours and evidence;
    any other, such as an empty or null one, gets the rate of toxic rows among labelled texts without words. Equal texts get equal scores; repeated rows give repeated
    rows; an empty table gives an empty one; other columns are ignored, and no column but the text is ever looked at.
    A null id is not held out.
    """
    own = docs.select(id_col).schema[0]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([own, T.StructField("score", T.DoubleType()), T.StructField("evidence", T.ArrayType(own.dataType))])

    def make():
        def work(part, texts):
            got = shared.value.scores(texts)
            return {id_col: part.column(0), "score": [s for s, _ in got], "evidence": [e for _, e in got]}

        return work

    scored = map_texts(docs.select(F.col(id_col), F.col(text_col).cast("string")), [id_col, text_col], text_col, make, schema)
    return scored.select(
        id_col,
        F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "evidence",
    )


def reject(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, as they are, whatever their other columns are called.

    Null and empty texts score as texts without words do; repeated rows stay or go together; an empty table gives an
    empty one; very long texts are scored whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def work(part: pa.RecordBatch, texts: list[str | None]) -> pa.RecordBatch:
            return part.filter(pa.array([s < threshold for s, _ in shared.value.scores([t or "" for t in texts])], pa.bool_()))

        return work

    return map_rows(docs, text_col, make)

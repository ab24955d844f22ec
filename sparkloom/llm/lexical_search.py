"""Ranked lexical search with block-max pruning over a forward index in blocks of consecutive documents.

The index is two tables: the forward index has a row for each document with its terms and how often it holds them, the
other for each block of documents the largest part that each of its terms can add to a score there. The sum of a query's
terms' largest parts is its bound in a block. Each query sorts the blocks by it and scores the documents of the first
few; then it goes on through the blocks until the bound falls below the score of the k-th best so far. The documents of
blocks that no query opens are never read into Python. All scores are whole numbers, and the result is exact.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, checkpoint, release, remove, slices, small, stored

#: Bytes of text in a block; a longer text makes a block of its own.
BLOCK_BYTES = 1 << 20
#: Blocks of each query that are scored first, and queries that are answered together.
SEED_BLOCKS = 4
TOGETHER = 1_000
#: Terms of a block that make a row of the table of maxima, so that its rows are small.
TERMS_A_ROW = 256
#: Rows that a worker unpacks at a time.
ROWS = 1_000
#: Rows of forward index up to which what to open is sent to all tasks; beyond, it is joined by a shuffle.
SENT_BLOCKS = 20_000
#: Bytes to terms: letters A to Z become small, all signs of ASCII but letters and digits become spaces.
SIGNS = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order, with repeats."""
    return text.translate(SIGNS).split()


def weight(documents: int, df: int) -> int:
    """What a term in ``df`` of ``documents`` documents weighs."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def parts(tf: np.ndarray, lengths: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """What a term that occurs ``tf`` times in a document of so many terms adds to its score, before its weight."""
    size, at = np.unique(lengths, return_inverse=True)
    m = np.array([50 + 50 * n * documents // terms for n in size.tolist()], np.int64)[at.ravel()]
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


@dataclass(frozen=True)
class Index:
    """The forward index and the blocks' maxima as tables in folders, with the totals that scores need.

    ``forward``: ``block, doc_id, n`` (terms with repeats), ``terms`` and ``tf``. ``maxima``: ``block``, some of its
    ``terms``, how many of its documents hold each (``held``) and the largest part of each (``most``).
    """

    forward: DataFrame
    maxima: DataFrame
    paths: tuple[str, str]
    documents: int
    terms: int

    def drop(self) -> None:
        """Deletes the index."""
        for path in self.paths:
            remove(self.forward.sparkSession, path)


MAXIMA = T.StructType(
    [
        T.StructField("block", T.LongType()),
        T.StructField("terms", T.ArrayType(T.BinaryType())),
        T.StructField("held", T.ArrayType(T.IntegerType())),
        T.StructField("most", T.ArrayType(T.IntegerType())),
    ]
)


def listed(values: pa.Array, sizes: np.ndarray) -> pa.ListArray:
    """Consecutive values as lists of these sizes."""
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), values)


def inside(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """The values of a column of lists, and how many each row has."""
    return lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)


def unpacked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in parts of a few rows, so that what is made of them stays small; memory is given back after each batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)
        release()


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> Index:
    """Indexes every row of ``docs`` by its whole text, in blocks of rows that follow each other as they are stored.

    Documents are not shuffled; a block has at most ``block_bytes`` of text, or one text. Null and empty texts and texts
    without terms are kept and never found; repeated rows are documents of their own; an empty table gives an empty
    index; other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType(
        [
            T.StructField("block", T.LongType()),
            rows.schema[0],
            T.StructField("n", T.LongType()),
            T.StructField("terms", T.ArrayType(T.BinaryType())),
            T.StructField("tf", T.ArrayType(T.IntegerType())),
        ]
    )
    arrow = arrow_schema(schema)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, 1, block_bytes):
                found = [Counter(terms_of(t)) if t else Counter() for t in part.column(1).cast(pa.binary()).to_pylist()]
                sizes = np.fromiter(map(len, found), np.int64, len(found))
                made = [
                    pa.array(np.full(len(found), number)),
                    part.column(0),
                    pa.array([sum(c.values()) for c in found], pa.int64()),
                    listed(pa.array([t for c in found for t in c], pa.binary()), sizes),
                    listed(pa.array([n for c in found for n in c.values()], pa.int32()), sizes),
                ]
                yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(made, arrow)], schema=arrow)
                number += 1
            release()

    forward, path = stored(rows.mapInArrow(cut, schema))
    total = forward.agg(F.count_if(F.col("n") > 0).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    documents, terms = total["documents"], total["terms"]
    maxima, path_of_maxima = stored(forward.select("block", "n", "terms", "tf").mapInArrow(lambda batches: largest(batches, documents, terms), MAXIMA))
    return Index(forward, maxima, (path, path_of_maxima), documents, terms)


def largest(batches: Iterable[pa.RecordBatch], documents: int, terms: int) -> Iterator[pa.RecordBatch]:
    """Rows of ``MAXIMA`` for forward rows whose blocks follow each other; a block cut by a task's end has rows from both."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        block = table.column("block").to_numpy()
        ends = np.r_[np.flatnonzero(np.diff(block)) + 1, len(block)] if len(block) else np.zeros(0, np.int64)
        begin = 0
        for end in ends[:-1].tolist():
            yield maxima_of(table.slice(begin, end - begin), documents, terms)
            begin = end
        rest = table.slice(begin).combine_chunks()
        del table
        release()
    if rest is not None and rest.num_rows:
        yield maxima_of(rest, documents, terms)


def maxima_of(rows: pa.Table, documents: int, terms: int) -> pa.RecordBatch:
    rows = rows.combine_chunks().to_batches()[0]
    values, sizes = inside(rows.column("terms"))
    tf = rows.column("tf").flatten().to_numpy().astype(np.int64)
    coded = values.dictionary_encode()
    at, n = coded.indices.to_numpy(), len(coded.dictionary)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, at, parts(tf, np.repeat(rows.column("n").to_numpy(), sizes), documents, terms))
    held = np.bincount(at, minlength=n)
    row = np.full(-(-n // TERMS_A_ROW), TERMS_A_ROW)
    row[-1:] = n - TERMS_A_ROW * (len(row) - 1)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(row), rows.column("block")[0].as_py())),
            *(listed(a, row) for a in (coded.dictionary, pa.array(held, pa.int32()), pa.array(most, pa.int32()))),
        ],
        names=MAXIMA.fieldNames(),
    )


class Queries:
    """A bounded set of queries: each one's terms, as places in all their terms, and the terms' weights."""

    def __init__(self, names: list, texts: list[str | None]) -> None:
        own = [sorted(set(terms_of((t or "").encode()))) for t in texts]
        kept = [i for i, terms in enumerate(own) if terms]
        self.names = [names[i] for i in kept]
        self.terms = sorted(set().union(*own)) if own else []
        at = {t: i for i, t in enumerate(self.terms)}
        self.of = [np.array([at[t] for t in own[i]], np.int64) for i in kept]
        self.flat = np.concatenate(self.of) if self.of else np.zeros(0, np.int64)
        self.begin = np.cumsum([0, *map(len, self.of)])[:-1]
        self.weights = np.zeros(len(self.terms), np.int64)

    def within(self, terms: pa.Array) -> np.ndarray:
        """The place among the queries' terms of each of these terms, -1 where no query asks for it."""
        return pc.fill_null(pc.index_in(terms, value_set=pa.array(self.terms, terms.type)), -1).to_numpy(zero_copy_only=False)

    def bounds(self, within: np.ndarray, most: np.ndarray) -> np.ndarray:
        """What a document can score at most by these terms, for each query."""
        part = np.zeros(len(self.terms), np.int64)
        asked = within >= 0
        np.add.at(part, within[asked], most[asked])  # rows from both sides of a cut add up to a larger bound
        return np.add.reduceat((part * self.weights)[self.flat], self.begin)


def best_of(rows: pa.RecordBatch, queries: Queries, floors: list[int], k: int, index: tuple[int, int]) -> Iterator[tuple[int, list[tuple]]]:
    """For each query that opens some of these forward rows (column ``asked``) its best, as ``(-score, no id, id)``, none below its floor."""
    values, sizes = inside(rows.column("terms"))
    within = queries.within(values)
    kept = np.flatnonzero(within >= 0)
    row = np.repeat(np.arange(rows.num_rows), sizes)[kept]
    term = within[kept]
    tf = rows.column("tf").flatten().to_numpy()[kept].astype(np.int64)
    value = parts(tf, rows.column("n").to_numpy()[row], *index) * queries.weights[term]
    begin = np.searchsorted(row, np.arange(rows.num_rows + 1))
    asked, times = inside(rows.column("asked"))
    asked, opens = asked.to_numpy(zero_copy_only=False), np.repeat(np.arange(rows.num_rows), times)
    order = np.argsort(asked, kind="stable")
    asked, opens = asked[order], opens[order]
    ids = rows.column("doc_id")
    own = np.zeros(len(queries.terms), bool)
    for q, places in zip(*grouped(asked, opens)):
        own[:] = False
        own[queries.of[q]] = True
        total = np.r_[0, np.cumsum(np.where(own[term], value, 0))]
        scores = total[begin[places + 1]] - total[begin[places]]
        places = places[scores >= max(1, floors[q])]
        scores = total[begin[places + 1]] - total[begin[places]]
        best = [(-s, x is None, x) for s, x in zip(scores.tolist(), ids.take(pa.array(places)).to_pylist())]
        if best:
            yield q, heapq.nsmallest(k, best, key=lambda b: b if not b[1] else b[:2])


def grouped(keys: np.ndarray, values: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """Sorted keys once each, and the values of each."""
    cuts = np.flatnonzero(np.diff(keys)) + 1
    return (keys[np.r_[0, cuts]].tolist(), np.split(values, cuts)) if len(keys) else ([], [])


def search(index: Index, queries: DataFrame, k: int = 50, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The ``k`` best documents for each query, by score and then by id: ``id_col, rank, doc_id, score``.

    Exact: a block is left closed only if no document in it can reach the k-th best score. Queries are a stated set and
    are answered in groups of ``TOGETHER``, whose terms and weights are sent to the tasks. A query without terms, null
    or empty, has no result; a repeated row has its results again; documents with a null id rank after their equals.
    An empty index or query set gives an empty table; other columns are ignored, whatever their names.
    """
    spark = index.forward.sparkSession
    rows = queries.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType(
        [
            T.StructField(id_col, rows.schema["id"].dataType),
            T.StructField("rank", T.IntegerType()),
            T.StructField("doc_id", index.forward.schema["doc_id"].dataType),
            T.StructField("score", T.LongType()),
        ]
    )
    found = spark.createDataFrame([], schema)
    asked = rows.toLocalIterator()
    while group := list(islice(asked, TOGETHER)):
        own = Queries([r["id"] for r in group], [r["text"] for r in group])
        if own.names and index.terms:
            weigh(index, own)
            names = spark.createDataFrame(list(enumerate(own.names)), T.StructType([T.StructField("query", T.LongType()), schema[0]]))
            best = ranked(index, own, k).join(F.broadcast(names), "query").select(*schema.fieldNames())
            found = found.unionByName(checkpoint(best))
    return found


def weigh(index: Index, queries: Queries) -> None:
    """Gives the queries' terms their weights, by how many documents of the whole index hold them."""

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(queries.terms), np.int64)
        for batch in unpacked(batches):
            at = queries.within(batch.column(0).flatten())
            np.add.at(df, at[at >= 0], batch.column(1).flatten().to_numpy()[at >= 0])
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], names=["term", "df"])

    df = index.maxima.select("terms", "held").mapInArrow(counted, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    for r in df.collect():  # a row for each term of the queries
        queries.weights[r["term"]] = weight(index.documents, r["df"])


def block_bounds(index: Index, queries: Queries) -> DataFrame:
    """``block, query, bound``: what a document of a block can score at most, where that is above 0."""
    shared = index.forward.sparkSession.sparkContext.broadcast(queries)

    def bounded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in unpacked(batches):
            values, sizes = inside(batch.column("terms"))
            within, most = own.within(values), batch.column("most").flatten().to_numpy()
            of = np.repeat(batch.column("block").to_numpy(), sizes)
            order = np.argsort(of, kind="stable")
            for block, places in zip(*grouped(of[order], order)):
                bounds = own.bounds(within[places], most[places])
                some = np.flatnonzero(bounds)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), block)), pa.array(some), pa.array(bounds[some])], names=["block", "query", "bound"])

    # a block's terms are in one row each, so that the bounds of its rows add up
    partial = index.maxima.select("block", "terms", "most").mapInArrow(bounded, "block long, query long, bound long")
    return partial.groupBy("block", "query").agg(F.sum("bound").alias("bound"))


def ranked(index: Index, queries: Queries, k: int) -> DataFrame:
    """``query, doc_id, score, rank``: first the few blocks of the largest bounds, then all others whose bound is not below the k-th score."""
    spark = index.forward.sparkSession
    size = index.documents, index.terms
    shared = spark.sparkContext.broadcast(queries)
    id_field = index.forward.schema["doc_id"]
    out = T.StructType([T.StructField("query", T.LongType()), id_field, T.StructField("score", T.LongType())])
    arrow = arrow_schema(out)
    bounds = checkpoint(block_bounds(index, queries))
    order = Window.partitionBy("query").orderBy(F.desc("bound"), "block")
    first = bounds.withColumn("n", F.row_number().over(order)).where(F.col("n") <= SEED_BLOCKS).drop("n")

    def scored(opened: DataFrame, floors: list[int]) -> DataFrame:
        kept = spark.sparkContext.broadcast(floors)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, floor = shared.value, list(kept.value)
            for batch in unpacked(batches):
                rows = []
                for q, best in best_of(batch, own, floor, k, size):
                    rows += [(q, x, -s) for s, _, x in best]
                    if len(best) == k:
                        floor[q] = max(floor[q], -best[-1][0])
                columns = list(zip(*rows)) if rows else [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

        blocks = opened.groupBy("block").agg(F.collect_list(F.col("query").cast("int")).alias("asked"))
        rows = index.forward.join(small(blocks, SENT_BLOCKS), "block").select("doc_id", "n", "terms", "tf", "asked")
        best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        return rows.mapInArrow(run, out).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    floors = [0] * len(queries.of)
    for r in scored(checkpoint(first), floors).where(F.col("rank") == k).select("query", "score").collect():  # a row for each query
        floors[r["query"]] = r["score"]
    least = spark.createDataFrame(list(enumerate(floors)), "query long, floor long")
    reach = bounds.join(F.broadcast(least), "query").where("bound >= floor")
    return scored(checkpoint(reach.select("block", "query")), floors)


def search_sql(k: int = 50) -> str:
    """The same ranking of all documents in DuckDB."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    terms = rf"regexp_extract_all(translate(text, '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, {terms} AS terms FROM documents WHERE text IS NOT NULL),
    total AS (SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d WHERE len(terms) > 0),
    tf AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM d) GROUP BY ALL),
    q AS (SELECT DISTINCT item_id, unnest({terms}) AS term FROM benchmark WHERE text IS NOT NULL),
    w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term, n_docs),
    s AS (
        SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
        FROM q JOIN tf USING (term) JOIN w USING (term), total GROUP BY ALL
    )
    SELECT item_id, rank::INTEGER AS rank, doc_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= {k}
    """

"""An inverted-file index of vectors: coarse centroids, and each centroid's list of vectors as a folder of Parquet files.

A query ranks the centroids and reads the lists of the nearest ones alone (``probes``). As each list knows how far its
farthest vector lies from its centroid, the angle between query and centroid bounds what a list can hold; with
``exact``, the query goes on through all lists that can still hold one of its k nearest, and the answer is that of a scan.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..plans.cut import checkpoint
from .relational import top_per_group

#: Vectors that centroids are learnt from, at most; all others are only assigned. Centroids at most, whatever the table.
SAMPLE, MOST_LISTS = 100_000, 4_096
#: Queries that are answered together, and rows of a list that go into one file at least.
TOGETHER, FILE_ROWS = 10_000, 50_000
#: Vectors that no angle can be told of, zero vectors and those of other sizes, make a list of their own.
APART = -1
#: Cells of a table of queries by rows of a list that a task fills at once.
CELLS = 1 << 21


@dataclass(frozen=True)
class VectorIndex:
    """``path/lists`` holds ``id, vec, list`` by list, ``path/centroids`` the lists: ``list, centroid, reach, n``.

    ``reach`` is the largest angle between a list's centroid and one of its vectors.
    """

    spark: SparkSession
    path: str
    id_type: str

    def lists(self) -> DataFrame:
        return self.spark.read.schema(f"id {self.id_type}, vec array<double>, angle double, list int").parquet(f"{self.path}/lists")

    def centroids(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/centroids")


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows at length 1; zero rows stay."""
    length = np.sqrt((rows * rows).sum(1, keepdims=True))
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


def matrix(column: pa.Array) -> np.ndarray:
    """A column of lists of one size as rows of doubles."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def build(vectors: DataFrame, path: str, key: str, vec: str, lists: int | None = None, size: int | None = None) -> VectorIndex:
    """Indexes every row of ``vectors (key, vec)`` under ``path``; ``lists`` is the square root of their number by default.

    Centroids are learnt by spherical k-means from at most ``SAMPLE`` vectors, drawn by a hash of their keys, of the
    commonest size (or ``size``); their number is bounded, so they are sent to all tasks. Each vector goes to its nearest
    centroid, ties to the first. Zero vectors, vectors of other sizes and vectors with a null in them go to a list apart,
    which no bound closes wrongly; rows without a vector are left out. A list is split over as many tasks as it has ``FILE_ROWS`` rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).alias("id"), F.col(vec).cast("array<double>").alias("vec")).where("vec IS NOT NULL")
    if size is None:
        common = rows.groupBy(F.size("vec").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
        size = common["size"] if common else 0
    fits = (F.size("vec") == size) & F.exists("vec", lambda x: x != 0) & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x))
    n = rows.where(fits).count()
    wanted = max(1, min(MOST_LISTS, lists or round(math.sqrt(n))))
    share = min(1.0, SAMPLE / max(1, n))
    drawn = rows.where(fits & ((F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)) < share)).orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    centres = np.zeros((0, size))
    if n:
        points = checkpoint(drawn.select(array_to_vector("vec").alias("features")))
        model = KMeans(k=wanted, seed=7, maxIter=8, distanceMeasure="cosine", initMode="random").fit(points)
        centres = unit(np.array(model.clusterCenters(), np.float64))
    shared = spark.sparkContext.broadcast(centres)
    kind = rows.schema["id"].dataType.simpleString()

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            fit = batch.column("fits").to_numpy(zero_copy_only=False).astype(bool)
            at, angle = np.full(len(fit), APART), np.full(len(fit), math.pi)
            if fit.any():
                cosine = unit(matrix(batch.column("vec").filter(batch.column("fits")))) @ own.T
                at[fit] = cosine.argmax(1)
                angle[fit] = np.arccos(np.clip(cosine.max(1), -1, 1))
            columns = [batch.column("id"), batch.column("vec"), pa.array(angle), pa.array(at, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "vec", "angle", "list"])

    dealt = rows.select("id", "vec", F.coalesce(fits, F.lit(False)).alias("fits")).mapInArrow(assign, f"id {kind}, vec array<double>, angle double, list int")
    parts = max(1, math.ceil(n / max(1, wanted) / FILE_ROWS))
    spread = dealt.repartition("list", F.pmod(F.xxhash64("id"), F.lit(parts)))
    spread.write.mode("overwrite").partitionBy("list").parquet(f"{path}/lists")
    found = VectorIndex(spark, path, kind)
    reach = found.lists().groupBy("list").agg(F.max("angle").alias("reach"), F.count("*").alias("n"))
    named = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)] + [(APART, [])], "list int, centroid array<double>")
    named.join(reach, "list").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    return found


def search(index: VectorIndex, asked: DataFrame, qid: str, vec: str, k: int, probes: int = 8, exact: bool = False, digits: int = 6) -> DataFrame:
    """``qid, id, score, rank``: the k nearest of each asked vector by cosine clipped to 0..1 and rounded, ties by id.

    Rows under the query's own id are left out, and vectors of another size are never near. ``asked`` is a stated set,
    taken in groups of ``TOGETHER``. With ``probes`` lists alone the answer may miss neighbours; with ``exact`` it is that of
    a scan, whatever ``probes`` is. Null vectors have no answer; a repeated query is answered once; an empty index gives an empty table.
    """
    n = asked.count()
    groups = max(1, -(-n // TOGETHER))
    found = None
    for g in range(groups):
        part = asked if groups == 1 else asked.where(F.pmod(F.xxhash64(qid), F.lit(groups)) == g)
        rows = _search(index, part, qid, vec, k, probes, exact, digits)
        found = rows if found is None else found.unionByName(rows)
    return found


def _search(index: VectorIndex, asked: DataFrame, qid: str, vec: str, k: int, probes: int, exact: bool, digits: int) -> DataFrame:
    spark = index.spark
    held = asked.select(F.col(qid).alias("qid"), F.col(vec).cast("array<double>").alias("vec")).where("vec IS NOT NULL").dropDuplicates(["qid"]).collect()
    lists = {r["list"]: r for r in index.centroids().collect()}  # MOST_LISTS rows at most
    names = sorted(x for x in lists if x != APART)
    centres = np.array([lists[x]["centroid"] for x in names])
    reach = np.array([lists[x]["reach"] for x in names])
    queries: list[tuple[object, np.ndarray]] = []
    bounds = np.zeros((len(held), len(names) + 1))
    for i, r in enumerate(held):
        q = np.array([math.nan if x is None else x for x in r["vec"]])
        queries.append((r["qid"], q))
        if len(names) and len(q) == centres.shape[1] and np.isfinite(q).all() and q.any():
            angle = np.arccos(np.clip(centres @ q / np.sqrt(q @ q), -1, 1))
            bounds[i, :-1] = np.cos(np.clip(angle - reach, 0, math.pi))
            order = np.argsort(angle, kind="stable")[:probes]
        else:
            order = np.zeros(0, np.int64)
        bounds[i, order] = 2  # read at once
    if APART in lists:
        names.append(APART)
        for i, (_, q) in enumerate(queries):
            own_size = len(centres) and len(q) == centres.shape[1]
            bounds[i, -1] = 0 if own_size else 2  # only zero vectors of the queries' size are there
    else:
        bounds = bounds[:, : len(names)]
    first = [(i, names[j]) for i, j in zip(*map(np.ndarray.tolist, np.nonzero(bounds == 2)))]
    best = checkpoint(_scored(index, queries, first, k, digits))
    if exact:
        least = np.full(len(held), -1.0)
        for r in best.where(F.col("rank") == k).select("query", "score").collect():
            least[r["query"]] = r["score"]
        slack = 10.0**-digits
        more = [(i, names[j]) for i, j in zip(*map(np.ndarray.tolist, np.nonzero((bounds < 2) & (np.maximum(bounds, 0) + slack >= least[:, None]))))]
        both = best.drop("rank").unionByName(_scored(index, queries, more, k, digits).drop("rank"))
        best = top_per_group(both, ["query"], [F.desc("score"), F.asc("id")], k)
    kind = asked.schema[qid].dataType.simpleString()
    named = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(queries)], f"query int, {qid} {kind}")
    return best.join(F.broadcast(named), "query").select(qid, "id", "score", "rank")


def _scored(index: VectorIndex, queries: list[tuple[object, np.ndarray]], opened: list[tuple[int, int]], k: int, digits: int) -> DataFrame:
    """``query, id, score, rank`` of the opened lists: only their folders are read, one product of matrices for each batch of a list."""
    by_list: dict[int, list[int]] = {}
    for q, name in opened:
        by_list.setdefault(name, []).append(q)
    shared = index.spark.sparkContext.broadcast((queries, by_list))
    rows = index.lists().where(F.col("list").isin(sorted(by_list))).select("list", "id", "vec")
    kind = rows.schema["id"].dataType.simpleString()

    names_ = pa.array([q for q, _ in queries], to_arrow_type(rows.schema["id"].dataType)) if queries else None
    told = index.spark.sparkContext.broadcast(names_)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, of = shared.value
        own_ids = told.value
        floors = np.full(len(asked), -1.0)  # the k-th score of each query so far but for its own row
        units = {}
        for batch in batches:
            name, size = batch.column("list").to_numpy(), pc.list_value_length(batch.column("vec")).to_numpy(zero_copy_only=False)
            for each in np.unique(name).tolist():
                for length in np.unique(size[name == each]).tolist():
                    places = np.flatnonzero((name == each) & (size == length))
                    if (each, length) not in units:
                        some = np.array([q for q in of[each] if len(asked[q][1]) == length], np.int64)
                        units = {(each, length): (some, np.nan_to_num(unit(np.array([asked[q][1] for q in some]).reshape(len(some), length))))}
                    some, vectors = units[each, length]
                    if not len(some):
                        continue
                    own = np.nan_to_num(unit(matrix(batch.column("vec").take(pa.array(places)))))
                    step = max(1, CELLS // len(places))
                    for first in range(0, len(some), step):
                        part = some[first : first + step]
                        cosine = np.round(np.clip(np.nan_to_num(vectors[first : first + step] @ own.T), 0, 1), digits)
                        # all that are not worse than the k-th and the query's own row, so that ties are settled by id later
                        if len(places) > k + 1:
                            floors[part] = np.maximum(floors[part], np.partition(cosine, -(k + 1), axis=1)[:, -(k + 1)])
                        q, r = np.nonzero(cosine >= floors[part][:, None])
                        ids, asked_ids = batch.column("id").take(pa.array(places[r])), own_ids.take(pa.array(part[q]))
                        out = pa.RecordBatch.from_arrays([pa.array(part[q], pa.int32()), ids, pa.array(cosine[q, r])], names=["query", "id", "score"])
                        yield out.filter(pc.not_equal(ids, asked_ids))

    found = rows.mapInArrow(score, f"query int, id {kind}, score double")
    return top_per_group(found, ["query"], [F.desc("score"), F.asc("id")], k)


def scanned(index: VectorIndex, asked: DataFrame, qid: str, vec: str, probes: int) -> DataFrame:
    """``qid, scanned``: the share of the indexed rows that ``probes`` lists hold, for each asked vector of the index's size."""
    held = asked.select(F.col(qid).alias("qid"), F.col(vec).cast("array<double>").alias("vec"))
    dot = F.aggregate(F.zip_with("vec", "centroid", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    lists = index.centroids().where(F.size("centroid") > 0)
    whole = lists.agg(F.sum("n").alias("n")).first()["n"]
    near = held.join(F.broadcast(lists), F.size("vec") == F.size("centroid")).withColumn("near", dot)
    top = top_per_group(near, ["qid"], [F.desc("near"), F.asc("list")], probes)
    return top.groupBy(F.col("qid").alias(qid)).agg((F.sum("n") / F.lit(whole)).alias("scanned"))

"""The inverted-file index against a scan of all vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import vector_index as V
from sparkloom.operators.vector import nearest

SCHEMA = "vec_id long, embedding array<float>"


def rows(frame):
    return sorted((r[0], r[3], r[1], r[2]) for r in frame.collect())


def wanted(asked, vectors, k):
    return rows(nearest(asked, vectors, "qid", "asked", "vec_id", "embedding", k).select("qid", F.col("vec_id").alias("id"), "score", "rank"))


def as_asked(vectors):
    return vectors.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("asked"))


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 24))
    made = np.repeat(centres, 40, 0) + 0.35 * rng.normal(size=(1200, 24))
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(made.astype(np.float32))], SCHEMA).repartition(4)


def test_few_lists_find_most_neighbours_where_vectors_cluster(clustered, tmp_path):
    index = V.build(clustered, str(tmp_path / "v"), "vec_id", "embedding")
    asked = as_asked(clustered.where("vec_id % 25 = 0"))
    exact = {x[:3:2] for x in wanted(asked, clustered, 10)}
    found = {x[:3:2] for x in rows(V.search(index, asked, "qid", "asked", 10, probes=4))}
    assert len(exact & found) >= 0.95 * len(exact)
    share = [r["scanned"] for r in V.scanned(index, asked, "qid", "asked", 4).collect()]
    assert len(share) == 48 and np.mean(share) < 0.25


@pytest.mark.parametrize("probes", [1, 5])
def test_exact_search_equals_a_scan_and_closes_lists(clustered, tmp_path, probes, monkeypatch):
    index = V.build(clustered, str(tmp_path / "v"), "vec_id", "embedding")
    asked = as_asked(clustered.where("vec_id % 100 = 3"))
    opened = []
    plain = V._scored
    monkeypatch.setattr(V, "_scored", lambda i, q, o, k, d: opened.append(len(o)) or plain(i, q, o, k, d))
    assert rows(V.search(index, asked, "qid", "asked", 7, probes=probes, exact=True)) == wanted(asked, clustered, 7)
    assert sum(opened) < 12 * index.centroids().count()  # not all lists for all queries


def test_odd_vectors(spark, tmp_path):
    """Zero, null, short and repeated vectors, ties, null elements, and a query of another size."""
    data = [(i, [float(i % 3), 1.0, 0.0]) for i in range(20)] + [(30, [0.0, 0.0, 0.0]), (31, None), (32, [1.0, 2.0]), (33, [2.0, 4.0]), (34, [-1.0, -1.0, 0.0]), (34, [-1.0, -1.0, 0.0]), (35, [])]
    vectors = spark.createDataFrame(data, SCHEMA).withColumn("list", F.lit("clash"))
    index = V.build(vectors, str(tmp_path / "v"), "vec_id", "embedding", lists=4)
    asked = as_asked(vectors.where("vec_id IN (0, 1, 30, 31, 32, 34)")).dropDuplicates(["qid"])
    assert rows(V.search(index, asked, "qid", "asked", 30, probes=1, exact=True)) == wanted(asked, vectors.dropna(subset=["embedding"]), 30)
    assert index.lists().count() == len(data) - 1
    nothing = V.build(vectors.limit(0), str(tmp_path / "e"), "vec_id", "embedding")
    assert V.search(nothing, asked, "qid", "asked", 3, exact=True).collect() == []
    assert V.search(index, asked.limit(0), "qid", "asked", 3).collect() == []

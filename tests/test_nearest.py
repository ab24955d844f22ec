"""The scan for nearest vectors: products of matrices choose, and give what a plain loop gives."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import vector as V

SCHEMA = "id long, v array<float>"


@pytest.mark.parametrize("limit", [10_000, 5])
def test_nearest_equals_a_plain_loop(spark, limit):
    """With ties, many equal vectors, zero vectors, vectors of other sizes, with a null in them, or null."""
    rng = np.random.default_rng(3)
    data = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(120, 6)).round(1).astype(np.float32))]
    data += [(i, [1.0, 2.0, 0.0, 0.0, 0.0, 1.0]) for i in range(200, 320)] + [(400, [0.0] * 6), (401, None), (402, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (403, [1.0, 2.0]), (404, [2.0, 4.0]), (405, [])]
    rows = spark.createDataFrame(data, SCHEMA).repartition(3).withColumn("label", F.col("id") % 3)
    asked = rows.where("id % 20 = 0 or id > 400").select(F.col("id").alias("qid"), F.col("v").alias("asked"), F.col("label").alias("own"))
    got = sorted((r.qid, r["rank"], r.id, r.score, r.own, r.label) for r in V.nearest(asked, rows, "qid", "asked", "id", "v", 7, limit).collect())
    wanted = []
    for q, a in data:
        if a is None or not (q % 20 == 0 or q > 400):
            continue
        scored = []
        for i, b in data:
            if b is not None and i != q and len(a) == len(b):
                x, y = np.array([np.nan if e is None else e for e in a], float), np.array([np.nan if e is None else e for e in b], float)
                size = np.sqrt(x @ x) * np.sqrt(y @ y)
                scored.append((-round(min(1.0, max(0.0, x @ y / size)), 6) if size > 0 else 0.0, i))
        wanted += [(q, n + 1, i, abs(s), q % 3, i % 3) for n, (s, i) in enumerate(sorted(scored)[:7])]
    assert [x[:3] + x[4:] for x in got] == [x[:3] + x[4:] for x in sorted(wanted)]
    assert [x[3] for x in got] == pytest.approx([x[3] for x in sorted(wanted)], abs=1e-6)


def test_no_pair_of_vectors_is_scored_by_rows(spark):
    """Of 2,000 rows and 40 asked vectors, few pairs are left when the plan comes to score them one by one."""
    data = [(i, v.tolist()) for i, v in enumerate(np.random.default_rng(4).normal(size=(2000, 8)))]
    rows = spark.createDataFrame(data, "id long, v array<double>").coalesce(1)
    asked = rows.where("id % 50 = 0").select(F.col("id").alias("qid"), F.col("v").alias("asked"))
    assert V._near(asked, rows, "qid", "asked", "id", "v", 5).count() < 40 * 12

"""Sums over tiles of links against plain loops, and the links that ranks are made of."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import graph as G
from sparkloom.operators import link_tiles as T


@pytest.mark.parametrize("block, sent", [(1 << 17, 1 << 24), (16, 0)])
def test_ranks_and_hits_equal_plain_loops(spark, monkeypatch, block, sent):
    """In one block or in many, with vectors sent to all or shuffled, and with a hub that most nodes link to."""
    monkeypatch.setattr(T, "BLOCK", block)
    monkeypatch.setattr(T, "SENT", sent)
    monkeypatch.setattr(T, "ROW_LINKS", 50)
    monkeypatch.setattr(T, "HELD", 2)
    rng = random.Random(4)
    links = [(f"n{rng.randrange(90)}", f"n{rng.randrange(60, 150)}") for _ in range(300)] + [(f"n{i}", "hub") for i in range(120)]
    links += links[:20]
    frame = spark.createDataFrame(links, "src string, dst string")
    topic = spark.createDataFrame([("hub", 2.0), ("n5", 1.0), ("nowhere", 5.0)], "id string, weight double")
    graph = T.LinkTiles(frame)
    ranks, found = G.page_ranks(graph, [None, topic], rounds=7), {r.id: r for r in G.tiled_hits(graph, 3).collect()}
    ranks = [{r.id: r["rank"] for r in x.collect()} for x in ranks]
    graph.close()
    ids = sorted({x for link in links for x in link})
    place = {x: i for i, x in enumerate(ids)}
    m = np.zeros((len(ids), len(ids)))
    for a, b in set(links):
        m[place[a], place[b]] = 1
    out = m.sum(1)
    for weight, got in zip(({x: 1.0 for x in ids}, {"hub": 2.0, "n5": 1.0}), ranks):
        p = np.array([weight.get(x, 0.0) for x in ids])
        p = r = p / p.sum()
        for _ in range(7):
            r = 0.15 * p + 0.85 * (m.T @ (r / np.maximum(out, 1)) + r[out == 0].sum() * p)
        assert [got[x] for x in ids] == pytest.approx(list(r / r.sum()))
    h = np.ones(len(ids))
    for _ in range(3):
        a = m.T @ h
        a /= np.sqrt(a @ a)
        h = m @ a
        h /= np.sqrt(h @ h)
    assert [found[x].hub for x in ids] == pytest.approx(list(h / h.max()))
    assert [found[x].authority for x in ids] == pytest.approx(list(a / a.max()))


def test_no_links(spark):
    none = spark.createDataFrame([], "src long, dst long")
    assert G.page_rank(none, rounds=2).count() == 0 and G.hits(none, rounds=2).count() == 0


def test_files_are_deleted(spark):
    graph = T.LinkTiles(spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long"))
    graph.tiles(), graph.tiles(back=True)
    paths = [graph._path, *(p for _, p in graph._made.values())]
    exists = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(p))
    assert all(map(exists, paths))
    graph.close()
    assert not any(map(exists, paths))

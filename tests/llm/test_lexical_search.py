"""Block-max search against brute force, SQL and by what it leaves closed."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import lexical_search as search
from sparkloom.llm.queries import SQL, op11_lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    """The contract's formula, document by document."""
    found = [(i, terms(t)) for i, t in docs]
    n_docs, n_terms = sum(bool(t) for _, t in found), sum(len(t) for _, t in found)
    df = Counter(t for _, own in found for t in set(own))
    out = []
    for item, text in items:
        scored = []
        for doc, own in found:
            tf = Counter(own)
            score = 0
            for t in set(terms(text)) & tf.keys():
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                m = 100 - 50 + (50 * len(own) * n_docs) // n_terms
                score += w * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 20 * m))
            if score > 0:
                scored.append((-score, doc is None, doc))
        scored.sort(key=lambda s: s if not s[1] else s[:2])
        out += [(item, r + 1, d, -s) for r, (s, _, d) in enumerate(scored[:k])]
    return out


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=lambda r: (str(r[0]), r[1]))


def made(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Größe", "日本", "x_y", "a-b", "KK", "naïve"]
    texts = [" ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(len(words))], k=rng.randint(0, 60))) for _ in range(n)]
    return [(i, t) for i, t in enumerate(texts)] + [(n + i, texts[i % 5]) for i in range(40)]  # many copies, so many ties


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_brute_force_in_small_blocks(spark, seed):
    docs = made(seed, 300)
    items = [(i, " ".join(random.Random(i).choices([f"w{j}" for j in range(60)], k=5))) for i in range(12)] + [(50, None), (51, "!!"), (52, docs[0][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    index = search.build(frame, block_bytes=2000)
    assert index.forward.select("block").distinct().count() > 20
    got = rows(search.search(index, spark.createDataFrame(items, "item_id long, text string"), k=7))
    assert got == sorted(brute(docs, items, 7), key=lambda r: (str(r[0]), r[1]))
    index.drop()


def test_bounds_leave_blocks_closed(spark):
    """Blocks that can't hold one of the best are not opened, and the bound of a block is at least its documents' best score."""
    docs = [(i, f"common common filler{i % 7} filler{i % 11}" + (" rare rare rare" if i in (17, 18, 19) else "")) for i in range(400)]
    index = search.build(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), block_bytes=1000)
    queries = search.Queries([1], ["rare common"])
    search.weigh(index, queries)
    wanted = brute(docs, [(1, "rare common")], 400)
    bounds = {r["block"]: r["bound"] for r in search.block_bounds(index, queries).collect()}
    of = {r["doc_id"]: r["block"] for r in index.forward.select("doc_id", "block").collect()}
    assert len(bounds) > 20
    for block, bound in bounds.items():
        assert bound >= max(s for _, _, d, s in wanted if of[d] == block)
    third = wanted[2][3]
    assert sum(b >= third for b in bounds.values()) <= 3  # of all blocks: those that hold the three
    got = search.search(index, spark.createDataFrame([(1, "rare common")], "item_id long, text string"), k=3)
    assert rows(got) == wanted[:3]
    index.drop()


def test_cut_blocks_have_larger_bounds():
    """A block whose rows come in two tasks gets rows of maxima from both; bounds only grow."""
    made = pa.table({"block": [5, 5, 5, 6], "n": [2, 3, 2, 1], "terms": pa.array([[b"a", b"b"], [b"a"], [b"b"], [b"a"]], pa.list_(pa.binary())), "tf": pa.array([[1, 1], [3], [2], [1]], pa.list_(pa.int32()))})
    queries = search.Queries([0], ["a b"])
    queries.weights[:] = 1

    def bound(batches, block):
        found = [r for b in search.largest(batches, 4, 8) for r in b.to_pylist() if r["block"] == block]
        within = queries.within(pa.array([t for r in found for t in r["terms"]], pa.binary()))
        return queries.bounds(within, np.array([m for r in found for m in r["most"]]))[0]

    whole = made.combine_chunks().to_batches()
    both = [made.slice(0, 2).combine_chunks().to_batches()[0], made.slice(2).combine_chunks().to_batches()[0]]
    assert bound(whole, 5) == bound(both, 5)  # batches of one task are joined
    assert bound(both[:1], 5) + bound(both[1:], 5) >= bound(whole, 5) > bound(whole, 6)


def test_nulls_repeats_ties_strings_and_empty_tables(spark, docs, empty):
    items = spark.createDataFrame([("q", "cat quiet alpha", 1.0), ("q", "cat quiet alpha", 2.0), ("none", None, 0.0), ("id", "row without id", 0.0)], "item_id string, text string, score double")
    index = search.build(docs)
    got = rows(search.search(index, items, k=50))
    own = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    wanted = brute(own, [("q", "cat quiet alpha")], 50) * 2 + brute(own, [("id", "row without id")], 50)
    assert got == sorted(wanted, key=lambda r: (str(r[0]), r[1]))
    assert any(r[2] is None for r in got)
    index.drop()
    nothing = search.build(empty)
    assert search.search(nothing, items).collect() == []
    assert search.search(index, items.limit(0)).collect() == []
    nothing.drop()
    named = spark.createDataFrame([("b", "cat"), ("a", "cat"), (None, "cat")], "doc_id string, text string")
    index = search.build(named.withColumn("block", F.lit("clash")))
    assert [r[2] for r in rows(search.search(index, items.where("score = 1"), k=3))] == ["a", "b", None]
    index.drop()


def test_query_equals_sql_and_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = sorted(tuple(r) for r in op11_lexical(spark, folder).collect())
    assert got == sorted(con.execute(SQL["op11_lexical"]).fetchall())
    docs, items = (con.execute(f"SELECT * FROM (SELECT {k}, text FROM {t})").fetchall() for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert got == sorted(brute(docs, items, 50))

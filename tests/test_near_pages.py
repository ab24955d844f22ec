"""The filter of near pages against the sequential rule that it stands for."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from sparkloom.operators import graph as G

SEEDS = 24


def signature(text):
    words = re.findall("[a-z0-9]{3,}", (text or "").lower())
    if not words:
        return ()
    runs = {" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))}
    return tuple(min(hashlib.sha1(f"{k}:{r}".encode()).hexdigest()[:16] for r in runs) for k in range(SEEDS))


def sequential(pages, threshold=0.90):
    """Pages in order; one that is like an earlier one that stayed goes."""
    stayed, kept = [], {}
    for key, text in sorted(pages):
        own = signature(text)
        kept[key] = not own or all(sum(x == y for x, y in zip(own, s)) / SEEDS < threshold for s in stayed)
        if own and kept[key]:
            stayed.append(own)
    return kept


def test_whole_table_equals_the_sequential_rule(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html")
    got = {r["page_id"]: r["kept"] for r in G.near_page_filter(pages, "page_id", F.col("html")).collect()}
    assert got == sequential([tuple(r) for r in pages.collect()])


def test_chains_wordless_pages_and_repeats(spark):
    rng = random.Random(9)
    base = [f"word{i}" for i in range(400)]
    pages = []
    for i in range(120):  # each a small change of one before it, so that likeness is not transitive
        text = list(base if i % 7 else [f"other{i}_{j}" for j in range(60)])
        for _ in range(rng.randint(0, 6)):
            text[rng.randrange(len(text))] = f"new{rng.randrange(9)}"
        pages.append((i, " ".join(text)))
    pages += [(200, "!!"), (201, "?? --"), (202, "a b"), (203, None), (204, ""), (205, "two words"), (206, "two words")]
    frame = spark.createDataFrame(pages, "page_id long, html string").withColumn("class", F.lit("clash"))
    got = {r["page_id"]: r["kept"] for r in G.near_page_filter(frame, "page_id", F.col("html")).collect()}
    assert got == sequential(pages)
    assert [got[i] for i in (200, 201, 202, 203, 204, 205, 206)] == [True] * 6 + [False]
    assert G.near_page_filter(frame.limit(0), "page_id", F.col("html")).collect() == []


def test_a_crowded_band_is_compared_with_leaders_alone(spark, monkeypatch):
    """10,000 classes that share two of three bands are decided by one comparison each, not by 5 x 10^7 pairs."""
    common = F.array(*(F.lit(f"{i:016x}") for i in range(SEEDS - 1)), F.format_string("%016x", F.col("id") + 1000))
    found = spark.range(10_000).select(F.col("id").alias("p"), common.alias("signature"))
    left = []
    plain = G.links_of
    monkeypatch.setattr(G, "links_of", lambda classes, threshold: left.append(classes.count()) or plain(classes, threshold))
    kept = [r["p"] for r in G.first_leaders(found, "p").where("kept").collect()]
    assert kept == [0] and left == [0]

"""The prefix-filtered join of sets against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import set_join as J
from sparkloom.operators.rerank import question_shortcut

SCHEMA = "id long, k array<string>"


def made(seed, n, size):
    rng = random.Random(seed)
    words = [f"w{i:02d}" for i in range(80)]
    return [(i, rng.choices(words, weights=[1 / (1 + j) ** 1.1 for j in range(80)], k=rng.randint(0, size))) for i in range(n)]


def scores(a, b, least):
    x, y = set(a), set(b)
    n = len(x & y)
    return 0.75 * n / len(x) + 0.15 * n / len(y) if n >= least else 0.0


@pytest.mark.parametrize("seed", [1, 2])
def test_shortcut_equals_all_pairs(spark, seed):
    asked, bank = made(seed, 60, 25), made(seed + 10, 80, 30)
    got = question_shortcut(spark.createDataFrame(asked, SCHEMA), spark.createDataFrame(bank, SCHEMA), ["id"], "k", "id")
    wanted = {i: max((scores(k, b, 2) for _, b in bank), default=0) for i, k in asked}
    assert {r["id"]: round(r["score"], 9) for r in got.collect()} == {i: round(s, 9) for i, s in wanted.items()}


def test_matches_equal_all_pairs(spark):
    asked, bank = made(5, 60, 25), [(i % 40, k) for i, k in made(6, 120, 12)]
    asked += [(100, bank[3][1] + ["tail"]), (101, bank[7][1][:4]), (102, None), (103, ["one"]), (104, [])]
    bank += [(50, None), (51, [])]
    frames = spark.createDataFrame(asked, SCHEMA), spark.createDataFrame(bank, "item long, k array<string>")
    got = sorted((r["id"], r["item"], round(r["score"], 6), r["rank"]) for r in J.bank_matches(*frames, ["id"], "item", "k").collect())
    wanted = []
    for i, k in asked:
        q = list(dict.fromkeys(k or []))[:16]
        best = {}
        for item, b in bank:
            if len(q) >= 2 and b and len(set(q) & set(b)) >= 2:
                lq, lb = " ".join(q), " ".join(b)
                best[item] = max(best.get(item, 0), scores(q, b, 2) + (0.10 if lq in lb else 0.06 if lb in lq else 0))
        ranked = sorted((-round(s, 9), item) for item, s in best.items() if s >= 0.24)[:2]
        wanted += [(i, item, round(-s, 6), r + 1) for r, (s, item) in enumerate(ranked)]
    assert got == sorted(wanted)


def test_common_members_are_no_keys(spark):
    """A member of nearly all sets is behind the rarer ones and keys none of them; pairs are made once."""
    rng = random.Random(3)
    rows = [(i, ["the", *rng.sample([f"w{j}" for j in range(400)], 9)]) for i in range(300)]
    frame = spark.createDataFrame(rows, SCHEMA)
    common = J.common_members(frame, "k")
    sorted_ = J.rare_first(frame, ["id"], "k", common)
    assert all(r["k"][-1] == "the" for r in sorted_.collect())
    need = J.least_shared(0.24)
    keys = J.prefixes(sorted_, spark.createDataFrame([(9,)], "class int"), "k", need).select("key").distinct()
    assert keys.where("key = 'the'").count() == 0
    pairs = J.overlaps(sorted_.withColumnRenamed("id", "a"), sorted_.withColumnRenamed("id", "b"), "k", lambda x, y: F.lit(4))
    got = [(r["a"], r["b"], r["shared"]) for r in pairs.collect()]
    sets = {i: set(k) for i, k in rows}
    assert sorted(got) == sorted((a, b, len(sets[a] & sets[b])) for a in sets for b in sets if len(sets[a] & sets[b]) >= 4)

"""What queries over whole texts shuffle, and that they still give all rows."""

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import search as S
from sparkloom.operators import set_join as J
from sparkloom.operators.rerank import question_shortcut


def exchanges(frame):
    return frame._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_bigrams_meet_their_pairs_where_texts_are_read(spark):
    rng = random.Random(1)
    texts = [(i, " ".join(rng.choices("a b c d e".split(), k=rng.randint(0, 12)))) for i in range(40)] + [(90, None), (91, ""), (92, "a")]
    frame = spark.createDataFrame(texts, "doc long, text string").repartition(4)
    pairs = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "b"), ("e", "x"), ("x", "e"), (None, "a")], "a string, b string")
    tokens = F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0))
    got = S.text_bigram_counts(frame, pairs, "doc", tokens)
    held = [list(zip(w, w[1:])) for w in ((t or "").split() for _, t in texts)]
    assert {(r.a, r.b): r.n for r in got.collect()} == {p: sum(p in h for h in held) for p in [("a", "b"), ("b", "b"), ("e", "x"), ("x", "e"), (None, "a")]}
    assert "collect_list" not in got._jdf.queryExecution().optimizedPlan().toString()  # no places are gathered


@pytest.mark.parametrize("block", [10_000, 7])
def test_best_match_shuffles_no_asked_set(spark, block):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(30)]
    make = lambda n, most: [(i, rng.choices(words, k=rng.randint(0, most))) for i in range(n)]
    asked, bank = make(70, 20) + [(100, None), (101, []), (102, ["other", None])], make(40, 15) + [(200, None)]
    frames = spark.createDataFrame(asked, "id long, k array<string>"), spark.createDataFrame(bank, "item long, k array<string>")
    found = J.best_match(*frames, ["id"], "k", block=block)
    wanted = {}
    for i, k in asked:
        q = set(k or []) - {None}
        wanted[i] = round(max([0.75 * len(q & set(b)) / len(q) + 0.15 * len(q & set(b)) / len(set(b)) for _, b in bank if b and len(q & set(b)) >= 2], default=0), 9)
    assert {r.id: round(r.score, 9) for r in found.collect()} == wanted
    if block == 10_000:
        assert exchanges(found) == 0
        assert exchanges(question_shortcut(*frames, ["id"], "k", "item")) == 0


def test_rocchio_deals_texts_once(spark, tmp_path):
    """Terms of documents are never dealt by term, nor by document and term: one exchange of texts, and those of small tables."""
    from sparkloom.queries import QUERIES

    rows = [(i, f"word{i % 7} other{i % 5} common", "en" if i % 2 else "de") for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = QUERIES["rocchio"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    dealt = {line.split("Exchange ")[1].split("ENSURE")[0].split("REPARTITION")[0] for line in plan.splitlines() if "Exchange hashpartitioning" in line}
    assert dealt and not any("term" in x for x in dealt)

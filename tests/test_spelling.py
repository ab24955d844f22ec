"""All tiers of the correction of words, by hand."""

from pyspark.sql import functions as F

from sparkloom.functions.text import soundex_strict
from sparkloom.operators import search as S


def test_tiers_and_adoption(spark):
    texts = (
        ["acute sepsis therapy"] * 7 + ["acute serpis therapy"] * 9 + ["severe sepals noted"] * 12 + ["rabert came"] * 6 + ["robert went"] * 6
        + ["rupertxx went"] * 2 + ["renal failure"] * 5 + ["renal failury"] + ["ashcroft"] * 3 + ["ashcrafted"] * 2
    )
    docs = spark.createDataFrame(list(enumerate(texts)), "doc long, text string")
    index = S.postings(docs, "doc", F.split("text", " "))
    asked = [
        ("sepsys", None, None),  # one edit from sepsis alone, two from serpis and sepals: distance wins over df
        ("sepsia", "acute", "therapy"),  # the same, beside its neighbours
        ("serals", "severe", None),  # one edit from sepals, two from serpis and sepsis
        ("failure", "renal", None),  # held by five documents: no correction is tried
        ("failurx", "renal", None),  # one edit from both failure and failury: the neighbour's count decides
        ("rbrtaaa", None, None),  # far from all by edits
        ("sep", None, None),  # too short
        ("two words", None, None),
        ("zzzzzz", "acute", None),  # no candidate
    ]
    frame = spark.createDataFrame(asked, "word string, left string, right string")
    got = {r["word"]: r for r in S.corrections(frame, S.vocabulary(index, "doc"), index, "doc").collect()}
    assert {w: (r["term"], r["tier"], r["distance"]) for w, r in got.items() if w.startswith("s")} == {
        "sepsys": ("sepsis", "edit", 1), "sepsia": ("sepsis", "edit", 1), "serals": ("sepals", "edit", 1)}
    assert got["sepsia"]["context"] == 14 and got["sepsys"]["context"] == 0
    assert (got["failurx"]["term"], got["failurx"]["context"]) == ("failure", 5)
    assert not {"failure", "sep", "two words", "zzzzzz"} & got.keys()
    assert S.corrections(frame.limit(0), S.vocabulary(index, "doc"), index, "doc").collect() == []
    none = index.where("term <> 'sepsis'")  # documents that may be used hold no sepsis: the best correction isn't adopted
    left = {r["word"] for r in S.corrections(frame, S.vocabulary(index, "doc"), none, "doc").collect()}
    assert "sepsys" not in left and "serals" in left


def test_sound_tier(spark):
    """A candidate three edits away has the same code, and wins only where none is within two."""
    docs = spark.createDataFrame([(i, "robberted") for i in range(3)] + [(9, "robertson")], "doc long, text string")
    index = S.postings(docs, "doc", F.split("text", " "))
    codes = spark.createDataFrame([("roabberted",), ("robertt",), ("ashcraft",)], "w string").select(soundex_strict(F.col("w")).alias("c"))
    assert [r["c"] for r in codes.collect()] == ["R163", "R163", "A226"]
    asked = spark.createDataFrame([("ruberted", None, None), ("raburtid", None, None)], "word string, left string, right string")
    got = {r["word"]: (r["term"], r["tier"], r["distance"]) for r in S.corrections(asked, S.vocabulary(index, "doc"), index, "doc", least=0.0).collect()}
    assert got == {"ruberted": ("robberted", "edit", 2), "raburtid": ("robberted", "sound", None)}

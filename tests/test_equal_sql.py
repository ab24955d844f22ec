"""Rows on which a query once differed from its SQL."""

import duckdb
import pytest

from sparkloom.queries import QUERIES, SQL


@pytest.fixture
def both(spark, tmp_path):
    """A query's rows over tables of these rows, and its SQL's, each sorted."""

    def run(name, **tables):
        con = duckdb.connect()
        for table, (columns, rows) in tables.items():
            spark.createDataFrame(rows, columns).coalesce(1).write.parquet(f"{tmp_path}/{name}/{table}.parquet")
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{name}/{table}.parquet/*.parquet'")
        got = QUERIES[name](spark, f"{tmp_path}/{name}")
        want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({SQL[name]})").fetchall()
        return sorted(map(tuple, got.collect())), sorted(want)

    return run


TURNS = "conv_id long, turn int, role string, text string"


def test_answer_quality_at_a_tenth(both):
    """Two of 13 and 27 words are a tenth of 40 halves: the harmonic mean of the shares comes out below .1."""
    words = lambda *spans: " ".join(f"w{i:03}" for a, b in spans for i in range(a, b))
    rows = [r for n in range(5, 40) for r in ((n, 0, "user", words((0, n))), (n, 1, "assistant", words((0, 2), (100, 100 + 40 - n - 2))))]
    got, want = both("answer_quality", conversations=(TURNS, rows))
    assert got == want
    assert {r[-1] for r in want if r[2] == 0.1} == {"attention"}


def test_query_ambiguity_keeps_letters_without_a_plain_form(both):
    """The SQL takes marks off and keeps other letters, so a word is not found across them."""
    texts = ["toßs", "tós", "TÓS seca", "liçense", "license", "ﬁebre", "fiébre y dolor", "x" * 40, "1 tos", "", None]
    got, want = both("query_ambiguity", conversations=(TURNS, [(i, 0, "user", x) for i, x in enumerate(texts)]))
    assert got == want


def test_spam_score_keeps_letters_without_a_plain_form(both):
    long = "<html><title>{}</title><p>" + "some plain words " * 5 + "{}</p></html>"
    cases = [
        ("geßte", "beßte $$$", "u"), ("t", "bete $$$", "u"), ("t", "béte $$$", "u"), ("Promoción", "ofertà casino", "u"), ("t", "!!!!!!!! bet", "u"),
        ("t", "$$$", "https://prómo.net"), ("t", "$$$", "https://promo.net"), ("A" * 200, "$$$", "u"),
    ]
    rows = [(i, u, long.format(title, words)) for i, (title, words, u) in enumerate(cases)] + [(90, "u", "ß" * 30 + "$$$"), (91, "u", "ß" * 50 + "$$$"), (92, None, "$$$ bet")]
    got, want = both("spam_score", pages=("page_id long, url string, html string", rows))
    assert got == want


def test_qa_shortcut_rounds_ties_as_sql(both):
    """7 of 48 and 21 words score .159375, which the SQL rounds down, and 3 of 15 and 16 score .178125, which it rounds up."""
    words = lambda *spans: " ".join(f"w{i:03}" for a, b in spans for i in range(a, b))
    asked = [(n, i, "user", words((0, i), (100, 100 + n - i))) for n in range(10, 60) for i in (3, 7)] + [(99, 0, "user", ""), (98, 0, "user", None)]
    bank = [(n, words((0, 7), (200, 200 + n - 7))) for n in (8, 16, 21, 30)]
    got, want = both("qa_shortcut", conversations=(TURNS, asked), benchmark=("item_id long, text string", bank))
    assert got == want

"""Every query runs, and those with SQL give DuckDB's rows, at the smallest scale."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from sparkloom.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: One query of each kind; the driver compares all.
SOME = "keyword_search boolean_expr phrase_match wildcard_kgram audit_summary scorecard_rollup episode_kpi alert_rules memory_topn context_pack quality_gate question_generation minhash_signature eval_ranking cluster_quality nb_multinomial rocchio bayes_posterior history_select actionability near_page_pairs rules_sepsis rules_qsofa gap_encoding vector_topk".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v if isinstance(v, bool) or v is None or isinstance(v, str) else float(f"{float(v):.8g}") if not hasattr(v, "year") else str(v)


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    got = sorted((tuple(map(plain, r)) for r in frame.select(*columns).collect()), key=str)
    found = duck.sql(SQL[name])
    assert sorted(found.columns) == columns
    places = [found.columns.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in places) for r in found.fetchall()), key=str)
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).columns == ["qid", "doc_id", "score", "rank"]
    assert set(SQL) <= set(QUERIES) <= set(entry.queries())

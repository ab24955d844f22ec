"""Fixtures worked out by hand, and invariants, for operators that SQL can't check."""

import datetime as dt
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.functions import codecs
from sparkloom.functions import text as X
from sparkloom.operators import evaluate, graph, ingest, learn, relational, rerank, rules, vector
from sparkloom.plans import boolean
from sparkloom.streaming import throttle


def rpn(query):
    return [str(t) for t in boolean.postfix(query)]


def test_boolean_language():
    assert rpn("(neutropenia OR fiebre) AND cultivos NOT pediatria") == ["neutropenia", "fiebre", "OR", "cultivos", "AND", "pediatria", "NOT", "AND"]
    assert rpn('"shock septico" NOT pediatria') == ['"shock septico"', "pediatria", "NOT", "AND"]
    assert [str(t) for t in boolean.lex("dolor /3 pecho AND fiebre")] == ["NEAR(dolor,pecho,3)", "AND", "fiebre"]
    assert rpn("(a OR b") == [] and rpn("a AND") == [] and rpn("/3 a") == ["a"]


def test_boolean_evaluation(spark):
    texts = [(1, "shock septico en adultos"), (2, "shock cardiogenico"), (3, "septico y shock"), (4, "nada")]
    docs = spark.createDataFrame(texts, "chunk_id long, text string")
    from sparkloom.operators.search import postings

    index = postings(docs, "chunk_id", X.ir_tokens(F.col("text")))
    ask = lambda q: sorted(r.chunk_id for r in boolean.evaluate(q, index, docs).collect())
    assert ask('"shock septico"') == [1]
    assert ask("shock /1 septico") == [1, 3]
    assert ask("shock NOT septico") == [2]
    assert ask("NOT shock") == [4]
    assert ask("nada OR cardiogenico") == [2, 4]


def test_phonetic_and_edit_distance(spark):
    rows = spark.createDataFrame([("Hermann",), ("Herman",), ("Ashcraft",), ("",)], "w string")
    assert [r.c for r in rows.select(X.soundex_strict(F.col("w")).alias("c")).collect()] == ["H655", "H655", "A226", ""]
    pairs = spark.createDataFrame([("oncologia", "xyz"), ("igual", "igual")], "a string, b string")
    assert [r.d for r in pairs.select(X.edit_distance(F.col("a"), F.col("b"), 2).alias("d")).collect()] == [3, 0]


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(1, 10**6), max_size=60))
def test_codecs_round_trip(ids):
    ids = sorted(ids)
    assert codecs.from_gaps(codecs.to_gaps(ids)) == ids
    assert codecs.decode_bytes(codecs.encode_bytes(codecs.to_gaps(ids))) == codecs.to_gaps(ids)
    assert codecs.decode_gamma(codecs.encode_gamma(codecs.to_gaps(ids))) == codecs.to_gaps(ids)


def test_markdown_blocks():
    text = "# H1\n## H2\n| a | b |\n\n- [x] done\n- item\nplain text"
    got = ingest.markdown_blocks(text)
    assert [k for k, _, _ in got] == ["section_header", "section_header", "table", "checklist", "list", "paragraph"]
    assert got[-1][2] == "Documento > H1 > H2"
    assert ingest.markdown_blocks("") == []


def test_chunks_keep_all_words_within_size():
    r = random.Random(1)
    for _ in range(20):
        text = "\n".join(" ".join("w" * r.randrange(1, 9) for _ in range(r.randrange(1, 400))) for _ in range(8))
        parts = [(b[1], b[2]) for b in ingest.markdown_blocks(text)]
        chunks = ingest.pack(parts, size=100, overlap=0)
        assert " ".join(c[0] for c in chunks).split() == text.split()
        assert all(ingest.tokens_of(c[0]) <= 200 for c in chunks)  # words are counted without the spaces between them
    assert ingest.tokens_of("abc") == 1 and ingest.tokens_of("a" * 9) == 2


def test_quality_gate_reasons(spark):
    rows = spark.createDataFrame([(1, "abc")], "doc long, text string")
    got = ingest.quality_gate(rows, "doc", F.length("text")).first()
    assert got.reasons == ["min_total_chars", "min_avg_chunk_chars"]


def test_scorecard_status(spark):
    kinds = ["match"] * 10 + ["under", "over"]
    rows = spark.createDataFrame([("a", k) for k in kinds] + [("b", "under")] * 12, "domain string, classification string")
    got = {r.domain: r for r in relational.scorecard(rows).collect()}
    assert (got["a"].under_rate, got["a"].over_rate, got["a"].match_rate, got["a"].status) == (8.33, 8.33, 83.33, "atencion")
    assert got["b"].status == "degradado" and got["total"].total == 24
    levels = spark.createDataFrame([(3, 2), (2, 3), (1, 1)], "ai int, human int")
    assert [r.d for r in levels.select(relational.deviation(F.col("ai"), F.col("human"), inverted=True).alias("d")).collect()] == ["under", "over", "match"]


def test_ranking_metrics(spark):
    rows = [(1, i + 1, g, 4) for i, g in enumerate([1, 0, 1, 0, 0])] + [(2, i + 1, g, 3) for i, g in enumerate([1, 0, 1, 1])]
    frame = spark.createDataFrame(rows, "q long, rank int, gain int, total int")
    got = {r.q: r for r in evaluate.ranking_metrics(frame, "q", "rank", "gain", "total", 5).collect()}
    assert (got[1].precision, got[1].recall, got[1].f1) == (0.4, 0.5, pytest.approx(0.444444))
    assert got[2].ap == pytest.approx(0.805556)
    raters = spark.createDataFrame([(1, 1), (0, 0), (1, 1), (0, 0)], "a int, b int")
    assert evaluate.kappa(raters, "a", "b", []).first().kappa == 1.0
    assert evaluate.kappa(raters.limit(0), "a", "b", []).first().kappa is None


def test_cluster_metrics_of_a_perfect_clustering(spark):
    rows = spark.createDataFrame([("a", 0), ("a", 0), ("b", 1), ("b", 1)], "t string, c int")
    got = evaluate.cluster_quality(rows, "t", "c").first()
    assert (got.purity, got.nmi, got.rand, got.f) == (1.0, 1.0, 1.0, 1.0)


def test_page_rank_sums_to_one_and_favours_trusted(spark):
    links = spark.createDataFrame([("trusted.org/a", "x"), ("x", "y"), ("y", "x")], "src string, dst string")
    plain = {r.id: r["rank"] for r in graph.page_rank(links, rounds=20).collect()}
    trusted = spark.createDataFrame([("trusted.org/a", 1.0)], "id string, weight double")
    topic = {r.id: r["rank"] for r in graph.page_rank(links, trusted, rounds=20).collect()}
    assert sum(plain.values()) == pytest.approx(1) and sum(topic.values()) == pytest.approx(1)
    assert topic["trusted.org/a"] > plain["trusted.org/a"]
    got = graph.hits(links, rounds=5).collect()
    assert max(r.hub for r in got) == max(r.authority for r in got) == 1.0


def test_canonical_urls(spark):
    urls = ["HTTP://Ex.com/a/?utm_source=x&b=1#f", "https://ex.com", "ftp://x/y", "https://ex.com/a;p?gclid=1", "mailto:x"]
    rows = spark.createDataFrame([(u,) for u in urls], "u string")
    got = [r.c for r in rows.select(X.canonical_url(F.col("u")).alias("c")).collect()]
    assert got == ["http://ex.com/a?b=1", "https://ex.com/", None, "https://ex.com/a", None]


def test_clusters(spark):
    r = np.random.default_rng(2)
    centres = np.eye(4) * 5
    x = np.concatenate([c + r.normal(0, 0.1, (30, 4)) for c in centres])
    truth = np.repeat(np.arange(4), 30)
    for linkage in ("single", "complete", "average"):
        got = learn.agglomerate(x / np.linalg.norm(x, axis=1, keepdims=True), 4, linkage)
        assert all(len(set(got[truth == c])) == 1 for c in range(4)) and len(set(got)) == 4
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<double>")
    for found in (learn.kmeans(rows, "k", "v", 4), learn.buckshot(rows, "k", "v", 4)):
        got = {q.k: q.cluster for q in found.collect()}
        assert all(len({got[i] for i in range(30 * c, 30 * c + 30)}) == 1 for c in range(4))


def test_svm_separates(spark):
    rows = [(i, "a" if i % 2 else "b", [1.0, 0.1 * (i % 3)] if i % 2 else [-1.0, 0.1]) for i in range(40)]
    frame = spark.createDataFrame(rows, "k long, label string, v array<double>")
    w = {r.label: r.weights for r in learn.ova_svm(frame, "label", "v", "k").collect()}
    assert w["a"][0] > 0 > w["b"][0]


def test_vectors(spark):
    row = spark.createDataFrame([([1.0, 0.0], [-1.0, 0.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>")
    got = row.select(vector.cosine(F.col("a"), F.col("b")), vector.cosine(F.col("a"), F.col("b"), clip=False), vector.cosine(F.col("a"), F.col("z"))).first()
    assert tuple(got) == (0.0, -1.0, 0.0)
    h = spark.createDataFrame([("x",)], "t string").select(vector.hash_embedding(F.col("t")).alias("v")).first().v
    assert len(h) == 384 and h[:32] == h[32:64] and max(map(abs, h)) <= 1


def test_mmr_prefers_variety(spark):
    rows = [(1, 1, [1.0, 0.0], 1.0), (1, 2, [1.0, 0.01], 1.0), (1, 3, [0.7, 0.7], 0.9)]
    frame = spark.createDataFrame(rows, "q long, d long, v array<double>, lex double").withColumn("asked", F.array(F.lit(1.0), F.lit(0.2)))
    got = [r.d for r in rerank.mmr(frame, "q", "d", "v", "asked", "lex", 3, lam=0.5).orderBy("rank").collect()]
    assert got[0] == 2 and sorted(got) == [1, 2, 3]


def test_sepsis_rules(spark):
    schema = "respiratory_rate int, systolic_bp int, altered boolean, infection boolean, map int, lactate double, minutes int"
    rows = spark.createDataFrame([(22, 100, True, True, None, None, None), (None,) * 7], schema)
    got = rules.SEPSIS.apply(rows).collect()
    assert (got[0].qsofa, got[0].severity, got[0].alerts) == (3, "high", [])
    assert (got[1].qsofa, got[1].severity, got[1].alerts) == (0, "low", [])
    lines = spark.createDataFrame([(4.0,), (14.0,), (30.0,)], "h double")
    assert [r.t for r in lines.select(rules.toxic_threshold(F.col("h")).alias("t")).collect()] == [150.0, 87.5, 25.0]


def test_login_throttle_states():
    state, seen = (0.0, 0, 0.0), []
    for at in (0, 10, 20, 30, 40, 50, 700):
        state, blocked = throttle.step(state, float(at), True)
        seen.append(blocked)
    assert seen == [False] * 5 + [True, False] and state[1] == 1
    assert throttle.step((0.0, 4, 0.0), 301.0, True)[0] == (301.0, 1, 0.0)
    assert throttle.step((0.0, 4, 0.0), 5.0, False)[0] == (0.0, 0, 0.0)


def test_login_throttle_stream(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [("u", start + dt.timedelta(seconds=10 * i), True) for i in range(8)] + [("v", start, False)]
    spark.createDataFrame(rows, "user string, ts timestamp, failed boolean").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user string, ts timestamp, failed boolean").parquet(str(tmp_path / "in"))
    run = throttle.throttle_stream(stream, "user", "ts", "failed").writeStream.format("memory").queryName("throttled")
    run = run.option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    run.processAllAvailable()
    run.stop()
    assert {(r.user, r.attempts, r.blocked) for r in spark.table("throttled").collect()} == {("u", 8, 3), ("v", 1, 0)}


def test_gauges_stream(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [("click", start + dt.timedelta(minutes=i)) for i in range(30)]
    spark.createDataFrame(rows, "kind string, ts timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("kind string, ts timestamp").parquet(str(tmp_path / "in"))
    run = throttle.gauges(stream, "ts", "5 minutes", "10 minutes", "kind").writeStream.format("memory").queryName("gauged")
    run = run.option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    run.processAllAvailable()
    run.stop()
    assert {r.n for r in spark.table("gauged").collect()} <= {10}


def test_layout_blocks_of_three_shapes(spark):
    from sparkloom.sources import layout

    rows = [
        (1, '{"blocks": [{"type": "Title", "content": " A "}, {"type": "equation", "text": "x=1", "page": 2}, {"type": "text", "content": ""}]}'),
        (2, '{"pdf_info": [{"page_idx": 4, "para_blocks": [{"type": "text", "text": "b"}]}]}'),
        (3, '{"pages": [{"blocks": []}, {"blocks": [{"category": "table", "content": "c", "section": "S"}]}]}'),
        (4, "not json"),
        (5, None),
    ]
    got = [tuple(r) for r in layout.blocks(spark.createDataFrame(rows, "doc long, j string"), "doc", "j").drop("bbox").orderBy("doc", "nth").collect()]
    assert got == [
        (1, 0, "header", "A", "Documento > Pagina 1", 1),
        (1, 1, "formula", "$$x=1$$", "Documento > Pagina 2", 2),
        (2, 0, "paragraph", "b", "Documento > Pagina 5", 5),
        (3, 0, "table", "c", "S", 2),
    ]


def test_soft_and_divisive_clusters(spark):
    r = np.random.default_rng(3)
    x = np.concatenate([c + r.normal(0, 0.05, (20, 3)) for c in np.eye(3) * 4])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = learn.divide(unit, 3)
    assert len(got) == 60 and len(set(got)) == 3  # the second seed is the nearest member, so splits need not be the best
    assert len(set(learn.divide(unit, 1))) == 1 and len(learn.divide(unit[:0], 3)) == 0
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<double>")
    soft = learn.soft_clusters(rows, "k", "v", 3, rounds=3).collect()
    assert len(soft) == 180
    for i in range(60):
        assert sum(s.weight for s in soft if s.k == i) == pytest.approx(1)
    assert max(s.weight for s in soft if s.k == 0) > 0.9
    assert learn.choose_k(rows, "k", "v", vocabulary=1000, least=2, most=3) == 2


def test_window_span_and_godel(spark):
    from sparkloom.operators import routing

    row = spark.createDataFrame([(["neutropenia", "x", "fiebre", "y", "cultivos", "fiebre"],)], "t array<string>")
    assert row.select(routing.smallest_window(F.col("t"), ["neutropenia", "fiebre"])).first()[0] == 3
    assert row.select(routing.smallest_window(F.col("t"), ["neutropenia", "z"])).first()[0] is None
    assert routing.from_godel(routing.godel([3, 0, 5])) == [3, 0, 5] and routing.godel([]) is None
    assert routing.continuity([["a", "b"], ["a", "b"]]) == pytest.approx(1) and routing.continuity([["a"]]) == 0

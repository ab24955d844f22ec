"""Readers and writers on small files, and cuts of lineage."""

import json

from pyspark.sql import functions as F

from sparkloom.plans.cut import checkpoint
from sparkloom.sources import tables as S


def test_text_tree(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.md").write_text("# X\nbody")
    (tmp_path / "y.TXT").write_text("plain")
    (tmp_path / "z.bin").write_text("no")
    got = {r.path.rpartition("/")[2]: r.content for r in S.text_tree(spark, str(tmp_path)).collect()}
    assert got == {"x.md": "# X\nbody", "y.TXT": "plain"}


def test_json_lines_pass_over_bad_ones(spark, tmp_path):
    lines = [json.dumps({"query": "a", "k": 1}), "", "{broken", json.dumps({"query": "b"})]
    (tmp_path / "q.jsonl").write_text("\n".join(lines))
    got = S.json_lines(spark, str(tmp_path / "q.jsonl"), "query string, k int").where("query is not null").orderBy("query").collect()
    assert [(r.query, r.k) for r in got] == [("a", 1), ("b", None)]


def test_upsert_replace_and_cache(spark):
    rows = spark.createDataFrame([(1, "old", 1), (1, "new", 2), (2, "x", 1)], "id long, v string, t int")
    assert {(r.id, r.v) for r in S.upsert(rows, ["id"], [F.desc("t")]).collect()} == {(1, "new"), (2, "x")}
    fresh = spark.createDataFrame([(1, "again", 3)], "id long, v string, t int")
    assert {(r.id, r.v) for r in S.replace_by_source(rows, fresh, "id").collect()} == {(1, "again"), (2, "x")}
    texts = spark.createDataFrame([("a",), ("b",)], "text string")
    cache = texts.limit(1).select(F.sha2("text", 256).alias("key"), F.array(F.lit(1.0)).alias("vector"))
    got = {r.text: r.vector for r in S.cached_vectors(texts, cache).collect()}
    assert sorted(v is None for v in got.values()) == [False, True]
    assert S.memory_document(spark, "c", "t").first().content == "c"


def test_bulk_payload(spark):
    row = S.bulk_payload(spark.createDataFrame([(7, "x")], "id long, t string"), "id", "chunks").first()
    action, body, rest = row.payload.split("\n")
    assert json.loads(action) == {"index": {"_index": "chunks", "_id": "7"}} and json.loads(body) == {"id": 7, "t": "x"} and rest == ""


def test_checkpoint_cuts_lineage(spark):
    cut = checkpoint(spark.range(10).withColumn("x", F.col("id") * 2))
    assert "Range" not in cut._jdf.queryExecution().toString() and cut.count() == 10


def test_page_sink_and_snapshot(spark, tmp_path):
    from sparkloom.sources import sinks

    page = [("http://Ex.com/a", "Ex.com", 1, "seed", "", "body", 1.5, 200, [("http://y.org/", "to y"), ("http://z.org/", None)])]
    schema = "url string, host string, depth int, discovered_from string, title string, text string, fetched_at double, status_code int, links array<struct<href:string,anchor:string>>"
    pages = spark.createDataFrame(page, schema)
    r = sinks.page_records(pages).first()
    assert r.file.startswith("ex.com/") and r.file.endswith(".md") and len(r.file) == len("ex.com/") + 14 + 3
    assert r.markdown == "# Web source\n\n- source_url: http://Ex.com/a\n- host: Ex.com\n- fetched_at_epoch: 1.500\n- depth: 1\n\nbody\n"
    line = json.loads(r.manifest)
    assert line["outgoing_edges"] == [{"url": "http://y.org/", "anchor": "to y"}, {"url": "http://z.org/", "anchor": ""}] and line["links_discovered"] == 2
    sinks.write_pages(pages, str(tmp_path / "out"))
    sinks.write_pages(pages, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out/manifest")).count() == 2 and spark.read.json(str(tmp_path / "out/pages")).count() == 2
    rank = spark.createDataFrame([(1, 0.2), (2, 0.8)], "id long, rank double")
    hub = spark.createDataFrame([(1, 0.5, 1.0), (2, 1.0, 0.5)], "id long, hub double, authority double")
    anchors = spark.createDataFrame([(1, ["a", "b"]), (1, ["a"])], "id long, words array<string>")
    sinks.write_snapshot(sinks.link_snapshot(rank, rank, hub, anchors), str(tmp_path / "snap"))
    got = {r.id: r for r in sinks.read_snapshot(spark, str(tmp_path / "snap")).collect()}
    assert got["1"].global_pagerank_norm == 0.25 and got["1"].incoming_anchor_terms == {"a": 2, "b": 1} and got["2"].hits_hub_norm == 1.0


def test_parsed_blocks_traces_and_thesaurus(spark, tmp_path):
    from sparkloom.sources import sinks

    text = "intro\n[Page 2]\nmore\n# A\n\n## B\n|x|y|\n|1|2|\n# C\nend"
    docs = spark.createDataFrame([(1, text), (2, None)], "d long, t string")
    got = [tuple(r) for r in sinks.parsed_blocks(docs, "d", "t").collect()]
    assert got == [
        (1, 0, "text", "intro", "Documento > Pagina 1", 1), (1, 1, "text", "more", "Documento > Pagina 2", 2),
        (1, 2, "table", "|x|y|\n|1|2|", "Documento > A > B", 2), (1, 3, "text", "end", "Documento > C", 2),
    ]
    files = spark.createDataFrame([("x.MD", "[Page 1]\na\n[page 2]\nb"), ("y.bin", "z"), ("e.txt", " ")], "path string, content string")
    assert [tuple(r)[1:] for r in sinks.parse_trace(files, "path", "content").collect()] == [("markdown", 21, 2, True), ("unsupported", 1, 1, False), ("text", 0, 1, False)]
    (tmp_path / "t.json").write_text(json.dumps({" Sepsis ": ["a", "A", "sepsis", "b", "", "c", "d", "e"]}))
    got = sinks.thesaurus(spark, str(tmp_path / "t.json")).collect()
    assert {r.synonym for r in got} == {"a", "b", "c", "d"} and {r.term for r in got} == {"sepsis"}


def test_audit_rows_regression_and_gauges(spark):
    from sparkloom.operators import relational
    from sparkloom.sources import sinks

    rows = spark.createDataFrame([(1, 2, 3), (2, 3, 3), (3, 3, 1)], "id long, ai int, human int")
    assert [r.classification for r in sinks.audit_row(rows, F.col("ai"), F.col("human")).orderBy("id").collect()] == ["under", "match", "over"]
    runs = spark.createDataFrame([(2, "q", "b", "d"), (1, "q", "a", "d"), (3, "z", "c", "d")], "id long, query string, answer string, domain string")
    assert [json.loads(r.value)["expected_answer"] for r in sinks.regression_set(runs, F.col("query") == "q").collect()] == ["a"]
    gauge = sinks.exposition(runs, F.lit("g"), F.col("id"), {"q": F.concat("query", F.lit('"'))}, "what").orderBy("nth").collect()
    assert [r.line for r in gauge][:3] == ["# HELP g what", "# TYPE g gauge", 'g{q="q\\""} 1']
    flags = relational.AUDITED["scasest"]
    log = spark.createDataFrame([("match", True, True, None, None), ("under", True, False, True, None)], "classification string, " + ", ".join(f"ai_{f} boolean, human_{f} boolean" for f in flags))
    r = relational.domain_audit(log, flags, []).first()
    assert (r.total, r.under_rate, r[f"{flags[0]}_match_rate"], r[f"{flags[1]}_match_rate"]) == (2, 50.0, 50.0, 50.0)


def test_rankings_follow_rewritten_documents(spark, tmp_path):
    """In one session, an index is made anew once its documents change, and kept while they don't."""
    from sparkloom.queries import QUERIES, search

    folder = str(tmp_path)
    texts = lambda word: spark.createDataFrame([(i, f"{word} {word} filler{i}", "src0", "en", 20) for i in range(6)], "doc_id long, text string, source string, lang string, n_chars long")
    spark.createDataFrame([(0, "walnut"), (1, "cedar")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    texts("walnut").write.parquet(f"{folder}/documents.parquet")
    found = lambda: {r["qid"] for r in QUERIES["bm25_topk"](spark, folder).collect()}
    assert found() == {0}
    first = search.INDEX.of(spark.read.parquet(f"{folder}/documents.parquet"), folder)
    assert search.INDEX.of(spark.read.parquet(f"{folder}/documents.parquet"), folder) is first
    texts("cedar").write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    assert found() == {1}
    texts("walnut").withColumn("doc_id", F.col("doc_id") + 10).write.mode("append").parquet(f"{folder}/documents.parquet")
    assert found() == {0, 1}
    search.INDEX.forget()
    assert found() == {0, 1}


def test_evaluation_rows_need_a_query(spark, tmp_path):
    lines = ['{"query": "a", "k": 1}', '{"k": 2}', '{"query": "  "}', "no json", "", '{"query": null}', '{"query": "b"}']
    (tmp_path / "e.jsonl").write_text("\n".join(lines))
    assert sorted(r["query"] for r in S.evaluation_rows(spark, str(tmp_path / "e.jsonl"), "query string, k long").collect()) == ["a", "b"]


def test_acceptance(spark):
    from sparkloom.operators.evaluate import acceptance

    rows = spark.createDataFrame([(1, 0.35, "x", None), (2, 0.2, "0.5", 1.0)], "id long, precision double, ndcg string, recall double")
    got = {r["id"]: r["failures"] for r in acceptance(rows, {"precision": 0.35, "ndcg": 0.6, "recall": 0.1, "none": 1.0}).collect()}
    assert got == {1: ["ndcg:invalid", "recall:missing", "none:missing"], 2: ["precision:0.2000<0.3500", "ndcg:0.5000<0.6000", "none:missing"]}
    assert [r["failures"] for r in acceptance(rows, {}).collect()] == [[], []]

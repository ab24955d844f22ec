"""Fixtures worked out by hand for evidence, ranking, graph, learning and the rules around an answer."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import text as X
from sparkloom.operators import assistant, evidence, graph, ingest, learn, rerank, routing, rules, search, vector
from sparkloom.plans import boolean


def one(spark, **columns):
    """A row of these texts, numbers and lists, and a function that evaluates a column on it."""
    frame = spark.createDataFrame([tuple(columns.values())], list(columns))
    return lambda column: frame.select(column.alias("x")).first().x


def test_grammar_of_boolean_queries():
    rpn = lambda q: [str(t) for t in boolean.postfix(q)]
    assert rpn("a b OR c") == ["a", "b", "AND", "c", "OR"] and rpn("NOT NOT a") == ["a", "NOT", "NOT"]
    assert rpn("a AND (b OR NOT c) d") == ["a", "b", "c", "NOT", "OR", "AND", "d", "AND"]
    assert rpn(")") == rpn("()") == rpn("a OR") == rpn("a OR OR b") == rpn("(a))") == rpn("") == []
    assert rpn('"covid-19 cases"') == ['"covid-19 cases"']
    term = boolean.Operand
    assert boolean.contexts("uno dos OR tres")[term(("dos",))] == ("uno", "tres")
    assert boolean.split_terms("a (b OR c) NOT d") == {"include": ["a"], "optional": ["b", "c"], "exclude": ["d"]}
    assert boolean.split_terms("dolor de pecho agudo") == {"include": [], "optional": ["dolor", "pecho", "agudo"], "exclude": []}


def test_hyphenated_phrases_and_needless_universe(spark):
    docs = spark.createDataFrame([(1, "new covid-19 cases"), (2, "covid 19 cases"), (3, "other")], "chunk_id long, text string")
    index = search.postings(docs, "chunk_id", X.ir_tokens(F.col("text")))
    ask = lambda q, u=docs: sorted(r.chunk_id for r in boolean.evaluate(q, index, u).collect())
    assert ask('"covid-19 cases"') == [1] and ask("NOT covid-19") == [3] and ask("other OR NOT cases") == [3]
    assert ask("cases NOT new", None) == [2]
    assert ask("a OR") == []


def test_phonetic_codes_fold_marks(spark):
    at = one(spark, w="Peña")
    assert at(X.soundex_strict(F.col("w"))) == "P500"


def test_overlap_evidence_and_action(spark):
    at = one(spark, q=["tratamiento", "antibiotico", "dosis", "sepsis"], t=["antibioticos", "sepsis", "tratar"], s="Iniciar antibiotico 2 mg y control 5 %", bare="!!")
    both = at(evidence.overlap(F.col("q"), F.col("t")))
    assert both == round((1 + 0.7) / math.log2(6), 4)  # tratamiento is left out of soft matches
    assert at(evidence.evidence(F.col("s"))) == round(3 * 0.12 + 2 * 0.06, 4)  # iniciar, antibiot, control
    got = at(evidence.actionability(F.col("s"), F.lit(0.5), F.lit(0.4), F.lit(0.2)))
    # words: iniciar antibiotico mg control; one action, all different
    assert got.score == pytest.approx(0.35 * 0.5 + 0.25 * 0.2 + 0.2 * 0.4 + 0.12 / 3 + 0.08, abs=1e-4) and got.aux_ratio == 0
    assert tuple(at(evidence.actionability(F.col("bare"), F.lit(1.0), F.lit(1.0), F.lit(1.0)))) == (0.0, 1.0)


def test_roles_zones_and_claims(spark):
    at = one(spark, a="Protocolo y dosis; contexto", b="historia y contexto", c="nada", d="Se recomienda segun datos", e="objetivo: metodo")
    assert tuple(at(evidence.rhetorical_role(F.col("a")))) == ("nucleus", round(2 / 3, 4))
    assert tuple(at(evidence.rhetorical_role(F.col("b")))) == ("satellite", 1.0) and tuple(at(evidence.rhetorical_role(F.col("c")))) == ("neutral", 0.5)
    assert at(evidence.claim_premise(F.col("d"))) == 1.0 and at(evidence.claim_premise(F.col("c"))) == 0.0
    assert at(evidence.argument_zone(F.col("e"))) == "aim" and at(evidence.argument_zone(F.col("c"))) == "none"


def test_source_bias(spark):
    at = one(spark, q="pasos para dolor", k=["pasos", "para", "dolor"], doc="docs/urgencias.md", raw="docs/pdf_raw/x.pdf", none="")
    bias = lambda source: at(evidence.source_bias(F.col("q"), F.col("k"), F.col(source), F.col("none"), F.col("none")))
    assert at(evidence.is_generic(F.col("q"), F.col("k"))) is True
    assert bias("doc") == 0.24 and bias("raw") == -0.28


def test_verifier(spark):
    rows = [(1, "a", 0.8, 0.5), (1, "b", 0.55, 0.9), (1, "c", 0.1, 0.9), (2, "d", 0.9, 0.1), (2, "e", 0.2, 0.1), (3, "f", 0.6, 0.6)]
    frame = spark.createDataFrame(rows, "q long, d string, v double, r double")
    assert {(x.d, x.score) for x in evidence.verified(frame, "q", "v", "r").collect()} == {("a", 0.8), ("b", 0.795), ("f", 0.6)}


def test_compression(spark):
    text = "Primera frase sobre sepsis. " + "Otra frase larga sin relacion alguna con la pregunta. " * 3 + "Lactato y sepsis al final."
    rows = [(1, text, ["sepsis", "lactato"]), (2, "corto", []), (3, "x" * 100, []), (4, None, ["sepsis"]), (5, "", []), (6, " " * 80, []), (7, "A b c. " + "Sepsis " * 12 + ". D.", ["sepsis"])]
    frame = spark.createDataFrame(rows, "id long, body string, asked array<string>").withColumn("text", F.lit("clash"))
    got = {r["id"]: r for r in evidence.squeezed(frame, ["id"], "body", "asked", 60).collect()}
    assert got[1]["text"] == "Primera frase sobre sepsis. Lactato y sepsis al final." and got[1]["chars"] == len(text)
    assert got[2]["text"] == "corto" and got[3]["text"] == "x" * 60 and got[4]["text"] == got[5]["text"] == "" and got[6]["text"] == " " * 60
    assert got[7]["text"] == ("Sepsis " * 12)[:60]  # the first one taken stays, however long


def test_coherence_measures():
    units = [["sepsis", "lactato", "shock"], ["sepsis", "fiebre"], ["shock", "sepsis"]]
    assert evidence.entity_grid(units, ["sepsis"]) == 1.0  # goes on twice, and the centre does
    assert evidence.entity_grid(units, ["lactato"]) == 0.35 and evidence.entity_grid(units[:2], ["sepsis"]) == 0.65
    assert evidence.latent_coherence(["sepsis"], [["sepsis"]]) == 0.0  # fewer than four terms
    assert 0 < evidence.latent_coherence(["sepsis", "shock"], units) <= 1
    assert evidence.chain_cohesion(["sepsis"], units) == round(0.55 * 5 / 7 + 0.30 + 0.15 * 2 / 4, 4)
    assert evidence.local_coherence(["una sola"]) == 0.0
    a = evidence.local_coherence(["el shock septico con lactato", "por ello el shock septico con lactato"])
    b = evidence.local_coherence(["por ello el shock septico con lactato", "el shock septico con lactato"])
    assert a > b  # a connector may follow but not open
    assert evidence.topic_alignment([0.5, 0.1], [1.0, 0.0]) == round(0.25 + 0.175 + 0.075, 4)


def test_discourse_rerank_limits_satellites(spark):
    zero = dict.fromkeys(evidence.WEIGHTS, 0.5)
    rows = [(1, i, "satellite" if i else "nucleus", "aim", 0.9 - i / 10, *zero.values()) for i in range(6)]
    frame = spark.createDataFrame(rows, ["q", "d", "role", "zone", "retrieval", *zero])
    got = evidence.discourse_rerank(frame, "q", "d").orderBy("rank").collect()
    assert [x.d for x in got] == [0, 1, 2, 3, 4]  # ceil(.6 * 6) satellites stay
    assert got[0].coherence == round(0.5 * sum(evidence.WEIGHTS.values()) + 0.08 * 0.6, 4)


def test_reflection_stops_when_it_is_enough(spark):
    rows = [(1, 1, 0.9, ["a", "b"]), (1, 2, 0.8, ["a", "b"]), (1, 3, 0.7, ["c", "d"]), (1, 4, 0.1, ["e"])]
    frame = spark.createDataFrame(rows, "q long, d long, base double, tokens array<string>").withColumn("asked", F.array(*map(F.lit, "abcd")))
    got = evidence.reflect(frame, "q", "d", "base", "tokens", "asked").orderBy("rank").collect()
    assert [x.d for x in got] == [1, 2] and got[1].evidentiality == round(0.75 * 0.85 + 0.25 * 0.5, 4)
    far = evidence.reflect(frame, "q", "d", "base", "tokens", "asked", threshold=2.0).orderBy("rank").collect()
    assert [x.d for x in far] == [1, 2, 3, 4]


def test_extractive_answer_avoids_repeats(spark):
    long = "iniciar tratamiento de la sepsis grave con antibiotico en una hora"
    said = [long, long + " ya", "priorizar el control del lactato y de la sepsis con monitor continuo", "corto"]
    rows = [(1, 1, i, s, [w for w in s.split() if len(w) > 2]) for i, s in enumerate(said)]
    frame = spark.createDataFrame(rows, "q long, doc long, nth int, sentence string, tokens array<string>")
    frame = frame.select("*", F.array(F.lit("sepsis"), F.lit("lactato")).alias("asked"), F.lit(0.8).alias("retrieval"), F.lit(0.1).alias("bias"), F.lit(False).alias("generic"))
    got = evidence.extractive_answer(frame, "q", items=2).orderBy("rank").collect()
    assert [g.sentence[:9] for g in got] == ["priorizar", "iniciar t"] and all(g.sentence.endswith(".") for g in got)


def test_early_goal(spark):
    rows = [(1, 0.7, 0.6, 0.3), (1, 0.2, 0.9, 0.9), (2, 0.7, 0.5, 0.9)]
    frame = spark.createDataFrame(rows, "q long, score double, action double, retrieval double")
    assert {(x.q, x.reached) for x in evidence.early_goal(frame, "q").collect()} == {(1, True), (2, False)}


def test_static_quality_and_proximity(spark):
    at = one(spark, t="Motor Operativo", s="docs/a.md", e="Pasos > Recomendacion", p="sepsis", none="")
    assert at(search.static_quality(F.col("t"), F.col("s"), F.col("e"), F.col("p"))) == pytest.approx(0.92)
    assert at(search.static_quality(F.col("none"), F.col("none"), F.col("none"), F.col("none"))) == 0
    r = random.Random(1)
    texts = [(i, " ".join(r.choice("abcdxyz") for _ in range(r.randrange(2, 40)))) for i in range(60)]
    docs = spark.createDataFrame(texts, "d long, text string")
    asked = ["a", "b", "c"]
    scored = docs.select(F.lit(1).alias("q"), "d", F.array(*map(F.lit, asked)).alias("active"), F.size(F.array_intersect(F.split("text", " "), F.array(*map(F.lit, asked)))).alias("present"))
    got = {x.d: x for x in search.proximity(scored, docs, "q", "d", F.split("text", " ")).collect()}
    for i, t in texts:
        w = t.split()
        spans = [k - j + 1 for j in range(len(w)) for k in range(j, len(w)) if set(asked) <= set(w[j : k + 1])]
        assert got[i].span == min(spans, default=None) and got[i].proximity == pytest.approx(min(1, 3 / min(spans)) if spans else 0)


def test_hosts_spam_and_addresses(spark):
    at = one(spark, a="www.nih.gov", b="x.edu", c="Ex.com", u="https://ex.com/a", title="CASINO BONUS NOW BUY NOW TODAY", s="click here!!! " + "a" * 9, fine="A plain snippet that is longer than forty characters.")
    assert [at(graph.host_authority(F.col(c))) for c in "abc"] == [0.98, 0.88, 0.55]
    assert at(graph.crawl_priority(F.col("a"), F.lit(2))) == 82 and at(graph.queue_of(F.lit(82), 4)) == 0 and at(graph.queue_of(F.lit(1), 4)) == 3
    # a short snippet, cries, a long run, three spam words, capitals
    assert at(graph.spam_score(F.col("title"), F.col("s"), F.col("u"))) == 1 + 2 + 2 + 3 + 1
    assert at(graph.spam_score(F.lit("A title"), F.col("fine"), F.col("u"))) == 0
    urls = spark.createDataFrame([("HTTP://Ex.com/a/?q=1#f",), ("//ex.com",), ("ex.com/A",), (None,)], "u string")
    assert [r.b for r in urls.select(graph.bare_url(F.col("u")).alias("b")).collect()] == ["http://ex.com/a", "https://ex.com/", "ex.com/a", ""]


def test_near_signatures_lose_no_pair_and_first_wins(spark):
    r = random.Random(4)
    base = [[f"{r.getrandbits(64):016x}" for _ in range(24)] for _ in range(12)]
    rows = []
    for i in range(120):
        s = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 3, 4])):
            s[r.randrange(24)] = f"{r.getrandbits(64):016x}"
        rows.append((i, s))
    found = spark.createDataFrame(rows, "p long, signature array<string>")
    members, links = graph.near_signatures(found, "p", 24, 0.90)
    like = lambda a, b: sum(x == y for x, y in zip(a, b)) / 24
    first = {}
    for i, s in rows:
        first.setdefault(tuple(s), i)
    want = {(a, b) for s, a in first.items() for t, b in first.items() if a < b and like(s, t) >= 0.9}
    assert {(x.a, x.b) for x in links.collect()} == want
    kept = []
    for i, s in rows:
        if all(like(s, rows[k][1]) < 0.9 for k in kept):
            kept.append(i)
    assert {x.p for x in graph.first_wins(members, links, "p").collect() if x.kept} == set(kept)
    none = found.where("p < 0")
    members, links = graph.near_signatures(none, "p")
    assert graph.first_wins(members, links, "p").count() == 0


def test_signatures_equal_plain_hashing(spark):
    import hashlib

    texts = ["uno dos tres cuatro cinco", "solo", "a b"]
    rows = spark.createDataFrame(list(enumerate(texts)), "d long, t string")
    got = {x.d: x.signature for x in graph.signatures(rows, "d", F.col("t"), 3).collect()}
    for i, shingles in enumerate([["uno dos tres", "dos tres cuatro", "tres cuatro cinco"], ["solo"], [""]]):
        assert got[i] == [min(hashlib.sha1(f"{k}:{s}".encode()).hexdigest()[:16] for s in shingles) for k in range(3)]


def test_anchors_and_base_set(spark):
    anchors = spark.createDataFrame([(1, ["sepsis", "x"]), (1, ["y", "z"]), (2, ["sepsis"])], "id long, words array<string>")
    assert {(x.id, x.anchor) for x in graph.anchor_relevance(anchors, ["sepsis"]).collect()} == {(1, 0.375), (2, 1.0)}
    links = spark.createDataFrame([(1, 3), (4, 2), (5, 6)], "src long, dst long")
    topic = spark.createDataFrame([(1, 0.5), (2, 0.4)], "id long, rank double")
    base = graph.base_set(links, anchors, topic.limit(0).select("id"), ["sepsis"], topic)
    assert sorted(x.id for x in base.collect()) == [1, 2, 3, 4]
    assert {x.id for x in graph.query_hits(links, base, 2).collect()} == {1, 2, 3, 4}


def test_svm_steps_by_hand(spark):
    # step 1: rate 20, the weights are empty, both margins are 0; then each step shrinks before it looks
    rows = spark.createDataFrame([(0, "a", [1.0, 0.0]), (1, "b", [0.0, 1.0])], "k long, label string, v array<double>")
    got = {r.label: r for r in learn.ova_svm(rows, "label", "v", "k", epochs=1).collect()}
    # class a: w = 20, b = 20; second step rate 10: w shrinks to 10, margin -(20) < 1, so w = (10, -10), b = 10
    assert got["a"].weights == pytest.approx([10.0, -10.0]) and got["a"].bias == pytest.approx(10.0)
    assert got["b"].weights == pytest.approx([-10.0, 10.0]) and got["b"].bias == pytest.approx(-10.0)
    assert got["a"].support == 1 and got["a"].hinge == pytest.approx(0.5)


def test_priors_bernoulli_and_certainty(spark):
    classes = spark.createDataFrame([("a",), ("b",)], "c string")
    got = {r.c: r.prior for r in learn.class_priors(classes, "c", "A", ("b", "b")).collect()}
    assert got["a"] == pytest.approx(1.35 / 2.75) and got["b"] == pytest.approx(1.40 / 2.75)
    train = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "y", 1), ("b", "z", 1)], "c string, term string, tf long")
    asked = spark.createDataFrame([(1, "x", 1), (1, "q", 1)], "d long, term string, tf long")
    got = {r.c: r.score for r in learn.bernoulli_bayes(train, asked, "d", "c").collect()}
    p, q = math.log(2 / 3), math.log(1 / 3)
    assert got["a"] == pytest.approx(math.log(0.5) + p + q + p) and got["b"] == pytest.approx(math.log(0.5) + q + q + q)
    sure = learn.certainty(spark.createDataFrame([(1, "a", 0.0), (1, "b", math.log(3))], "d long, c string, score double"), "d", "c").first()
    assert (sure.top, sure.probability, sure.margin) == ("b", pytest.approx(0.75), pytest.approx(0.5)) and sure.entropy == pytest.approx(0.8112781, abs=1e-6)


def test_prototypes_cascade_and_questions(spark):
    rows = spark.createDataFrame([(1, "Oliguria y anuria"), (2, "nada")], "k long, t string")
    got = {r.k: r for r in learn.prototype_posterior(rows, "k", F.col("t"), {"renal": ("oliguria", "anuria"), "otro": ("fiebre", "tos")}).collect()}
    like = [0.99, 0.25 / (1 + math.sqrt(2))]
    assert got[1].top == "renal" and got[1].probability == pytest.approx(like[0] / sum(like)) and got[1].uncertainty == "low" and got[1].priority == "high"
    assert got[2].abstain and got[2].ood == pytest.approx(0.8) and got[2].ood_level == "high"
    frame = spark.createDataFrame([(["a", "b", "c"], "b", None)], "f array<string>, x string, y string")
    assert frame.select(learn.cascade(F.col("f"), [F.col("x"), F.col("y"), F.lit("d")]).alias("r")).first().r == ["d", "b", "a"]
    cands = spark.createDataFrame([("a", "1", 0.5), ("b", "2", 0.5)], "id string, cluster string, p double")
    like = spark.createDataFrame([("a", "f", 1.0), ("b", "f", 0.0), ("a", "g", 0.5)], "id string, feature string, p double")
    got = {r.feature: r for r in learn.question_gain(cands, like).collect()}
    h = -(0.95 * math.log2(0.95) + 0.05 * math.log2(0.05))
    assert got["f"].ig == pytest.approx(1 - h, abs=1e-4) and got["f"].div == 1.0 and got["f"].con == 0.5 and got["f"]["rank"] == 1
    assert got["g"].ig == 0 and got["g"].div == 0.2


def test_cluster_terms_and_candidates(spark):
    members = spark.createDataFrame([(1, 0, "x"), (2, 0, "x"), (3, 1, "y")], "d long, cluster int, c string")
    counts = spark.createDataFrame([(1, "a", 3), (2, "b", 1), (3, "b", 4)], "d long, term string, tf long")
    got = {r.cluster: r for r in learn.cluster_terms(members, counts, "d", "c").collect()}
    assert (got[0].size, got[0].dominant, got[0].terms) == (2, "x", ["a"]) and got[1].terms == ["b"]
    scores = spark.createDataFrame([(9, 0, 0.1), (9, 1, 0.9)], "q long, cluster int, similarity double")
    r = learn.cluster_candidates(scores, members, "q", "c").first()
    assert (r.cluster, r.classes, r.singleton) == (1, ["y"], True)


def test_logic_and_contracts(spark):
    cases = [
        ("Oliguria, K: 6,5 y ECG", "nephrology", ["nephro_hyperkalemia_critical"], "consistent"),
        ("Oliguria, K 5.9", "nephrology", [], "insufficient_evidence"),
        ("Cefalea con TA 165/112", "gynecology_obstetrics", ["obstetric_htn_severe"], "consistent"),
        ("Sepsis y shock", "nephrology", [], "insufficient_evidence"),
        ("Neutropenia sin fiebre", "oncology", ["oncology_neutropenia_fever"], "inconsistent"),
        ("Lactato alto, TA 85/40", "sepsis", ["sepsis_shock_operational"], "consistent"),
    ]
    rows = spark.createDataFrame([(i, t, d) for i, (t, d, _, _) in enumerate(cases)], "i long, t string, d string")
    none = F.array().cast("array<string>")
    got = {r.i: r.l for r in rows.select("i", assistant.logic(F.col("t"), F.array("d"), none).alias("l")).collect()}
    assert [(got[i].rules, got[i].status) for i in range(6)] == [(r, s) for _, _, r, s in cases]
    assert got[0].actions[0] == "Activar ruta nefrologia critica." and got[0].abstain is False
    found = {r.i: r.c for r in rows.select("i", assistant.contract(F.col("t"), F.col("d"), F.lit(False)).alias("c")).collect()}
    assert found[0].triggered and found[0].state == "needs_data" and found[0].missing == ["Tendencia de creatinina (basal vs actual)"]
    assert found[4] is None and found[2].fall_back is True


def test_ambiguity_findings_and_text_shapes(spark):
    at = one(spark, q="dolor", k=["dolor"], long="uno dos tres cuatro cinco seis siete ocho nueve diez de la", done="x" * 50 + ".", a="uno dos tres", b="dos tres cuatro")
    got = at(assistant.ambiguity(F.col("q"), F.col("k"), F.lit("other"), F.lit(0), F.lit(False)))
    assert got.score == round(0.47 * 7 / 8 + 0.28 + 0.20 + 0.10, 4) and got.ask
    assert not at(assistant.ambiguity(F.col("q"), F.col("k"), F.lit("management_plan"), F.lit(1), F.lit(True))).ask
    bank = {"general": {"default": "?", "dose": "d?"}, "renal": {"dose": "rd?"}}
    pick = lambda d, i: at(assistant.clarification(F.lit(d), F.lit(i), bank))
    assert (pick("renal", "dose"), pick("renal", "x"), pick("otro", "dose"), pick("otro", "x")) == ("rd?", "?", "d?", "?")
    words = lambda c: F.split(c, " ")
    assert at(assistant.suggestions(F.col("k"), ["dolor", "otra cosa", "otra cosa", "mas"], words, 2)) == ["otra cosa", "mas"]
    assert at(assistant.looks_truncated(F.col("long"))) and not at(assistant.looks_truncated(F.col("done")))
    assert at(assistant.looks_like_echo(F.lit("### Consulta: x"))) and not at(assistant.looks_like_echo(F.lit("bien")))
    assert at(assistant.continued(F.col("a"), F.col("b"))) == "uno dos tres cuatro" and at(assistant.continued(F.col("a"), F.lit("dos"))) == "uno dos tres"
    assert at(assistant.continued(F.col("a"), F.lit("y mas"))) == "uno dos tres y mas"
    none = F.array().cast("array<string>")
    note = lambda s, r, ok: [f.code for f in at(assistant.findings(s, F.lit(r), F.lit(ok), F.lit("clinical"), F.lit(0), F.lit(False), F.lit(False)))]
    assert note(none, "low", True) == ["security_baseline_ok"] and note(F.array(F.lit("x")), "high", False) == ["prompt_injection_signal", "dangerous_tool_blocked"]
    questions = spark.createDataFrame([(None,), ([],), (["¿Qué dice este fragmento?"],), (["¿Qué dice?"],), (["", " "],)], "q array<string>")
    assert [r.p for r in questions.select(assistant.placeholder_question(F.col("q")).alias("p")).collect()] == [True, True, True, False, True]
    assert at(assistant.prompt([("A", F.lit("x")), ("B", F.lit("")), ("C", F.lit("y"))], 100)) == "### A\nx\n\n### C\ny"
    assert at(assistant.compact(F.create_map(F.lit("k"), F.lit("v" * 300)))) == '{"k":"' + "v" * 180 + '"}'


def test_alerts_hold(spark):
    start = dt.datetime(2024, 1, 1)
    held = [0, 1, 1, 1, 0, 1, 1]
    rows = spark.createDataFrame([(start + dt.timedelta(minutes=i), h) for i, h in enumerate(held)], "t timestamp, h int")
    got = assistant.held_alerts(rows, "t", (("A", "warning", "h > 0", 2), ("B", "critical", "missing_rule IS NULL OR h < 0", 1))[:1]).collect()
    assert [(r.t - start).seconds // 60 for r in got] == [3]


def test_relevance_precedence(spark):
    rows = spark.createDataFrame([(q, d, f"text {d} sepsis" if d == 1 else "x") for q in (1, 2, 3) for d in (1, 2)], "q long, d long, t string")
    graded = spark.createDataFrame([(1, 2, 3), (1, 7, 1)], "q long, d long, grade int")
    expected = spark.createDataFrame([(1, 1), (2, 1), (2, 8)], "q long, d long")
    terms = spark.createDataFrame([(3, ["Sepsis"])], "q long, terms array<string>")
    got = {(r.q, r.d): (r.gain, r.total) for r in assistant.relevance(rows, "q", "d", F.col("t"), graded, expected, terms).collect()}
    assert got == {(1, 1): (0, 2), (1, 2): (3, 2), (2, 1): (1, 2), (2, 2): (0, 2), (3, 1): (1, 1), (3, 2): (0, 1)}


def test_queries_are_parted_and_compacted(spark):
    at = one(spark, a="dolor de pecho intenso; fiebre alta desde ayer", b="dolor de pecho y fiebre alta", c="pasos para sepsis grave con lactato alto: monitor")
    assert at(routing.segments(F.col("a"))) == ["dolor de pecho intenso", "fiebre alta desde ayer"]
    assert at(routing.segments(F.col("b"), least=6)) == ["dolor de pecho", "fiebre alta"] and at(routing.segments(F.lit("solo"))) == ["solo"]
    none = F.array().cast("array<string>")
    assert at(routing.compacted(F.col("c"), F.lit("complex"), none)) == "sepsis grave lactato alto monitor"
    assert at(routing.compacted(F.col("c"), F.lit("simple"), none)) == "pasos para sepsis grave con lactato alto: monitor"
    got = at(routing.intents(F.col("c"), {"plan": ("pasos",), "dosis": ("dosis",)}, {"plan": ("bundle", "ruta")}))
    assert got.intents == ["plan"] and got.expand == ["bundle", "ruta"]


def test_shortcut_specialties_questions(spark):
    asked = spark.createDataFrame([(1, ["a", "b", "c", "d"]), (2, ["z"])], "k long, t array<string>")
    bank = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "x"])], "i long, t array<string>")
    assert {r.k: r.score for r in rerank.question_shortcut(asked, bank, ["k"], "t", "i").collect()} == {1: pytest.approx(0.525), 2: 0.0}
    at = one(spark, p="docs/47_x.md", q="otro/Neurologia-1.pdf", r="nada.md", t="Shock con criterio GRACE > 140", s="Documento > Plan")
    assert [at(ingest.specialty(F.col(c))) for c in "pqr"] == ["sepsis", "neurology", None]
    assert at(ingest.keywords(F.col("t"))) == ["GRACE > 140", "grace", "shock"]
    got = at(ingest.questions(F.col("t"), F.col("s")))
    assert got == [
        "¿Cual es el manejo operativo de Plan?", "¿Cuales son los pasos iniciales para Plan?", "¿Que criterios de decision se describen en Plan?",
        "¿Que recomendaciones practicas se dan para GRACE > 140, grace?", "¿Como se integran shock, criterio dentro del plan operativo?",
    ]
    assert at(vector.distance_score(F.lit(3.0))) == 0.25
    rows = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [3.0, 6.0]), ("b", [5.0, 5.0])], "g string, v array<double>")
    assert {r.g: r.v for r in vector.mean_pool(rows, ["g"], "v").collect()} == {"a": [2.0, 4.0], "b": [5.0, 5.0]}
    assert np.isclose(sum(learn.class_priors(rows.select("g").distinct(), "g").toPandas()["prior"]), 1)


def judged(spark, engine, **values):
    """The one row of an engine over these findings; what is not named is unknown."""
    text = " ".join([p for parts in (*engine.scores.values(), *engine.lists.values()) for p, _ in parts] + [*engine.flags.values()] + [p for _, p in engine.levels])
    import re

    words = set(re.findall(r"[a-z_]+", re.sub(r"'[^']*'", "", text))) - {"coalesce", "false", "greatest", "least", "abs", *engine.scores, *engine.flags}
    kind = lambda n: "string" if n in ("site", "wood", "koh", "colour", "pattern", "sex", "antigen", "pathogen") else None
    numbers = {"respiratory_rate", "systolic_bp", "lactate", "map", "fluids", "minutes", "grace", "heart_rate", "oxygen", "age", "itch", "comorbidities", "baseline_bp", "current_bp", "onset_hours", "non_hdl", "apob"}
    row = {n: values.get(n) for n in words | values.keys()}
    schema = ", ".join(f"{n} {kind(n) or ('double' if n in numbers else 'boolean')}" for n in row)
    frame = spark.createDataFrame([tuple(float(v) if n in numbers and v is not None else v for n, v in row.items())], schema)
    return engine.apply(frame).first()


def test_engines_by_hand(spark):
    r = judged(spark, rules.SEPSIS_BUNDLE, respiratory_rate=24, systolic_bp=90, infection=True, antibiotics=True, lactate=4.5, fluids=30, minutes=61)
    assert (r.qsofa, r.high_risk, r.shock, r.severity) == (2, True, True, "critical")
    assert r.bundle == ["Extraer hemocultivos antes de antibiotico si no retrasa inicio."] and len(r.escalation) == 4 and len(r.alerts) == 4
    r = judged(spark, rules.SEPSIS_BUNDLE)
    assert (r.qsofa, r.severity, r.alerts) == (0, "low", ["Sin infeccion sospechada: validar pertinencia del protocolo."])
    r = judged(spark, rules.SCASEST, dyspnea=True, troponin=True, grace=141, no_antiplatelet=True, heart_rate=60, oxygen=89)
    assert (r.suspected, r.high_risk, r.severity) == (True, True, "high") and len(r.treatment) == 2 and len(r.escalation) == 2 and len(r.alerts) == 2
    r = judged(spark, rules.SCASEST, grace=150)
    assert (r.suspected, r.high_risk, r.escalation) == (False, False, ["Estratificar destino segun GRACE y evolucion clinica."])
    r = judged(spark, rules.RESPIRATORY, age=70, pathogen="covid", onset_hours=121, antigen="negativo", baseline_bp=140, current_bp=110)
    assert r.vulnerable and r.relative_shock and r.antiviral == ["Valorar Remdesivir IV 3 dias (<7 dias de inicio)."] and len(r.isolation) == 2
    r = judged(spark, rules.PITYRIASIS, age=20, site="tronco", scratch_sign=True, koh="positivo_spaghetti_albondigas", warm_pain=True)
    assert (r.versicolor, r.rosada, r.alba, r.severity) == (10, 0, 0, "versicolor") and len(r.red_flags) == 1
    assert judged(spark, rules.PITYRIASIS, age=12, herald_patch=True).severity == "indeterminado"  # 4 against 3
    r = judged(spark, rules.ACNE_ROSACEA, comedones=True, site="espalda", flushing=True)
    assert (r.acne, r.rosacea, r.severity) == (5, 2, "acne") and judged(spark, rules.ACNE_ROSACEA).severity == "rosacea"
    r = judged(spark, rules.CARDIO_RISK, age=66, smoker=True, systolic_bp=150, non_hdl=165)
    assert (r.score, r.severity) == (7, "high") and judged(spark, rules.CARDIO_RISK, established=True).severity == "very_high"
    frame = spark.createDataFrame([("moderate", 131.0, None, True, None), ("low", 100.0, None, None, None)], "severity string, non_hdl double, established boolean, diabetes boolean, smoker boolean")
    got = rules.cardio_plan(frame).collect()
    assert (got[0].ldl_target, got[0].drug_suggested, got[0].intensive_lifestyle) == (100, True, True) and (got[1].risk_percent, got[1].drug_suggested) == (4.0, False)

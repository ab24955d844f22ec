"""Re-ranking, dialogue memory, answer checks, row rules and the login throttle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import evidence as V
from ..operators import rerank as K
from ..operators import rules as U
from ..operators import routing as O
from ..operators.ingest import discourse_units
from ..operators.noise import clean_snippet
from ..operators.relational import top_per_group
from ..operators.set_join import bank_matches
from ..operators.vector import cosine, hash_embedding, mean_pool, windows
from ..plans.cut import checkpoint, small
from ..streaming.throttle import throttle
from .registry import Tables, query
from .search import RANK, _features, _top, _top_sql

TOK = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9]{{3,}}'))"
STOP = "(" + ", ".join(f"'{w}'" for w in X.RELEVANCE_STOP_WORDS) + ")"


@query()
def mmr_rerank(t: Tables) -> DataFrame:
    """For each label its mean vector is the query; the pool is its 200 vectors of highest relevance, of all."""
    asked = mean_pool(t.embeddings, ["label"], "embedding").withColumnRenamed("embedding", "asked")
    rows = t.embeddings.join(small(checkpoint(asked)), "label").withColumn("lexical", (F.col("vec_id") % 10).cast("double"))
    rows = rows.withColumn("near", 0.7 * cosine(F.col("embedding"), F.col("asked"), clip=False) + 0.3 * F.col("lexical") / 9)
    pool = top_per_group(rows, ["label"], [F.desc("near"), F.asc("vec_id")], 200, "n").drop("n", "near")
    return K.mmr(pool, "label", "vec_id", "embedding", "asked", "lexical", 5)


PAIR = r"""p AS (SELECT a.conv_id, a.turn, {q} AS q, {r} AS r FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)""".format(
    q=TOK.format("a.text"), r=TOK.format("b.text")
)


def _pairs(t: Tables) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = t.conversations.select("conv_id", "turn", "text", F.lead("text").over(w).alias("answer"), F.lead("turn").over(w).alias("nt")).where("nt = turn + 1")
    tokens = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]{3,}"), F.lit(0)))
    return rows.select("conv_id", "turn", "answer", tokens(F.col("text")).alias("q"), tokens(F.col("answer")).alias("r"))


def _in(words: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _count(words: tuple[str, ...], text: str = "x") -> str:
    return "(" + " + ".join(f"contains({text}, '{w}')::INT" for w in words) + ")"


OVERLAP = f"""CASE WHEN len(q) = 0 THEN 0 ELSE round(least(1.0, (len(list_intersect(q, r)) + 0.7 * coalesce(list_sum(list_transform(q, lambda t: CASE WHEN list_contains(r, t) OR length(t) < 5 OR t IN {_in(V.SOFT_EXCLUDED)} THEN 0.0
    WHEN len(list_filter(r, lambda w: length(w) >= 5 AND left(w, 5) = left(t, 5))) > 0 THEN 1.0
    WHEN length(t) >= 8 AND len(list_filter(r, lambda w: length(w) >= 8 AND left(w, 3) = left(t, 3))) > 0 THEN 0.5 ELSE 0.0 END)), 0)) / log2(2.0 + len(q)))::DOUBLE, 4) END"""


@query(f"WITH {PAIR} SELECT conv_id, turn, {OVERLAP} AS score FROM p")
def overlap_score(t: Tables) -> DataFrame:
    """A turn and the next one."""
    return _pairs(t).select("conv_id", "turn", V.overlap(F.col("q"), F.col("r")).alias("score"))


EVIDENCE = f"round(least(1.0, 0.12 * {_count(V.EVIDENCE_TERMS)} + 0.06 * len(regexp_extract_all(x, '{V.EVIDENCE_NUMBER}')))::DOUBLE, 4)"


@query(f"SELECT doc_id, {EVIDENCE} AS evidence FROM (SELECT doc_id, lower(text) AS x FROM documents)")
def evidence_score(t: Tables) -> DataFrame:
    """X3."""
    return t.documents.select("doc_id", V.evidence(F.col("text")).alias("evidence"))


@query(
    f"""WITH {PAIR}, x AS (SELECT conv_id, turn, {OVERLAP} AS o, {EVIDENCE} AS e, list_filter(regexp_extract_all(x, '[a-z0-9]{{2,}}'), lambda w: w NOT IN {_in(V.ACTION_STOP_WORDS)}) AS w
      FROM (SELECT p.*, lower(c.text) AS x FROM p JOIN conversations c ON p.conv_id = c.conv_id AND c.turn = p.turn + 1)),
    y AS (SELECT *, len(w) AS n, len(list_filter(w, lambda z: z IN {_in(V.AUXILIARIES)})) / greatest(1, len(w)) AS aux, least(1.0, len(list_filter(w, lambda z: z IN {_in(V.ACTIONS)})) / 3.0) AS act,
      len(list_distinct(w)) / greatest(1, len(w)) AS varied FROM x)
    SELECT conv_id, turn, CASE WHEN n = 0 THEN 0 ELSE round(round(greatest(0, least(1, 0.35 * o + 0.25 * e + 0.20 * 0.5 + 0.12 * act + 0.08 * varied - 0.18 * greatest(0, aux - 0.35)))::DOUBLE, 9)::DECIMAL(12, 9), 4) END::DOUBLE AS score,
    CASE WHEN n = 0 THEN 1 ELSE round(aux, 4) END::DOUBLE AS aux_ratio FROM y"""
)
def actionability(t: Tables) -> DataFrame:
    """The next turn as an answer, at a retrieval score of a half."""
    rows = _pairs(t).withColumn("a", V.actionability(F.col("answer"), V.overlap(F.col("q"), F.col("r")), F.lit(0.5), V.evidence(F.col("answer"))))
    return rows.select("conv_id", "turn", "a.score", "a.aux_ratio")


def _best(words: dict[str, tuple[str, ...]]) -> str:
    counts = {z: _count(w) for z, w in words.items()}
    top = f"greatest({', '.join(counts.values())})"
    return f"CASE WHEN {top} = 0 THEN 'none' " + " ".join(f"WHEN {c} = {top} THEN '{z}'" for z, c in counts.items()) + " END"


@query(
    f"""SELECT doc_id, {_best(V.ZONES)} AS zone, CASE WHEN n + s = 0 THEN 'neutral' WHEN n >= s THEN 'nucleus' ELSE 'satellite' END AS role,
    CASE WHEN n + s = 0 THEN 0.5 ELSE round(greatest(0.55, greatest(n, s) / (n + s)), 4) END::DOUBLE AS sure, round(0.55 * ({_count(V.CLAIMS)} > 0)::INT + 0.45 * ({_count(V.PREMISES)} > 0)::INT, 4)::DOUBLE AS claim_premise
    FROM (SELECT *, {_count(V.NUCLEUS)} AS n, {_count(V.SATELLITE)} AS s FROM (SELECT doc_id, lower(text) AS x FROM documents))"""
)
def argument_zone(t: Tables) -> DataFrame:
    """Zone, role, claims and premises."""
    text = F.col("text")
    rows = t.documents.select("doc_id", V.argument_zone(text).alias("zone"), V.rhetorical_role(text).alias("r"), V.claim_premise(text).alias("claim_premise"))
    return rows.select("doc_id", "zone", "r.role", "r.sure", "claim_premise")


BIAS = f"""b AS (SELECT d.doc_id, d.item_id, d.q, 'docs/' || CASE WHEN d.lang = 'en' THEN '' ELSE 'pdf_raw/' END || d.source AS place, d.text AS query, list_distinct(list_filter(regexp_extract_all(lower(d.source || ' ' || d.lang), '[a-z0-9]{{3,}}'), lambda w: w NOT IN {STOP})) AS r
  FROM (SELECT documents.doc_id, source, lang, item_id, benchmark.text, list_distinct(list_filter(regexp_extract_all(lower(benchmark.text), '[a-z0-9]{{3,}}'), lambda w: w NOT IN {STOP})) AS q FROM documents JOIN benchmark ON item_id = doc_id % (SELECT count(*) FROM benchmark)) d)"""


@query(
    f"""WITH {BIAS}, f AS (SELECT *, {OVERLAP} AS focus, contains(place, 'docs/pdf_raw/') AS raw, {_count(V.OPERATIONAL_QUERY, 'lower(query)')} > 0 AND len(list_filter(q, lambda t: length(t) >= 6 AND t NOT IN {_in(V.GENERIC_TOKENS)})) <= 2 AS generic,
      {_count(V.OPERATIONAL_SOURCE, 'place')} > 0 AS op FROM b)
    SELECT doc_id, generic, round(greatest(-0.28, least(0.28, CASE WHEN raw THEN 0 ELSE 0.12 END + 0.12 * op::INT + least(0.08, 0.10 * focus) - 0.04 * raw::INT - 0.18 * (raw AND generic AND NOT op)::INT - 0.08 * (raw AND generic AND focus < 0.18)::INT))::DOUBLE, 4) AS bias FROM f"""
)
def source_bias(t: Tables) -> DataFrame:
    """Each document as a source for the benchmark passage of its number; other languages stand for raw files."""
    n = t.benchmark.count()
    asked = t.benchmark.select(F.col("item_id").alias("item"), F.col("text").alias("query"), X.relevance_set(F.col("text")).alias("q"))
    rows = t.documents.withColumn("item", F.pmod("doc_id", F.lit(max(1, n)))).join(small(checkpoint(asked)), "item")
    place = F.concat(F.when(F.col("lang") == "en", "docs/").otherwise("docs/pdf_raw/"), "source")
    bias = V.source_bias(F.col("query"), F.col("q"), place, F.col("lang"), F.col("source"))
    return rows.select("doc_id", V.is_generic(F.col("query"), F.col("q")).alias("generic"), bias.alias("bias"))


def _passages(t: Tables, k: int = 8) -> DataFrame:
    """``qid, doc, text, query, asked, retrieval``: the best documents for each benchmark passage; scores by the query's best."""
    found = _top(_features(t), "bm25", k).withColumn("most", F.max("score").over(Window.partitionBy("qid")))
    found = found.select("qid", F.col("doc_id").alias("doc"), F.greatest(F.lit(0.0), F.coalesce(F.col("score") / F.nullif("most", F.lit(0.0)), F.lit(0.0))).alias("retrieval"))
    asked = t.benchmark.select(F.col("item_id").alias("qid"), F.col("text").alias("query"), X.relevance_set(F.col("text")).alias("asked"))
    docs = t.documents.select(F.col("doc_id").alias("doc"), "text", "source", "lang")
    return checkpoint(found.join(asked, "qid").join(docs, "doc"))


def _sentences(t: Tables) -> DataFrame:
    long = V.passage_sentences(_passages(t), ["qid", "doc", "retrieval", "asked", "query", "source", "lang"], "text", most=0)
    return long.withColumn("tokens", X.relevance_set(F.col("sentence")))


CHAIN_TOKENS = f"list_filter(regexp_extract_all(lower({{}}), '[a-z0-9]{{{{3,}}}}'), lambda x: x NOT IN {STOP})"


@query(
    f"""WITH d AS (SELECT doc_id, {CHAIN_TOKENS.format('text')} AS k, list_distinct(list_transform(list_filter({CHAIN_TOKENS.format('left(text, 200)')}, lambda x: length(x) >= 5), lambda x: left(x, 5))) AS own FROM documents),
    r AS (SELECT doc_id, root, count(*) AS c FROM (SELECT doc_id, left(unnest(list_filter(k, lambda x: length(x) >= 5)), 5) AS root FROM d) GROUP BY ALL),
    g AS (SELECT doc_id, count(*) AS roots, count(*) FILTER (c >= 2) AS chains, coalesce(sum(c) FILTER (c >= 2), 0) AS held FROM r GROUP BY doc_id),
    h AS (SELECT d.doc_id, count(*) AS hits FROM d JOIN r ON r.doc_id = d.doc_id AND list_contains(own, root) AND c >= 2 GROUP BY d.doc_id),
    s AS (SELECT doc_id, coalesce(held, 0) / greatest(1, len(k)) AS density, coalesce(hits, 0) / greatest(1, len(own)) AS share, coalesce(chains, 0) / greatest(1, coalesce(roots, 0)) AS variety
      FROM d LEFT JOIN g USING (doc_id) LEFT JOIN h USING (doc_id))
    SELECT doc_id, round(density, 6)::DOUBLE AS density, round(share, 6)::DOUBLE AS share, round(variety, 6)::DOUBLE AS variety, round(least(1, 0.55 * density + 0.30 * share + 0.15 * variety), 6)::DOUBLE AS cohesion FROM s"""
)
def lexical_chains(t: Tables) -> DataFrame:
    """How far each whole text chains its words, and takes up those of its first 200 characters."""
    found = V.chain_shares(t.documents, "doc_id", X.relevance_list(F.col("text")), X.relevance_list(F.left("text", F.lit(200))))
    return found.select("doc_id", *(F.round(c, 6).alias(c) for c in ("density", "share", "variety", "cohesion")))


@query()
def extractive_compress(t: Tables) -> DataFrame:
    """The sentences of a passage's best documents that answer it, in their order."""
    rows = _sentences(t)
    section = X.relevance_set(F.concat_ws(" ", "source", "lang"))
    rows = rows.withColumn("score", V.sentence_relevance(F.col("sentence"), F.col("tokens"), F.col("asked"), section, F.col("retrieval")))
    return K.compress(rows, "qid", "doc", "nth", "score", "sentence")


@query()
def overlap_compress(t: Tables) -> DataFrame:
    """The best documents squeezed to 400 characters."""
    return V.squeezed(_passages(t), ["qid", "doc"], "text", "asked", 400)


def _measured(t: Tables, most: int | None = None) -> DataFrame:
    """Passages with their scores, of whole texts or of clean snippets of ``most`` characters."""
    rows = _passages(t)
    if most:
        rows = rows.withColumn("text", clean_snippet(F.col("text"), most)).where("text <> ''")
    rows = rows.withColumn("tokens", X.relevance_list(F.col("text")))
    rows = rows.withColumn("overlap", V.overlap(F.col("asked"), F.array_distinct("tokens"))).withColumn("evidence", V.evidence(F.col("text")))
    action = V.actionability(F.col("text"), F.col("overlap"), F.col("retrieval"), F.col("evidence"))["score"]
    return rows.withColumn("action", action)


@query()
def discourse_rerank(t: Tables) -> DataFrame:
    """The best documents for each passage by retrieval and coherence."""
    rows = _measured(t).withColumn("units", discourse_units(F.col("text"), most=10))
    salient = O.salient(rows.select("qid", "query").distinct(), "qid", "query").groupBy("qid").agg(F.array_sort(F.collect_list("word")).alias("entities"))
    rows = rows.join(salient, "qid", "left").withColumn("entities", F.coalesce("entities", F.array().cast("array<string>")))
    rows = rows.withColumn("overlaps", F.transform("units", lambda u: V.overlap(F.col("asked"), X.relevance_set(u)))).withColumn("r", V.rhetorical_role(F.col("text")))
    rows = checkpoint(rows)
    more = V.coherence(rows, ["qid", "doc"], "asked", "entities", "units", "overlaps")
    rows = rows.join(more, ["qid", "doc"]).select(
        "*",
        V.centering(F.col("tokens"), F.col("entities")).alias("centering"),
        V.cohesion(F.col("tokens"), F.col("asked"), F.col("overlap")).alias("cohesion"),
        V.claim_premise(F.col("text")).alias("claim"),
        V.argument_zone(F.col("text")).alias("zone"),
        F.col("r.role").alias("role"),
        F.col("r.sure").alias("sure"),
    )
    return V.discourse_rerank(rows, "qid", "doc")


@query()
def evidential_reflection(t: Tables) -> DataFrame:
    """Of the best documents, by clean snippets of 320 characters, those that together are evidence enough."""
    base = 0.35 * F.col("overlap") + 0.25 * F.col("evidence") + 0.20 * F.col("retrieval") + 0.20 * F.col("action")
    rows = _measured(t, 320).select("qid", "doc", "asked", F.array_distinct("tokens").alias("tokens"), F.round(base, 4).alias("base"))
    return V.reflect(rows, "qid", "doc", "base", "tokens", "asked")


@query()
def extractive_answer(t: Tables) -> DataFrame:
    """Five sentences that answer each passage."""
    rows = _sentences(t)
    bias = V.source_bias(F.col("query"), F.col("asked"), F.concat(F.lit("docs/"), "source"), F.col("lang"), F.col("source"))
    return V.extractive_answer(rows.withColumn("bias", bias).withColumn("generic", V.is_generic(F.col("query"), F.col("asked"))), "qid")


@query()
def early_goal(t: Tables) -> DataFrame:
    """Whether the best sentence already answers a passage."""
    rows = _sentences(t).withColumn("o", V.overlap(F.col("asked"), F.col("tokens"))).withColumn("e", V.evidence(F.col("sentence")))
    rows = rows.withColumn("action", V.actionability(F.col("sentence"), F.col("o"), F.col("retrieval"), F.col("e"))["score"])
    return V.early_goal(rows.withColumn("score", V.goal_score(F.col("o"), F.col("action"), F.col("e"), F.col("retrieval"))), "qid")


@query(
    f"""WITH {RANK}, r AS (SELECT qid, doc_id, score, score / max(score) OVER (PARTITION BY qid) AS v FROM ({_top_sql('bm25')})),
    c AS (SELECT *, count(*) OVER (PARTITION BY qid) AS n, count(*) FILTER (v >= 0.5) OVER (PARTITION BY qid) AS good FROM r)
    SELECT qid, doc_id, round(greatest(v, 0.7 * 0.6 + 0.3 * v), 4) AS score FROM c WHERE v >= 0.5 AND good >= least(2, n)"""
)
def verifier_filter(t: Tables) -> DataFrame:
    """Documents whose score is half of the best or more, if there are two, blended with a retrieval score of .6."""
    found = _top(_features(t), "bm25").withColumn("v", F.col("score") / F.max("score").over(Window.partitionBy("qid"))).drop("score")
    return V.verified(found.withColumn("retrieval", F.lit(0.6)), "qid", "v", "retrieval").select("qid", "doc_id", "score")


@query(f"WITH {PAIR} SELECT conv_id, turn, round(coalesce(len(list_intersect(r, q)) / nullif(len(r), 0), 0), 6) AS faithfulness FROM p")
def gate_faithfulness(t: Tables) -> DataFrame:
    """X25."""
    return _pairs(t).select("conv_id", "turn", F.round(K.faithfulness(F.col("r"), [F.col("q")]), 6).alias("faithfulness"))


F1 = "coalesce(2 * len(list_intersect(q, r)) / nullif(len(q) + len(r), 0), 0)"


@query(
    f"""WITH {PAIR} SELECT conv_id, turn, round(f, 6) AS relevance, round(g, 6) AS groundedness, CASE WHEN f >= 0.3 AND g >= 0.5 THEN 'ok' WHEN f >= 0.1 OR g >= 0.3 THEN 'attention' ELSE 'degraded' END AS status
    FROM (SELECT *, {F1} AS f, coalesce(len(list_intersect(r, q)) / nullif(len(r), 0), 0) AS g FROM p)"""
)
def answer_quality(t: Tables) -> DataFrame:
    """X27."""
    m = K.answer_quality(F.col("q"), F.col("r"), F.col("q"))
    return _pairs(t).select("conv_id", "turn", F.round(m["relevance"], 6).alias("relevance"), F.round(m["groundedness"], 6).alias("groundedness"), m["status"].alias("status"))


@query(
    f"""WITH c AS (SELECT conv_id, turn, role, {TOK.format('text')} AS k, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
    s AS (SELECT a.conv_id, a.turn, b.turn AS past, round(0.58 * coalesce(len(list_intersect(a.k, b.k)) / nullif(len(a.k), 0), 0) + 0.32 * exp(-0.45 * (a.turn - b.turn)) + 0.10 * (b.role = 'user')::INT, 6) AS score
      FROM c a JOIN c b ON a.conv_id = b.conv_id AND b.n BETWEEN a.n - 6 AND a.n - 1)
    SELECT conv_id, turn, past, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, past DESC)::INT AS rank FROM s) WHERE rank <= 2"""
)
def history_select(t: Tables) -> DataFrame:
    """X28."""
    tokens = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]{3,}"), F.lit(0)))
    turns = t.conversations.select("conv_id", "turn", "role", tokens.alias("k"))
    return K.history(turns, "conv_id", "turn", "k", F.col("role") == "user")


@query(
    """SELECT conv_id, turn, last_value(e IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS entity FROM
    (SELECT conv_id, turn, CASE WHEN contains(text, 'http') THEN 'link' WHEN regexp_matches(text, '[0-9]{3,}') THEN 'number' END AS e FROM conversations)"""
)
def dialogue_state(t: Tables) -> DataFrame:
    """X32."""
    entity = F.when(F.col("text").contains("http"), "link").when(F.col("text").rlike("[0-9]{3,}"), "number")
    return K.carry_entity(t.conversations, "conv_id", "turn", entity).select("conv_id", "turn", "entity")


@query(
    f"""WITH b AS (SELECT list({TOK.format('text')} ORDER BY item_id) AS bank FROM benchmark), d AS (SELECT conv_id, turn, {TOK.format('text')} AS q FROM conversations)
    SELECT conv_id, turn, round(coalesce(list_max(list_transform(bank, lambda x: CASE WHEN len(list_intersect(q, x)) >= 2 THEN 0.75 * len(list_intersect(q, x)) / len(q) + 0.15 * len(list_intersect(q, x)) / len(x) ELSE 0 END)), 0)::DOUBLE, 5) AS score FROM d, b"""
)
def qa_shortcut(t: Tables) -> DataFrame:
    """H8: every turn against the benchmark as the bank of questions; scores that end in a 5 are rounded as SQL rounds them, by their product."""
    tokens = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]{3,}"), F.lit(0)))
    asked = t.conversations.select("conv_id", "turn", tokens.alias("k"))
    found = K.question_shortcut(asked, t.benchmark.select("item_id", tokens.alias("k")), ["conv_id", "turn"], "k", "item_id")
    return found.select("conv_id", "turn", (F.round(F.col("score") * 1e5) / 1e5).alias("score"))


#: Words that no question is met through (fixed values).
QA_STOP_WORDS = ("de", "la", "el", "los", "las", "con", "sin", "para", "por", "del", "que", "como", "en", "y", "o")
QA_TOKENS = "list_filter(regexp_extract_all(lower({}), '[a-z0-9]{{3,}}'), lambda x: x NOT IN (" + ", ".join(f"'{w}'" for w in QA_STOP_WORDS) + "))"


@query(
    f"""WITH d AS (SELECT conv_id, turn, {QA_TOKENS.format('text')} AS k FROM conversations),
    o AS (SELECT conv_id, turn, list(w ORDER BY i)[:16] AS q FROM (SELECT conv_id, turn, w, min(i) AS i FROM (SELECT conv_id, turn, unnest(k) AS w, generate_subscripts(k, 1) AS i FROM d) GROUP BY ALL) GROUP BY ALL),
    b AS (SELECT item_id, {QA_TOKENS.format('text')} AS k FROM benchmark),
    m AS (SELECT conv_id, turn, item_id, len(list_intersect(q, k)) AS n, len(q) AS nq, len(list_distinct(k)) AS nb, array_to_string(q, ' ') AS lq, array_to_string(k, ' ') AS lb FROM o, b WHERE len(q) >= 2),
    s AS (SELECT conv_id, turn, item_id, 0.75 * n / nq + 0.15 * n / nb + CASE WHEN contains(lb, lq) THEN 0.10 WHEN contains(lq, lb) THEN 0.06 ELSE 0 END AS score FROM m WHERE n >= 2)
    SELECT conv_id, turn, item_id, round(score, 5)::DOUBLE AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, item_id)::INT AS rank
    FROM (SELECT conv_id, turn, item_id, round(score, 9) AS score FROM s WHERE score >= 0.24)) WHERE rank <= 2"""
)
def qa_matches(t: Tables) -> DataFrame:
    """H8: the two benchmark passages that a turn's first 16 terms match best, if well enough."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]{3,}"), F.lit(0))
    tokens = F.filter(words, lambda w: ~w.isin(*QA_STOP_WORDS))
    found = bank_matches(t.conversations.select("conv_id", "turn", tokens.alias("k")), t.benchmark.select("item_id", tokens.alias("k")), ["conv_id", "turn"], "item_id", "k")
    return found.select("conv_id", "turn", "item_id", F.round("score", 5).alias("score"), "rank")


@query("SELECT doc_id, len(w)::INT AS windows FROM (SELECT doc_id, range(0, greatest(0, ceil((length(text) - 2000) / 1760.0))::INT + 1) AS w FROM documents)")
def embedding_windows(t: Tables) -> DataFrame:
    """V5."""
    return t.documents.select("doc_id", F.size(windows(F.col("text"))).alias("windows"))


@query("SELECT label, i::INT AS i, round(avg(x), 6) AS x FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY ALL")
def vector_mean(t: Tables) -> DataFrame:
    """V5."""
    pooled = mean_pool(t.embeddings.select("label", F.transform("embedding", lambda x: x.cast("double")).alias("embedding")), ["label"], "embedding")
    return pooled.select("label", F.posexplode("embedding").alias("i", "x")).select("label", "i", F.round("x", 6).alias("x"))


@query()
def hash_vectors(t: Tables) -> DataFrame:
    """V6, and the cosine of each vector with itself."""
    rows = t.documents.select("doc_id", hash_embedding(F.col("text")).alias("v"))
    return rows.select("doc_id", F.slice("v", 1, 4).alias("head"), F.round(cosine(F.col("v"), F.col("v")), 6).alias("self"))


SEPSIS_COLUMNS = [
    "event_id",
    "event_type <> 'view' AS infection",
    "10 + event_id % 20 AS respiratory_rate",
    "80 + event_id % 60 AS systolic_bp",
    "event_id % 7 = 0 AS altered",
    "CASE WHEN event_id % 5 > 0 THEN 50 + event_id % 40 END AS map",
    "CASE WHEN event_id % 3 > 0 THEN value / 15 END AS lactate",
    "event_id % 120 AS minutes",
]


@query(U.sql(U.SEPSIS, f"(SELECT {', '.join(SEPSIS_COLUMNS)} FROM events)", "event_id"))
def rules_qsofa(t: Tables) -> DataFrame:
    """App. A: additive score, alerts and severity with missing measurements."""
    rows = t.events.selectExpr(*SEPSIS_COLUMNS)
    return U.SEPSIS.apply(rows).select("event_id", "qsofa", "alerts", "severity")


@query(U.sql(U.BANDED, "(SELECT event_id, CASE WHEN event_id % 11 > 0 THEN value END AS m, event_type = 'click' AS flag FROM events)", "event_id"))
def rules_banded(t: Tables) -> DataFrame:
    """App. A: bands of one measure."""
    rows = t.events.select("event_id", F.when(F.col("event_id") % 11 > 0, F.col("value")).alias("m"), (F.col("event_type") == "click").alias("flag"))
    return U.BANDED.apply(rows).select("event_id", "stage", "alerts", "severity")


@query(U.sql(U.ARGMAX, "lineitem", "l_orderkey, l_linenumber"))
def rules_argmax(t: Tables) -> DataFrame:
    """App. A: the higher of two scores, abstaining where they are close."""
    return U.ARGMAX.apply(t.lineitem).select("l_orderkey", "l_linenumber", "score_a", "score_b", "red_flags", "severity")


@query("SELECT event_id, round(CASE WHEN value <= 4 THEN 150 WHEN value >= 24 THEN 25 ELSE 150 - 6.25 * (value - 4) END, 6) AS threshold FROM events")
def toxic_threshold(t: Tables) -> DataFrame:
    """App. A: piecewise linear threshold."""
    return t.events.select("event_id", F.round(U.toxic_threshold(F.col("value")), 6).alias("threshold"))


@query(
    """WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS ta, event_type = 'error' AS failed, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    s AS (SELECT user_id, 0::BIGINT AS n, 0::DOUBLE AS first, 0 AS c, 0::DOUBLE AS until, NULL::BIGINT AS event_id, false AS blocked FROM (SELECT DISTINCT user_id FROM events)
    UNION ALL SELECT user_id, n, CASE WHEN b THEN first WHEN NOT failed THEN 0 WHEN fresh THEN ta ELSE first END, CASE WHEN b THEN c WHEN NOT failed THEN 0 WHEN fresh THEN 1 ELSE c + 1 END,
    CASE WHEN b THEN until WHEN failed AND NOT fresh AND c + 1 >= 5 THEN ta + 600 ELSE 0 END, event_id, b FROM (SELECT o.*, first, c, until, until > 0 AND ta < until AS b,
    c = 0 OR until <> 0 OR ta - first > 300 AS fresh FROM s JOIN o ON o.user_id IS NOT DISTINCT FROM s.user_id AND o.n = s.n + 1))
    SELECT user_id, event_id, blocked, c::INT AS failures FROM s WHERE n > 0"""
)
def login_throttle(t: Tables) -> DataFrame:
    """Errors are failed attempts."""
    return throttle(t.events.withColumn("failed", F.col("event_type") == "error"), "user_id", "ts", "event_id", "failed")


@query()
def gatekeeper(t: Tables) -> DataFrame:
    """The second of a passage's best documents as the answer, the others as evidence."""
    rows = _passages(t).groupBy("qid").agg(F.first("query").alias("query"), F.array_sort(F.collect_list(F.struct((-F.col("retrieval")).alias("r"), "doc", "text"))).alias("p"))
    rows = rows.select("qid", "query", F.get("p", F.lit(1))["text"].alias("answer"), F.transform(F.filter("p", lambda x, i: i != 1), lambda x: x["text"]).alias("passages"))
    return K.gatekeeper(rows, "qid", "query", "answer", "passages")


def _flag(n: int, name: str) -> str:
    """A finding that events have every n-th time, and don't know every seventh."""
    return f"CASE WHEN event_id % 7 > 0 THEN (event_id + user_id) % {n} = 0 END AS {name}"


def _choice(values: tuple[str, ...], name: str, step: int = 1) -> str:
    cases = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE (event_id + {step} * user_id) % {len(values)} {cases} END AS {name}"


def _flags(*names: str) -> list[str]:
    return [_flag(2 + i % 5, n) for i, n in enumerate(names)]


SITES = ("torax", "espalda", "cara", "tronco", "mejillas", "extremidades_superiores", "nariz")
ENGINES = {
    "rules_sepsis": (U.SEPSIS_BUNDLE, [*SEPSIS_COLUMNS, *_flags("vasopressor", "cultures", "antibiotics"), "CASE WHEN event_id % 3 > 0 THEN event_id % 50 END AS fluids"]),
    "rules_scasest": (
        U.SCASEST,
        ["event_id", *_flags("chest_pain", "dyspnea", "syncope", "st_depression", "t_inversion", "troponin", "unstable", "arrhythmia", "refractory", "no_antiplatelet", "no_anticoagulation"),
         "CASE WHEN event_id % 3 > 0 THEN 100 + event_id % 90 END AS grace", "CASE WHEN event_id % 5 > 0 THEN 40 + event_id % 60 END AS heart_rate", "80 + event_id % 20 AS oxygen"],
    ),
    "rules_respiratory": (
        U.RESPIRATORY,
        ["event_id", "20 + event_id % 70 AS age", *_flags("immunosuppressed", "vaccinated", "needs_oxygen", "no_oral"), "event_id % 3 AS comorbidities", "CASE WHEN event_id % 5 > 0 THEN 120 + event_id % 50 END AS baseline_bp",
         "90 + event_id % 60 AS current_bp", "CASE WHEN event_id % 4 > 0 THEN event_id % 200 END AS onset_hours", _choice(("negativo", "positivo", "no_realizado"), "antigen"), _choice(("covid", "gripe", "vrs", "otro"), "pathogen", 3)],
    ),
    "rules_pityriasis": (
        U.PITYRIASIS,
        ["event_id", "event_id % 80 AS age", "event_id % 10 AS itch", *_flags("fine_scaling", "scratch_sign", "recurrent", "herald_patch", "tree_pattern", "prodrome", "atopic", "sensory_loss", "warm_pain", "systemic"),
         _choice(SITES, "site"), _choice(("amarillo_naranja", "negativo", "no_realizado"), "wood", 2), _choice(("positivo_spaghetti_albondigas", "negativo"), "koh", 5), _choice(("hipocromica", "hipercromica", "normal"), "colour", 7)],
    ),
    "rules_acne": (
        U.ACNE_ROSACEA,
        ["event_id", *_flags("comedones", "hyperandrogenism", "flushing", "telangiectasias", "triggers", "photosensitive", "ocular", "phymatous", "severe_nodules", "systemic", "raised_markers"),
         _choice(SITES, "site"), _choice(("polimorfo", "papulo_pustuloso", "nodulo_quistico"), "pattern", 2), _choice(("femenino", "masculino"), "sex", 3)],
    ),
    "rules_cardio": (
        U.CARDIO_RISK,
        ["event_id", "30 + event_id % 60 AS age", "110 + event_id % 70 AS systolic_bp", "120 + event_id % 140 AS non_hdl", "CASE WHEN event_id % 3 > 0 THEN 70 + event_id % 80 END AS apob",
         *_flags("smoker", "diabetes", "kidney_disease", "family_history", "inflammatory", "established")],
    ),
}


def _engine_query(name: str):
    engine, columns = ENGINES[name]

    def run(t: Tables) -> DataFrame:
        return engine.apply(t.events.selectExpr(*columns)).select("event_id", *engine.scores, *engine.flags, *engine.lists, "severity")

    run.__name__, run.__module__ = name, __name__
    run.__doc__ = "App. A: one of the rule engines over findings made of events, a part of them unknown."
    return query(U.sql(engine, f"(SELECT {', '.join(columns)} FROM events)", "event_id"))(run)


for _name in ENGINES:
    _engine_query(_name)


@query()
def cardio_plan(t: Tables) -> DataFrame:
    """App. A: targets and treatment by the level of cardiovascular risk."""
    engine, columns = ENGINES["rules_cardio"]
    plan = U.cardio_plan(engine.apply(t.events.selectExpr(*columns)))
    return plan.select("event_id", "severity", "risk_percent", "ldl_target", "non_hdl_target", "intensive_lifestyle", "drug_suggested")

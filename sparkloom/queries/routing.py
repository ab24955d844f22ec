"""Routing, expansion, discourse and ordered rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import catalogue as C
from ..operators import routing as O
from ..operators.evaluate import acceptance
from ..operators.ingest import discourse_units
from .registry import Tables, query

NW = "len(list_filter(regexp_split_to_array({0}, '\\s+'), lambda w: w <> ''))"


def _has(words: tuple[str, ...], text: str = "lower(text)") -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


@query(
    f"""SELECT conv_id, turn, greatest(3, least(CASE WHEN {_has(O.RISK_WORDS)} THEN greatest(k, 6) ELSE k END, 7)) AS k FROM
    (SELECT *, CASE WHEN {NW.format('text')} <= 5 THEN 5 WHEN {NW.format('text')} >= 18 THEN 7 ELSE 6 END AS k FROM conversations)"""
)
def adaptive_k(t: Tables) -> DataFrame:
    """H11, F9."""
    return t.conversations.select("conv_id", "turn", O.adaptive_k(F.col("text"), 6, 3, 12).alias("k"))


SEP = " + ".join(f"length(x) - length(replace(x, '{c}', ''))" for c in ":;(),")
CON = " + ".join(f"(length(x) - length(replace(x, '{c}', ''))) // {len(c)}" for c in O.CONNECTORS)


@query(
    f"""WITH c AS (SELECT conv_id, turn, lower(text) AS x, {NW.format('text')} AS n FROM conversations), s AS (SELECT conv_id, turn, n, {SEP} AS sep, {CON} AS con, {_has(O.PROCEDURE_WORDS, 'x')} AS p FROM c)
    SELECT conv_id, turn, CASE WHEN (n >= 16)::INT + (sep >= 2)::INT + (con >= 2)::INT + p::INT >= 2 THEN 'complex' WHEN n <= 6 AND sep = 0 AND con <= 1 THEN 'simple' ELSE 'medium' END AS complexity FROM s"""
)
def query_complexity(t: Tables) -> DataFrame:
    """H12."""
    return t.conversations.select("conv_id", "turn", O.complexity(F.col("text")).alias("complexity"))


THES = "th AS (SELECT DISTINCT lower(p_brand) AS term, lower(p_type) AS synonym FROM part)"


@query(
    f"""WITH {THES}, k AS (SELECT term, synonym FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY synonym) AS n FROM th WHERE term <> synonym) WHERE n <= 4),
    q AS (SELECT DISTINCT p_partkey AS qid, lower(p_brand) AS term FROM part) SELECT qid, term FROM q UNION SELECT qid, synonym FROM q JOIN k USING (term)"""
)
def thesaurus_expand(t: Tables) -> DataFrame:
    """Brands with the types that they occur with as synonyms."""
    th = t.part.select(F.lower("p_brand").alias("term"), F.lower("p_type").alias("synonym"))
    return O.expand(t.part.select(F.col("p_partkey").alias("qid"), F.lower("p_brand").alias("term")), "qid", "term", th)


QT = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9]{{3,}}'))"


@query(
    f"""WITH a AS (SELECT item_id AS qid, {QT.format('text')} AS q FROM benchmark), c AS (SELECT doc_id AS cid, {QT.format('text')} AS c FROM documents)
    SELECT qid, cid, size FROM (SELECT qid, cid, len(c)::INT AS size, row_number() OVER (PARTITION BY qid ORDER BY len(c), cid) AS n FROM a JOIN c ON len(q) > 0 AND list_has_all(c, q)) WHERE n = 1"""
)
def cache_superset(t: Tables) -> DataFrame:
    """Cached texts that hold all tokens of a query."""
    tok = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]{3,}"), F.lit(0)))
    asked = t.benchmark.select(F.col("item_id").alias("qid"), tok(F.col("text")).alias("k"))
    return O.cached_superset(asked, t.documents.select(F.col("doc_id").alias("cid"), tok(F.col("text")).alias("k")), "qid", "cid", "k")


STOP = "(" + ", ".join(f"'{w}'" for w in X.RELEVANCE_STOP_WORDS) + ")"


@query(
    f"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{{3,}}')) AS word FROM documents)
    SELECT doc_id, word, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, length(word) DESC, word)::INT AS rank FROM
    (SELECT doc_id, word, count(*) AS n FROM w WHERE length(word) >= 4 AND word NOT IN {STOP} GROUP BY ALL)) WHERE rank <= 6"""
)
def salient_entities(t: Tables) -> DataFrame:
    """X8."""
    return O.salient(t.documents, "doc_id", "text")


@query(
    r"""WITH p AS (SELECT a.conv_id, a.turn, regexp_extract_all(lower(a.text), '[a-z0-9]{3,}') AS q, regexp_extract_all(lower(b.text), '[a-z0-9]{3,}') AS r FROM conversations a
      JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
    g AS (SELECT *, list_distinct(list_transform(range(1, len(q)), lambda i: q[i] || ' ' || q[i + 1])) AS qb, list_distinct(list_transform(range(1, len(r)), lambda i: r[i] || ' ' || r[i + 1])) AS rb,
      list_distinct(q) AS qs, list_distinct(r) AS rs FROM p), i AS (SELECT *, len(list_intersect(qs, rs)) AS s FROM g)
    SELECT conv_id, turn, round(greatest(0, least(1, 0.34::DOUBLE * coalesce(s / nullif(len(qs), 0), 0) + 0.16::DOUBLE * coalesce(s / nullif(len(rs), 0), 0) + 0.18::DOUBLE * 0.5 + 0.12::DOUBLE * coalesce(len(list_intersect(qb, rb)) / nullif(len(qb), 0), 0))), 6) AS score FROM i"""
)
def pair_score(t: Tables) -> DataFrame:
    """A turn and the next one."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = t.conversations.select("conv_id", "turn", "text", F.lead("text").over(w).alias("answer"), F.lead("turn").over(w).alias("nt")).where("nt = turn + 1")
    tok = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]{3,}"), F.lit(0))
    rows = rows.select("conv_id", "turn", tok(F.col("text")).alias("q"), tok(F.col("answer")).alias("r"))
    return rows.select("conv_id", "turn", F.round(O.pair_score(F.col("q"), F.col("r"), F.lit(0.5), F.lit(0.0)), 6).alias("score"))


@query()
def topic_continuity(t: Tables) -> DataFrame:
    """X9."""
    units = F.transform(discourse_units(F.col("text")), lambda u: F.regexp_extract_all(F.lower(u), F.lit("[a-z0-9]{3,}"), F.lit(0)))
    return O.topic_continuity(t.documents.select("doc_id", units.alias("units")), "doc_id", "units")


@query(
    r"""WITH k AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9#\-\+/]+')) AS w, generate_subscripts(regexp_extract_all(lower(text), '[a-z0-9#\-\+/]+'), 1) AS i FROM documents),
    a AS (SELECT doc_id, i FROM k WHERE w = 'hest'), b AS (SELECT doc_id, i FROM k WHERE w = 'the')
    SELECT d.doc_id, (SELECT min(abs(a.i - b.i) + 1) FROM a JOIN b ON a.doc_id = b.doc_id WHERE a.doc_id = d.doc_id)::INT AS span FROM documents d"""
)
def window_span(t: Tables) -> DataFrame:
    """Of two words."""
    return t.documents.select("doc_id", X.ir_tokens(F.col("text")).alias("k")).select("doc_id", O.smallest_window(F.col("k"), ["hest", "the"]).cast("int").alias("span"))


@query()
def lsi_scores(t: Tables) -> DataFrame:
    """Over each query's pool."""
    from ..operators import search as S
    from .search import POOL, _counts

    counts = _counts(t).where("zone = 'body'")
    asked = S.query_terms(t.benchmark.withColumnRenamed("item_id", "qid"), "qid", F.col("text"))
    pool = S.candidate_pool(asked, counts, "qid", "doc_id", POOL)
    rows = pool.join(counts, "doc_id").select("qid", "doc_id", "term", (1 + F.ln("tf")).alias("w"))
    own = asked.select("qid", F.lit(None).cast("long").alias("doc_id"), "term", (1 + F.ln("qtf")).alias("w"))
    return O.latent_scores(rows.union(own), "qid", "doc_id").withColumn("score", F.round("score", 6))


CASES = "CASE " + " ".join(f"WHEN {_has(w)} THEN '{n}'" for n, _, w in O.TRIAGE) + " ELSE 'general' END"
SURE = "CASE " + " ".join(f"WHEN {_has(w)} THEN {c}" for n, c, w in O.TRIAGE) + " ELSE 0.55 END"


@query(
    f"""SELECT doc_id, category, CASE WHEN u OR category IN ('bug', 'ops') THEN 'high' WHEN category IN ('docs', 'analysis') THEN 'low' ELSE 'medium' END AS priority,
    CASE WHEN u THEN greatest(s, 0.85) WHEN category IN ('bug', 'ops') THEN greatest(s, 0.8) ELSE s END::DOUBLE AS confidence FROM
    (SELECT doc_id, {CASES} AS category, {SURE} AS s, {_has(O.URGENT)} AS u FROM documents)"""
)
def rules_triage(t: Tables) -> DataFrame:
    """C19."""
    return O.triage(t.documents, F.col("text")).select("doc_id", "category", "priority", "confidence")


@query(
    """SELECT event_id, CASE WHEN g IS NOT NULL AND injected THEN 'critical' WHEN (g = 'clinical_actions' AND clinical) OR (g = 'external_network' AND web) THEN 'high' WHEN g IS NOT NULL THEN 'medium' ELSE 'low' END AS risk FROM
    (SELECT event_id, CASE event_type WHEN 'click' THEN 'clinical_actions' WHEN 'view' THEN 'external_network' WHEN 'signup' THEN 'sensitive_media' END AS g, event_id % 2 = 0 AS clinical, event_id % 3 = 0 AS web, event_id % 7 = 0 AS injected FROM events)"""
)
def tool_risk(t: Tables) -> DataFrame:
    """Y2."""
    group = F.when(F.col("event_type") == "click", "clinical_actions").when(F.col("event_type") == "view", "external_network").when(F.col("event_type") == "signup", "sensitive_media")
    odd = lambda n: F.col("event_id") % n == 0
    return t.events.select("event_id", O.tool_risk(group, odd(2), odd(3), odd(7)).alias("risk"))


@query(
    """SELECT event_id, CASE WHEN event_type = 'error' THEN false WHEN event_type IN ('click', 'purchase') THEN true WHEN event_type = 'signup' THEN false ELSE event_type = 'view' END AS allowed FROM events"""
)
def layered_policy(t: Tables) -> DataFrame:
    """Later layers override earlier ones."""
    text = lambda *w: F.array(*map(F.lit, w)) if w else F.array().cast("array<string>")
    layers = F.array(
        F.struct(text("view", "signup").alias("allow"), text("click").alias("deny")),
        F.struct(text("click", "purchase").alias("allow"), text("signup").alias("deny")),
        F.struct(text().alias("allow"), text("error").alias("deny")),
    )
    return t.events.select("event_id", O.layered_policy(layers, F.col("event_type")).alias("allowed"))


@query(
    """SELECT lang, round(a, 6) AS now, round(b, 6) AS before, round(a - b, 6) AS delta FROM (SELECT lang, avg(n_chars) AS a FROM documents GROUP BY lang) JOIN
    (SELECT lang, avg(n_chars) AS b FROM documents JOIN labels USING (doc_id) GROUP BY lang) USING (lang)"""
)
def baseline_delta(t: Tables) -> DataFrame:
    """A18."""
    return O.compared(t.documents, t.documents.join(t.labels.select("doc_id"), "doc_id"), ["lang"], "n_chars")


#: Least values of three metrics of documents by language, one of which nobody measures.
LEAST = {"mean_chars": 2400.0, "good": 0.9, "ndcg": 0.3}


@query(
    """WITH s AS (SELECT lang, avg(n_chars) AS mean_chars, avg(quality) AS good FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang)
    SELECT lang, list_filter([CASE WHEN mean_chars < 2400 THEN format('mean_chars:{:.4f}<2400.0000', mean_chars) END, CASE WHEN good IS NULL THEN 'good:missing' WHEN good < 0.9 THEN format('good:{:.4f}<0.9000', good) END, 'ndcg:missing'],
    lambda x: x IS NOT NULL) AS failures FROM s"""
)
def acceptance_failures(t: Tables) -> DataFrame:
    """Which of three thresholds the documents of each language fail."""
    rows = t.documents.join(t.labels.select("doc_id", "quality"), "doc_id", "left").groupBy("lang").agg(F.avg("n_chars").alias("mean_chars"), F.avg("quality").alias("good"))
    return acceptance(rows, LEAST).select("lang", "failures")


@query(
    """WITH a AS (SELECT DISTINCT word FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark) WHERE length(word) >= 7),
    b AS (SELECT DISTINCT term FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM conversations) WHERE length(term) >= 7)
    SELECT word, term, (3 - levenshtein(word, term))::INT AS points FROM a JOIN b ON left(word, 4) = left(term, 4) WHERE levenshtein(word, term) <= 2"""
)
def fuzzy_domain_match(t: Tables) -> DataFrame:
    """C9."""
    words = lambda df, n: df.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias(n))
    return O.fuzzy_match(words(t.benchmark, "word"), words(t.conversations, "term"), "word", "term")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY user_id")
def latest_status(t: Tables) -> DataFrame:
    """Y7."""
    return O.latest_status(t.events, "user_id", "ts", "event_id", F.col("event_type"))


@query("SELECT doc_id FROM documents WHERE lang IN ('de', 'fr')")
def relaxed_filter(t: Tables) -> DataFrame:
    """Nothing has the first language, so the second filter holds."""
    ids = lambda *langs: t.documents.where(F.col("lang").isin(*langs)).select("doc_id")
    return O.relaxed(ids("xx"), ids("de", "fr"))


@query(
    """SELECT o_custkey, o_orderpriority, round(max(round(o_totalprice / 1e6, 5) + least(0.08, 0.1 * part)::DOUBLE), 5) AS score, count(*) AS parts FROM (SELECT *, o_orderkey % 3 AS part FROM orders) GROUP BY ALL"""
)
def segment_merge(t: Tables) -> DataFrame:
    """H7: results of a query's parts, merged by document."""
    rows = t.orders.select("o_custkey", "o_orderpriority", (F.col("o_orderkey") % 3).alias("part"), F.round(F.col("o_totalprice") / 1e6, 5).alias("s"))
    return O.boosted_merge(rows, "o_custkey", "o_orderpriority", "part", "s")


TERMS = ["license", "token", "hest", "blest"]


@query(
    f"""WITH r AS (SELECT doc_id, lower(text) AS x, lang FROM documents WHERE {_has(tuple(TERMS))}), w AS (SELECT * FROM r WHERE lang IN ('de')), s AS (SELECT doc_id,
    round(({' + '.join(f"contains(x, '{t}')::INT" for t in TERMS)}) + 1.1 * ({' OR '.join(f"contains(x, '{t}')" for t in TERMS)})::INT + CASE WHEN lang = 'de' THEN 1.6 ELSE 0 END, 6)::DOUBLE AS score FROM w)
    SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id)::INT AS rank FROM s ORDER BY score DESC, doc_id LIMIT 10"""
)
def domain_search(t: Tables) -> DataFrame:
    """H4: texts are their own question; the source is the keyword."""
    return O.domain_search(t.documents, "doc_id", F.col("text"), F.array("source"), F.array("text"), F.col("lang"), TERMS, ["de"], 10)


@query(
    """SELECT doc_id, lang FROM (SELECT doc_id, lang, 0 AS l FROM documents WHERE lang = 'es' UNION ALL SELECT doc_id, lang, 1 FROM documents WHERE lang = 'fr') ORDER BY l, doc_id LIMIT 130"""
)
def source_merge(t: Tables) -> DataFrame:
    """Spanish documents, then those that are Spanish or French."""
    some = lambda *langs: t.documents.where(F.col("lang").isin(*langs)).select("doc_id", "lang")
    return O.merged_sources([some("es"), some("es", "fr")], "doc_id", "doc_id", 130)


@query(
    """SELECT doc_id, source FROM (SELECT doc_id, source, lang = 'es' AS hit, max((lang = 'es')::INT) OVER (PARTITION BY source) AS any_hit FROM documents) WHERE hit OR any_hit = 0"""
)
def domain_filter(t: Tables) -> DataFrame:
    """Of each source its Spanish documents, or all where it has none."""
    rows = O.domain_filter(t.documents, "source", F.array("lang"), F.array(F.lit("es")))
    return rows.select("doc_id", "source")


MARKERS = {"plan": ("pasos", "the"), "dosis": ("dosis", "ment"), "riesgo": ("riesgo", "ver")}
EXPANSION = {"plan": ("bundle", "ruta"), "dosis": ("pauta", "ruta")}


@query(
    f"""SELECT conv_id, turn, list_filter([{', '.join(f"CASE WHEN {_has(w, 'x')} THEN '{n}' END" for n, w in MARKERS.items())}], lambda v: v IS NOT NULL) AS intents,
    list_filter(e, lambda v, i: list_position(e, v) = i) AS expand FROM (SELECT *, list_concat({', '.join(f"CASE WHEN {_has(MARKERS[n], 'x')} THEN {list(w)} ELSE [] END" for n, w in EXPANSION.items())}) AS e
    FROM (SELECT conv_id, turn, lower(text) AS x FROM conversations))"""
)
def query_intents(t: Tables) -> DataFrame:
    """What a turn asks for, and the terms that this adds to a search."""
    rows = t.conversations.select("conv_id", "turn", O.intents(F.col("text"), MARKERS, EXPANSION).alias("i"))
    return rows.select("conv_id", "turn", "i.intents", "i.expand")


@query()
def query_compaction(t: Tables) -> DataFrame:
    """Turns in their parts, and complex ones in eight words."""
    none = F.array().cast("array<string>")
    return t.conversations.select("conv_id", "turn", O.segments(F.col("text")).alias("parts"), O.compacted(F.col("text"), O.complexity(F.col("text")), none).alias("compact"))


def _count(words: tuple[str, ...], text: str) -> str:
    return "(" + " + ".join(f"contains({text}, '{w}')::INT" for w in words) + ")"


_FOLD = r"regexp_replace(strip_accents(lower({})), '[^\x00-\x7F]', '', 'g')"
#: Passages as questions of four kinds, and documents as sections with marks of the catalogue's rules before them.
_ASKED = "CASE item_id % 4 WHEN 0 THEN text WHEN 1 THEN text || ' pasos' WHEN 2 THEN text || ' manejo en perforacion' ELSE text || ' acciones en abdomen' END"
_MARKS = ("", "Manejo y exploracion abdominal. ", "Validacion, perforacion. ", "Analítica, constantes. ", "")


@query(
    f"""WITH q AS (SELECT item_id AS qid, {_FOLD.format(_ASKED)} AS low FROM benchmark),
    f AS (SELECT qid, list_distinct(regexp_extract_all(low, '[a-z0-9]{{3,}}')) AS w, {_count(C.GENERIC_QUESTION, 'low')} > 0 AS g, {_count(C.SPECIFIC, 'low')} = 0 AS o, {_count(C.ABDOMINAL_QUESTION, 'low')} > 0 AS b FROM q),
    s AS (SELECT source, doc_id AS section, lang, left(CASE doc_id % 5 {' '.join(f"WHEN {i} THEN '{m}' || text" for i, m in enumerate(_MARKS))} END, 620) AS t FROM documents),
    m AS (SELECT *, {_FOLD.format('t')} AS low FROM s), k AS (SELECT *, list_distinct(regexp_extract_all(low, '[a-z0-9]{{3,}}')) AS w, 2 * {_count(C.OPERATIONAL, 'low')} - 2 * {_count(C.NOT_OPERATIONAL, 'low')} AS mg,
      3 * {_count(C.NEUTRAL, 'low')} - 3 * {_count(C.SPECIFIC, 'low')} AS mo, 3 * {_count(C.ABDOMINAL, 'low')} AS mb FROM m),
    c AS (SELECT CASE lang WHEN 'de' THEN 'gastro_hepato' ELSE lang END AS domain, source FROM (SELECT DISTINCT lang, source FROM documents WHERE lang IN ('de', 'en'))),
    x AS (SELECT qid, domain, c.source, section, t, len(list_intersect(f.w, k.w)) + CASE WHEN g THEN mg ELSE 0 END + CASE WHEN g AND o THEN mo ELSE 0 END + CASE WHEN b AND domain = 'gastro_hepato' THEN mb ELSE 0 END AS score
      FROM f, c JOIN k ON k.source = c.source),
    y AS (SELECT *, row_number() OVER (PARTITION BY qid, domain, source ORDER BY score DESC, section) AS r FROM x WHERE score > 0)
    SELECT qid, rank, domain, source, section_text, score FROM (SELECT qid, domain, source, left(t, 280) AS section_text, score::BIGINT AS score,
      row_number() OVER (PARTITION BY qid ORDER BY score DESC, domain, source)::INT AS rank FROM y WHERE r = 1) WHERE rank <= 3"""
)
def catalogue_sources(t: Tables) -> DataFrame:
    """The three best of the sources of two languages for each passage, by their best documents."""
    n, text = F.col("item_id") % 4, F.col("text")
    asked = F.when(n == 0, text).when(n == 1, F.concat(text, F.lit(" pasos"))).when(n == 2, F.concat(text, F.lit(" manejo en perforacion"))).otherwise(F.concat(text, F.lit(" acciones en abdomen")))
    questions = t.benchmark.select(F.col("item_id").alias("qid"), asked.alias("text"))
    mark = F.element_at(F.array(*map(F.lit, _MARKS)), (F.col("doc_id") % 5 + 1).cast("int"))
    sections = t.documents.select("source", F.col("doc_id").alias("section"), F.left(F.concat(mark, "text"), F.lit(C.LONG_SECTION)).alias("text"))
    domains = t.spark.createDataFrame([(0, "en", "English", ""), (1, "gastro_hepato", "German", "")], "nth int, domain string, label string, summary string")
    matched = questions.select("qid").crossJoin(F.broadcast(domains))
    named = F.when(F.col("lang") == "de", "gastro_hepato").otherwise(F.col("lang"))
    listed = t.documents.where(F.col("lang").isin("de", "en")).select(named.alias("domain"), "source").distinct()
    listed = listed.select("domain", F.row_number().over(Window.partitionBy("domain").orderBy("source")).alias("nth"), F.col("source").alias("title"), "source")
    found = C.catalogue_sources(questions, matched, listed, sections, "qid").where("source <> 'domain_catalog'")
    return found.select("qid", "rank", "domain", "source", F.col("snippet").alias("section_text"), "score")

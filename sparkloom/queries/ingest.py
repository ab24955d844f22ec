"""Document ingest over ``documents`` and ``pages``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import ingest as I
from ..operators import noise as N
from ..plans.rank import global_rank
from .registry import Tables, query


@query()
def parse_blocks(t: Tables) -> DataFrame:
    """D1."""
    return I.blocks(t.documents, "doc_id", "text")


@query()
def chunk_documents(t: Tables) -> DataFrame:
    """D5, D6, D7."""
    return I.chunks(t.documents, "doc_id", "text")


@query("SELECT doc_id, greatest(1, length(text) // 4)::INT AS tokens FROM documents")
def token_estimate(t: Tables) -> DataFrame:
    """D4."""
    return t.documents.select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


KEYS = "[" + ", ".join(f"'{w}'" for w in I.KEYWORDS) + "]"
#: Every third document gets words of the domain, so that keywords and questions have something to find.
DOMAIN_TEXT = "CASE doc_id % 3 WHEN 0 THEN text || ' Shock y sepsis: criterio GRACE > 140, tratamiento' WHEN 1 THEN text || ' algoritmo de riesgo con ECG' ELSE text END"
FOUND = f"list_sort(list_distinct(list_concat(list_filter({KEYS}, lambda w: contains(lower(text), w)), regexp_extract_all(text, '\\b[A-Z]+\\s*(?:[><]=?|=)\\s*\\d+\\b'))))::VARCHAR[]"


def _domain_texts(t: Tables) -> DataFrame:
    return t.documents.selectExpr("doc_id", "lang", f"{DOMAIN_TEXT} AS text")


@query(f"SELECT doc_id, {FOUND} AS keywords FROM (SELECT doc_id, {DOMAIN_TEXT} AS text FROM documents)")
def keyword_extract(t: Tables) -> DataFrame:
    """D2."""
    return _domain_texts(t).select("doc_id", I.keywords(F.col("text")).alias("keywords"))


def _asked(words: tuple[str, ...], template: str) -> str:
    return f"CASE WHEN {' OR '.join(f'contains(lower(text), {w!r})' for w in words)} THEN replace('{template}', '{{}}', topic) END"


@query(
    f"""WITH d AS (SELECT doc_id, 'seccion ' || lang AS topic, {DOMAIN_TEXT} AS text FROM documents), k AS (SELECT *, {FOUND} AS k,
      list_filter(regexp_extract_all(lower(text), '[a-zA-Z0-9\\-]+'), lambda w: length(w) >= 5 AND w NOT IN ({', '.join(f"'{w}'" for w in I.QUESTION_STOP)})) AS w FROM d),
    u AS (SELECT *, list_filter(w, lambda x, i: list_position(w, x) = i) AS own FROM k)
    SELECT doc_id, list_filter(['¿Cual es el manejo operativo de ' || topic || '?', '¿Cuales son los pasos iniciales para ' || topic || '?', {', '.join(_asked(w, q) for w, q in I.QUESTION_RULES)},
    CASE WHEN len(k) > 0 THEN '¿Que recomendaciones practicas se dan para ' || array_to_string(k[1:2], ', ') || '?' END,
    CASE WHEN len(own) > 0 THEN '¿Como se integran ' || array_to_string(own[1:2], ', ') || ' dentro del plan operativo?' END], lambda q: q IS NOT NULL)[1:6] AS questions FROM u"""
)
def question_generation(t: Tables) -> DataFrame:
    """D3."""
    section = F.concat(F.lit("Documento > seccion  "), "lang")
    return _domain_texts(t).select("doc_id", I.questions(F.col("text"), section).alias("questions"))


@query("SELECT doc_id, md5(rtrim(left(source || ' | ' || lang, 180)) || chr(10) || text) AS decorated FROM documents")
def chunk_decoration(t: Tables) -> DataFrame:
    """D8."""
    return t.documents.select("doc_id", F.md5(I.decorate(F.col("text"), F.col("source"), F.col("lang"))).alias("decorated"))


NAMES = [*I.CONTENT_TYPES, "nothing known"]
CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in I.CONTENT_TYPES.items())


@query(f"SELECT event_id, CASE lower(trim(name)) {CASES} ELSE 'paragraph' END AS kind FROM (SELECT event_id, ' ' || upper([{', '.join(f'{n!r}' for n in NAMES)}][event_id % {len(NAMES)} + 1]) AS name FROM events)")
def content_type(t: Tables) -> DataFrame:
    """Events as blocks that go by all names of types in turn."""
    name = F.concat(F.lit(" "), F.upper(F.element_at(F.array(*map(F.lit, NAMES)), (F.col("event_id") % len(NAMES) + 1).cast("int"))))
    return t.events.select("event_id", I.content_type(name).alias("kind"))


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def exact_dedup(t: Tables) -> DataFrame:
    """D10, D11."""
    return I.first_copies(t.documents, "text", [F.asc("doc_id")]).select("doc_id", "source")


GATE = """p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
 g AS (SELECT doc_id, count(*) AS n_chunks, sum(length(line))::BIGINT AS total_chars, avg(length(line)) AS mean FROM p GROUP BY doc_id),
 r AS (SELECT doc_id, n_chunks, total_chars, list_filter([CASE WHEN n_chunks < 1 THEN 'min_chunks' END, CASE WHEN total_chars < 180 THEN 'min_total_chars' END,
 CASE WHEN mean < 48 THEN 'min_avg_chunk_chars' END], lambda x: x IS NOT NULL) AS reasons FROM g)"""


def _gate(t: Tables) -> DataFrame:
    lines = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return I.quality_gate(lines, "doc_id", F.length("line"))


@query(f"WITH {GATE} SELECT * FROM r")
def quality_gate(t: Tables) -> DataFrame:
    """With lines as chunks."""
    return _gate(t)


@query(f"WITH {GATE} SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM r) GROUP BY reason")
def rejection_histogram(t: Tables) -> DataFrame:
    """D13."""
    return _gate(t).select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


PATHS = "CASE doc_id % 4 WHEN 0 THEN 'docs/47_' || source || '.md' WHEN 1 THEN 'docs/pdf_raw/Neurologia ' || source || '.pdf' WHEN 2 THEN 'docs/58_' || source || '.md' ELSE 'docs/otros/' || source || '.md' END"


@query(
    f"""SELECT doc_id, CASE {' '.join(f"WHEN contains(p, '{k}') THEN '{v}'" for k, v in I.PATH_SPECIALTIES.items())} {' '.join(f"WHEN contains(b, '{k}') THEN '{v}'" for k, v in I.NAME_SPECIALTIES)} END AS specialty
    FROM (SELECT doc_id, lower(path) AS p, regexp_replace(regexp_extract(lower(path), '([^/]*)$', 1), '[^a-z0-9_.-]', '', 'g') AS b FROM (SELECT doc_id, {PATHS} AS path FROM documents))"""
)
def specialty_infer(t: Tables) -> DataFrame:
    """Documents under paths of the kinds that the maps know."""
    return t.documents.selectExpr("doc_id", f"{PATHS} AS path").select("doc_id", I.specialty(F.col("path")).alias("specialty"))


@query("SELECT d.doc_id, coalesce(l.quality::VARCHAR, d.lang) AS specialty FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def specialty_backfill(t: Tables) -> DataFrame:
    """A chunk's own value, else its document's."""
    own = t.labels.select("doc_id", F.col("quality").cast("string").alias("own"))
    return t.documents.join(own, "doc_id", "left").select("doc_id", F.coalesce("own", "lang").alias("specialty"))


BOX = ["event_id", "user_id AS page", "CASE WHEN event_id % 7 > 0 THEN value END AS y0", "CASE WHEN event_id % 5 > 0 THEN value % 10 END AS x0"]


@query(f"SELECT event_id, page, row_number() OVER (ORDER BY page, coalesce(y0, 1e9), coalesce(x0, 1e9), event_id)::INT AS place FROM (SELECT {', '.join(BOX)} FROM events)")
def block_order(t: Tables) -> DataFrame:
    """All blocks in reading order; events are blocks, their users pages, and some have no box."""
    order = [F.asc("page"), F.coalesce("y0", F.lit(1e9)).asc(), F.coalesce("x0", F.lit(1e9)).asc(), F.asc("event_id")]
    return global_rank(t.events.selectExpr(*BOX), order, "place").select("event_id", "page", F.col("place").cast("int").alias("place"))


@query(
    """WITH p AS (SELECT doc_id, source, place, line FROM (SELECT doc_id, source, generate_subscripts(string_split(text, chr(10)), 1) AS place, unnest(string_split(text, chr(10))) AS line FROM documents)),
    e AS (SELECT *, row_number() OVER (PARTITION BY source, doc_id ORDER BY place) = 1 OR row_number() OVER (PARTITION BY source, doc_id ORDER BY place DESC) = 1 AS edge FROM p),
    o AS (SELECT source, line FROM e WHERE edge AND length(line) <= 120 GROUP BY ALL HAVING count(DISTINCT doc_id) >= 2)
    SELECT doc_id, count(*) AS kept FROM e WHERE NOT (edge AND (source, line) IN (SELECT (source, line) FROM o)) GROUP BY doc_id"""
)
def repeated_edges(t: Tables) -> DataFrame:
    """Documents as pages of their source, without lines that recur at their edges."""
    rows = t.documents.select("source", "doc_id", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    return I.without_repeated_edges(rows, "source", "doc_id", "place", "line").groupBy("doc_id").agg(F.count("*").alias("kept"))


@query(
    r"""SELECT conv_id, turn, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?i)</?(?:system|assistant|user)>', '', 'g'), '```', '''''''', 'g'),
    '(?i)<<<\s*end[^>]*>>>', '', 'g'), '(?i)ignore (?:all )?previous instructions', '[removed]', 'g')) AS clean,
    list_filter([CASE WHEN regexp_matches(text, '(?i)</?(?:system|assistant|user)>') THEN 'role_tag' END, CASE WHEN contains(text, '```') THEN 'code_fence' END,
    CASE WHEN regexp_matches(text, '(?i)<<<\s*end[^>]*>>>') THEN 'marker' END, CASE WHEN regexp_matches(text, '(?i)ignore (?:all )?previous instructions') THEN 'override' END],
    lambda x: x IS NOT NULL) AS signals FROM conversations"""
)
def sanitise_text(t: Tables) -> DataFrame:
    """D22, D23."""
    clean, signals = I.sanitise(F.col("text"))
    return t.conversations.select("conv_id", "turn", F.md5(clean).alias("clean"), signals.alias("signals"))


@query(
    r"""SELECT doc_id, list_slice(list_concat(list_filter(u, lambda x, i: list_position(u, x) = i), []::VARCHAR[]), 1, 16) AS facts FROM (SELECT doc_id,
    list_concat(regexp_extract_all(lower(text), '\d+(?:[.,]\d+)?\s?(?:mg|ml|mmhg|%|kg|h|min)'), regexp_extract_all(lower(text), '(?:<=|>=|<|>)\s?\d+(?:[.,]\d+)?'),
    list_filter(['license', 'token', 'password'], lambda w: contains(lower(text), w))) AS u FROM documents)"""
)
def fact_extraction(t: Tables) -> DataFrame:
    """D24."""
    return t.documents.select("doc_id", I.facts(F.col("text"), ["license", "token", "password"]).alias("facts"))


@query()
def sentence_split(t: Tables) -> DataFrame:
    """DuckDB's expressions look no further back, so this has no SQL."""
    return t.documents.select("doc_id", I.sentences(F.col("text")).alias("sentences"), I.discourse_units(F.col("text")).alias("units"))


@query(
    r"""WITH k AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9#\-\+/]+') AS w FROM documents),
    a AS (SELECT doc_id, w, coalesce(list_position(list_transform(w, lambda x: x IN ('hest', 'blest', 'license')), true), 0) AS pos FROM k)
    SELECT doc_id, array_to_string(CASE WHEN pos > 0 THEN w[greatest(1, pos - 14):pos + 14] ELSE w[1:28] END, ' ') AS snippet FROM a"""
)
def kwic_snippet(t: Tables) -> DataFrame:
    """D29."""
    asked = F.array(*map(F.lit, ("hest", "blest", "license")))
    return t.documents.select("doc_id", I.kwic(X.ir_tokens(F.col("text")), asked).alias("snippet"))


@query(
    """SELECT doc_id FROM (SELECT doc_id, list_slice(string_split(text, chr(10)), 1, 8) AS head FROM documents)
    WHERE len(list_filter(head, lambda x: NOT (length(x) < 30 OR contains(lower(x), 'license')))) > 0"""
)
def noise_filter(t: Tables) -> DataFrame:
    """Documents of whose first eight lines not all are noise."""
    noise = lambda x: (F.length(x) < 30) | F.contains(F.lower(x), F.lit("license"))
    return t.documents.where(~F.forall(F.slice(F.split("text", "\n"), 1, 8), noise)).select("doc_id")


@query(
    r"""SELECT doc_id, left(trim(regexp_replace(regexp_replace(text, '[*#`|>]+', ' ', 'g'), '[ \t\n\r]+', ' ', 'g')), 220) AS snippet FROM documents"""
)
def snippet_clean(t: Tables) -> DataFrame:
    """D25."""
    bare = F.regexp_replace(F.regexp_replace("text", "[*#`|>]+", " "), "[ \\t\\n\\r]+", " ")
    return t.documents.select("doc_id", F.left(F.trim(bare), F.lit(220)).alias("snippet"))


_HEADS = ("", "git pull app/x\n", "short\n\n", "See docs/40_motor.md and C:/notes/old/plan.pdf for the whole of it.\n", "{json}\n")
#: Documents behind lines of several kinds.
NOISED = f"CASE doc_id % 5 {' '.join(f"WHEN {i} THEN '{h}'" for i, h in enumerate(_HEADS))} END || text".replace("\n", "' || chr(10) || '")
_LINES = "list_filter(regexp_split_to_array({}, '[\n\r]'), lambda x: trim(x) <> '')"


def _noisy(x: str) -> str:
    low = f"lower(trim({x}))"
    return "(" + " OR ".join(f"contains({low}, '{m}')" for m in N.NOISE) + f" OR length(regexp_replace({low}, '[^\\p{{L}}]', '', 'g')) < {N.LETTERS})"


def _noised() -> Column:
    return F.concat(F.element_at(F.array(*map(F.lit, _HEADS)), (F.col("doc_id") % 5 + 1).cast("int")), "text")


@query(
    f"""WITH d AS (SELECT doc_id, source, 'docs/' || (doc_id % 100)::VARCHAR || '_' || source AS file, {NOISED} AS t FROM documents), l AS (SELECT doc_id, source, file, {_LINES.format('t')}[1:8] AS h FROM d),
    n AS (SELECT doc_id, source, len(list_filter(h, lambda x: NOT {_noisy('x')})) = 0 OR NOT doc_id % 100 BETWEEN 40 AND 86 AS noise FROM l), w AS (SELECT *, count(*) FILTER (NOT noise) OVER (PARTITION BY source) = 0 AS fell_back FROM n)
    SELECT doc_id, source, fell_back FROM w WHERE NOT noise OR fell_back"""
)
def noise_rules(t: Tables) -> DataFrame:
    """Of each source the documents that are no noise by their first lines and by their numbers, or all if none is left."""
    rows = t.documents.select("doc_id", "source", F.concat(F.lit("docs/"), (F.col("doc_id") % 100).cast("string"), F.lit("_"), "source").alias("file"), _noised().alias("text"))
    return N.drop_noisy(rows, "source", "text", "file").select("doc_id", "source", "fell_back")


@query(
    f"""WITH d AS (SELECT doc_id, {NOISED} AS t FROM documents), l AS (SELECT doc_id, t, list_transform(list_filter({_LINES.format('t')}, lambda x: NOT {_noisy('x')}), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))) AS k FROM d),
    c AS (SELECT doc_id, t, list_filter(k, lambda x, i: coalesce(list_sum(list_transform(k[1:i - 1], lambda y: length(y))), 0) < 320) AS k FROM l),
    m AS (SELECT doc_id, CASE WHEN len(k) = 0 THEN trim(regexp_replace(t, '\\s+', ' ', 'g')) ELSE array_to_string(k, ' ') END AS x FROM c)
    SELECT doc_id, left(trim(regexp_replace(regexp_replace(regexp_replace(x, '\\bdocs[\\\\/][^\\s)]+', '', 'gi'), '(?:[A-Za-z]:)?[\\\\/](?:[^\\\\/\\s]+[\\\\/])+[^\\\\/\\s]+(?:\\.(?:md|txt|pdf))?', '', 'gi'), '\\s{{2,}}', ' ', 'g')), 320) AS snippet FROM m"""
)
def snippet_chain(t: Tables) -> DataFrame:
    """Snippets of 320 characters without noise and paths."""
    return t.documents.select("doc_id", N.clean_snippet(_noised(), 320).alias("snippet"))


@query()
def page_manifest(t: Tables) -> DataFrame:
    """Pages as files with their manifest lines."""
    from ..operators.graph import page_parts
    from ..sources.sinks import page_records

    parts = page_parts(t.pages, "url", "html")
    host = F.lower(F.regexp_extract("url", "^[A-Za-z]+://([^/?#]*)", 1))
    pages = parts.select("url", host.alias("host"), F.lit(1).alias("depth"), F.lit("seed").alias("discovered_from"), "title", "text", F.lit(0.0).alias("fetched_at"), F.lit(200).alias("status_code"), "links")
    return page_records(pages)


@query()
def parsed_markdown_blocks(t: Tables) -> DataFrame:
    """Documents with a heading and a page mark before every other line."""
    from ..sources.sinks import parsed_blocks

    text = F.concat(F.lit("# "), "source", F.lit("\n[Page 2]\n"), F.replace("text", F.lit("\n"), F.lit("\n\n")))
    return parsed_blocks(t.documents.select("doc_id", text.alias("text")), "doc_id", "text")


@query(
    """SELECT doc_id, CASE WHEN p LIKE '%.md' THEN 'markdown' WHEN p LIKE '%.txt' THEN 'text' ELSE 'unsupported' END AS parser, length(trim(text)) AS chars, 1 AS pages, p NOT LIKE '%.bin' AND length(trim(text)) > 0 AS ok FROM
    (SELECT doc_id, text, CASE doc_id % 3 WHEN 0 THEN 'a.md' WHEN 1 THEN 'b.txt' ELSE 'c.bin' END AS p FROM documents)"""
)
def parse_traces(t: Tables) -> DataFrame:
    """S3: documents as files of three kinds."""
    from ..sources.sinks import parse_trace

    path = F.when(F.col("doc_id") % 3 == 0, "A.md").when(F.col("doc_id") % 3 == 1, "b.TXT").otherwise("c.bin")
    rows = t.documents.select("doc_id", path.alias("path"), "text")
    found = parse_trace(rows.select(F.concat("path", F.lit("")).alias("path"), "text", "doc_id").withColumn("path", F.concat(F.col("doc_id").cast("string"), F.lit("/"), "path")), "path", "text")
    return found.select(F.split_part("path", F.lit("/"), F.lit(1)).cast("long").alias("doc_id"), "parser", "chars", "pages", "ok")


@query("SELECT doc_id, nth::INT AS nth, CASE nth WHEN 0 THEN 'header' WHEN 1 THEN 'formula' ELSE 'paragraph' END AS type, CASE nth WHEN 0 THEN source WHEN 1 THEN '$$' || lang || '$$' ELSE 'x' END AS content, nth::INT + 1 AS page FROM documents, (SELECT unnest([0, 1, 2]) AS nth)")
def layout_blocks(t: Tables) -> DataFrame:
    """Documents as layouts of three blocks, one on each page."""
    from ..sources.layout import blocks

    block = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("content"))
    pages = F.array(*(F.struct(F.array(b).alias("blocks")) for b in (block("Title", F.col("source")), block("equation", F.col("lang")), block("other", F.lit("x")))))
    rows = t.documents.select("doc_id", F.to_json(F.struct(pages.alias("pages"))).alias("json"))
    return blocks(rows, "doc_id", "json").select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "nth")).alias("n"), "type", "content", "page").select("doc_id", (F.col("n") - 1).alias("nth"), "type", "content", "page")


@query("SELECT doc_id, sha256(text) AS key, sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0) AS first_run, false AS second_run, 8 AS size FROM documents")
def vector_cache(t: Tables) -> DataFrame:
    """Which vectors a cache that knows a third of the documents has for all of them, and which must be computed afterwards: none."""
    from ..operators.vector import hash_embedding
    from ..plans.cut import checkpoint, new_folder, remove
    from ..sources.vector_cache import VectorCache

    path = new_folder(t.spark, "vector-cache")
    cache = VectorCache(t.spark, path)
    compute = lambda rows: rows.select("key", hash_embedding(F.col("text"), 8).alias("vector"))
    cache.with_vectors(t.documents.where("doc_id % 3 = 0").select("text"), "text", compute)
    before = checkpoint(cache.vectors().select("key", F.lit(True).alias("had")))
    whole = cache.with_vectors(t.documents.select("doc_id", "text"), "text", compute)
    missed: list[int] = []
    again = cache.with_vectors(t.documents.select("text"), "text", lambda rows: missed.append(1) or compute(rows))
    found = whole.join(before, "key", "left").select("doc_id", "key", F.coalesce("had", F.lit(False)).alias("first_run"), F.lit(bool(missed)).alias("second_run"), F.size("vector").alias("size"))
    del again
    found = checkpoint(found)
    remove(t.spark, path)
    return found

"""Index, Boolean search and ranking over ``documents``; ``benchmark`` passages are the queries."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import search as S
from ..operators import vector_index as V
from ..operators.relational import top_per_group
from ..plans import boolean as B
from ..plans.cut import checkpoint, new_folder, remove
from ..sources.stored import Kept
from .registry import Tables, query

TOK = r"regexp_extract_all(lower(text), '[a-z0-9#\-\+/]+')"
#: Documents with each token at its places, for the SQL.
POST = f"p AS (SELECT doc_id AS chunk_id, unnest({TOK}) AS term, generate_subscripts({TOK}, 1) - 1 AS place FROM documents)"


def _index(t: Tables) -> DataFrame:
    docs = t.documents.select(F.col("doc_id").alias("chunk_id"), "text")
    return S.postings(docs, "chunk_id", X.ir_tokens(F.col("text")))


def _boolean(t: Tables, text: str, cap: int | None = None) -> DataFrame:
    universe = t.documents.select(F.col("doc_id").alias("chunk_id"))
    return B.evaluate(text, _index(t), universe, cap=cap)


def _has(*terms: str) -> list[str]:
    return [f"(SELECT chunk_id FROM p WHERE term = '{x}')" for x in terms]


@query(f"WITH {POST} SELECT term, count(DISTINCT chunk_id) AS df, count(*) AS cf FROM p GROUP BY term")
def vocab_df(t: Tables) -> DataFrame:
    """Every term with its document and collection frequency; terms are counted in their documents first, without places."""
    own = t.documents.select("doc_id", F.explode(X.ir_tokens(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    return own.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query("WITH {} {} INTERSECT {}".format(POST, *_has("thre", "tion")))
def boolean_and(t: Tables) -> DataFrame:
    """B15, P1."""
    return _boolean(t, "thre AND tion")


@query("WITH {} {} UNION {}".format(POST, *_has("hest", "blest")))
def boolean_or(t: Tables) -> DataFrame:
    """B15, P3."""
    return _boolean(t, "hest OR blest")


@query("WITH {} SELECT doc_id AS chunk_id FROM documents EXCEPT {}".format(POST, *_has("the")))
def boolean_not(t: Tables) -> DataFrame:
    """Over all documents."""
    return _boolean(t, "NOT the")


@query("WITH {} (({} UNION {}) INTERSECT {}) EXCEPT {}".format(POST, *_has("hest", "blest", "the", "was")))
def boolean_expr(t: Tables) -> DataFrame:
    """Implicit AND, parentheses and NOT."""
    return _boolean(t, "(hest OR blest) the NOT was")


@query(
    f"""WITH {POST}, l AS (SELECT chunk_id, term, dense_rank() OVER (PARTITION BY term ORDER BY chunk_id) AS r FROM p WHERE term IN ('the', 'and'))
    SELECT chunk_id FROM l WHERE term = 'the' AND r <= 180 INTERSECT SELECT chunk_id FROM l WHERE term = 'and' AND r <= 180"""
)
def boolean_capped(t: Tables) -> DataFrame:
    """Lists are cut at the 180 lowest ids before they are intersected."""
    return _boolean(t, '"the" AND "and"', cap=180)


@query(
    f"WITH {POST} SELECT DISTINCT a.chunk_id FROM p a JOIN p b ON a.chunk_id = b.chunk_id AND b.place = a.place + 1 WHERE a.term = 'of' AND b.term = 'the'"
)
def phrase_match(t: Tables) -> DataFrame:
    """B6, B12."""
    return _boolean(t, '"of the"')


@query(
    f"""WITH {POST} SELECT DISTINCT a.chunk_id FROM p a JOIN p b ON a.chunk_id = b.chunk_id AND a.place <> b.place
    AND abs(a.place - b.place) - 1 <= 3 WHERE a.term = 'hest' AND b.term = 'the'"""
)
def near_match(t: Tables) -> DataFrame:
    """B2, B7."""
    return _boolean(t, "hest /3 the")


VOCAB = f"v AS (SELECT term, count(DISTINCT chunk_id) AS df FROM p GROUP BY term)"


def _grams(x: str) -> str:
    return f"list_distinct(list_transform(range(1, greatest(length('$' || {x} || '$') - 2, 1) + 1), lambda i: substr('$' || {x} || '$', i, 3)))"


@query(
    f"""WITH {POST}, {VOCAB}, c AS (SELECT * FROM v WHERE term LIKE 'her%' ORDER BY df DESC, term LIMIT 16),
    s AS (SELECT *, len(list_intersect({_grams('term')}, {_grams("'her'")})) AS i, len(list_distinct(list_concat({_grams('term')}, {_grams("'her'")}))) AS u FROM c)
    SELECT term, df, round(i / u, 6) AS similarity FROM s WHERE i / u >= 0.18"""
)
def wildcard_kgram(t: Tables) -> DataFrame:
    """B8."""
    return S.wildcard(S.vocabulary(_index(t), "chunk_id"), "her*").withColumn("similarity", F.round("similarity", 6))


@query(
    f"""WITH {POST}, {VOCAB}, w AS (SELECT DISTINCT word FROM (SELECT unnest({TOK}) AS word FROM benchmark) WHERE length(word) >= 5),
    c AS (SELECT word, term, df, row_number() OVER (PARTITION BY word ORDER BY df DESC, term) AS n FROM w JOIN v ON left(word, 1) = left(term, 1)
      AND abs(length(word) - length(term)) <= 2 AND word <> term),
    d AS (SELECT word, term, df, levenshtein(word, term) AS distance FROM c WHERE n <= 128),
    g AS (SELECT *, len(list_intersect({_grams('word')}, {_grams('term')})) / len(list_distinct(list_concat({_grams('word')}, {_grams('term')}))) AS j FROM d WHERE distance <= 2)
    SELECT word, term, distance::INT AS distance, df FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY distance, df DESC, term) AS r FROM g WHERE j >= 0.18) WHERE r = 1"""
)
def spell_suggest(t: Tables) -> DataFrame:
    """Terms near the words of the benchmark passages."""
    words = t.benchmark.select(F.explode(X.ir_tokens(F.col("text"))).alias("word")).distinct()
    return S.spelling(S.vocabulary(_index(t), "chunk_id"), words, "word")


def _sound(x: str) -> str:
    """The Soundex code of a term, in SQL."""
    letters = f"regexp_replace(upper({x}), '[^A-Z]', '', 'g')"
    once = f"translate({letters}, 'BFPVCGJKQSXZDTLMNRAEIOUYHW', '11112222222233455600000000')"
    for digit in "0123456":
        once = f"regexp_replace({once}, '{digit}+', '{digit}', 'g')"
    return f"CASE WHEN {letters} = '' THEN '' ELSE rpad(left({letters}, 1) || replace(substr({once}, 2), '0', ''), 4, '0') END"


@query(
    f"""WITH {POST}, {VOCAB}, k AS (SELECT item_id, unnest({TOK}) AS word, generate_subscripts({TOK}, 1) AS i FROM benchmark),
    o AS (SELECT word, lag(word) OVER (PARTITION BY item_id ORDER BY i) AS l, lead(word) OVER (PARTITION BY item_id ORDER BY i) AS r FROM k),
    w AS (SELECT DISTINCT word, l, r FROM o LEFT JOIN v ON o.word = v.term WHERE length(word) >= 5 AND coalesce(df, 0) <= 4),
    c AS (SELECT u.word, v.term, v.df, row_number() OVER (PARTITION BY u.word ORDER BY v.df DESC, v.term) AS n FROM (SELECT DISTINCT word FROM w) u JOIN v ON left(u.word, 1) = left(v.term, 1)
      AND length(v.term) BETWEEN greatest(3, length(u.word) - 2) AND length(u.word) + 2),
    g AS (SELECT word, term, df, n, levenshtein(word, term) AS lev, {_sound('word')} = {_sound('term')} AND {_sound('term')} <> '' AS alike FROM c WHERE n <= 128 AND word <> term
      AND len(list_intersect({_grams('word')}, {_grams('term')})) / len(list_distinct(list_concat({_grams('word')}, {_grams('term')}))) >= 0.18),
    m AS (SELECT w.word, l, r, term, df, CASE WHEN lev <= 2 THEN lev END AS distance FROM w JOIN g ON w.word = g.word WHERE (lev <= 2 OR alike) AND (n <= 10 OR l IS NULL AND r IS NULL)),
    b AS (SELECT x.term AS a, y.term AS b, count(DISTINCT x.chunk_id) AS n FROM p x JOIN p y ON x.chunk_id = y.chunk_id AND y.place = x.place + 1
      WHERE (x.term, y.term) IN (SELECT (l, term) FROM m UNION SELECT (term, r) FROM m) GROUP BY ALL),
    s AS (SELECT m.*, coalesce(b1.n, 0) + coalesce(b2.n, 0) AS context FROM m LEFT JOIN b b1 ON b1.a = l AND b1.b = term LEFT JOIN b b2 ON b2.a = term AND b2.b = r)
    SELECT word, l AS left_word, r AS right_word, term, CASE WHEN distance IS NULL THEN 'sound' ELSE 'edit' END AS tier, distance::INT AS distance, context, df FROM (SELECT *, row_number() OVER
      (PARTITION BY word, l, r ORDER BY distance IS NULL, distance, context DESC, df DESC, term) AS nth FROM s) WHERE nth = 1"""
)
def spell_cascade(t: Tables) -> DataFrame:
    """Corrections of the rare words of the benchmark passages by edits, neighbours, df and, last, sound."""
    index = checkpoint(_index(t))
    order = Window.partitionBy("item_id").orderBy("i")
    words = t.benchmark.select("item_id", F.posexplode(X.ir_tokens(F.col("text"))).alias("i", "word"))
    asked = words.select("word", F.lag("word").over(order).alias("left"), F.lead("word").over(order).alias("right"))
    found = S.corrections(asked, S.vocabulary(index, "chunk_id"), index, "chunk_id")
    return found.withColumnRenamed("left", "left_word").withColumnRenamed("right", "right_word")


@query(
    """SELECT a.p_partkey, CASE WHEN levenshtein(a.p_name, a.p_type) > 12 THEN 13 ELSE levenshtein(a.p_name, a.p_type) END::INT AS distance FROM part a"""
)
def levenshtein_cutoff(t: Tables) -> DataFrame:
    """B10."""
    return t.part.select("p_partkey", X.edit_distance(F.col("p_name"), F.col("p_type"), 12).alias("distance"))


@query(
    f"""SELECT p_partkey, round(len(list_intersect({_grams('p_name')}, {_grams('p_type')})) / len(list_distinct(list_concat({_grams('p_name')}, {_grams('p_type')}))), 6) AS j FROM part"""
)
def kgram_jaccard(t: Tables) -> DataFrame:
    """B8."""
    return t.part.select("p_partkey", F.round(X.jaccard(X.kgrams(F.col("p_name")), X.kgrams(F.col("p_type"))), 6).alias("j"))


@query(f"SELECT c_custkey, {_sound('c_name')} AS code FROM customer")
def soundex_codes(t: Tables) -> DataFrame:
    """B11."""
    return t.customer.select("c_custkey", X.soundex_strict(F.col("c_name")).alias("code"))


POOL = 88
#: The whole ranking in SQL, from counts to features.
RANK = f"""
cnt AS (
  SELECT doc_id, 'title' AS zone, 0.28 AS w, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(source || ' ' || source), '[a-z0-9#\\-\\+/]+')) AS term FROM documents) GROUP BY ALL
  UNION ALL SELECT doc_id, 'section', 0.24, 'documento', 1 FROM documents
  UNION ALL SELECT doc_id, 'body', 0.28, term, count(*) FROM (SELECT doc_id, unnest({TOK}) AS term FROM documents) GROUP BY ALL),
q0 AS (SELECT item_id AS qid, unnest({TOK}) AS term, generate_subscripts({TOK}, 1) AS place FROM benchmark),
q1 AS (SELECT qid, term, count(*) AS qtf, min(place) AS place FROM q0 GROUP BY ALL),
q AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY qtf DESC, place) AS n FROM q1) WHERE n <= 24),
pool AS (SELECT qid, doc_id FROM (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY doc_id) AS n FROM
  (SELECT DISTINCT qid, doc_id FROM q JOIN cnt USING (term))) WHERE n <= {POOL}),
len AS (SELECT doc_id, greatest(1, sum(CASE WHEN zone = 'body' THEN tf ELSE 0 END)) AS len FROM cnt GROUP BY doc_id),
size AS (SELECT qid, count(*) AS nn, avg(len) AS avg_len FROM pool JOIN len USING (doc_id) GROUP BY qid),
hit AS (SELECT qid, term, any_value(qtf) AS qtf, any_value(place) AS place, doc_id, sum(w * (1 + ln(tf))) AS sub, sum(w * tf)::DOUBLE AS wtf, sum(w)::DOUBLE AS present
  FROM q JOIN cnt USING (term) JOIN pool USING (qid, doc_id) GROUP BY qid, term, doc_id),
df AS (SELECT qid, term, count(*) AS df, sum(wtf) AS ctf FROM hit GROUP BY ALL),
st AS (SELECT q.qid, q.term, q.qtf, q.place, coalesce(df, 0) AS df, coalesce(ctf, 0) AS ctf, nn, avg_len, ln((nn + 1) / (coalesce(df, 0) + 1)) + 1 AS idf
  FROM q LEFT JOIN df ON q.qid = df.qid AND q.term = df.term JOIN size ON q.qid = size.qid),
rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY idf DESC, place) AS nth, count(*) FILTER (idf >= 1.15) OVER (PARTITION BY qid) AS strong,
  count(*) OVER (PARTITION BY qid) AS alln FROM st),
ac AS (SELECT *, (1 + ln(qtf)) * idf AS qw FROM rk WHERE CASE WHEN strong < least(alln, 4) THEN nth <= 4 ELSE idf >= 1.15 END),
a2 AS (SELECT *, sqrt(sum(qw * qw) OVER (PARTITION BY qid)) AS qnorm, count(*) OVER (PARTITION BY qid) AS n_terms,
  greatest(1e-12, ctf / nullif(sum(ctf) OVER (PARTITION BY qid), 0)) AS cprob FROM ac),
feat AS (SELECT a2.qid, hit.doc_id, sum(qw * sub * idf) / (sqrt(sum(sub * idf * sub * idf)) * any_value(qnorm)) AS cosine, sum(present) / any_value(n_terms) AS zone,
  sum(ln((nn - df + 0.5) / (df + 0.5) + 1) * (wtf * 2.5) / (wtf + 1.5 * (0.25 + 0.75 * greatest(1, len / greatest(1, avg_len))))) AS bm25,
  sum(ln(greatest(1e-9, nn - df + 0.5) / greatest(1e-9, df + 0.5))) AS bim,
  sum(hit.qtf * ln(greatest(1e-12, (wtf + 1200 * cprob) / (len + 1200)))) AS qlm,
  sum(hit.qtf * ln(greatest(1e-12, 0.8 * wtf / len + 0.2 * cprob))) AS qlm_jm, any_value(len / greatest(1, avg_len)) AS rel_len
  FROM a2 JOIN hit ON a2.qid = hit.qid AND a2.term = hit.term JOIN len USING (doc_id) GROUP BY a2.qid, hit.doc_id),
f AS (SELECT *, (0.8 * cosine + 0.2 * zone) / greatest(0.2, 0.8 + 0.2 * rel_len) AS combined FROM feat)
"""


def _make_counts(documents: DataFrame) -> DataFrame:
    docs = documents.select("doc_id", "source", "text")
    zones = {"title": F.concat_ws(" ", "source", "source"), "section": F.lit("Documento"), "body": F.col("text")}
    return S.zone_counts(docs, "doc_id", zones)


#: The index of ``documents`` of each folder, for as long as its files stay as they are.
INDEX = Kept(_make_counts)


def _counts(t: Tables) -> DataFrame:
    return INDEX.of(t.documents, t.folder)


def _features(t: Tables) -> DataFrame:
    return S.features(t.benchmark.withColumnRenamed("item_id", "qid"), _counts(t), "qid", "doc_id", F.col("text"), POOL)


def _top(scored: DataFrame, score: str, k: int = 10) -> DataFrame:
    rounded = scored.withColumn("score", F.round(F.col(score), 6))
    return top_per_group(rounded, ["qid"], [F.desc("score"), F.asc("doc_id")], k).select("qid", "doc_id", "score", "rank")


def _top_sql(score: str, source: str = "f", k: int = 10) -> str:
    return f"""SELECT qid, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id)::INT AS rank
    FROM (SELECT qid, doc_id, round({score}, 6) AS score FROM {source})) WHERE rank <= {k}"""


@query(f"WITH {RANK} {_top_sql('bm25')}")
def bm25_topk(t: Tables) -> DataFrame:
    """R2-R5, R12, T2."""
    return _top(_features(t), "bm25")


@query(f"WITH {RANK} {_top_sql('combined')}")
def tfidf_zone_topk(t: Tables) -> DataFrame:
    """R1-R11."""
    return _top(_features(t), "combined")


@query(f"WITH {RANK} {_top_sql('qlm')}")
def qlm_dirichlet(t: Tables) -> DataFrame:
    """R14."""
    return _top(_features(t), "qlm")


@query(f"WITH {RANK} {_top_sql('qlm_jm')}")
def qlm_jm(t: Tables) -> DataFrame:
    """R14."""
    return _top(_features(t), "qlm_jm")


@query(f"WITH {RANK} {_top_sql('bim')}")
def bim_bonus(t: Tables) -> DataFrame:
    """R13."""
    return _top(_features(t), "bim")


def _mm(c: str) -> str:
    w = "OVER (PARTITION BY qid)"
    return f"CASE WHEN max({c}) {w} > min({c}) {w} THEN ({c} - min({c}) {w}) / (max({c}) {w} - min({c}) {w}) ELSE 0 END"


#: Places of a query's active terms in the documents that hold them all, and the shortest run with all of them.
SPAN = f"""pl AS (SELECT doc_id, unnest({TOK}) AS term, generate_subscripts({TOK}, 1) AS place FROM documents),
 wh AS (SELECT a2.qid, hit.doc_id, any_value(n_terms) AS n FROM a2 JOIN hit ON a2.qid = hit.qid AND a2.term = hit.term
   WHERE EXISTS (SELECT 1 FROM cnt WHERE cnt.doc_id = hit.doc_id AND cnt.term = hit.term AND zone = 'body') GROUP BY a2.qid, hit.doc_id HAVING count(*) = any_value(n_terms) AND any_value(n_terms) >= 2),
 pt AS (SELECT wh.qid, wh.doc_id, n, term, pl.place AS place FROM wh JOIN a2 USING (qid) JOIN pl USING (doc_id, term)),
 en AS (SELECT e.qid, e.doc_id, e.place AS stop, p.term, any_value(p.n) AS n, max(p.place) AS newest FROM pt e JOIN pt p ON e.qid = p.qid AND e.doc_id = p.doc_id AND p.place <= e.place GROUP BY ALL),
 sp AS (SELECT qid, doc_id, min(stop - begin + 1) AS span, any_value(n) AS n FROM (SELECT qid, doc_id, stop, min(newest) AS begin, any_value(n) AS n FROM en GROUP BY qid, doc_id, stop HAVING count(*) = any_value(n)) GROUP BY ALL)"""
#: Documents of good quality stand for those of the curated folder.
GOOD = "CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 0.72 ELSE 0.07 END"
BLEND = f"""{SPAN}, fs AS (SELECT f.*, span, n FROM f LEFT JOIN sp ON f.qid = sp.qid AND f.doc_id = sp.doc_id), b AS (SELECT fs.qid, fs.doc_id, 0.70 * (0.35 * combined + 0.65 * {_mm('bm25')}) + 0.30 * {_mm('qlm')} + 0.10 * {_mm('bim')}
   + 0.12 * {GOOD} + 0.10 * CASE WHEN span IS NULL THEN 0 ELSE least(1, n / span) END AS score, CASE WHEN {GOOD} >= 0.55 THEN 0 ELSE 1 END AS tier
   FROM fs LEFT JOIN labels l ON fs.doc_id = l.doc_id)"""


def _blended(t: Tables) -> DataFrame:
    near = S.proximity(checkpoint(_features(t)), t.documents, "qid", "doc_id", X.ir_tokens(F.col("text")))
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    sources = t.documents.select("doc_id", "source", "lang").join(t.labels, "doc_id", "left")
    title = F.when(good, F.concat(F.lit("Motor operativo "), "source")).otherwise(F.col("source"))
    place = F.when(good, F.concat(F.lit("docs/"), "source")).otherwise(F.col("source"))
    sources = sources.select("doc_id", S.static_quality(title, place, F.lit("Documento"), F.col("lang")).alias("static"))
    scored = S.blend(near.join(sources, "doc_id"), "qid", F.col("static"), F.col("proximity"))
    return scored.withColumn("tier", F.when(F.col("static") >= 0.55, 0).otherwise(1))


@query(f"WITH {RANK}, {BLEND} {_top_sql('score', '(SELECT * FROM b WHERE score > 0)')}")
def keyword_search(t: Tables) -> DataFrame:
    """The flagship, all features blended with proximity and static quality."""
    return _top(_blended(t), "score")


@query(
    f"""WITH {RANK}, {BLEND} SELECT qid, doc_id, tier, rank FROM (SELECT qid, doc_id, tier, row_number() OVER (PARTITION BY qid ORDER BY tier, round(score, 6) DESC, doc_id)::INT AS rank
    FROM b WHERE score > 0) WHERE rank <= 10"""
)
def tiered_rank(t: Tables) -> DataFrame:
    """Documents of high static quality first."""
    rows = _blended(t).withColumn("score", F.round("score", 6))
    return top_per_group(rows, ["qid"], [F.asc("tier"), F.desc("score"), F.asc("doc_id")], 10).select("qid", "doc_id", "tier", "rank")


VEC = """v AS (SELECT a.vec_id AS qid, b.vec_id, b.label, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]))
  * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))) AS cosine, a.label AS own FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)"""


def _neighbours(t: Tables, k: int) -> DataFrame:
    from ..operators.vector import nearest

    e = t.embeddings
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("asked"), F.col("label").alias("own"))
    return nearest(asked, e, "qid", "asked", "vec_id", "embedding", k)


@query(
    f"""WITH {VEC} SELECT qid, vec_id, score, rank FROM (SELECT qid, vec_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id)::INT AS rank
    FROM (SELECT qid, vec_id, round(greatest(0, least(1, cosine)), 6) AS score FROM v)) WHERE rank <= 10"""
)
def vector_topk(t: Tables) -> DataFrame:
    """The nearest vectors of every 50th, against all."""
    return _neighbours(t, 10).select("qid", "vec_id", "score", "rank")


def _asked_vectors(t: Tables) -> DataFrame:
    return t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("asked"))


@query(
    f"""WITH {VEC} SELECT qid, vec_id, score, rank FROM (SELECT qid, vec_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id)::INT AS rank
    FROM (SELECT qid, vec_id, round(greatest(0, least(1, cosine)), 6) AS score FROM v)) WHERE rank <= 10"""
)
def vector_index_topk(t: Tables) -> DataFrame:
    """The same from an inverted-file index, lists opened until no other can hold a nearer vector."""
    path = new_folder(t.spark, "vectors")
    index = V.build(t.embeddings, path, "vec_id", "embedding")
    found = checkpoint(V.search(index, _asked_vectors(t), "qid", "asked", 10, exact=True))
    remove(t.spark, path)
    return found.select("qid", F.col("id").alias("vec_id"), "score", "rank")


#: Lists that a query reads where it need not be exact: at least so many, and this share of all. The vectors at hand are noise without
#: clusters, of which three quarters must be read for a recall of 0.95; where vectors cluster, a tenth does (tests/test_vector_index.py).
PROBES, PROBED = 8, 0.75


@query()
def vector_index_recall(t: Tables) -> DataFrame:
    """How many of each query's exact ten nearest the index finds in few lists, and the share of vectors that it reads."""
    path = new_folder(t.spark, "vectors")
    index = V.build(t.embeddings, path, "vec_id", "embedding")
    probes = max(PROBES, math.ceil(PROBED * index.centroids().count()))
    asked = _asked_vectors(t)
    near = V.search(index, asked, "qid", "asked", 10, probes=probes).select("qid", F.col("id").alias("vec_id"))
    hits = _neighbours(t, 10).select("qid", "vec_id").join(near.withColumn("hit", F.lit(1)), ["qid", "vec_id"], "left")
    hits = hits.groupBy("qid").agg(F.count("hit").alias("hits"), F.count("*").alias("wanted"))
    found = checkpoint(hits.join(V.scanned(index, asked, "qid", "asked", probes), "qid").select("qid", "hits", "wanted", F.round("scanned", 6).alias("scanned")))
    remove(t.spark, path)
    return found


@query(
    f"""WITH {VEC}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM (SELECT qid, vec_id, label, own, round(greatest(0, least(1, cosine)), 6) AS score FROM v))
    SELECT qid, own, label, round(votes, 5) AS votes FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY votes DESC, label) AS n FROM
    (SELECT qid, any_value(own) AS own, label, sum(score) AS votes FROM r WHERE rank <= 10 GROUP BY qid, label)) WHERE n = 1"""
)
def vector_label_knn(t: Tables) -> DataFrame:
    """Labels by votes of the nearest vectors."""
    votes = _neighbours(t, 10).groupBy("qid", "label").agg(F.first("own").alias("own"), F.sum("score").alias("votes"))
    best = top_per_group(votes, ["qid"], [F.desc("votes"), F.asc("label")], 1, "n")
    # sums of six digits may end in a 5, which SQL rounds by its product
    return best.select("qid", "own", "label", (F.round(F.col("votes") * 1e5) / 1e5).alias("votes"))


FUSE = f"""k AS (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM (SELECT qid, doc_id, round(bm25, 6) AS score FROM f)),
 m AS (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM (SELECT qid, doc_id, round(qlm, 6) AS score FROM f))"""


def _rmm(src: str) -> str:
    w = "OVER (PARTITION BY qid)"
    return f"(SELECT qid, doc_id, CASE WHEN max(score) {w} > min(score) {w} THEN (score - min(score) {w}) / (max(score) {w} - min(score) {w}) ELSE 1 - (rank - 1) / count(*) {w} END AS s FROM {src} WHERE rank <= 20)"


@query(
    f"""WITH {RANK}, {FUSE}, u AS (SELECT coalesce(a.qid, b.qid) AS qid, coalesce(a.doc_id, b.doc_id) AS doc_id, 0.5 * coalesce(a.s, 0) + 0.5 * coalesce(b.s, 0) AS fused
    FROM {_rmm('k')} a FULL JOIN {_rmm('m')} b ON a.qid = b.qid AND a.doc_id = b.doc_id) {_top_sql('fused', 'u')}"""
)
def minmax_fusion(t: Tables) -> DataFrame:
    """Two ranked lists, normalised and merged by a full outer join."""
    from ..operators.vector import fuse

    f = _features(t)
    a, b = (top_per_group(f.select("qid", "doc_id", F.round(c, 6).alias("score")), ["qid"], [F.desc("score"), F.asc("doc_id")], 20) for c in ("bm25", "qlm"))
    return _top(fuse(a, b, "qid", "doc_id", 0.5, 0.5), "fused")


@query(
    f"""WITH {RANK}, seed AS (SELECT qid, doc_id FROM ({_top_sql('bm25', k=3)})),
    c AS (SELECT qid, term, sum(1 + ln(tf)) / 3 AS tf, count(*) AS n FROM seed JOIN (SELECT doc_id, term, sum(tf) AS tf FROM cnt WHERE zone = 'body' GROUP BY ALL) USING (doc_id) GROUP BY qid, term),
    d AS (SELECT term, count(DISTINCT doc_id) AS df FROM cnt WHERE zone = 'body' GROUP BY term),
    s AS (SELECT qid, term, round(0.75 * tf * (ln(((SELECT count(*) FROM documents) + 1) / (df + 1)) + 1), 6) AS score FROM c JOIN d USING (term) WHERE length(term) >= 3
      AND NOT EXISTS (SELECT 1 FROM q WHERE q.qid = c.qid AND q.term = c.term))
    SELECT qid, term, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, term) AS n FROM s) WHERE n <= 6"""
)
def prf_terms(t: Tables) -> DataFrame:
    """H6: terms of the best three documents that the query lacks."""
    from ..operators.vector import feedback_terms

    docs = t.documents.select("doc_id", "text")
    counts = _counts(t).where("zone = 'body'")
    seeds = _top(_features(t), "bm25", 3).select("qid", "doc_id")
    asked = S.query_terms(t.benchmark.withColumnRenamed("item_id", "qid"), "qid", F.col("text"))
    return feedback_terms(seeds, counts, asked, docs, "qid", "doc_id", seeds_per_query=3, k=6)


@query(
    f"""WITH {RANK}, k AS (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM (SELECT qid, doc_id, round(bm25, 6) AS score FROM f)),
    n AS (SELECT qid, doc_id, s AS fused FROM {_rmm('k')}) {_top_sql('fused', 'n')}"""
)
def keyword_only(t: Tables) -> DataFrame:
    """H2: hybrid search without its vector side."""
    from ..operators.vector import hybrid

    found = top_per_group(_features(t).select("qid", "doc_id", F.round("bm25", 6).alias("score")), ["qid"], [F.desc("score"), F.asc("doc_id")], 20)
    return _top(hybrid(found, None, "qid", "doc_id"), "fused")


PAIRED = "pr AS (SELECT DISTINCT a.term AS a, b.term AS b FROM (SELECT item_id, unnest(w) AS term, generate_subscripts(w, 1) AS i FROM k) a JOIN (SELECT item_id, unnest(w) AS term, generate_subscripts(w, 1) AS i FROM k) b ON a.item_id = b.item_id AND b.i = a.i + 1)"


@query(
    f"""WITH {POST}, k AS (SELECT item_id, {TOK} AS w FROM benchmark), {PAIRED},
    m AS (SELECT x.term AS a, y.term AS b, count(DISTINCT x.chunk_id) AS n FROM p x JOIN p y ON x.chunk_id = y.chunk_id AND y.place = x.place + 1 WHERE (x.term, y.term) IN (SELECT (a, b) FROM pr) GROUP BY ALL)
    SELECT a, b, coalesce(n, 0) AS n FROM pr LEFT JOIN m USING (a, b)"""
)
def context_bigrams(t: Tables) -> DataFrame:
    """How often the words of each passage stand side by side in documents."""
    words = t.benchmark.select(X.ir_tokens(F.col("text")).alias("w"))
    pairs = words.select(F.explode(F.arrays_zip(F.expr("slice(w, 1, greatest(size(w) - 1, 0))").alias("a"), F.expr("slice(w, 2, greatest(size(w) - 1, 0))").alias("b"))).alias("p"))
    return S.text_bigram_counts(t.documents.select("doc_id", "text"), pairs.select("p.a", "p.b"), "doc_id", X.ir_tokens(F.col("text")))


@query(
    f"""WITH {POST} SELECT chunk_id FROM p WHERE term IN ('hest', 'blest', 'nowhereword') AND NOT EXISTS (SELECT 1 FROM p WHERE term = 'nowhereword') GROUP BY chunk_id"""
)
def relaxed_union(t: Tables) -> DataFrame:
    """Nothing has all three words, so documents with any of them."""
    index = checkpoint(_index(t))
    strict = B.evaluate("hest blest nowhereword", index)
    return S.relaxed_union(strict, index, ["hest", "blest", "nowhereword"], "chunk_id", explicit=False)


@query(f"WITH {POST}, o AS (SELECT chunk_id, bool_or(term IN ('well-known', 'wellknown', 'the-and', 'theand')) AS b FROM p GROUP BY chunk_id), s AS (SELECT DISTINCT x.chunk_id FROM p x JOIN p y ON x.chunk_id = y.chunk_id AND y.place = x.place + 1 WHERE (x.term, y.term) IN (('the', 'and'), ('well', 'known'))) SELECT chunk_id FROM o WHERE b UNION SELECT chunk_id FROM s")
def term_variants(t: Tables) -> DataFrame:
    """Hyphenated words as they are, without their hyphen, or as two words."""
    return B.evaluate("well-known OR the-and", _index(t))


@query(
    """SELECT conv_id, turn, list_filter(w, lambda x, i: list_position(w, x) = i) AS words FROM (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z0-9]{3,}') AS w FROM conversations)"""
)
def ordered_distinct(t: Tables) -> DataFrame:
    """Words once, in the order in which they come."""
    return t.conversations.select("conv_id", "turn", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]{3,}"), F.lit(0))).alias("words"))


@query(
    """SELECT a.vec_id AS qid, b.vec_id, round(1 / (1 + list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"""
)
def distance_scores(t: Tables) -> DataFrame:
    """V3, V4: every vector and the next."""
    from ..operators.vector import distance_score

    a = t.embeddings.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("e"))
    both = a.join(t.embeddings.select("vec_id", "embedding"), F.col("vec_id") == F.col("qid") + 1)
    gap = F.aggregate(F.zip_with("e", "embedding", lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return both.select("qid", "vec_id", F.round(distance_score(F.sqrt(gap)), 6).alias("score"))

"""Web graph and evaluation. Customers link to the suppliers that they order from, suppliers to customers who send goods back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import evaluate as E
from ..operators import graph as G
from ..plans.cut import checkpoint
from .registry import Tables, query
from .search import RANK, _features, _top, _top_sql


def _trade(t: Tables) -> DataFrame:
    """Line items with the ids of customer and supplier as nodes of one graph: even and odd numbers."""
    orders = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") * 2).cast("long").alias("c"))
    return t.lineitem.select("l_orderkey", (F.col("l_suppkey") * 2 + 1).cast("long").alias("s"), "l_returnflag").join(orders, "l_orderkey")


def _links(t: Tables) -> DataFrame:
    # each pair of nodes once, with whether goods went back; then its one or two links
    pairs = _trade(t).groupBy("c", "s").agg(F.coalesce(F.bool_or(F.col("l_returnflag") == "R"), F.lit(False)).alias("back"))
    link = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"))
    return pairs.select(F.explode(F.when(F.col("back"), F.array(link("c", "s"), link("s", "c"))).otherwise(F.array(link("c", "s")))).alias("l")).select("l.src", "l.dst")


LINKS = """tr AS (SELECT l_suppkey::BIGINT * 2 + 1 AS s, o_custkey::BIGINT * 2 AS c, l_returnflag FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
  e AS MATERIALIZED (SELECT c AS src, s AS dst FROM tr UNION SELECT s, c FROM tr WHERE l_returnflag = 'R'), ids AS MATERIALIZED (SELECT src AS id FROM e UNION SELECT dst FROM e),
  deg AS MATERIALIZED (SELECT src AS id, count(*) AS degree FROM e GROUP BY src)"""


def _rank_sql(personal: str, rounds: int = 50) -> str:
    parts = [f"WITH {LINKS}, p0 AS (SELECT ids.id, {personal} AS w FROM ids), p AS MATERIALIZED (SELECT id, w / (SELECT sum(w) FROM p0) AS p FROM p0), r0 AS MATERIALIZED (SELECT id, p AS r FROM p)"]
    for i in range(rounds):
        parts.append(
            f""", r{i + 1} AS MATERIALIZED (SELECT p.id, 0.15 * p.p + 0.85 * (coalesce(g.got, 0) + (SELECT coalesce(sum(r), 0) FROM r{i} WHERE id NOT IN (SELECT id FROM deg)) * p.p) AS r FROM p LEFT JOIN
            (SELECT dst AS id, sum(r / degree) AS got FROM e JOIN r{i} ON e.src = r{i}.id JOIN deg ON deg.id = e.src GROUP BY dst) g ON p.id = g.id)"""
        )
    return " ".join(parts) + f" SELECT id, round(r / (SELECT sum(r) FROM r{rounds}), 6) AS rank FROM r{rounds}"


@query(_rank_sql("1.0::DOUBLE"))
def pagerank(t: Tables) -> DataFrame:
    """G9, J9."""
    return G.page_rank(_links(t)).select("id", F.round("rank", 6).alias("rank"))


def _suppliers(graph: G.LinkTiles) -> DataFrame:
    return graph.nodes.select("id").where("id % 2 = 1").withColumn("weight", F.lit(1.0))


@query(_rank_sql("CASE WHEN id % 2 = 1 THEN 1.0 ELSE 0.0 END::DOUBLE"))
def topic_pagerank(t: Tables) -> DataFrame:
    """Teleport to suppliers alone."""
    graph = G.LinkTiles(_links(t))
    (found,) = G.page_ranks(graph, [_suppliers(graph)])
    graph.close()
    return found.select("id", F.round("rank", 6).alias("rank"))


def _hits_sql(rounds: int) -> str:
    parts = [f"WITH {LINKS}, h0 AS (SELECT id, 1.0::DOUBLE AS h FROM ids)"]
    for i in range(rounds):
        parts.append(
            f""", x{i + 1} AS MATERIALIZED (SELECT ids.id, coalesce(s, 0) AS a FROM ids LEFT JOIN (SELECT dst AS id, sum(h) AS s FROM e JOIN h{i} ON e.src = h{i}.id GROUP BY dst) g ON g.id = ids.id),
            a{i + 1} AS MATERIALIZED (SELECT id, a / (SELECT sqrt(sum(a * a)) FROM x{i + 1}) AS a FROM x{i + 1}),
            y{i + 1} AS MATERIALIZED (SELECT ids.id, coalesce(s, 0) AS h FROM ids LEFT JOIN (SELECT src AS id, sum(a) AS s FROM e JOIN a{i + 1} ON e.dst = a{i + 1}.id GROUP BY src) g ON g.id = ids.id),
            h{i + 1} AS MATERIALIZED (SELECT id, h / (SELECT sqrt(sum(h * h)) FROM y{i + 1}) AS h FROM y{i + 1})"""
        )
    return " ".join(parts) + f" SELECT h.id, round(h / (SELECT max(h) FROM h{rounds}), 6) AS hub, round(a / (SELECT max(a) FROM a{rounds}), 6) AS authority FROM h{rounds} h JOIN a{rounds} a ON h.id = a.id"


@query(_hits_sql(20))
def hits(t: Tables) -> DataFrame:
    """G11."""
    return G.hits(_links(t)).select("id", F.round("hub", 6).alias("hub"), F.round("authority", 6).alias("authority"))


#: What the link queries ask for; the type of a part stands for the anchor of a link to its supplier.
ASKED = ["promo", "steel", "copper"]


def _anchors(t: Tables) -> DataFrame:
    parts = t.part.select(F.col("p_partkey").alias("l_partkey"), F.regexp_extract_all(F.lower("p_type"), F.lit("[a-z]{3,}"), F.lit(0)).alias("words"))
    return t.lineitem.select((F.col("l_suppkey") * 2 + 1).cast("long").alias("id"), "l_partkey").join(parts, "l_partkey").select("id", "words")


@query(
    """WITH w AS (SELECT l_suppkey::BIGINT * 2 + 1 AS id, unnest(regexp_extract_all(lower(p_type), '[a-z]{3,}')) AS w FROM lineitem JOIN part ON l_partkey = p_partkey)
    SELECT id, round(least(1, 1.5 * count(*) FILTER (w IN ('promo', 'steel', 'copper')) / count(*))::DOUBLE, 6) AS anchor FROM w GROUP BY id"""
)
def anchor_relevance(t: Tables) -> DataFrame:
    """G13."""
    return G.anchor_relevance(_anchors(t), ASKED).select("id", F.round("anchor", 6).alias("anchor"))


@query()
def link_score(t: Tables) -> DataFrame:
    """General and topical rank, authority, hub and anchors of all nodes."""
    graph = G.LinkTiles(_links(t))
    ranks, found = G.page_ranks(graph, [None, _suppliers(graph)]), G.tiled_hits(graph)
    graph.close()
    return G.link_score(*ranks, found, G.anchor_relevance(_anchors(t), ASKED)).select("id", F.round("score", 6).alias("score"))


@query()
def query_focused_hits(t: Tables) -> DataFrame:
    """Suppliers whose anchors name what is asked for, and their neighbours."""
    links = checkpoint(_links(t))
    topic = checkpoint(links.groupBy(F.col("dst").alias("id")).agg(F.count("*").cast("double").alias("rank")))
    base = checkpoint(G.base_set(links, _anchors(t), topic.limit(0).select("id"), ASKED, topic))
    found = G.query_hits(links, base)
    return found.select("id", F.round("hub", 6).alias("hub"), F.round("authority", 6).alias("authority"))


@query()
def html_extract(t: Tables) -> DataFrame:
    """D20, D21, S15."""
    return G.page_parts(t.pages, "url", "html")


@query()
def edge_extract(t: Tables) -> DataFrame:
    """G8."""
    return G.edges(G.page_parts(t.pages, "url", "html"))


@query()
def url_canonical(t: Tables) -> DataFrame:
    """G1."""
    return t.pages.select("page_id", X.canonical_url(F.col("url")).alias("canonical"))


AUTH = "greatest(0.55, " + ", ".join(f"CASE WHEN h = '{d}' OR h LIKE '%.{d}' THEN {v} ELSE 0 END" for d, v in G.AUTHORITIES.items()) + ", CASE WHEN h LIKE '%.gov' THEN 0.92 WHEN h LIKE '%.edu' THEN 0.88 ELSE 0 END)::DOUBLE"


@query(
    f"""SELECT page_id, authority, priority, greatest(0, least(3, floor((100 - priority) * 4 / 101)))::INT AS queue FROM (SELECT page_id, authority,
    greatest(1, least(100, trunc(authority * 100 - least(10, d) * 8)::INT))::INT AS priority FROM (SELECT page_id, {AUTH} AS authority, d FROM
    (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS h, len(regexp_extract_all(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/'))::INT AS d FROM pages)))"""
)
def host_authority(t: Tables) -> DataFrame:
    """A page's depth is the number of steps in its path."""
    host = F.lower(F.regexp_extract("url", "^[A-Za-z]+://([^/?#]*)", 1))
    depth = F.regexp_count(F.regexp_extract("url", "^[A-Za-z]+://[^/?#]*([^?#]*)", 1), F.lit("/"))
    rows = t.pages.select("page_id", G.host_authority(host).alias("authority"), G.crawl_priority(host, depth).alias("priority"))
    return rows.withColumn("queue", G.queue_of(F.col("priority"), 4))


@query(
    r"""SELECT page_id, CASE WHEN h = '' THEN lower(u) ELSE (CASE WHEN s = '' THEN 'https' ELSE s END) || '://' || h || (CASE WHEN p = '' THEN '/' ELSE p END) END AS url FROM (SELECT page_id, trim(url) AS u,
    lower(regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS s, lower(regexp_extract(trim(url), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)) AS h,
    regexp_replace(regexp_extract(trim(url), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#;]*)', 1), '/+$', '') AS p FROM pages)"""
)
def url_bare(t: Tables) -> DataFrame:
    """G2."""
    return t.pages.select("page_id", G.bare_url(F.col("url")).alias("url"))


SHINGLES = """w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]{3,}') AS w FROM documents),
 s AS (SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(w) - 2, 1) + 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS s FROM w)"""
SEEDS = 24


@query(f"WITH {SHINGLES} SELECT doc_id, len(s)::INT AS n_shingles, md5(array_to_string(list_sort(s), '|')) AS digest FROM s")
def word_shingles(t: Tables) -> DataFrame:
    """G3."""
    s = t.documents.select("doc_id", G.shingles(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").alias("n_shingles"), F.md5(F.array_join(F.array_sort("s"), "|")).alias("digest"))


@query(
    f"WITH {SHINGLES} SELECT doc_id, ["
    + ", ".join(f"list_min(list_transform(s, lambda x: left(sha1('{k}:' || x), 16)))" for k in range(SEEDS))
    + "] AS signature FROM s"
)
def minhash_signature(t: Tables) -> DataFrame:
    """G4."""
    return G.signatures(t.documents, "doc_id", F.col("text"), SEEDS)


PAGE_SIGNATURES = (
    r"""w AS (SELECT page_id, regexp_extract_all(lower(html), '[a-z0-9]{3,}') AS w FROM pages), s AS (SELECT page_id, list_distinct(list_transform(range(1, greatest(len(w) - 2, 1) + 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS s FROM w),
    m AS MATERIALIZED (SELECT page_id, ["""
    + ", ".join(f"list_min(list_transform(s, lambda x: left(sha1('{k}:' || x), 16)))" for k in range(SEEDS))
    + "] AS g FROM s)"
)


def _near_pages(t: Tables) -> tuple[DataFrame, DataFrame]:
    found = checkpoint(G.signatures(t.pages, "page_id", F.col("html"), SEEDS))
    return G.near_signatures(found, "page_id", SEEDS, 0.90)


@query(
    f"""WITH {PAGE_SIGNATURES}, c AS (SELECT g, min(page_id) AS class FROM m GROUP BY g), p AS (SELECT a.class AS a, b.class AS b FROM c a JOIN c b ON a.class < b.class
      WHERE len(list_filter(range(1, {SEEDS + 1}), lambda i: a.g[i] = b.g[i])) / {SEEDS}.0 >= 0.9),
    n AS (SELECT class, count(*) AS links FROM (SELECT a AS class FROM p UNION ALL SELECT b FROM p) GROUP BY class)
    SELECT page_id, class, coalesce(links, 0) AS links FROM m JOIN c USING (g) LEFT JOIN n USING (class)"""
)
def near_page_pairs(t: Tables) -> DataFrame:
    """The class of each page (the first of those with its signature) and its number of links to other classes."""
    members, links = _near_pages(t)
    both = links.select(F.col("a").alias("class")).union(links.select(F.col("b").alias("class"))).groupBy("class").agg(F.count("*").alias("links"))
    return members.join(both, "class", "left").select("page_id", "class", F.coalesce("links", F.lit(0)).alias("links"))


@query()
def near_page_filter(t: Tables) -> DataFrame:
    """Which pages a crawl in the order of page_id would keep."""
    return G.near_page_filter(t.pages, "page_id", F.col("html"), SEEDS, 0.90)


# evaluation


RELEVANT = f"""{RANK}, r AS (SELECT qid, doc_id, rank, CASE WHEN l.quality = 1 THEN 2 WHEN l.toxic = 0 THEN 1 ELSE 0 END AS gain FROM ({_top_sql('bm25', k=10)}) LEFT JOIN labels l USING (doc_id)),
  n AS (SELECT qid, greatest(1, count(*) FILTER (gain > 0)) AS total FROM r GROUP BY qid)"""


def _ranked(t: Tables) -> DataFrame:
    """The best ten documents for each passage; a judged document's gain is 2 for good quality, 1 for no toxicity; all others 0."""
    from pyspark.sql import Window

    rows = _top(_features(t), "bm25", 10).join(t.labels, "doc_id", "left")
    gain = F.when(F.col("quality") == 1, 2).when(F.col("toxic") == 0, 1).otherwise(0)
    rows = rows.select("qid", "doc_id", "rank", gain.alias("gain"))
    return rows.withColumn("total", F.greatest(F.lit(1), F.count_if(F.col("gain") > 0).over(Window.partitionBy("qid"))))


@query(
    f"""WITH {RELEVANT}, k AS (SELECT r.*, total, CASE WHEN gain > 0 THEN 1 ELSE 0 END AS rel FROM r JOIN n USING (qid)),
    s AS (SELECT *, sum(rel) OVER (PARTITION BY qid ORDER BY rank) AS seen, row_number() OVER (PARTITION BY qid ORDER BY gain DESC, rank) AS ideal FROM k),
    g AS (SELECT qid, sum(rel) AS hits, any_value(total) AS total, sum(rel * seen / rank) AS ap, min(CASE WHEN rel = 1 THEN rank END) AS first, sum(gain / log2(rank + 1)) AS dcg,
      sum(gain / log2(ideal + 1)) AS idcg FROM s GROUP BY qid)
    SELECT qid, round(hits / 10, 6) AS precision, round(hits / greatest(1, total), 6) AS recall, round(coalesce(2 * (hits / 10) * (hits / greatest(1, total)) / nullif(hits / 10 + hits / greatest(1, total), 0), 0), 6) AS f1,
    round(ap / greatest(1, total), 6) AS ap, round(coalesce(1 / first, 0), 6) AS rr, round(coalesce(dcg / nullif(idcg, 0), 0), 6) AS ndcg FROM g"""
)
def eval_ranking(t: Tables) -> DataFrame:
    """Of the keyword ranking of all documents; the number of relevant ones is what was observed, at least 1."""
    return E.ranking_metrics(_ranked(t), "qid", "rank", "gain", "total", 10)


@query(
    """SELECT lang, n, round((po - pe) / nullif(1 - pe, 0), 6) AS kappa FROM (SELECT *, pa * pb + (1 - pa) * (1 - pb) AS pe FROM
    (SELECT lang, count(*) AS n, avg((quality = toxic)::INT) AS po, avg(quality) AS pa, avg(toxic) AS pb FROM labels JOIN documents USING (doc_id) GROUP BY lang))"""
)
def eval_kappa(t: Tables) -> DataFrame:
    """A19."""
    return E.kappa(t.labels.join(t.documents.select("doc_id", "lang"), "doc_id"), "quality", "toxic", ["lang"])


PAIRS = r"""p AS (SELECT a.conv_id, a.turn, list_distinct(regexp_extract_all(lower(a.text), '[a-z0-9]{3,}')) AS q, list_distinct(regexp_extract_all(lower(b.text), '[a-z0-9]{3,}')) AS r
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant')"""


def _pairs(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = t.conversations.select("*", F.lead("text").over(w).alias("answer"), F.lead("role").over(w).alias("next_role"), F.lead("turn").over(w).alias("next_turn"))
    rows = rows.where("role = 'user' and next_role = 'assistant' and next_turn = turn + 1")
    tokens = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]{3,}"), F.lit(0)))
    return rows.select("conv_id", "turn", tokens(F.col("text")).alias("q"), tokens(F.col("answer")).alias("r"))


@query(
    f"""WITH {PAIRS} SELECT conv_id, turn, round(coalesce(2 * (i / nullif(len(q), 0)) * (i / nullif(len(r), 0)) / nullif(i / nullif(len(q), 0) + i / nullif(len(r), 0), 0), 0), 6) AS f1
    FROM (SELECT *, len(list_intersect(q, r)) AS i FROM p)"""
)
def token_f1(t: Tables) -> DataFrame:
    """Question and answer by their tokens."""
    return _pairs(t).select("conv_id", "turn", F.round(E.token_f1(F.col("q"), F.col("r")), 6).alias("f1"))


@query("SELECT event_type, quantile_disc(value, 0.95) AS p95, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def latency_p95(t: Tables) -> DataFrame:
    """A20, A24."""
    return t.events.groupBy("event_type").agg(E.nearest_rank("value", 0.95).alias("p95"), F.round(F.avg("value"), 6).alias("mean"))


@query("SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL")
def confusion_matrix(t: Tables) -> DataFrame:
    """A21."""
    return E.confusion(t.labels, "quality", "toxic")


F1 = """c AS (SELECT lang AS t, CASE WHEN n_chars % 3 = 0 THEN 'en' ELSE lang END AS g, count(*) AS n FROM documents GROUP BY ALL),
 s AS (SELECT t AS label, (SELECT sum(n) FROM c x WHERE x.t = a.t AND x.g = a.t) AS tp, sum(n) AS nt, (SELECT sum(n) FROM c x WHERE x.g = a.t) AS ns FROM c a GROUP BY t)"""


def _guessed(t: Tables) -> DataFrame:
    return t.documents.select(F.col("lang").alias("t"), F.when(F.col("n_chars") % 3 == 0, "en").otherwise(F.col("lang")).alias("g"))


@query(f"WITH {F1} SELECT label, round(coalesce(tp, 0) / ns, 6) AS p, round(coalesce(tp, 0) / nt, 6) AS r, round(2 * tp / (ns + nt), 6) AS f1 FROM s")
def macro_micro_f1(t: Tables) -> DataFrame:
    """A21."""
    s = E.class_scores(_guessed(t), "t", "g")
    return s.select("label", *(F.round(c, 6).alias(c) for c in ("p", "r", "f1")))


@query(
    """WITH c AS (SELECT lang AS t, source AS c, count(*) AS n FROM documents GROUP BY ALL), nt AS (SELECT t, sum(n) AS nt FROM c GROUP BY t), nc AS (SELECT c, sum(n) AS nc, max(n) AS top FROM c GROUP BY c),
    N AS (SELECT sum(n)::DOUBLE AS nn FROM c), f AS (SELECT *, 2 * (n / nc) * (n / nt) / (n / nc + n / nt) AS f FROM c JOIN nt USING (t) JOIN nc USING (c), N),
    m AS (SELECT sum(n / nn * ln(n * nn / (nt * nc))) AS mi, sum(n * (n - 1) / 2) AS same, any_value(nn) AS nn FROM f),
    a AS (SELECT sum(-(nt / nn) * ln(nt / nn)) AS ht, sum(nt * (nt - 1) / 2) AS pt FROM nt, N), b AS (SELECT sum(-(nc / nn) * ln(nc / nn)) AS hc, sum(nc * (nc - 1) / 2) AS pc, sum(top) AS top FROM nc, N),
    g AS (SELECT sum(nt / nn * f) AS f FROM (SELECT t, max(f) AS f, any_value(nt) AS nt, any_value(nn) AS nn FROM f GROUP BY t))
    SELECT round(top / nn, 6) AS purity, round(2 * mi / (ht + hc), 6) AS nmi, round((nn * (nn - 1) / 2 + 2 * same - pt - pc) / (nn * (nn - 1) / 2), 6) AS rand, round(f, 6) AS f FROM m, a, b, g"""
)
def cluster_quality(t: Tables) -> DataFrame:
    """Sources as clusters of languages."""
    return E.cluster_quality(t.documents.select("lang", "source"), "lang", "source")


@query(
    r"""WITH k AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9#\-\+/]+') AS w FROM documents), f AS (SELECT term, min(doc_id) AS doc_id FROM (SELECT doc_id, unnest(w) AS term FROM k) GROUP BY term),
    n AS (SELECT doc_id, count(*) AS fresh FROM f GROUP BY doc_id), r AS (SELECT sum(len(w)) OVER (ORDER BY k.doc_id) AS t, sum(coalesce(fresh, 0)) OVER (ORDER BY k.doc_id) AS v FROM k LEFT JOIN n USING (doc_id))
    SELECT round(regr_slope(log10(v), log10(t)), 5) AS heaps_b, round(regr_intercept(log10(v), log10(t)), 5) AS heaps_a, count(*) AS points FROM r WHERE t > 0 AND v > 0"""
)
def heaps_zipf(t: Tables) -> DataFrame:
    """A15."""
    return E.heaps_zipf(t.documents, X.ir_tokens(F.col("text")), "doc_id")


ZIPF = r"""z AS (SELECT term, count(*) AS cf FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9#\-\+/]+')) AS term FROM documents) GROUP BY term),
    r AS (SELECT row_number() OVER (ORDER BY cf DESC, term) AS rank, term, cf FROM z)"""


@query(f"WITH {ZIPF} SELECT rank, term, cf, rank * cf AS product FROM r")
def zipf_ranks(t: Tables) -> DataFrame:
    """Rank and frequency of every term."""
    return E.zipf_ranks(t.documents, X.ir_tokens(F.col("text")))


@query(
    f"""WITH {ZIPF}, p AS (SELECT rank, rank * cf AS product FROM r) SELECT count(*) AS terms, round(avg(product) FILTER (rank <= 25), 4) AS top_mean,
    round(stddev_pop(product) FILTER (rank <= 25), 4) AS top_deviation, round(avg(product), 4) AS mean, round(stddev_pop(product), 4) AS deviation FROM p"""
)
def zipf_fit(t: Tables) -> DataFrame:
    """How even rank * frequency is, over the first 25 terms and over all."""
    fit = E.zipf_fit(E.zipf_ranks(t.documents, X.ir_tokens(F.col("text"))))
    return fit.select("terms", *(F.round(c, 4).alias(c) for c in ("top_mean", "top_deviation", "mean", "deviation")))

"""Filters, joins, set operations, summaries and windows.

Runs are ``events`` (workflow: event_type, failed: error, fallback: signup, latency: value, input: props), care tasks are
``orders`` with ``customer`` as patients, audits are ``labels`` (human level: quality, machine level: toxic).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import relational as R
from ..sources import tables as S
from ..sources import sinks
from .registry import Tables, query



@query("SELECT event_id, event_type FROM events")
def table_scan(t: Tables) -> DataFrame:
    """S1."""
    return t.events.select("event_id", "event_type")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def filter_equality(t: Tables) -> DataFrame:
    """F1."""
    return t.orders.where("o_orderstatus = 'F' and o_orderpriority = '1-URGENT'").select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 25 OFFSET 50")
def page_list(t: Tables) -> DataFrame:
    """a page of tasks."""
    return R.page(t.orders.select("o_orderkey", "o_custkey"), "o_orderkey", 50, 25)


@query("SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'")
def filtered_count(t: Tables) -> DataFrame:
    """F3."""
    return t.orders.where("o_orderstatus = 'F'").agg(F.count("*").alias("n"))


@query("SELECT * EXCLUDE (o_orderdate) FROM orders WHERE o_orderkey = 7")
def point_lookup(t: Tables) -> DataFrame:
    """F4."""
    return t.orders.where("o_orderkey = 7").drop("o_orderdate")


@query("SELECT event_id, user_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12' AND event_type = 'error'")
def time_range(t: Tables) -> DataFrame:
    """a closed interval of time and a status."""
    return t.events.where("ts between timestamp'2024-01-05' and timestamp'2024-01-12' and event_type = 'error'").select("event_id", "user_id")


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%an%' OR p_name ILIKE '%RE%' OR p_type ILIKE '%an%' OR p_type ILIKE '%RE%'")
def like_any(t: Tables) -> DataFrame:
    """words looked for in several columns, whatever their case."""
    words = ["an", "RE"]
    return t.part.where(R.matches_any(F.col("p_name"), words) | R.matches_any(F.col("p_type"), words)).select("p_partkey", "p_name")


@query("SELECT doc_id, lang FROM documents WHERE lang IN ('de', 'fr')")
def in_list(t: Tables) -> DataFrame:
    """F7."""
    return t.documents.where(F.col("lang").isin("de", "fr")).select("doc_id", "lang")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 50")
def json_predicate(t: Tables) -> DataFrame:
    """F8, A5: a value taken out of JSON."""
    k = F.get_json_object("props", "$.k").cast("long")
    return t.events.select("event_id", k.alias("k")).where("k >= 50")


@query(
    """SELECT doc_id, CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN 'validated' ELSE 'pending' END AS status
    FROM labels WHERE toxic = 0 AND quality = 1"""
)
def status_precedence(t: Tables) -> DataFrame:
    """Only validated sources, whatever status is asked for."""
    status = F.when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 1, "validated").otherwise("pending")
    return t.labels.select("doc_id", status.alias("status")).where("status = 'validated'")


@query(
    r"""SELECT page_id, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS host FROM pages
    WHERE lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) = 'example.org' OR lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) LIKE '%.example.org'
    OR lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) = 'example.net' OR lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) LIKE '%.example.net'"""
)
def domain_allow_list(t: Tables) -> DataFrame:
    """hosts that are an allowed domain or lie below one."""
    host = F.lower(F.regexp_extract("url", "^[A-Za-z]+://([^/?#]*)", 1))
    return t.pages.select("page_id", host.alias("host")).where(R.host_allowed(F.col("host"), ["example.org", "example.net"]))


@query(
    """SELECT conv_id, turn FROM conversations WHERE role = 'assistant' AND length(text) BETWEEN 20 AND 4000
    AND NOT contains(text, '?') AND NOT contains(lower(text), 'system prompt')"""
)
def regression_candidates(t: Tables) -> DataFrame:
    """Answers fit for a regression set."""
    text = F.col("text")
    ok = F.length(text).between(20, 4000) & ~text.contains("?") & ~F.lower(text).contains("system prompt")
    return t.conversations.where((F.col("role") == "assistant") & ok).select("conv_id", "turn")


@query("SELECT event_id FROM events WHERE value IS NULL OR value > 50")
def active_sources(t: Tables) -> DataFrame:
    """without an end, or with one that is not reached."""
    return t.events.where(F.col("value").isNull() | (F.col("value") > 50)).select("event_id")


@query(
    """SELECT count(*) AS failing_steps FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
    WHERE o.o_orderstatus = 'F' AND l.l_returnflag = 'R'"""
)
def run_step_join(t: Tables) -> DataFrame:
    """Steps (lineitem) of runs (orders)."""
    steps = t.lineitem.where("l_returnflag = 'R'").select("l_orderkey")
    runs = t.orders.where("o_orderstatus = 'F'").select("o_orderkey")
    return steps.join(runs, F.col("l_orderkey") == F.col("o_orderkey")).agg(F.count("*").alias("failing_steps"))


@query(
    """SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'
    ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50"""
)
def patient_messages(t: Tables) -> DataFrame:
    """The latest tasks of some patients."""
    joined = t.orders.join(t.customer.where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
    return R.recent(joined, "o_orderdate", "o_orderkey", 50).select("o_orderkey", "c_name", "o_totalprice")


@query("SELECT c_custkey, c_name, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def parent_lookup(t: Tables) -> DataFrame:
    """Each child with its parent's name."""
    parent = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return t.customer.join(parent, "c_nationkey", "left").select("c_custkey", "c_name", "n_name")


@query(
    """SELECT conv_id, turn, string_agg(role, '>' ORDER BY other) AS pack FROM (SELECT a.conv_id, a.turn, b.turn AS other, b.role
    FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn - 1 AND a.turn + 1) GROUP BY conv_id, turn"""
)
def context_pack(t: Tables) -> DataFrame:
    """Each turn with its neighbours, by a range frame instead of a self join."""
    near = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(-1, 1)
    return t.conversations.select("conv_id", "turn", F.array_join(F.collect_list("role").over(near), ">").alias("pack"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def incremental_anti(t: Tables) -> DataFrame:
    """Documents that are not known yet."""
    return S.not_yet_ingested(t.documents.select("doc_id"), t.labels, "doc_id")


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def candidate_semi(t: Tables) -> DataFrame:
    """J7."""
    return t.documents.select("doc_id", "source").join(t.labels.where("quality = 1").select("doc_id"), "doc_id", "left_semi")


@query(
    """SELECT lang, n * (n - 1) // 2 AS pairs, same FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang) JOIN
    (SELECT lang, sum(m * (m - 1) // 2)::BIGINT AS same FROM (SELECT lang, source, count(*) AS m FROM documents GROUP BY ALL) GROUP BY lang) USING (lang)"""
)
def pair_counts(t: Tables) -> DataFrame:
    """Pairs of a group, and those that agree in a second column, counted without making the pairs."""
    cells = t.documents.groupBy("lang", "source").agg(F.count("*").alias("m"))
    n = F.sum("m")
    return cells.groupBy("lang").agg((n * (n - 1) / 2).cast("long").alias("pairs"), F.sum((F.col("m") * (F.col("m") - 1) / 2).cast("long")).alias("same"))


@query("SELECT l_suppkey AS dst, count(DISTINCT l_partkey) AS n_in FROM lineitem GROUP BY l_suppkey")
def incoming_edges(t: Tables) -> DataFrame:
    """The edges part to supplier, inverted."""
    edges = t.lineitem.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    return edges.groupBy("dst").agg(F.count_distinct("src").alias("n_in"))


@query(
    """SELECT source, n_name FROM (SELECT DISTINCT source, lower(text) AS x FROM documents) JOIN nation ON contains(x, lower(left(n_name, 4)))
    GROUP BY ALL"""
)
def lexicon_containment(t: Tables) -> DataFrame:
    """Which words of a small lexicon each source holds; the lexicon is the broadcast side of a nested loop."""
    lexicon = F.broadcast(t.nation.select("n_name", F.lower(F.left("n_name", F.lit(4))).alias("word")))
    docs = t.documents.select("source", F.lower("text").alias("x"))
    return docs.join(lexicon, F.expr("contains(x, word)")).select("source", "n_name").distinct()


@query(
    """SELECT l_suppkey AS id FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_suppkey FROM lineitem WHERE l_discount > 0.09 AND l_quantity > 49"""
)
def postings_and(t: Tables) -> DataFrame:
    """Lists of ids met by an intersection, which Spark makes a join of both; P2's skips are a way of walking one list, and give the same."""
    a = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("id"))
    return a.intersect(t.lineitem.where("l_discount > 0.09 and l_quantity > 49").select("l_suppkey"))


@query("SELECT l_suppkey AS id FROM lineitem WHERE l_quantity > 49.5 UNION SELECT l_suppkey FROM lineitem WHERE l_tax > 0.079")
def postings_or(t: Tables) -> DataFrame:
    """P3."""
    a = t.lineitem.where("l_quantity > 49.5").select(F.col("l_suppkey").alias("id"))
    return a.union(t.lineitem.where("l_tax > 0.079").select("l_suppkey")).distinct()


@query("SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def postings_not(t: Tables) -> DataFrame:
    """P4."""
    return t.customer.select(F.col("c_custkey").alias("id")).join(
        t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("id")), "id", "left_anti"
    )


@query(
    """SELECT user_id, string_agg(gap, ',' ORDER BY event_id) AS gaps FROM (SELECT user_id, event_id,
    event_id - coalesce(lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS gap FROM events) WHERE gap > 0 GROUP BY user_id"""
)
def gap_encoding(t: Tables) -> DataFrame:
    """P5: postings as gaps."""
    ids = t.events.groupBy("user_id").agg(F.array_sort(F.collect_set("event_id")).alias("ids"))
    gaps = F.transform("ids", lambda x, i: x - F.coalesce(F.when(i > 0, F.get("ids", i - 1)), F.lit(0)))
    return ids.select("user_id", F.array_join(F.filter(gaps, lambda g: g > 0).cast("array<string>"), ",").alias("gaps"))


RUNS = """SELECT {by} count(*) AS total_runs, count(*) FILTER (event_type <> 'error') AS completed_runs,
    count(*) FILTER (event_type = 'error') AS failed_runs, count(*) FILTER (event_type = 'signup') AS fallback_steps,
    round(100.0 * count(*) FILTER (event_type = 'signup') / count(*), 2) AS fallback_rate FROM events {group}"""


def _runs(t: Tables, by: list[str]) -> DataFrame:
    return R.run_summary(t.events, by, F.col("event_type") == "error", F.col("event_type") == "signup")


@query(RUNS.format(by="", group=""))
def ops_summary(t: Tables) -> DataFrame:
    """A1."""
    return _runs(t, [])


@query(RUNS.format(by="user_id,", group="GROUP BY user_id"))
def ops_by_workflow(t: Tables) -> DataFrame:
    """The gauges of each workflow (here each user's)."""
    return _runs(t, ["user_id"])


AUDIT = """count(*) AS total, count(*) FILTER (a = h) AS match, count(*) FILTER (a < h) AS under, count(*) FILTER (a > h) AS over,
    round(100.0 * count(*) FILTER (a = h) / count(*), 2) AS match_rate, round(100.0 * count(*) FILTER (a < h) / count(*), 2) AS under_rate,
    round(100.0 * count(*) FILTER (a > h) / count(*), 2) AS over_rate"""


def _audits(t: Tables) -> DataFrame:
    rows = t.labels.join(t.documents.select("doc_id", "lang"), "doc_id")
    return rows.withColumn("classification", R.deviation(F.col("toxic"), F.col("quality")))


@query(f"SELECT lang, {AUDIT} FROM (SELECT lang, toxic AS a, quality AS h FROM labels JOIN documents USING (doc_id)) GROUP BY lang")
def audit_summary(t: Tables) -> DataFrame:
    """A2, A4."""
    return R.audit_summary(_audits(t), ["lang"])


@query("SELECT lang, round(100.0 * avg(CASE WHEN toxic IS NOT DISTINCT FROM quality THEN 1 ELSE 0 END), 2) AS match_rate FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def audit_match_rate(t: Tables) -> DataFrame:
    """A3."""
    return _audits(t).groupBy("lang").agg(R.match_rate(F.col("toxic"), F.col("quality")).alias("match_rate"))


@query(
    f"""WITH s AS (SELECT coalesce(lang, 'total') AS domain, {AUDIT} FROM (SELECT lang, toxic AS a, quality AS h FROM labels JOIN documents USING (doc_id))
    GROUP BY ROLLUP (lang)) SELECT domain, total, match_rate, under_rate, over_rate, CASE WHEN total = 0 THEN 'sin_datos'
    WHEN under_rate > 10 OR over_rate > 20 THEN 'degradado' WHEN under_rate > 0 OR over_rate > 0 THEN 'atencion' ELSE 'estable' END AS status FROM s"""
)
def scorecard_rollup(t: Tables) -> DataFrame:
    """A6, W2."""
    return R.scorecard(_audits(t).withColumn("domain", F.col("lang")))


@query("SELECT event_type, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS k_sum, count(json_extract(props, '$.k')) AS n FROM events GROUP BY event_type")
def json_sum(t: Tables) -> DataFrame:
    """A8."""
    k = F.get_json_object("props", "$.k").cast("long")
    return t.events.groupBy("event_type").agg(F.sum(k).alias("k_sum"), F.count(k).alias("n"))


FLAGS = R.AUDITED["cardio_risk"]
FLAG_SQL = ", ".join(f"event_id % {3 + i} = 0 AS ai_{f}, CASE WHEN event_id % 11 > 0 THEN (event_id + user_id) % {3 + i} = 0 END AS human_{f}" for i, f in enumerate(FLAGS))
CALLED = "CASE WHEN event_id % 4 = 0 THEN 'under' WHEN event_id % 4 = 1 THEN 'over' ELSE 'match' END AS classification"


@query(
    f"""SELECT event_type, total, match, under, over, {', '.join(f'{f}_match_rate' for f in FLAGS)}, round(100.0 * under / total, 2) AS under_rate, round(100.0 * over / total, 2) AS over_rate FROM
    (SELECT event_type, count(*) AS total, count(*) FILTER (classification = 'match') AS match, count(*) FILTER (classification = 'under') AS under, count(*) FILTER (classification = 'over') AS over,
    {', '.join(f"round(100.0 * avg((ai_{f} IS NOT DISTINCT FROM human_{f})::INT), 2) AS {f}_match_rate" for f in FLAGS)} FROM (SELECT event_type, {CALLED}, {FLAG_SQL} FROM events) GROUP BY event_type)"""
)
def domain_audits(t: Tables) -> DataFrame:
    """A3: events as reviews of one domain, some without a human flag."""
    rows = t.events.selectExpr("event_type", CALLED, *FLAG_SQL.replace(", CASE", "\n CASE").replace(", event_id", "\n event_id").split("\n"))
    return R.domain_audit(rows, FLAGS, ["event_type"])


@query(
    """WITH w AS (SELECT conv_id, turn, unnest(list_slice(regexp_extract_all(lower(text), '[a-z]{3,}'), 1, 200)) AS item, generate_subscripts(list_slice(regexp_extract_all(lower(text), '[a-z]{3,}'), 1, 200), 1) AS place FROM conversations)
    SELECT conv_id, item, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, seen, item)::INT AS rank FROM (SELECT conv_id, item, count(*) AS n, min((turn, place)) AS seen FROM w GROUP BY conv_id, item)) WHERE rank <= 5""".replace("list_slice(regexp_extract_all(lower(text), '[a-z]{3,}'), 1, 200)", "regexp_extract_all(lower(text), '[a-z]{3,}')")
)
def memory_top_facts(t: Tables) -> DataFrame:
    """The words that a conversation's turns name most."""
    rows = t.conversations.select("conv_id", "turn", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0)).alias("words"))
    return R.frequent_in_arrays(rows, ["conv_id"], "words", "turn", 5).select("conv_id", "item", "n", "rank")


@query(
    """SELECT row_number() OVER (ORDER BY n, o, line)::INT AS nth, line FROM (SELECT 'runs_total' AS n, 1 AS o, 'runs_total{kind="' || event_type || '"} ' || count(*)::VARCHAR AS line FROM events GROUP BY event_type
    UNION ALL SELECT 'runs_total', 0, unnest(['# HELP runs_total Runs by kind', '# TYPE runs_total gauge']))"""
)
def metrics_exposition(t: Tables) -> DataFrame:
    """S24."""
    gauges = t.events.groupBy("event_type").agg(F.count("*").alias("n"))
    return sinks.exposition(gauges, F.lit("runs_total"), F.col("n"), {"kind": F.col("event_type")}, "Runs by kind")


@query(
    """SELECT to_json({query: q, expected_answer: a, domain: d})::VARCHAR AS value FROM (SELECT left(text, 40) AS q, arg_min(source, doc_id) AS a, arg_min(lang, doc_id) AS d FROM documents WHERE length(text) > 200 GROUP BY 1)
    WHERE q NOT LIKE '%"%' AND q NOT LIKE '%\\%' AND NOT regexp_matches(q, '[\\x00-\\x1f/]')"""
)
def regression_export(t: Tables) -> DataFrame:
    """Documents as answers; queries without characters that JSON writers spell in different ways."""
    runs = t.documents.select(F.col("doc_id").alias("id"), F.left("text", F.lit(40)).alias("query"), F.col("source").alias("answer"), F.col("lang").alias("domain"), "text")
    plain = ~F.rlike("query", F.lit(r'[\x00-\x1f/"\\]'))
    return sinks.regression_set(runs, (F.length("text") > 200) & plain)


@query(
    """SELECT user_id, event_type, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first_seen, event_type)::INT AS rank
    FROM (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first_seen FROM events GROUP BY ALL)) WHERE rank <= 3"""
)
def memory_topn(t: Tables) -> DataFrame:
    """A9."""
    return R.frequent_items(t.events, ["user_id"], "event_type", F.col("event_id"), 3).select("user_id", "event_type", "n", "rank")


@query("SELECT event_type, count(DISTINCT user_id) AS encounters FROM events GROUP BY event_type")
def encounter_count(t: Tables) -> DataFrame:
    """A10."""
    return t.events.groupBy("event_type").agg(F.count_distinct("user_id").alias("encounters"))


@query(
    """WITH e AS (SELECT user_id, CAST(ts AS DATE) AS day, min(ts) AS arrival, min(ts) FILTER (event_type = 'click') AS c,
    min(ts) FILTER (event_type = 'purchase') AS p FROM events GROUP BY ALL)
    SELECT user_id, strftime(day, '%Y-%m-%d') AS day, round((epoch_us(c) - epoch_us(arrival)) / 6e7, 2) AS to_click,
    round((epoch_us(p) - epoch_us(c)) / 6e7, 2) AS click_to_purchase FROM e"""
)
def episode_kpi(t: Tables) -> DataFrame:
    """Minutes between the stages of each user's day."""
    days = t.events.withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    e = days.groupBy("user_id", "day").agg(
        F.min("ts").alias("arrival"), *(F.min(F.when(F.col("event_type") == s, F.col("ts"))).alias(s) for s in ("click", "purchase"))
    )
    return e.select(
        "user_id", "day", R.minutes_between(F.col("arrival"), F.col("click")).alias("to_click"), R.minutes_between(F.col("click"), F.col("purchase")).alias("click_to_purchase")
    )


@query(
    """SELECT from_stage, to_stage, count(*) AS n, (from_stage, to_stage) IN (('view', 'click'), ('click', 'purchase'), ('signup', 'view')) AS allowed FROM
    (SELECT event_type AS from_stage, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS to_stage FROM events) WHERE to_stage IS NOT NULL GROUP BY ALL"""
)
def stage_transitions(t: Tables) -> DataFrame:
    """A12."""
    return R.transitions(t.events, ["user_id"], "event_type", "ts", "event_id", [("view", "click"), ("click", "purchase"), ("signup", "view")])


@query(
    """WITH g AS (SELECT count(*) FILTER (event_type = 'error') AS failed, 100.0 * count(*) FILTER (event_type = 'signup') / count(*) AS fallback_rate,
    count(*) AS total FROM events) SELECT 'AgentRunsFailed' AS alert, 'warning' AS severity FROM g WHERE failed > 0 UNION ALL
    SELECT 'AgentFallbackRateHigh', 'warning' FROM g WHERE fallback_rate > 10 UNION ALL SELECT 'NoRuns', 'critical' FROM g WHERE total = 0"""
)
def alert_rules(t: Tables) -> DataFrame:
    """A13."""
    gauges = t.events.agg(
        F.count_if(F.col("event_type") == "error").alias("failed"),
        (100.0 * F.count_if(F.col("event_type") == "signup") / F.count("*")).alias("fallback_rate"),
        F.count("*").alias("total"),
    )
    rules = [("AgentRunsFailed", "warning", "failed > 0"), ("AgentFallbackRateHigh", "warning", "fallback_rate > 10"), ("NoRuns", "critical", "total = 0")]
    return R.alerts(gauges, rules)


@query(
    """SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M') AS minute, event_type, count(*) / 60.0::DOUBLE AS rate,
    quantile_cont(value, 0.95) AS p95 FROM events GROUP BY ALL"""
)
def rate_per_minute(t: Tables) -> DataFrame:
    """Events a second and 95th percentile of each minute."""
    w = t.events.groupBy(F.window("ts", "1 minute").alias("w"), "event_type").agg((F.count("*") / 60.0).alias("rate"), F.percentile("value", 0.95).alias("p95"))
    return w.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("minute"), "event_type", "rate", "p95")


@query("SELECT source, count(*) AS documents, sum(n_chars)::BIGINT AS chars, round(avg(n_chars), 4) AS mean_chars FROM documents GROUP BY source")
def ingest_statistics(t: Tables) -> DataFrame:
    """A23, A24."""
    return t.documents.groupBy("source").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"), F.round(F.avg("n_chars"), 4).alias("mean_chars"))


@query("SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def recent_runs(t: Tables) -> DataFrame:
    """T1."""
    return R.recent(t.events, "ts", "event_id", 20).select("event_id", "user_id")


@query(
    """SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INT AS rank
    FROM orders) WHERE rank <= 3"""
)
def topk_per_query(t: Tables) -> DataFrame:
    """T2."""
    return R.top_per_group(t.orders, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3).select("o_custkey", "o_orderkey", "rank")


@query(
    """WITH o AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY CASE WHEN value > 50 THEN 0 ELSE 1 END, event_id) AS nth FROM events),
    k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN value > 50 THEN 0 ELSE 1 END, event_id)::INT AS rank,
      count(*) OVER (PARTITION BY user_id) AS kept_keys FROM o WHERE nth = 1)
    SELECT user_id, event_type, event_id, rank, (SELECT count(*) FROM events e WHERE e.user_id = k.user_id) - least(kept_keys, 3) AS suppressed FROM k WHERE rank <= 3"""
)
def alert_fatigue(t: Tables) -> DataFrame:
    """T4."""
    out = R.alert_fatigue(t.events, ["user_id"], "event_type", F.col("value") > 50, "event_id", 3)
    return out.select("user_id", "event_type", "event_id", "rank", "suppressed")


@query("SELECT event_id, CASE WHEN value >= 75 THEN 0 WHEN value >= 25 THEN 1 ELSE 2 END AS bucket FROM events")
def priority_bucket(t: Tables) -> DataFrame:
    """Which queue a row waits in."""
    v = F.col("value")
    return t.events.select("event_id", F.when(v >= 75, 0).when(v >= 25, 1).otherwise(2).alias("bucket"))


@query(
    """SELECT user_id, event_id, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS running,
    event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events"""
)
def running_totals(t: Tables) -> DataFrame:
    """W1."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    running = F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return t.events.select("user_id", "event_id", running.alias("running"), (F.col("event_id") - F.lag("event_id").over(w)).alias("gap"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_summary(t: Tables) -> DataFrame:
    """All groupings of two columns."""
    return t.lineitem.cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("qty"))


@query(
    """SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1"""
)
def latest_upsert(t: Tables) -> DataFrame:
    """Of several writes for one key the latest stays."""
    return S.upsert(t.events, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id")


@query(
    """SELECT doc_id, lang FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE lang = 'de') UNION ALL SELECT doc_id, lang FROM documents WHERE lang = 'de'"""
)
def replace_by_source(t: Tables) -> DataFrame:
    """S12."""
    return S.replace_by_source(t.documents, t.documents.where("lang = 'de'"), "source").select("doc_id", "lang")


@query(
    """SELECT doc_id, '{"index":{"_index":"chunks","_id":"' || doc_id || '"}}' || chr(10) || '{"doc_id":' || doc_id || ',"lang":"' || lang || '"}' || chr(10) AS payload FROM documents"""
)
def bulk_payload(t: Tables) -> DataFrame:
    """S18."""
    return S.bulk_payload(t.documents.select("doc_id", "lang"), "doc_id", "chunks")


GAPS = """g AS (SELECT user_id, event_id - coalesce(lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS gap FROM events),
 b AS (SELECT user_id, floor(log2(gap))::INT + 1 AS bits FROM g WHERE gap > 0)"""


@query(
    f"""WITH {GAPS} SELECT user_id, count(*) AS n, sum(ceil(bits / 7))::BIGINT AS byte_size, 4 + ceil(sum(2 * bits - 1) / 8)::BIGINT AS gamma_size, true AS same FROM b GROUP BY user_id"""
)
def postings_codecs(t: Tables) -> DataFrame:
    """Each user's events as postings in both codes: their sizes, and whether decoding gives the postings back."""
    import pandas as pd

    from ..functions import codecs

    def code(frames):
        for f in frames:
            rows = []
            for user, ids in zip(f["user_id"], f["ids"]):
                gaps = codecs.to_gaps([int(i) for i in ids])
                short, gamma = codecs.encode_bytes(gaps), codecs.encode_gamma(gaps)
                same = codecs.decode_bytes(short) == gaps == codecs.decode_gamma(gamma)
                rows.append((user, len(gaps), len(short), len(gamma), same))
            yield pd.DataFrame(rows, columns=["user_id", "n", "byte_size", "gamma_size", "same"])

    ids = t.events.groupBy("user_id").agg(F.array_sort(F.collect_set("event_id")).alias("ids"))
    kind = t.events.schema["user_id"].dataType.simpleString()
    return ids.mapInPandas(code, f"user_id {kind}, n long, byte_size long, gamma_size long, same boolean").where("n > 0")


@query(
    """SELECT time_bucket(INTERVAL '10 minutes', ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL"""
)
def event_windows(t: Tables) -> DataFrame:
    """The batch form of the windowed gauges of a stream."""
    w = F.window("ts", "10 minutes")
    return t.events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean")).select("w.start", "event_type", "n", "mean")


@query(
    """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k"""
)
def event_sessions(t: Tables) -> DataFrame:
    """Sessions that end after half an hour without an event."""
    found = t.events.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return found.select("user_id", F.col("w.start").alias("start"), "n")


@query(
    """SELECT c.event_id AS click_id, p.event_id AS purchase_id, epoch_us(p.ts) // 1000000 - epoch_us(c.ts) // 1000000 AS seconds FROM events c JOIN events p ON c.user_id = p.user_id
    WHERE c.event_type = 'click' AND p.event_type = 'purchase' AND p.ts >= c.ts AND p.ts <= c.ts + INTERVAL 6 HOURS"""
)
def click_to_purchase(t: Tables) -> DataFrame:
    """The batch form of the join of two streams: a user's purchases within six hours of a click."""
    from ..streaming.windows import within

    side = lambda kind, short: t.events.where(F.col("event_type") == kind).select(F.col("event_id").alias(f"{kind}_id"), F.col("user_id").alias(f"{short}_user"), F.col("ts").alias(f"{short}_ts"))
    met = within(side("click", "c"), side("purchase", "p"), ("c_user", "p_user"), ("c_ts", "p_ts"), 6 * 3600)
    return met.select("click_id", "purchase_id", (F.unix_seconds(F.col("p_ts").cast("timestamp")) - F.unix_seconds(F.col("c_ts").cast("timestamp"))).alias("seconds"))


@query("SELECT event_id, (2 ** (event_id % 3 + 1) * 3 ** (user_id % 4 + 1) * 5 ** (event_id % 2 + 1))::BIGINT::VARCHAR AS code, true AS same FROM events")
def number_codes(t: Tables) -> DataFrame:
    """Three steps of a plan as one number, and whether it gives them back."""
    import pandas as pd

    from ..operators.routing import from_godel, godel

    def code(frames):
        for f in frames:
            codes = [godel([a, b, c]) for a, b, c in zip(f["a"].tolist(), f["b"].tolist(), f["c"].tolist())]
            same = [from_godel(x) == [a, b, c] for x, a, b, c in zip(codes, f["a"], f["b"], f["c"])]
            yield pd.DataFrame({"event_id": f["event_id"], "code": codes, "same": same})

    rows = t.events.selectExpr("event_id", "event_id % 3 AS a", "user_id % 4 AS b", "event_id % 2 AS c")
    return rows.mapInPandas(code, "event_id long, code string, same boolean")

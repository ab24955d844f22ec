"""Classification and clustering: documents by language, embeddings by label, line items by risk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cluster_rounds as R
from ..operators import decision as D
from ..operators import learn as L
from ..operators.relational import top_per_group
from ..plans.cut import checkpoint, small
from .registry import Tables, query

#: Terms of the learning queries: runs of three or more a-z, 0-9 of the lower-case text.
PATTERN = "[a-z0-9]{3,}"
TOKENS = f"regexp_extract_all(lower(text), '{PATTERN}')"
COUNTS = f"c AS (SELECT doc_id, lang, term, count(*) AS tf FROM (SELECT doc_id, lang, unnest({TOKENS}) AS term FROM documents) GROUP BY ALL)"


def _tokens():
    return F.regexp_extract_all(F.lower("text"), F.lit(PATTERN), F.lit(0))


def _counts(t: Tables) -> DataFrame:
    return L.term_counts(t.documents, "doc_id", "lang", _tokens())


@query(
    f"""WITH {COUNTS}, cell AS (SELECT lang, term, sum(tf) AS n FROM c GROUP BY ALL), s AS (SELECT lang, sum(n) AS total FROM cell GROUP BY lang), v AS (SELECT count(DISTINCT term) AS v FROM cell),
    pr AS (SELECT lang, count(*) / (SELECT count(*) FROM documents) AS prior FROM documents GROUP BY lang),
    g AS (SELECT d.doc_id, s.lang, any_value(ln(prior)) + sum(tf * ln((coalesce(n, 0) + 1) / (total + v.v))) AS score
      FROM (SELECT doc_id, term, tf FROM c) d CROSS JOIN (SELECT * FROM s JOIN pr USING (lang)) s CROSS JOIN v LEFT JOIN cell ON cell.term = d.term AND cell.lang = s.lang GROUP BY d.doc_id, s.lang, total)
    SELECT doc_id, guess, round(score, 4) AS score FROM (SELECT doc_id, lang AS guess, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang) AS n FROM g) WHERE n = 1"""
)
def nb_multinomial(t: Tables) -> DataFrame:
    """The likeliest language; priors are the languages' shares of documents."""
    c = checkpoint(_counts(t))
    share = t.documents.groupBy("lang").agg(F.count("*").alias("n"))
    priors = L.class_priors(share, "lang", size="n")
    scored = L.multinomial_bayes(c.select("lang", "term", "tf"), c.drop("lang"), "doc_id", "lang", priors)
    best = top_per_group(scored, ["doc_id"], [F.desc("score"), F.asc("lang")], 1, "n")
    return best.select("doc_id", F.col("lang").alias("guess"), F.round("score", 4).alias("score"))


@query("SELECT lang, round((1 + CASE WHEN lang = 'de' THEN 0.35 ELSE 0 END + CASE WHEN lang IN ('fr', 'es') THEN 0.20 ELSE 0 END) / sum(1 + CASE WHEN lang = 'de' THEN 0.35 ELSE 0 END + CASE WHEN lang IN ('fr', 'es') THEN 0.20 ELSE 0 END) OVER ()::DOUBLE, 6) AS prior FROM (SELECT DISTINCT lang FROM documents)")
def boosted_priors(t: Tables) -> DataFrame:
    """German as the specialty, French and Spanish as matched domains."""
    return L.class_priors(t.documents.select("lang").distinct(), "lang", "DE", ("fr", " es")).select("lang", F.round("prior", 6).alias("prior"))


BERNOULLI = f"""h AS (SELECT DISTINCT doc_id, unnest({TOKENS}) AS term FROM documents), cl AS (SELECT DISTINCT lang, term FROM h JOIN documents USING (doc_id)), v AS (SELECT count(DISTINCT term) AS v FROM cl),
 n AS (SELECT lang, count(*) AS total, count(*) OVER () AS k FROM cl GROUP BY lang), m AS (SELECT doc_id, count(*) AS m FROM h GROUP BY doc_id), o AS (SELECT doc_id, lang, count(*) AS own FROM h JOIN cl USING (term) GROUP BY ALL),
 b AS (SELECT doc_id, n.lang, ln(1.0 / k) + (total - coalesce(own, 0)) * ln(1 / 3.0) + (v - total - (m - coalesce(own, 0))) * ln(2 / 3.0) + coalesce(own, 0) * ln(2 / 3.0) + (m - coalesce(own, 0)) * ln(1 / 3.0) AS score
   FROM m CROSS JOIN n CROSS JOIN v LEFT JOIN o USING (doc_id, lang))"""


@query(
    f"""WITH {BERNOULLI} SELECT doc_id, guess, round(score, 3) AS score FROM (SELECT doc_id, lang AS guess, score, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 6) DESC, lang) AS n FROM b) WHERE n = 1"""
)
def nb_bernoulli(t: Tables) -> DataFrame:
    """By presence of terms alone."""
    c = checkpoint(_counts(t))
    scored = L.bernoulli_bayes(c, c, "doc_id", "lang").withColumn("near", F.round("score", 6))
    best = top_per_group(scored, ["doc_id"], [F.desc("near"), F.asc("lang")], 1, "n")
    return best.select("doc_id", F.col("lang").alias("guess"), F.round("score", 3).alias("score"))


CHI = f"""h AS (SELECT DISTINCT doc_id, lang, unnest({TOKENS}) AS term FROM documents), cell AS (SELECT term, lang, count(*)::DOUBLE AS a FROM h GROUP BY ALL),
 t AS (SELECT term, lang, a, sum(a) OVER (PARTITION BY term) - a AS b, nc - a AS c, n - nc - (sum(a) OVER (PARTITION BY term) - a) AS d, n FROM cell
   JOIN (SELECT lang, count(*)::DOUBLE AS nc FROM documents GROUP BY lang) USING (lang), (SELECT count(*)::DOUBLE AS n FROM documents)),
 m AS (SELECT term, round(max(coalesce(n * (a * d - b * c) * (a * d - b * c) / nullif((a + b) * (c + d) * (a + c) * (b + d), 0), 0)), 5) AS chi2,
   round(max(CASE WHEN a > 0 THEN a / n * ln(a * n / ((a + b) * (a + c))) ELSE 0 END + CASE WHEN b > 0 THEN b / n * ln(b * n / ((a + b) * (b + d))) ELSE 0 END
   + CASE WHEN c > 0 THEN c / n * ln(c * n / ((c + d) * (a + c))) ELSE 0 END + CASE WHEN d > 0 THEN d / n * ln(d * n / ((c + d) * (b + d))) ELSE 0 END), 6) AS mi FROM t GROUP BY term)"""


@query(f"WITH {CHI} SELECT * FROM m ORDER BY chi2 DESC, term LIMIT 256")
def chi2_select(t: Tables) -> DataFrame:
    """Both measures of the terms with the highest chi-square."""
    return L.term_selection(t.documents, "doc_id", "lang", _tokens(), 256)


@query(
    f"""WITH {COUNTS}, df AS (SELECT term, count(*) AS df FROM c GROUP BY term), r AS (SELECT doc_id, lang, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w FROM c JOIN df USING (term)),
    u AS (SELECT doc_id, lang, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM r), m AS (SELECT lang, term, sum(w) / any_value(n) AS c FROM u JOIN (SELECT lang, count(*) AS n FROM documents GROUP BY lang) USING (lang) GROUP BY lang, term),
    k AS (SELECT lang, term, c / sqrt(sum(c * c) OVER (PARTITION BY lang)) AS c FROM m), s AS (SELECT doc_id, k.lang AS guess, round(sum(w * c), 6) AS score FROM u JOIN k USING (term) GROUP BY ALL)
    SELECT doc_id, guess, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, guess) AS n FROM s) WHERE n = 1"""
)
def rocchio(t: Tables) -> DataFrame:
    """The nearest class mean."""
    size = t.documents.agg(F.count("*").alias("n_docs"))
    # texts are dealt by id once, so that counts, lengths and scores of a document are made where it lies
    docs = t.documents.select("doc_id", "lang", "text").repartition("doc_id")
    vectors = L.tfidf(L.term_counts(docs, "doc_id", "lang", _tokens()).drop("lang"), "doc_id", size)
    scored = L.rocchio(vectors, t.documents.select("doc_id", "lang"), "doc_id", "lang")
    scored = scored.select("doc_id", F.col("lang").alias("guess"), F.round("score", 6).alias("score"))
    return top_per_group(scored, ["doc_id"], [F.desc("score"), F.asc("guess")], 1, "n").drop("n")


@query()
def svm_ova(t: Tables) -> DataFrame:
    """C7."""
    return L.ova_svm(t.embeddings, "label", "embedding", "vec_id")


SURE = """v AS (SELECT user_id, event_type, sum(value) / 100.0 AS s FROM events GROUP BY ALL), e AS (SELECT *, exp(s - max(s) OVER (PARTITION BY user_id)) AS e FROM v), p AS (SELECT user_id, event_type, e / sum(e) OVER (PARTITION BY user_id) AS p FROM e),
 r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY p DESC, event_type) AS n FROM p)"""


@query(
    f"""WITH {SURE}, g AS (SELECT user_id, max(CASE WHEN n = 1 THEN event_type END) AS top, max(p) AS probability, coalesce(max(CASE WHEN n = 2 THEN p END), 0) AS second, sum(CASE WHEN p > 0 THEN -p * ln(p) ELSE 0 END) / ln(greatest(2, count(*))) AS entropy FROM r GROUP BY user_id)
    SELECT user_id, top, round(probability, 6) AS probability, round(probability - second, 6) AS margin, round(entropy, 6) AS entropy FROM g"""
)
def class_certainty(t: Tables) -> DataFrame:
    """Softmax, margin and entropy of what kind of event a user's values speak for."""
    scored = t.events.groupBy("user_id", "event_type").agg((F.sum("value") / 100.0).alias("score"))
    sure = L.certainty(scored, "user_id", "event_type")
    return sure.select("user_id", "top", *(F.round(c, 6).alias(c) for c in ("probability", "margin", "entropy")))


PROTOTYPES = {"en": ("the", "that", "with", "from"), "de": ("der", "nicht", "und", "verein", "keit"), "fr": ("des", "que", "ment"), "es": ("que", "las", "cion", "mente")}


@query()
def prototype_posterior(t: Tables) -> DataFrame:
    """C11: languages as classes, given by parts of words."""
    found = L.prototype_posterior(t.documents, "doc_id", F.col("text"), PROTOTYPES)
    return found.select("doc_id", "top", "ood_level", "uncertainty", "abstain", "priority", *(F.round(c, 6).alias(c) for c in ("probability", "margin", "entropy", "coverage", "ood")))


@query()
def rerank_cascade(t: Tables) -> DataFrame:
    """Each document's language by its class mean, put right by Bayes and then by its prototype."""
    c = checkpoint(_counts(t))
    best = lambda s: top_per_group(s.withColumn("score", F.round("score", 6)), ["doc_id"], [F.desc("score"), F.asc("lang")], 1, "n")
    mean = L.rocchio(L.tfidf(c.drop("lang"), "doc_id", t.documents.agg(F.count("*").alias("n_docs"))), t.documents.select("doc_id", "lang"), "doc_id", "lang")
    first = top_per_group(mean.withColumn("score", F.round("score", 6)), ["doc_id"], [F.desc("score"), F.asc("lang")], 3, "n")
    first = first.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "lang"))), lambda s: s["lang"]).alias("first"))
    bayes = best(L.multinomial_bayes(c.select("lang", "term", "tf"), c.drop("lang"), "doc_id", "lang")).select("doc_id", F.col("lang").alias("bayes"))
    proto = L.prototype_posterior(t.documents, "doc_id", F.col("text"), PROTOTYPES).where("not abstain").select("doc_id", F.col("top").alias("proto"))
    rows = first.join(bayes, "doc_id", "left").join(proto, "doc_id", "left")
    return rows.select("doc_id", L.cascade(F.col("first"), [F.col("bayes"), F.col("proto")]).alias("classes"))


GAIN = """cd AS (SELECT event_type AS id, CASE WHEN event_type IN ('view', 'click') THEN 'browse' ELSE 'act' END AS cluster, count(*) / (SELECT count(*) FROM events)::DOUBLE AS prior, avg((value > 50)::INT) AS high, avg((value > 90)::INT) AS top, avg((user_id % 2 = 0)::INT) AS even FROM events GROUP BY event_type),
 g AS (SELECT id, cluster, prior, f AS feature, CASE f WHEN 'high' THEN high WHEN 'top' THEN top ELSE even END AS l FROM cd, (SELECT unnest(['high', 'top', 'even']) AS f)),
 u AS (SELECT *, prior * greatest(0.05, least(0.95, l)) AS y0, prior * greatest(0.05, least(0.95, 1 - l)) AS n0 FROM g),
 q AS (SELECT *, y0 / sum(y0) OVER (PARTITION BY feature) AS y, n0 / sum(n0) OVER (PARTITION BY feature) AS n FROM u),
 s AS (SELECT feature, greatest(0, sum(-prior * log2(prior)) - 0.5 * sum(-y * log2(y)) - 0.5 * sum(-n * log2(n))) AS ig, 1 - sum(prior * prior) AS con, CASE WHEN arg_max(cluster, (round(y, 12), prior, id)) = arg_max(cluster, (round(n, 12), prior, id)) THEN 0.2 ELSE 1.0 END::DOUBLE AS div FROM q GROUP BY feature)"""


@query(f"WITH {GAIN} SELECT feature, round(0.5 * ig + 0.35 * div + 0.15 * con, 4) AS gain, round(ig, 4) AS ig, round(div, 4) AS div, round(con, 4) AS con, row_number() OVER (ORDER BY round(0.5 * ig + 0.35 * div + 0.15 * con, 4) DESC, feature)::INT AS rank FROM s")
def question_gain(t: Tables) -> DataFrame:
    """C14: what to ask of an event to tell its kind."""
    marks = {"high": F.col("value") > 50, "top": F.col("value") > 90, "even": F.col("user_id") % 2 == 0}
    known = t.events.groupBy(F.col("event_type").alias("id")).agg(F.count("*").cast("double").alias("p"), *(F.avg(m.cast("int")).alias(n) for n, m in marks.items()))
    known = checkpoint(known.withColumn("cluster", F.when(F.col("id").isin("view", "click"), "browse").otherwise("act")))
    like = known.select("id", F.inline(F.array(*(F.struct(F.lit(n).alias("feature"), F.col(n).alias("p")) for n in marks))))
    return L.question_gain(known.select("id", "cluster", "p"), like)


@query()
def kmeans_clusters(t: Tables) -> DataFrame:
    """K1."""
    return L.kmeans(t.embeddings, "vec_id", "embedding", 8)


@query()
def buckshot_clusters(t: Tables) -> DataFrame:
    """K4, K6."""
    return L.buckshot(t.embeddings, "vec_id", "embedding", 8)


@query()
def choose_k(t: Tables) -> DataFrame:
    """K3: the number of clusters of vectors, all from three to eight in the same passes; the vocabulary is the number of dimensions."""
    found = R.choose_k(t.embeddings, "vec_id", "embedding", vocabulary=t.embeddings.select(F.size("embedding")).first()[0])
    return found.select("k", F.round("rss", 6).alias("rss"), F.round("aic", 6).alias("aic"), "chosen")


@query()
def divisive_clusters(t: Tables) -> DataFrame:
    """K5: six clusters by splits."""
    return R.divisive(t.embeddings, "vec_id", "embedding", 6)


RISK = {"l_quantity": (25.0, 25.0, 14.0, 0.8), "l_discount": (0.05, 0.05, 0.03, -0.5), "l_tax": (0.04, 0.04, 0.02, 0.3)}
Z = {n: f"((coalesce({n}, {med}) - {mean}) / {dev})" for n, (med, mean, dev, _) in RISK.items()}


@query(
    f"""SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-(-0.4 + {' + '.join(f'{w} * {Z[n]}' for n, (*_, w) in RISK.items())}))), 6) AS risk,
    round(({' + '.join(f'abs({z})' for z in Z.values())}) / 3, 6) AS anomaly FROM lineitem"""
)
def logistic_risk(t: Tables) -> DataFrame:
    """C12."""
    rows = L.logistic_risk(t.lineitem, RISK, -0.4)
    return rows.select("l_orderkey", "l_linenumber", F.round("risk", 6).alias("risk"), F.round("anomaly", 6).alias("anomaly"))


@query(
    """SELECT l_orderkey, l_linenumber, round(m, 4) AS margin, round(greatest(0, 1 - m), 4) AS hinge, CASE WHEN m >= 1 THEN 'critical' WHEN m >= 0 THEN 'urgent' ELSE 'stable' END AS level FROM
    (SELECT *, (1.2 * (l_quantity > 40)::INT + 0.8 * (l_returnflag = 'R')::INT + 0.6 * (l_discount > 0.08)::INT - 0.9 * (l_linestatus = 'O')::INT - 0.5)::DOUBLE AS m FROM lineitem)"""
)
def linear_triage(t: Tables) -> DataFrame:
    """C13."""
    one = lambda p: F.expr(p).cast("int")
    m = 1.2 * one("l_quantity > 40") + 0.8 * one("l_returnflag = 'R'") + 0.6 * one("l_discount > 0.08") - 0.9 * one("l_linestatus = 'O'") - 0.5
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.round(m, 6).alias("m"))
    level = F.when(F.col("m") >= 1, "critical").when(F.col("m") >= 0, "urgent").otherwise("stable")
    return rows.select("l_orderkey", "l_linenumber", F.round("m", 4).alias("margin"), F.round(F.greatest(F.lit(0.0), 1 - F.col("m")), 4).alias("hinge"), level.alias("level"))


@query("SELECT event_id, round(ln(1 + greatest(0, least(10, value / 10))) / ln(11), 6) AS intensity FROM events")
def fechner_risk(t: Tables) -> DataFrame:
    """C17."""
    return t.events.select("event_id", F.round(L.fechner(F.col("value") / 10), 6).alias("intensity"))


#: Events as questions that name signs and pain.
QUESTION = """concat_ws(' ', CASE WHEN event_id % 3 = 0 THEN concat('TA: ', CAST(80 + event_id % 100 AS STRING), '/', CAST(50 + event_id % 70 AS STRING)) END,
    CASE WHEN event_id % 4 = 0 THEN concat('SatO2 ', CAST(85 + event_id % 15 AS STRING), '%') END, CASE WHEN event_id % 5 = 0 THEN concat('K+ ', CAST(4 + event_id % 3 AS STRING), ',', CAST(event_id % 10 AS STRING)) END,
    CASE event_id % 6 WHEN 0 THEN 'dolor 3 a 8/10' WHEN 1 THEN 'dolor nivel 9' WHEN 2 THEN concat('escala de 7-', CAST(event_id % 11 AS STRING)) END,
    CASE WHEN event_id % 7 = 0 THEN 'con oliguria, FC >= 120, 38,5 h y cefalea intensa' WHEN event_id % 7 = 1 THEN 'Rechaza; familiar con alérgia en urgencias' END)"""
_N = lambda pattern, g=1: f"TRY_CAST(replace(nullif(regexp_extract(q, '{pattern}', {g}), ''), ',', '.') AS DOUBLE)"
_F = lambda x: f"(ln(1 + greatest(0, least(10, {x}))) / ln(11))"
_SIGNS = (
    ("sys <= 90", 0.45, "hypotension_critical"), ("sys >= 160 OR dia >= 110", 0.35, "hypertension_severe"), ("sat <= 91", 0.40, "oxygenation_critical"), ("sat > 91 AND sat <= 94", 0.20, "oxygenation_warning"),
    ("k >= 6", 0.45, "hyperkalemia_critical"), ("k < 6 AND k >= 5.5", 0.25, "hyperkalemia_warning"), ("intensity >= 0.82", 0.15, "pain_high_perceived_intensity"), ("change >= 0.18", 0.15, "pain_perceived_worsening"),
    *((f"contains(low, '{w}')", 0.08, f"red_flag:{w.replace(' ', '_')}") for w in D.RED_FLAGS), ("event_type = 'signup' AND (sys >= 160 OR dia >= 110)", 0.10, "obstetric_hypertensive_priority"),
)
_LOW = r"regexp_replace(strip_accents(lower(q)), '[^\x00-\x7F]', '', 'g')"
ASKED = f"q AS (SELECT event_id, event_type, {QUESTION} AS q FROM events)"


@query(
    f"""WITH {ASKED}, n AS (SELECT *, {_LOW} AS low, {_N(D.PRESSURE)} AS sys, {_N(D.PRESSURE, 2)} AS dia, {_N(D.SATURATION)} AS sat, {_N(D.POTASSIUM)} AS k, {_N(D.PAIN_RANGE)} AS a, {_N(D.PAIN_RANGE, 2)} AS b, {_N(D.PAIN_LEVEL)} AS l FROM q),
    f AS (SELECT *, CASE WHEN b IS NOT NULL THEN {_F('b')} WHEN l IS NOT NULL THEN {_F('l')} END AS intensity, CASE WHEN b IS NOT NULL THEN abs({_F('b')} - {_F('a')}) END AS change FROM n),
    r AS (SELECT *, round(least(1, {' + '.join(f'CASE WHEN {c} THEN {p} ELSE 0 END' for c, p, _ in _SIGNS)}), 9)::DOUBLE AS risk, list_filter([{', '.join(f"CASE WHEN {c} THEN '{n}' END" for c, _, n in _SIGNS)}], lambda x: x IS NOT NULL)[1:8] AS signals FROM f)
    SELECT event_id, round(intensity, 3) AS intensity, round(change, 3) AS change, round(risk, 3) AS risk, CASE WHEN risk >= 0.6 THEN 'high' WHEN risk >= 0.35 THEN 'medium' ELSE 'low' END AS level, signals FROM r"""
)
def decision_risk(t: Tables) -> DataFrame:
    """C17: perceived pain, added risk and signals of events as questions."""
    domain = F.when(F.col("event_type") == "signup", "gynecology_obstetrics").otherwise(F.col("event_type"))
    rows = t.events.select("event_id", domain.alias("domain"), F.expr(QUESTION).alias("q"))
    found = D.decision_risk(F.col("q"), F.col("domain"))
    return rows.select("event_id", *(found[n].alias(n) for n in ("intensity", "change", "risk", "level", "signals")))


_SPOKEN = ", ".join(f"CASE WHEN {' OR '.join(f'contains(low, {chr(39)}{w}{chr(39)})' for w in words)} THEN '{fact}' END" for words, fact in D.SPOKEN)


@query(
    f"""WITH {ASKED}, n AS (SELECT event_id, q, {_LOW} AS low FROM q), f AS (SELECT event_id, list_concat(list_transform(regexp_extract_all(q, '{D.UNITS}'), lambda x: 'umbral:' || replace(lower(x), ' ', '')),
    list_transform(regexp_extract_all(q, '{D.COMPARISONS}'), lambda x: 'comparador:' || replace(lower(x), ' ', '')), list_filter([{_SPOKEN}], lambda x: x IS NOT NULL),
    list_transform(list_filter({list(D.TERMS)}, lambda w: contains(low, w)), lambda w: 'termino:' || w)) AS u FROM n)
    SELECT event_id, list_filter(u, lambda x, i: list_position(u, x) = i)[1:16] AS facts FROM f"""
)
def question_facts(t: Tables) -> DataFrame:
    """Facts of events as questions."""
    return t.events.select("event_id", D.question_facts(F.expr(QUESTION)).alias("facts"))


#: The same questions with what the model of risk looks for.
RISKY = f"""concat_ws(' ', {QUESTION}, CASE event_id % 11 WHEN 0 THEN 'creatinina actual: 2,4 y fiebre' WHEN 1 THEN 'QRS ancho, potasio = 6.3' WHEN 2 THEN 'Neutropenia febril, saturacion 90' WHEN 3 THEN 'k 3,1 hipoxia' END)"""
_R = {n: _N(p).replace("(q,", "(low,") for n, p in D.NAMED.items()} | {n: "CASE WHEN " + " OR ".join(f"contains(low, '{w}')" for w in words) + (f" OR {_N(D.SATURATED).replace('(q,', '(low,')} < 92" if n == "hypoxemia_flag" else "") + " THEN 1.0 ELSE 0.0 END" for n, words in D.FLAGGED.items()}
_S = {n: f"((coalesce({n}, {med}) - {mean}) / {dev})" for n, (med, mean, dev, _) in D.RISK_MODEL.items()}


@query(
    f"""WITH q AS (SELECT event_id, {RISKY} AS q FROM events), l AS (SELECT event_id, {_LOW} AS low FROM q), f AS (SELECT event_id, {', '.join(f'({_R[n]})::DOUBLE AS {n}' for n in D.RISK_MODEL)} FROM l),
    s AS (SELECT event_id, list_filter([{', '.join(f"CASE WHEN {n} IS NULL THEN '{n}' END" for n in D.RISK_MODEL)}], lambda x: x IS NOT NULL) AS missing,
      1 / (1 + exp(-({D.RISK_BIAS} + {' + '.join(f'({w}) * {_S[n]}' for n, (*_, w) in D.RISK_MODEL.items())}))) AS p, ({' + '.join(f'abs({z})' for z in _S.values())}) / 8 AS a FROM f)
    SELECT event_id, missing, round(p, 4) AS probability, CASE WHEN p >= 0.75 THEN 'high' WHEN p >= 0.45 THEN 'medium' ELSE 'low' END AS priority, round(a, 4) AS anomaly, a >= 1.75 AS is_anomalous FROM s"""
)
def text_risk(t: Tables) -> DataFrame:
    """The model of risk over events as questions."""
    found = D.text_risk(t.events.select("event_id", F.expr(RISKY).alias("q")), ["event_id"], "q")
    return found.select("event_id", "missing", F.round("probability", 4).alias("probability"), "priority", F.round("anomaly", 4).alias("anomaly"), "is_anomalous")


BAYES = """k AS (SELECT event_type AS h, count(*) AS nh, avg((value > 50)::INT) AS p FROM events GROUP BY event_type), pr AS (SELECT h, nh / (SELECT count(*) FROM events) AS prior, p FROM k),
 l AS (SELECT user_id, h, sum(ln(greatest(1e-6, least(1 - 1e-6, CASE WHEN value > 50 THEN p ELSE 1 - p END)))) + any_value(ln(prior)) AS s FROM events CROSS JOIN pr GROUP BY user_id, h),
 x AS (SELECT *, exp(s - max(s) OVER (PARTITION BY user_id)) AS e FROM l)"""


@query(f"WITH {BAYES} SELECT user_id, h, round(e / sum(e) OVER (PARTITION BY user_id), 6) AS posterior FROM x")
def bayes_posterior(t: Tables) -> DataFrame:
    """C11, C14: which kind of event a user's values are like."""
    high = (F.col("value") > 50).cast("int")
    known = t.events.groupBy(F.col("event_type").alias("h")).agg(F.count("*").alias("nh"), F.avg(high).alias("ph"))
    whole = t.events.agg(F.count("*").alias("all"))
    # five kinds of events
    known = known.crossJoin(F.broadcast(whole)).select("h", (F.col("nh") / F.col("all")).alias("prior"), "ph")
    rows = t.events.select("user_id", high.alias("high")).crossJoin(F.broadcast(known))
    like = rows.select("user_id", "h", F.when(F.col("high") == 1, F.col("ph")).otherwise(1 - F.col("ph")).alias("p"))
    return L.bayes_update(known.select("h", "prior"), like, "user_id", "h").select("user_id", "h", F.round("posterior", 6).alias("posterior"))


@query(
    """SELECT c_mktsegment, round(a, 6) AS incidence, round(b, 6) AS control_incidence, round(a / nullif(b, 0), 6) AS risk_ratio, round(b - a, 6) AS arr, round(1 / nullif(abs(b - a), 0), 4) AS nnt FROM
    (SELECT c_mktsegment, count(*) FILTER (o_orderstatus = 'F' AND o_totalprice > 200000) / nullif(count(*) FILTER (o_totalprice > 200000), 0) AS a,
    count(*) FILTER (o_orderstatus = 'F' AND o_totalprice <= 200000) / nullif(count(*) FILTER (o_totalprice <= 200000), 0) AS b FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment)"""
)
def epidemiology_rates(t: Tables) -> DataFrame:
    """C20."""
    rows = t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    case, exposed = F.col("o_orderstatus") == "F", F.col("o_totalprice") > 200000
    g = rows.groupBy("c_mktsegment").agg(
        F.count_if(case & exposed).alias("a"), F.count_if(exposed).alias("na"), F.count_if(case & ~exposed).alias("b"), F.count_if(~exposed).alias("nb")
    )
    m = L.epidemiology(F.col("a"), F.col("na"), F.col("b"), F.col("nb"))
    return g.select("c_mktsegment", *(F.round(v, 4 if k == "nnt" else 6).alias(k) for k, v in m.items()))


@query(
    f"""WITH c AS (SELECT source AS cluster, doc_id, lang FROM documents), {COUNTS.replace('c AS (', 'w AS (', 1)}, cell AS (SELECT cluster, term, sum(tf) AS n FROM w JOIN c USING (doc_id) GROUP BY ALL),
    i AS (SELECT cluster, sum(n) AS inside FROM cell GROUP BY cluster), a AS (SELECT term, sum(n) AS a FROM cell GROUP BY term),
    s AS (SELECT cluster, term, round(n / greatest(1, inside) - (a - n) / greatest(1, (SELECT sum(inside) FROM i) - inside), 9) AS score FROM cell JOIN i USING (cluster) JOIN a USING (term)),
    b AS (SELECT cluster, list(term ORDER BY r) AS terms FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, term DESC) AS r FROM s WHERE score > 0) WHERE r <= 3 GROUP BY cluster),
    d AS (SELECT cluster, lang AS dominant FROM (SELECT cluster, lang, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, lang) AS r FROM c GROUP BY cluster, lang) WHERE r = 1)
    SELECT cluster, size, dominant, terms FROM (SELECT cluster, count(*) AS size FROM c GROUP BY cluster) JOIN d USING (cluster) LEFT JOIN b USING (cluster)"""
)
def cluster_labels(t: Tables) -> DataFrame:
    """K8: sources as clusters of documents."""
    members = t.documents.select("doc_id", F.col("source").alias("cluster"), "lang")
    return L.cluster_terms(members, checkpoint(_counts(t)), "doc_id", "lang")


def _hard_clusters(t: Tables) -> DataFrame:
    return checkpoint(t.embeddings.join(L.kmeans(t.embeddings, "vec_id", "embedding", 8), "vec_id"))


@query()
def cluster_candidates(t: Tables) -> DataFrame:
    """K9: every 50th vector as a query against the clusters of all."""
    from ..operators.vector import cosine, mean_pool

    rows = _hard_clusters(t)
    mean = small(checkpoint(mean_pool(rows, ["cluster"], "embedding").withColumnRenamed("embedding", "mean")))
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), "embedding").crossJoin(mean)
    scores = asked.select("qid", "cluster", cosine(F.col("embedding"), F.col("mean")).alias("similarity"))
    found = L.cluster_candidates(scores, rows, "qid", "label")
    return found.select("qid", "cluster", F.round("confidence", 6).alias("confidence"), F.round("margin", 6).alias("margin"), "classes", "singleton")


@query()
def cluster_objective(t: Tables) -> DataFrame:
    """K7: the objective of hard clusters of vectors against their labels, for six and eight clusters."""
    from ..operators.evaluate import cluster_quality

    out = None
    for k in (6, 8):
        rows = t.embeddings.select("vec_id", F.col("label").cast("string").alias("label")).join(L.kmeans(t.embeddings, "vec_id", "embedding", k), "vec_id")
        q = cluster_quality(checkpoint(rows).select("label", "cluster"), "label", "cluster")
        part = q.select(F.lit(k).alias("k"), F.round(L.cluster_objective(F.col("f"), F.col("nmi"), F.col("purity"), k, 6), 6).alias("objective"), "purity", "nmi", "f")
        out = part if out is None else out.union(part)
    return out


@query()
def soft_clusters(t: Tables) -> DataFrame:
    """K2: the weights of each vector in four soft clusters."""
    return L.soft_clusters(t.embeddings, "vec_id", "embedding", 4).select("vec_id", "cluster", F.round("weight", 6).alias("weight"))

"""Rules around an answer: logic and contracts, ambiguity, security findings, compaction, text checks, and candidate pages."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold
from ..plans.scan import segmented_scan
from . import graph as G


def _any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def _all(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for w in words:
        out = out & F.contains(text, F.lit(w))
    return out


def _hits(text: Column, words: tuple[str, ...]) -> Column:
    return sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0))


def plain(text: Column) -> Column:
    """Folded, with single spaces."""
    return F.trim(F.regexp_replace(fold(F.coalesce(text, F.lit(""))), r"\s+", " "))


def potassium(text: Column) -> Column:
    """The first potassium value that a text gives, such as K 6.2 or k+: 6,2."""
    return F.replace(F.nullif(F.regexp_extract(text, r"(?i)\bk\+?\s*[:=]?\s*(\d+(?:[.,]\d+)?)\b", 1), F.lit("")), F.lit(","), F.lit(".")).cast("double")


def pressure(text: Column, part: int) -> Column:
    """The first blood pressure that a text gives as TA 160/110: part 1 systolic, 2 diastolic."""
    return F.nullif(F.regexp_extract(text, r"(?i)\bta\s*(\d{2,3})\s*/\s*(\d{2,3})\b", part), F.lit("")).cast("int")


#: Fixed values. A rule: its domains, words of which one and words that all must occur, a condition, priority and actions.
LOGIC_RULES = (
    (
        "nephro_hyperkalemia_critical", ("nephrology", "critical_ops"), ("oliguria", "anuria"), (), "k_ge_6", "critical",
        ("Activar ruta nefrologia critica.", "Solicitar ECG inmediato y monitorizacion continua.", "Escalar valoracion medica prioritaria por hiperkalemia."),
    ),
    (
        "obstetric_htn_severe", ("gynecology_obstetrics", "critical_ops"), ("cefalea", "fosfenos"), (), "ta_ge_160_110", "critical",
        ("Activar protocolo obstetrico de hipertension severa.", "Monitorizacion materno-fetal intensiva.", "Escalar equipo obstetrico de forma inmediata."),
    ),
    (
        "sepsis_shock_operational", ("sepsis", "critical_ops"), ("sepsis", "shock", "lactato"), (), "shock_or_hypotension", "high",
        ("Activar bundle operativo de sepsis (0-60 min).", "Control hemodinamico y reevaluacion seriada."),
    ),
    (
        "oncology_neutropenia_fever", ("oncology",), (), ("neutropenia", "fiebre"), None, "high",
        ("Activar ruta de neutropenia febril oncologica.", "Escalar evaluacion infecciosa y aislamiento segun protocolo."),
    ),
    (
        "pediatrics_measles_isolation", ("pediatrics_neonatology",), (), ("sarampion", "fiebre"), None, "high",
        ("Activar aislamiento respiratorio pediatrico.", "Escalar circuito de vigilancia epidemiologica."),
    ),
)
DENIABLE = ("fiebre", "dolor", "sangrado", "disnea")
SIGNALS = ("shock", "fiebre", "dolor", "sangrado", "oliguria", "anuria", "disnea", "cefalea", "fosfenos", "neutropenia", "sarampion")
EVIDENCE_FACTS = ("termino:", "unit:", "comparator:", "logic_rule:", "risk_level:")


def logic(text: Column, domains: Column, facts: Column) -> Column:
    """Struct of fired ``rules``, their ``actions`` (six at most), ``contradictions``, ``items`` of evidence, ``status`` and ``abstain``.

    A contradiction is a symptom that a text both denies and, by its plain word, reports; it makes the text inconsistent. With neither
    rules nor three items of evidence there is too little to say.
    """
    low = plain(text)
    condition = {
        None: F.lit(True),
        "k_ge_6": F.coalesce(potassium(text) >= 6, F.lit(False)),
        "ta_ge_160_110": F.coalesce((pressure(text, 1) >= 160) & (pressure(text, 2) >= 110), F.lit(False)),
        "shock_or_hypotension": F.contains(low, F.lit("shock")) | F.coalesce(pressure(text, 1) <= 90, F.lit(False)),
    }
    fired = [
        (n, F.arrays_overlap(domains, F.array(*map(F.lit, d))) & (_any(low, some) if some else F.lit(True)) & _all(low, every) & condition[c], acts)
        for n, d, some, every, c, _, acts in LOGIC_RULES
    ]
    rules = F.array_compact(F.array(*(F.when(p, F.lit(n)) for n, p, _ in fired)))
    none = F.array().cast("array<string>")
    actions = F.slice(F.array_distinct(F.concat(*(F.when(p, F.array(*map(F.lit, acts))).otherwise(none) for _, p, acts in fired))), 1, 6)
    # a text that denies a symptom holds its word as well
    contradictions = F.array_compact(F.array(*(F.when(F.contains(low, F.lit(f"sin {w}")), F.lit(w)) for w in DENIABLE)))
    items = _hits(low, SIGNALS) + F.size(F.filter(facts, lambda f: F.exists(F.array(*map(F.lit, EVIDENCE_FACTS)), lambda p: F.startswith(f, p))))
    status = F.when(F.size(contradictions) > 0, "inconsistent").when((F.size(rules) == 0) & (items < 3), "insufficient_evidence").otherwise("consistent")
    return F.struct(
        rules.alias("rules"), actions.alias("actions"), contradictions.alias("contradictions"), items.alias("items"), status.alias("status"), (status != "consistent").alias("abstain")
    )


#: Fixed values. A contract: its id, words that trigger it, and what it needs, each known by its words.
CONTRACTS = {
    "nephrology": (
        "nephrology_hyperkalemia_ops_v1",
        ("oliguria", "anuria", "renal", "hiperkalemia", "k ", "k+"),
        {
            "ECG inmediato con cambios por hiperkalemia": ("ecg", "ondas t", "qrs", "bradiarritmia"),
            "Diuresis cuantificada (ml/kg/h)": ("diuresis", "ml/kg/h", "anuria", "oliguria"),
            "Tendencia de creatinina (basal vs actual)": ("creatinina", "basal", "fra", "deterioro renal"),
        },
    ),
    "gynecology_obstetrics": (
        "gyne_obstetric_hypertensive_ops_v1",
        ("gestante", "embarazo", "obstetric", "cefalea", "fosfenos", "preeclampsia", "eclampsia"),
        {
            "Doble toma de TA severa en ventana corta": ("ta", "hipertension", "160/110"),
            "Datos de dano de organo (plaquetas, creatinina, enzimas)": ("plaquetas", "creatinina", "transaminasas", "proteinuria"),
            "Estado materno-fetal monitorizado": ("monitorizacion", "fetal", "materno"),
        },
    ),
}


def contract(text: Column, specialty: Column, inconsistent: Column) -> Column:
    """Struct of the contract's ``id``, ``triggered``, what is ``missing``, its ``state`` and whether to ``fall_back``; null where no contract holds."""
    low = plain(text)
    grave = {
        "nephrology": F.coalesce(potassium(text) >= 6, F.lit(False)),
        "gynecology_obstetrics": F.coalesce((pressure(text, 1) >= 160) & (pressure(text, 2) >= 110), F.lit(False)),
    }
    out = F.lit(None)
    for domain, (name, triggers, needs) in CONTRACTS.items():
        triggered = _any(F.concat(low, F.lit(" ")) if any(t.endswith(" ") for t in triggers) else low, triggers) | grave[domain]
        missing = F.array_compact(F.array(*(F.when(~_any(low, words), F.lit(label)) for label, words in needs.items())))
        state = F.when(inconsistent, "blocked_contradiction").when((F.size(missing) > 0) & triggered, "needs_data").when(F.size(missing) > 0, "partial").otherwise("ready")
        own = F.struct(
            F.lit(name).alias("id"), triggered.alias("triggered"), missing.alias("missing"), state.alias("state"), state.isin("blocked_contradiction", "needs_data").alias("fall_back")
        )
        out = F.when(specialty == domain, own).otherwise(out)
    return out


#: Complaints that say little by themselves.
AMBIGUOUS = ("dolor", "fiebre", "mareo", "vomitos", "malestar", "cansancio", "debilidad", "hinchazon", "tos", "cefalea")


def ambiguity(text: Column, tokens: Column, intent: Column, keyword_hits: Column, social: Column, folded: Callable[[Column], Column] = plain) -> Column:
    """Struct of ``score`` and whether to ``ask``: a short query without numbers, known words or a plan, of vague complaints (in the ``folded`` text)."""
    n = F.size(tokens)
    short = F.greatest(F.lit(0.0), (8.0 - F.least(n, F.lit(8))) / 8.0)
    vague = F.least(F.lit(1.0), _hits(folded(text), AMBIGUOUS) / 2.0)
    score = 0.47 * short + F.when(F.rlike(text, F.lit(r"\d")), 0.0).otherwise(0.28) + F.when(keyword_hits <= 0, 0.20).otherwise(0.0) + 0.20 * vague
    score = score - F.when(intent.isin("management_plan", "follow_up_plan"), 0.18).otherwise(0.0)
    score = F.round(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 9), 4)
    return F.struct(score.alias("score"), ((score >= 0.62) & (n <= 16) & ~social).alias("ask"))


def clarification(domain: Column, intent: Column, bank: dict[str, dict[str, str]]) -> Column:
    """The question of the domain for the intent, else its default, else the general ones (``bank["general"]``)."""
    general = bank["general"]
    own = lambda questions: F.coalesce(*(F.when(intent == i, F.lit(q)) for i, q in questions.items() if i != "default"), F.lit(questions.get("default")))
    out = own(general)
    for name, questions in bank.items():
        if name != "general":
            out = F.when(domain == name, F.coalesce(own(questions), own(general))).otherwise(out)
    return out


def suggestions(tokens: Column, candidates: list[str], words_of, most: int = 3) -> Column:
    """The first candidates that don't say what the query says already (nine tenths of its words)."""
    fresh = [F.when(F.coalesce(F.size(F.array_intersect(tokens, words_of(F.lit(c)))) / F.nullif(F.size(tokens), F.lit(0)), F.lit(0.0)) < 0.9, F.lit(c)) for c in dict.fromkeys(candidates)]
    return F.slice(F.array_compact(F.array(*fresh)), 1, most)


def findings(signals: Column, risk: Column, allowed: Column, mode: Column, sources: Column, validated: Column, web: Column) -> Column:
    """Array of struct ``code, severity`` for a turn: injections, dangerous tools, missing sources, web sources; else all is well."""
    danger = risk.isin("high", "critical")
    one = lambda p, code, severity: F.when(p, F.struct(F.lit(code).alias("code"), severity.alias("severity")))
    found = F.array_compact(
        F.array(
            one(F.size(signals) > 0, "prompt_injection_signal", F.when(danger, "critical").otherwise("warn")),
            one(danger & ~allowed, "dangerous_tool_blocked", F.lit("info")),
            one(danger & allowed, "dangerous_tool_allowed", F.when(risk == "high", "warn").otherwise("info")),
            one((mode == "clinical") & validated & (sources == 0), "missing_validated_internal_sources", F.lit("critical")),
            one(web, "web_sources_used", F.lit("info")),
        )
    )
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.struct(F.lit("security_baseline_ok").alias("code"), F.lit("info").alias("severity"))))


def compact(payload: Column, most: int = 600) -> Column:
    """A map of texts with keys of 80 and values of 180 characters at most, as JSON; if that is too long, its beginning."""
    cut = F.map_from_entries(F.transform(F.map_entries(payload), lambda e: F.struct(F.left(e["key"], F.lit(80)), F.left(e["value"], F.lit(180)))))
    raw = F.to_json(cut)
    return F.when(F.length(raw) <= most, raw).otherwise(F.to_json(F.struct(F.left(raw, F.lit(most)).alias("summary"))))


def prompt(parts: list[tuple[str, Column]], budget: int) -> Column:
    """The parts under their headings, in order, as far as the budget of characters reaches."""
    text = F.concat_ws("\n\n", *(F.when(F.length(c) > 0, F.concat(F.lit(f"### {h}\n"), c)) for h, c in parts))
    return F.rtrim(F.left(text, F.lit(budget)))


#: Words after which an answer can't end.
OPEN_ENDS = ("a", "de", "del", "la", "el", "y", "o", "que", "con", "por", "para", "en", "cuando", "como", "unos", "unas", "un", "una")


def looks_truncated(answer: Column) -> Column:
    """A text of ten words or more that ends, without a mark, in a word that goes on."""
    text = F.trim(F.coalesce(answer, F.lit("")))
    words = F.split(F.lower(text), r"\s+")
    ended = F.rlike(text, F.lit(r"""[.!?…:;)\]}"']$"""))
    return (F.length(text) >= 40) & ~ended & (F.size(words) >= 10) & F.regexp_replace(F.element_at(words, -1), "^[,.;:!?]+|[,.;:!?]+$", "").isin(*OPEN_ENDS)


def looks_like_echo(answer: Column) -> Column:
    """An answer that repeats the prompt."""
    low = F.lower(F.trim(F.coalesce(answer, F.lit(""))))
    begins = F.rlike(low, F.lit("^(### consulta|consulta:|evidencia:)"))
    return begins | (F.contains(low, F.lit("### consulta")) & F.contains(low, F.lit("### evidencia")))


def continued(base: Column, more: Column, most: int = 12) -> Column:
    """An answer and its continuation as one; words that end the first and begin the second stand once."""
    a, b = F.trim(F.coalesce(base, F.lit(""))), F.trim(F.coalesce(more, F.lit("")))
    x, y = F.split(a, r"\s+"), F.split(b, r"\s+")
    fits = lambda n: (F.size(x) >= n) & (F.size(y) >= n) & (F.slice(x, F.greatest(F.size(x) - (n - 1), F.lit(1)), n) == F.slice(y, 1, n))
    shared = F.coalesce(*(F.when(fits(n), F.lit(n)) for n in range(most, 0, -1)), F.lit(0))
    joined = F.array_join(F.concat(x, F.slice(y, shared + 1, F.greatest(F.size(y), F.lit(1)))), " ")
    return F.when(a == "", b).when((b == "") | F.contains(a, b), a).when(F.contains(b, a), b).when(shared > 0, joined).otherwise(F.concat_ws(" ", a, b))


def placeholder_question(questions: Column) -> Column:
    """No questions, or only the one that stands for none."""
    bare = F.filter(F.transform(questions, lambda q: F.trim(F.regexp_replace(fold(F.trim(q)), r"[^a-z0-9\s]", ""))), lambda q: q != "")
    return F.coalesce((F.size(bare) == 0) | ((F.size(bare) == 1) & bare[0].isin("que dice este fragmento", "qu dice este fragmento")), F.lit(True))


def relevance(rows: DataFrame, qid: str, doc: str, text: Column, graded: DataFrame, expected: DataFrame, terms: DataFrame) -> DataFrame:
    """``rows`` with ``gain`` and ``total``: by graded judgements where a query has any, else expected documents, else expected terms.

    ``graded (qid, doc, grade)``, ``expected (qid, doc)``, ``terms (qid, terms array)``. The total of relevant ones is that of the judgements, or of what
    was observed, at least 1, where there are only terms.
    """
    g = graded.groupBy(qid).agg(F.count_if(F.col("grade") > 0).alias("__g"))
    e = expected.groupBy(qid).agg(F.count("*").alias("__e"))
    out = rows.join(g, qid, "left").join(e, qid, "left").join(terms.withColumnRenamed("terms", "__t"), qid, "left")
    out = out.join(graded.select(qid, doc, F.col("grade").alias("__grade")), [qid, doc], "left")
    out = out.join(expected.select(qid, doc).distinct().withColumn("__hit", F.lit(1.0)), [qid, doc], "left")
    low = F.lower(text)
    named = F.coalesce(F.exists("__t", lambda w: F.contains(low, F.lower(w))).cast("double"), F.lit(0.0))
    gain = F.when(F.col("__g").isNotNull(), F.coalesce(F.col("__grade").cast("double"), F.lit(0.0))).when(F.col("__e").isNotNull(), F.coalesce("__hit", F.lit(0.0))).otherwise(named)
    out = out.withColumn("gain", gain)
    seen = F.greatest(F.lit(1), F.count_if(F.col("gain") > 0).over(Window.partitionBy(qid)))
    return out.withColumn("total", F.coalesce("__g", "__e", seen)).drop("__g", "__e", "__t", "__grade", "__hit")


def regression_summary(rows: DataFrame) -> DataFrame:
    """Averages and rates over the rows without an error: ``error, token_f1, domain_hit, must_include_ok, forbidden_hit, latency_ms``."""
    ok = F.col("error").isNull() | (F.col("error") == "")
    share = lambda c: F.round(F.coalesce(F.avg(F.when(ok, F.coalesce(F.col(c), F.lit(False)).cast("int"))), F.lit(0.0)), 4)
    return rows.agg(
        F.count("*").alias("rows_total"),
        F.count_if(ok).alias("ok"),
        F.count_if(~ok).alias("errors"),
        F.round(F.coalesce(F.avg(F.when(ok, F.coalesce("token_f1", F.lit(0.0)))), F.lit(0.0)), 4).alias("token_f1_avg"),
        share("domain_hit").alias("domain_hit_rate"),
        share("must_include_ok").alias("must_include_rate"),
        F.when(F.count_if(ok) > 0, share("forbidden_hit")).otherwise(1.0).alias("forbidden_leak_rate"),
        F.coalesce(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY CASE WHEN error IS NULL OR error = '' THEN latency_ms END)"), F.lit(0)).cast("long").alias("latency_p95_ms"),
    )


def holds_all(text: Column, terms: Column) -> Column:
    """Whether a text, with single spaces, holds all terms."""
    low = F.lower(F.regexp_replace(F.trim(text), r"\s+", " "))
    return F.forall(terms, lambda w: F.contains(low, F.lower(F.trim(w))))


def holds_any(text: Column, terms: Column) -> Column:
    """Whether it holds one."""
    low = F.lower(F.regexp_replace(F.trim(text), r"\s+", " "))
    return F.exists(terms, lambda w: (F.trim(w) != "") & F.contains(low, F.lower(F.trim(w))))


def page_relevance(asked: Column, title: Column, snippet: Column, words_of) -> Column:
    """.65 of the query's words in the title, .35 in the snippet, and up to .12 for the snippet's length."""
    share = lambda c: F.coalesce(F.size(F.array_intersect(asked, words_of(c))) / F.nullif(F.size(asked), F.lit(0)), F.lit(0.0))
    score = 0.65 * share(title) + 0.35 * share(snippet) + 0.12 * F.least(F.lit(1.0), F.length(F.trim(snippet)) / 240.0)
    return F.when(F.size(asked) == 0, 0.0).otherwise(F.least(F.lit(1.0), score))


def web_candidates(pages: DataFrame, key: str, url: str, title: str, snippet: str, asked: Column, allowed: list[str], words_of, links: DataFrame | None = None, blend: float = 0.35, most: int = 1000) -> DataFrame:
    """``key, url, authority, relevance, quality, rank``: the ``most`` best candidate pages that may be shown, best first.

    Hosts outside ``allowed``, spam, repeated addresses and near copies of an earlier candidate go. Quality is .62 authority + .38 relevance,
    and where ``links (url, link)`` knows the page, .35 of its link score in place of as much of it.
    """
    from .relational import host_allowed

    host = F.lower(F.regexp_extract(url, "^[A-Za-z]+://([^/?#]*)", 1))
    rows = pages.select(key, G.bare_url(F.col(url)).alias("url"), host.alias("host"), F.col(title).alias("title"), F.col(snippet).alias("snippet"))
    rows = rows.where(host_allowed(F.col("host"), allowed) if allowed else F.lit(True)).where("url != ''")
    rows = rows.where(G.spam_score(F.col("title"), F.col("snippet"), F.col("url")) < 3)
    first = rows.groupBy("url").agg(F.min(key).alias(key))
    rows = G.checkpoint(rows.join(first, ["url", key], "left_semi"))
    kept = G.near_page_filter(rows, key, F.concat_ws(" ", "title", "snippet"), 16, 0.85).where("kept").select(key)
    rows = rows.join(kept, key, "left_semi")
    rows = rows.withColumn("authority", G.host_authority(F.col("host"))).withColumn("relevance", page_relevance(asked, F.col("title"), F.col("snippet"), words_of))
    quality = F.least(F.lit(1.0), 0.62 * F.col("authority") + 0.38 * F.col("relevance"))
    if links is not None:
        rows = rows.join(links.select("url", "link"), "url", "left")
        quality = F.when(F.col("link").isNotNull(), (1 - blend) * quality + blend * F.col("link")).otherwise(quality)
    scored = rows.select(key, "url", "title", *(F.round(c, 6).alias(n) for n, c in (("authority", F.col("authority")), ("relevance", F.col("relevance")), ("quality", quality))))
    best = scored.orderBy(F.desc("quality"), F.desc("title"), key).limit(most)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("quality"), F.desc("title"), key))).drop("title")


#: Fixed values. Alert rules over one row of gauges: name, severity, predicate, minutes that it must hold.
ALERTS = (
    ("AgentRunsFailedDetected", "warning", "agent_runs_failed > 0", 1),
    ("AgentFallbackRateHigh", "warning", "agent_fallback_rate > 10", 2),
    ("ScasestAuditUnderRateHigh", "warning", "scasest_under_rate > 10", 2),
    ("ScasestAuditOverRateHigh", "warning", "scasest_over_rate > 20", 2),
    ("CardioRiskAuditUnderRateHigh", "warning", "cardio_risk_under_rate > 10", 2),
    ("CardioRiskAuditOverRateHigh", "warning", "cardio_risk_over_rate > 20", 2),
    ("ResuscitationAuditUnderRateHigh", "warning", "resuscitation_under_rate > 10", 2),
    ("ResuscitationAuditOverRateHigh", "warning", "resuscitation_over_rate > 20", 2),
    ("CareTaskQualityUnderRateHigh", "warning", "quality_under_rate > 10", 2),
    ("CareTaskQualityOverRateHigh", "warning", "quality_over_rate > 20", 2),
    ("CareTaskQualityMatchRateLow", "warning", "quality_match_rate < 80 AND quality_total >= 10", 3),
)


class Hold:
    """A machine of ``plans.scan`` over rows ``holds``: the time (``__at``) since which a rule has held without a break, or none."""

    start: int | None = None

    def summarise(self, rows: pd.DataFrame) -> tuple[bool, int | None]:
        """Whether the rule broke, and since when it holds at the end, from this segment alone."""
        broken = np.flatnonzero(~rows["holds"].to_numpy(bool))
        first = int(broken[-1]) + 1 if len(broken) else 0
        return len(broken) > 0, int(rows["__at"].iloc[first]) if first < len(rows) else None

    def apply(self, summary: tuple[bool, int | None], state: int | None) -> int | None:
        broke, since = summary
        return since if broke or state is None else state

    def replay(self, rows: pd.DataFrame, state: int | None) -> dict[str, Any]:
        holds, at = rows["holds"].to_numpy(bool), rows["__at"].to_numpy(np.int64)
        place = np.arange(len(at))
        broken = np.maximum.accumulate(np.where(holds, -1, place))  # the last break up to each row
        since = at[np.minimum(broken + 1, len(at) - 1)]
        if state is not None:
            since = np.where(broken < 0, state, since)
        return {"held": np.where(holds, at - since, -1)}


def held_alerts(gauges: DataFrame, time: str, rules=ALERTS, rows_a_part: int = 1_000_000) -> DataFrame:
    """``time, alert, severity`` wherever a rule has held at all samples of ``gauges`` for its minutes.

    Samples stand at most a minute apart. The run of samples that a rule holds at begins after the last one at which it didn't. An
    alert's samples are split over tasks by time (``plans.scan``).
    """
    out = None
    for name, severity, predicate, minutes in rules:
        holds = F.coalesce(F.expr(predicate), F.lit(False))
        part = gauges.select(F.col(time), F.lit(name).alias("alert"), F.lit(severity).alias("severity"), F.lit(minutes).alias("minutes"), holds.alias("holds"))
        out = part if out is None else out.union(part)
    timed = out.where(F.col(time).isNotNull()).withColumn("__at", F.unix_seconds(F.col(time).cast("timestamp")))
    scanned = segmented_scan(timed, "alert", ["__at"], Hold(), "held long", rows_a_part)
    return scanned.where(F.col("holds") & (F.col("held") >= 60 * F.col("minutes"))).select(time, "alert", "severity")

"""Filters, joins, summaries and operational analytics over tables of runs, tasks and reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """100 * part / whole, 0 where there is nothing."""
    return F.when(whole > 0, F.round(100.0 * part / whole, digits)).otherwise(F.lit(0.0))


def page(rows: DataFrame, key: str, offset: int, limit: int) -> DataFrame:
    """a page of rows in the order of ``key``."""
    return rows.orderBy(key).offset(max(0, offset)).limit(max(0, limit))


def recent(rows: DataFrame, time: str, key: str, limit: int) -> DataFrame:
    """The latest rows, ties by higher key."""
    return rows.orderBy(F.desc(time), F.desc(key)).limit(limit)


def top_per_group(rows: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group by ``order``, which must end in a key."""
    nth = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return rows.withColumn(rank, nth).where(F.col(rank) <= k)


def matches_any(column: Column, words: list[str]) -> Column:
    """a case-insensitive LIKE for any word."""
    out = F.lit(False)
    for w in words:
        out = out | column.ilike(f"%{w}%")
    return out


def host_allowed(host: Column, domains: list[str]) -> Column:
    """the host is one of the domains or lies below one."""
    return F.exists(F.array(*map(F.lit, domains)), lambda d: (host == d) | host.endswith(F.concat(F.lit("."), d)))


def run_summary(runs: DataFrame, by: list[str], failed: Column, fallback: Column) -> DataFrame:
    """Totals, completed, failed and fallback rate, over all or by columns."""
    out = runs.groupBy(*by).agg(
        F.count("*").alias("total_runs"),
        F.count_if(~failed).alias("completed_runs"),
        F.count_if(failed).alias("failed_runs"),
        F.count_if(fallback).alias("fallback_steps"),
    )
    return out.withColumn("fallback_rate", percent(F.col("fallback_steps"), F.col("total_runs")))


def deviation(ai: Column, human: Column, inverted: bool = False) -> Column:
    """A4: match, under or over for ordinal levels; inverted where level 1 is the most urgent."""
    name = ("over", "under") if not inverted else ("under", "over")
    return F.when(ai == human, "match").when(ai > human, name[0]).when(ai < human, name[1])


def audit_summary(rows: DataFrame, by: list[str], kind: str = "classification") -> DataFrame:
    """A2: counts and rates of matches, under- and over-calls."""
    counts = [F.count_if(F.col(kind) == k).alias(k) for k in ("match", "under", "over")]
    out = rows.groupBy(*by).agg(F.count("*").alias("total"), *counts)
    return out.select(
        "*", *(percent(F.col(k), F.col("total")).alias(f"{k}_rate") for k in ("match", "under", "over"))
    )


def match_rate(ai: Column, human: Column) -> Column:
    """A3: percentage of equal flags, nulls counting as values."""
    return F.round(100.0 * F.avg(ai.eqNullSafe(human).cast("int")), 2)


#: The flags that each domain's reviews compare; a log has ai_<flag> and human_<flag> of each.
AUDITED = {
    "screening": ("hiv_screening_suggested", "sepsis_route_suggested", "persistent_covid_suspected", "long_acting_candidate"),
    "medicolegal": ("consent_required", "judicial_notification_required", "chain_of_custody_required"),
    "scasest": ("escalation_required", "immediate_antiischemic_strategy"),
    "cardio_risk": ("non_hdl_target_required", "pharmacologic_strategy_suggested", "intensive_lifestyle_required"),
    "resuscitation": ("shock_recommended", "reversible_causes_completed", "airway_plan_adequate"),
}


def domain_audit(rows: DataFrame, flags: tuple[str, ...], by: list[str], kind: str = "classification") -> DataFrame:
    """A3: a domain's counts and rates of matches, under- and over-calls, and the rate at which each flag agrees."""
    rates = [F.round(100.0 * F.avg(F.col(f"ai_{f}").eqNullSafe(F.col(f"human_{f}")).cast("int")), 2).alias(f"{f}_match_rate") for f in flags]
    whole = rows.groupBy(*by).agg(F.count("*").alias("total"), *(F.count_if(F.col(kind) == k).alias(k) for k in ("match", "under", "over")), *rates)
    return whole.select("*", percent(F.col("under"), F.col("total")).alias("under_rate"), percent(F.col("over"), F.col("total")).alias("over_rate"))


def quality_status(total: Column, under_rate: Column, over_rate: Column) -> Column:
    """No data, degraded (under above 10 or over above 20), attention (any deviation), stable."""
    return (
        F.when(total == 0, "sin_datos")
        .when((under_rate > 10) | (over_rate > 20), "degradado")
        .when((under_rate > 0) | (over_rate > 0), "atencion")
        .otherwise("estable")
    )


def scorecard(rows: DataFrame, domain: str = "domain") -> DataFrame:
    """A summary of each domain and of all, by one roll-up."""
    out = rows.rollup(domain).agg(
        F.count("*").alias("total"), *(F.count_if(F.col("classification") == k).alias(k) for k in ("match", "under", "over"))
    )
    out = out.select(
        F.coalesce(domain, F.lit("total")).alias("domain"),
        "total",
        *(percent(F.col(k), F.col("total")).alias(f"{k}_rate") for k in ("match", "under", "over")),
    )
    return out.withColumn("status", quality_status(F.col("total"), F.col("under_rate"), F.col("over_rate")))


def frequent_items(rows: DataFrame, by: list[str], item: str, first_seen: Column, k: int) -> DataFrame:
    """The k most frequent items, ties by when they were first seen."""
    counted = rows.groupBy(*by, item).agg(F.count("*").alias("n"), F.min(first_seen).alias("first_seen"))
    return top_per_group(counted, by, [F.desc("n"), F.asc("first_seen"), F.asc(item)], k)


def frequent_in_arrays(rows: DataFrame, by: list[str], items: str, order: str, k: int) -> DataFrame:
    """The k most frequent items of arrays, ties by where they were first seen: the row by ``order``, then the place."""
    long = rows.select(*by, order, F.posexplode(items).alias("__place", "item"))
    return frequent_items(long, by, "item", F.struct(order, "__place"), k)


def minutes_between(a: Column, b: Column) -> Column:
    """Minutes from a to b with two digits, null if either is missing."""
    micros = [F.unix_micros(c.cast("timestamp")) for c in (a, b)]
    return F.round((micros[1] - micros[0]) / 6e7, 2)


def stage_times(events: DataFrame, by: list[str], stage: str, time: str, stages: list[str]) -> DataFrame:
    """The first time of each stage, one column each."""
    return events.groupBy(*by).agg(*(F.min(F.when(F.col(stage) == s, F.col(time))).alias(s) for s in stages))


def transitions(events: DataFrame, by: list[str], stage: str, time: str, key: str, allowed: list[tuple[str, str]]) -> DataFrame:
    """How often a stage follows another, and whether that is allowed."""
    w = Window.partitionBy(*by).orderBy(time, key)
    moved = events.select(F.col(stage).alias("from_stage"), F.lead(stage).over(w).alias("to_stage")).where("to_stage is not null")
    counted = moved.groupBy("from_stage", "to_stage").agg(F.count("*").alias("n"))
    ok = F.lit(False)
    for a, b in allowed:
        ok = ok | ((F.col("from_stage") == a) & (F.col("to_stage") == b))
    return counted.withColumn("allowed", ok)


def alerts(gauges: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """The rules (name, severity, SQL predicate over the one row of ``gauges``) that fire."""
    found = F.array_compact(
        F.array(*(F.when(F.coalesce(F.expr(p), F.lit(False)), F.struct(F.lit(n).alias("alert"), F.lit(s).alias("severity"))) for n, s, p in rules))
    )
    return gauges.select(F.inline(found))


def alert_fatigue(rows: DataFrame, by: list[str], key: str, high: Column, order: str, keep: int) -> DataFrame:
    """T4: one alert of each key, high ones preferred; high first, at most ``keep``; the rest are counted as suppressed."""
    once = top_per_group(rows.withColumn("__low", (~high).cast("int")), [*by, key], [F.asc("__low"), F.asc(order)], 1, "__nth")
    w = Window.partitionBy(*by)
    ranked = once.withColumn("rank", F.row_number().over(w.orderBy("__low", order))).withColumn("kept_keys", F.count("*").over(w))
    total = rows.groupBy(*by).agg(F.count("*").alias("all_alerts"))
    shown = ranked.where(F.col("rank") <= keep).join(total, by)
    return shown.withColumn("suppressed", F.col("all_alerts") - F.least(F.col("kept_keys"), F.lit(keep))).drop("__low", "__nth")

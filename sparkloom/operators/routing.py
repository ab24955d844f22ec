"""Query routing, expansion and caching; discourse measures; triage and risk by ordered rules; number codes."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import relevance_list
from .relational import top_per_group

#: Words that mark a query as risky, as a procedure, or that join its parts.
RISK_WORDS = ("shock", "hiperkalemia", "qrs", "anuria", "oliguria", "neutropenia", "preeclampsia", "sepsis")
PROCEDURE_WORDS = ("pasos", "criterios", "bundle", "ruta", "algoritmo", "priorizar")
CONNECTORS = (" y ", " con ", " sin ", " o ")


def _any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def _words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def _count(text: Column, part: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def adaptive_k(text: Column, base: int, least: int, most: int) -> Column:
    """One less for short queries, one more for long ones; risky ones get no less than the base."""
    n = _words(text)
    k = F.when(n <= 5, max(least, base - 1)).when(n >= 18, min(most, base + 1)).otherwise(base)
    k = F.when(_any(F.lower(text), RISK_WORDS), F.greatest(k, F.lit(min(most, base)))).otherwise(k)
    return F.greatest(F.lit(least), F.least(k, F.lit(min(most, base + 1)), F.lit(most)))


def complexity(text: Column, long_query: int = 16) -> Column:
    """Complex with two signals or more of length, separators, connectors and procedure words."""
    low, n = F.lower(text), _words(text)
    separators = sum((_count(low, c) for c in ":;(),"), F.lit(0))
    connectors = sum((_count(low, c) for c in CONNECTORS), F.lit(0))
    one = lambda c: c.cast("int")
    signals = one(n >= long_query) + one(separators >= 2) + one(connectors >= 2) + one(_any(low, PROCEDURE_WORDS))
    return F.when(signals >= 2, "complex").when((n <= 6) & (separators == 0) & (connectors <= 1), "simple").otherwise("medium")


def expand(queries: DataFrame, qid: str, term: str, thesaurus: DataFrame, per_term: int = 4) -> DataFrame:
    """``qid, term``: a query's terms and up to ``per_term`` synonyms of each from ``thesaurus (term, synonym)``."""
    kept = top_per_group(thesaurus.where("synonym != term").distinct(), ["term"], [F.asc("synonym")], per_term, "__n").select("term", "synonym")
    more = queries.join(kept, queries[term] == kept["term"]).select(qid, F.col("synonym").alias(term))
    return queries.select(qid, term).union(more).distinct()


def cached_superset(asked: DataFrame, cached: DataFrame, qid: str, cid: str, tokens: str) -> DataFrame:
    """The smallest cached query whose tokens hold all of an asked query's, ties by id.

    Pairs are met through the asked query's rarest token, which any superset must have; the tokens themselves are read for these pairs alone.
    """
    long = cached.select(cid, F.explode(tokens).alias("__t"))
    often = long.groupBy("__t").agg(F.count("*").alias("__n"))
    rare = asked.select(qid, F.col(tokens).alias("__q"), F.explode(tokens).alias("__t")).join(often, "__t", "left")
    rare = top_per_group(rare.fillna({"__n": 0}), [qid], [F.asc("__n"), F.asc("__t")], 1, "__r").drop("__n", "__r")
    met = rare.join(long, "__t").join(cached.select(cid, F.col(tokens).alias("__c")), cid)
    hit = met.where(F.size(F.array_except("__q", "__c")) == 0)
    return top_per_group(hit.withColumn("size", F.size("__c")), [qid], [F.asc("size"), F.asc(cid)], 1, "__r").select(qid, cid, "size")


def intents(text: Column, markers: dict[str, tuple[str, ...]], expansion: dict[str, tuple[str, ...]]) -> Column:
    """Struct of the ``intents`` whose words the text holds and the distinct terms that ``expand`` them."""
    low = F.lower(text)
    found = F.array_compact(F.array(*(F.when(_any(low, words), F.lit(name)) for name, words in markers.items())))
    none = F.array().cast("array<string>")
    terms = F.concat(*(F.when(_any(low, words), F.array(*map(F.lit, expansion.get(name, ()))).cast("array<string>")).otherwise(none) for name, words in markers.items()))
    return F.struct(found.alias("intents"), F.array_distinct(terms).alias("expand"))


#: Words that a compacted query drops.
COMPACT_STOP = ("con", "sin", "para", "por", "del", "las", "los", "que", "como", "and", "the", "with", "from", "hasta", "entre", "sobre")
COMPACT_PLAIN = ("pasos", "criterios", "acciones", "inicial", "iniciales")


def compacted(text: Column, complexity_: Column, extra: Column, most: int = 8, least: int = 4) -> Column:
    """A complex query's first ``most`` words of four letters or more, with those of ``extra``; others, and too short ones, stay as they are."""
    words = F.concat(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9\-/+]+"), F.lit(0)), extra)
    kept = F.slice(F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 4) & ~w.isin(*COMPACT_STOP, *COMPACT_PLAIN))), 1, most)
    return F.when((complexity_ == "complex") & (F.size(kept) >= least), F.array_join(kept, " ")).otherwise(text)


#: Words that part a query's intents.
SEGMENT_END = r"(?i)[;\n]+|\s(?:ademas|además|junto\s+con|asociado\s+a|concomitante\s+con)\s+"
SOFT_END = r"(?i)\s(?:y|e|mas|más)\s+"


def segments(text: Column, least: int = 12, most: int = 4) -> Column:
    """H7: the parts of a query with several intents; one that has no hard parts is cut at plain connectors. Short parts go."""
    long = lambda parts: F.array_distinct(F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: F.length(p) >= least))
    hard = long(F.split(text, SEGMENT_END))
    soft = long(F.split(text, SOFT_END))
    return F.slice(F.when(F.size(hard) >= 2, hard).when(F.size(soft) >= 2, soft).otherwise(F.array(text)), 1, most)


def salient(rows: DataFrame, key: str, text: str, most: int = 6) -> DataFrame:
    """A text's most frequent words of four or more letters, longer first on ties."""
    long = rows.select(key, F.explode(relevance_list(F.col(text))).alias("word")).where(F.length("word") >= 4)
    counted = long.groupBy(key, "word").agg(F.count("*").alias("n")).withColumn("size", F.length("word"))
    return top_per_group(counted, [key], [F.desc("n"), F.desc("size"), F.asc("word")], most).select(key, "word", "n", "rank")


def pair_score(asked: Column, tokens: Column, retrieval: Column, evidence: Column) -> Column:
    """.34 recall + .16 precision + .18 retrieval + .12 shared pairs of words + .12 evidence, from 0 to 1."""

    def pairs(a: Column) -> Column:
        return F.array_distinct(F.transform(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), lambda x, i: F.concat_ws(" ", x, F.get(a, i + 1))))

    q, t = F.array_distinct(asked), F.array_distinct(tokens)
    both = F.size(F.array_intersect(q, t))
    share = lambda n, d: F.coalesce(n / F.nullif(d, F.lit(0)), F.lit(0.0))
    two = share(F.size(F.array_intersect(pairs(asked), pairs(tokens))), F.size(pairs(asked)))
    score = 0.34 * share(both, F.size(q)) + 0.16 * share(both, F.size(t)) + 0.18 * retrieval + 0.12 * two + 0.12 * evidence
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def boundaries(units: list[list[str]], window: int = 2) -> list[float]:
    """Cosine of the word counts before and after each boundary between units."""
    counts = [Counter(u) for u in units]
    sums = lambda part: sum(part, Counter())
    found = []
    for i in range(1, len(units)):
        left, right = sums(counts[max(0, i - window) : i]), sums(counts[i : i + window])
        norm = math.sqrt(sum(v * v for v in left.values()) * sum(v * v for v in right.values()))
        found.append(sum(v * right[w] for w, v in left.items()) / norm if norm else 0.0)
    return found


def continuity(units: list[list[str]], window: int = 2) -> float:
    """The mean over all boundaries; 0 for fewer than two units."""
    found = boundaries(units, window)
    return sum(found) / len(found) if found else 0.0


def topic_continuity(rows: DataFrame, key: str, units: str) -> DataFrame:
    """X9 for each row: ``key, continuity`` of an array of units, each an array of tokens."""
    kind = rows.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({key: f[key], "continuity": [round(continuity([list(u) for u in us]), 6) for us in f[units]]})

    return rows.select(key, units).mapInPandas(run, f"{key} {kind}, continuity double")


def smallest_window(tokens: Column, wanted: list[str]) -> Column:
    """Length of the shortest run of tokens that holds all wanted ones; null if one is missing.

    A shortest run ends at a wanted token and begins at the earliest of the last places of all wanted tokens up to there.
    """

    def places_of(word: str) -> Column:
        return F.filter(F.transform(tokens, lambda x, i: F.when(x == word, i)), lambda i: i.isNotNull())

    places = {w: places_of(w) for w in wanted}
    ends = F.array_sort(F.flatten(F.array(*places.values())))

    def length(end: Column) -> Column:
        last = [F.array_max(F.filter(p, lambda i: i <= end)) for p in places.values()]
        complete = last[0].isNotNull()
        for x in last[1:]:
            complete = complete & x.isNotNull()
        first = F.least(*last) if len(last) > 1 else last[0]
        return F.when(complete, end - first + 1)

    return F.array_min(F.transform(ends, length))


def latent_scores(counts: DataFrame, qid: str, doc: str, rank: int = 64, most_terms: int = 600) -> DataFrame:
    """``qid, doc, score``: cosine of query and document in the pool's latent space, not below 0.

    ``counts (qid, doc, term, w)`` holds a pool of fixed size for each query, whose matrix one task decomposes; rows with a
    null document are the query's own terms.
    """
    types = {f.name: f.dataType.simpleString() for f in counts.schema}

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        q = frame[frame[doc].isna()]
        d = frame[frame[doc].notna()]
        total = d.groupby("term")["w"].sum().sort_values(ascending=False, kind="stable")
        terms = list(dict.fromkeys([*sorted(q["term"]), *total.index]))[:most_terms]
        place = {t: i for i, t in enumerate(terms)}
        ids = sorted(d[doc].unique())
        x = np.zeros((len(ids), len(terms)))
        row = {k: i for i, k in enumerate(ids)}
        for k, t, w in zip(d[doc], d["term"], d["w"]):
            if t in place:
                x[row[k], place[t]] = w
        v = np.zeros(len(terms))
        for t, w in zip(q["term"], q["w"]):
            if t in place:
                v[place[t]] = w
        u, s, vt = np.linalg.svd(x, full_matrices=False)
        k = min(rank, int((s > 1e-9).sum()))
        docs, asked = u[:, :k] * s[:k], (vt[:k] @ v) / s[:k]
        norm = np.linalg.norm(docs, axis=1) * np.linalg.norm(asked)
        score = np.where(norm > 0, docs @ asked / np.where(norm > 0, norm, 1), 0.0).clip(0)
        return pd.DataFrame({qid: frame[qid].iloc[0], doc: np.array(ids).astype("int64"), "score": score})

    return counts.groupBy(qid).applyInPandas(solve, f"{qid} {types[qid]}, {doc} {types[doc]}, score double")


#: Categories with their words, in the order in which they are tried, and how sure a hit is.
TRIAGE = (
    ("bug", 0.8, ("bug", "error", "fix", "exception", "crash", "incident")),
    ("docs", 0.76, ("docs", "readme", "document", "guide", "tutorial")),
    ("ops", 0.78, ("deploy", "docker", "infra", "monitor", "prometheus", "grafana")),
    ("analysis", 0.74, ("analyze", "investigate", "research", "spike", "poc")),
    ("dev", 0.72, ("api", "feature", "endpoint")),
)
URGENT = ("urgent", "asap", "critical", "blocker", "production")


def triage(rows: DataFrame, text: Column) -> DataFrame:
    """Adds ``category, priority, confidence``; confidence below .65 falls back to the general category."""
    low = F.lower(text)
    category, sure = F.lit("general"), F.lit(0.55)
    for name, confidence, words in reversed(TRIAGE):
        category = F.when(_any(low, words), name).otherwise(category)
        sure = F.when(_any(low, words), confidence).otherwise(sure)
    urgent, grave = _any(low, URGENT), category.isin("bug", "ops")
    priority = F.when(urgent | grave, "high").when(category.isin("docs", "analysis"), "low").otherwise("medium")
    confidence = F.when(urgent, F.greatest(sure, F.lit(0.85))).when(grave, F.greatest(sure, F.lit(0.8))).otherwise(sure)
    return rows.select("*", category.alias("category"), priority.alias("priority"), confidence.alias("confidence"))


def layered_policy(layers: Column, tool: Column) -> Column:
    """Whether a tool is allowed by the last of the layers (struct allow, deny: arrays) that names it; denied by default."""
    return F.aggregate(
        layers,
        F.lit(False),
        lambda ok, l: F.when(F.array_contains(l["deny"], tool), False).when(F.array_contains(l["allow"], tool), True).otherwise(ok),
    )


def tool_risk(group: Column, clinical: Column, web: Column, injected: Column) -> Column:
    """Y2: low without a group, else medium; high for actions in a clinical answer or for network with web sources; critical with an injection."""
    grouped = group.isNotNull()
    high = ((group == "clinical_actions") & clinical) | ((group == "external_network") & web)
    return F.when(grouped & injected, "critical").when(high, "high").when(grouped, "medium").otherwise("low")


PRIMES = (2, 3, 5, 7, 11, 13, 17, 19, 23, 29)


def godel(sequence: list[int], most: int = 12, digits: int = 120) -> str | None:
    """The product of the primes to the power of each value plus one; null for no values or too long a number."""
    if not sequence:
        return None
    code = math.prod(p ** (min(most, max(0, v)) + 1) for p, v in zip(PRIMES, sequence))
    return str(code) if len(str(code)) <= digits else None


def from_godel(code: str) -> list[int]:
    """The values that a code stands for."""
    n, out = int(code) if code.isdigit() else 0, []
    for p in PRIMES:
        power = 0
        while n and n % p == 0:
            n //= p
            power += 1
        if not power:
            break
        out.append(power - 1)
    return out


def compared(now: DataFrame, before: DataFrame, by: list[str], value: str) -> DataFrame:
    """Averages by group beside a baseline, and their difference."""
    a = now.groupBy(*by).agg(F.avg(value).alias("now"))
    b = before.groupBy(*by).agg(F.avg(value).alias("before"))
    both = a.join(b, by, "left")
    return both.select(*by, F.round("now", 6).alias("now"), F.round("before", 6).alias("before"), F.round(F.col("now") - F.col("before"), 6).alias("delta"))


def fuzzy_match(words: DataFrame, lexicon: DataFrame, word: str, term: str) -> DataFrame:
    """Word and term of seven or more letters with equal first four, at an edit distance up to 2: 3 points equal, 2 at one, 1 at two."""
    a = words.select(word).distinct().where(F.length(word) >= 7).withColumn("head", F.left(word, F.lit(4)))
    b = lexicon.select(term).distinct().where(F.length(term) >= 7).withColumn("head", F.left(term, F.lit(4)))
    near = a.join(b, "head").withColumn("d", F.levenshtein(F.col(word), F.col(term), 2)).where("d >= 0")
    return near.select(word, term, (3 - F.col("d")).alias("points"))


def latest_status(events: DataFrame, key: str, time: str, order: str, status: Column) -> DataFrame:
    """The status that the latest event of each key gives it."""
    return events.groupBy(key).agg(F.max_by(status, F.struct(time, order)).alias("status"))


def relaxed(strict: DataFrame, loose: DataFrame) -> DataFrame:
    """The strict result, or the loose one where the strict is empty, decided inside the plan."""
    none = strict.limit(1).agg((F.count("*") == 0).alias("__none"))
    return strict.unionByName(loose.crossJoin(F.broadcast(none)).where("__none").drop("__none"))


def boosted_merge(rows: DataFrame, qid: str, doc: str, part: str, score: str) -> DataFrame:
    """H7: of a document found by several parts of a query, the highest score with a bonus of .1 for each earlier part, .08 at most."""
    bonus = F.least(F.lit(0.08), 0.1 * F.col(part))
    return rows.groupBy(qid, doc).agg(F.round(F.max(F.col(score) + bonus), 5).alias("score"), F.count("*").alias("parts"))


def domain_search(
    chunks: DataFrame, doc: str, text: Column, keywords: Column, questions: Column, specialty: Column, terms: list[str], specialties: list[str], k: int, pool: int | None = None
) -> DataFrame:
    """H4: ``doc, score, rank``: rows that hold one of up to twelve terms, best first.

    A row scores one for each term it holds, 1.4 for each keyword among the terms, 1.1 for each question that holds one of the
    first eight terms, and 1.6 for a wanted specialty; rows of wanted specialties are searched alone if there are any.
    ``pool`` keeps the first rows by id, as a row limit without order would.
    """
    terms = list(dict.fromkeys(t.lower() for t in terms))[:12]
    low = F.lower(text)
    rows = chunks.select(doc, low.alias("__t"), keywords.alias("__k"), questions.alias("__q"), F.lower(specialty).alias("__s"))
    rows = rows.where(_any(F.col("__t"), tuple(terms)))
    wanted = rows.where(F.col("__s").isin(specialties)) if specialties else rows.limit(0)
    rows = relaxed(wanted, rows)
    if pool is not None:
        rows = rows.orderBy(doc).limit(pool)
    hits = sum((F.contains(F.col("__t"), F.lit(t)).cast("int") for t in terms), F.lit(0))
    asked = F.size(F.filter("__q", lambda q: _any(F.lower(q), tuple(terms[:8]))))
    known = F.size(F.filter("__k", lambda w: F.lower(w).isin(terms)))
    score = hits + 1.4 * known + 1.1 * asked + F.when(F.col("__s").isin(specialties), 1.6).otherwise(0.0)
    scored = rows.select(doc, F.round(score, 6).alias("score")).where("score > 0")
    best = scored.orderBy(F.desc("score"), doc).limit(k)

    # the k best rows alone are numbered
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), doc)))


def merged_sources(lists: list[DataFrame], key: str, order: str, most: int) -> DataFrame:
    """Several lists of sources as one: each key once, from the first list that has it, at most ``most``."""
    numbered = None
    for i, rows in enumerate(lists):
        part = rows.withColumn("__list", F.lit(i))
        numbered = part if numbered is None else numbered.unionByName(part)
    once = top_per_group(numbered, [key], [F.asc("__list"), F.asc(order)], 1, "__n")
    return once.orderBy("__list", order).limit(most).drop("__list", "__n")


def domain_filter(rows: DataFrame, qid: str, domains: Column, wanted: Column) -> DataFrame:
    """Rows with a wanted domain; queries none of whose rows has one keep all."""

    hit = F.size(F.array_intersect(domains, wanted)) > 0
    some = F.max(F.col("__hit").cast("int")).over(Window.partitionBy(qid))
    return rows.withColumn("__hit", hit).withColumn("__some", some).where("__hit or __some = 0").drop("__hit", "__some")

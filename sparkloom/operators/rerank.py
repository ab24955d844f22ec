"""Re-ranking, evidence, context compression, dialogue memory and answer checks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import overlap_f1
from .relational import top_per_group
from .set_join import best_match


def mmr(rows: DataFrame, qid: str, doc: str, vec: str, asked: str, lexical: str, k: int, lam: float = 0.70) -> DataFrame:
    """``qid, doc, rank``: the next pick is the row with the best .70 relevance - .30 similarity to those picked.

    Relevance is .7 cosine + .3 min-max lexical score. A query's candidates, a bounded pool, are ranked in one task.
    """

    def pick(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(doc).reset_index(drop=True)
        x = np.stack(frame[vec].to_list()).astype(float)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        q = np.array(frame[asked].iloc[0], float)
        q /= max(np.linalg.norm(q), 1e-12)
        lex = frame[lexical].to_numpy(float)
        lex = (lex - lex.min()) / (lex.max() - lex.min()) if lex.max() > lex.min() else np.zeros(len(lex))
        rel = 0.7 * (x @ q) + 0.3 * lex
        chosen: list[int] = []
        worst = np.full(len(x), -np.inf)
        while len(chosen) < min(k, len(x)):
            score = rel if not chosen else lam * rel - (1 - lam) * worst
            score = np.where(np.isin(np.arange(len(x)), chosen), -np.inf, score)
            chosen.append(int(np.argmax(score)))
            worst = np.maximum(worst, x @ x[chosen[-1]])
        return pd.DataFrame({qid: frame[qid].iloc[0], doc: frame[doc].iloc[chosen], "rank": range(1, len(chosen) + 1)})

    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.groupBy(qid).applyInPandas(pick, f"{qid} {types[qid]}, {doc} {types[doc]}, rank int")


def compress(rows: DataFrame, qid: str, doc: str, nth: str, score: str, text: str, per_doc: int = 2, overall: int = 8, least: float = 0.20, longest: int = 280) -> DataFrame:
    """``qid, doc, context``: each document's best sentences, of these the query's best, in their order again."""
    good = rows.where(F.col(score) >= least)
    top = top_per_group(good, [qid, doc], [F.desc(score), F.asc(nth)], per_doc, "__d")
    top = top_per_group(top, [qid], [F.desc(score), F.asc(doc), F.asc(nth)], overall, "__q")
    parts = F.transform(F.array_sort(F.collect_list(F.struct(nth, text))), lambda s: s[text])
    return top.groupBy(qid, doc).agg(F.left(F.array_join(parts, " "), F.lit(longest)).alias("context"))


def faithfulness(answer: Column, contexts: list[Column]) -> Column:
    """Share of the answer's tokens that the contexts hold together; 0 for an empty answer."""
    union = F.array_distinct(F.concat(*contexts))
    return F.coalesce(F.size(F.array_intersect(answer, union)) / F.nullif(F.size(answer), F.lit(0)), F.lit(0.0))


def gate_tokens(text: Column, longer_than: int) -> Column:
    """Distinct white-space words without brackets and stops at their ends, longer than so many characters."""
    words = F.transform(F.split(F.lower(F.trim(F.coalesce(text, F.lit("")))), r"\s+"), lambda w: F.regexp_replace(w, r"^[.,;:()\[\]{}]+|[.,;:()\[\]{}]+$", ""))
    return F.array_distinct(F.filter(words, lambda w: F.length(w) > longer_than))


#: Answers that say nothing.
GENERIC_ANSWERS = ("no tengo informacion suficiente", "necesito mas contexto", "es dificil decir", "depende de muchos factores")


def gatekeeper(rows: DataFrame, key: str, query: str, answer: str, passages: str, least_context: float = 0.15, least_faith: float = 0.20) -> DataFrame:
    """``key, context_relevance, faithfulness, issues, valid`` for rows with an array of passages.

    Context relevance is the share of the query's words that the best of six passages holds, faithfulness the share of the answer's
    that five passages hold together. An answer that is short or general, not supported or beside the question is not valid; one that
    cites no passage (no long word of the first two) only gets a note.
    """
    q, a = gate_tokens(F.col(query), 3), gate_tokens(F.col(answer), 4)
    share = lambda part, whole: F.coalesce(F.size(F.array_intersect(part, whole)) / F.nullif(F.size(part), F.lit(0)), F.lit(0.0))
    best = F.array_max(F.transform(F.slice(passages, 1, 6), lambda p: share(q, gate_tokens(p, 3))))
    held = F.flatten(F.transform(F.slice(passages, 1, 5), lambda p: gate_tokens(p, 4)))
    low = F.lower(F.coalesce(F.col(answer), F.lit("")))
    long = lambda p: F.slice(F.filter(F.split(F.lower(p), r"\s+"), lambda w: F.length(w) > 6), 1, 6)
    cited = F.exists(F.flatten(F.transform(F.slice(passages, 1, 2), long)), lambda w: F.contains(low, w))
    general = F.lit(False)
    for phrase in GENERIC_ANSWERS:
        general = general | F.contains(low, F.lit(phrase))
    scored = rows.select(
        key, F.round(F.coalesce(best, F.lit(0.0)), 6).alias("context_relevance"), F.round(share(a, held), 6).alias("faithfulness"), (F.size(passages) > 0).alias("some"),
        ((F.length(F.trim(low)) < 80) | general).alias("general"), cited.alias("cited"), (F.size(F.array_intersect(q, gate_tokens(F.col(answer), 3))) > 0).alias("on"),
    )
    issues = F.array_compact(
        F.array(
            F.when(F.col("general"), "risk:generic"),
            F.when(F.col("some") & ~F.col("cited"), "note:no_citation"),
            F.when(F.col("some") & (F.col("context_relevance") < least_context), "note:context"),
            F.when(F.col("some") & (F.col("faithfulness") < least_faith), "risk:unsupported"),
            F.when(~F.col("on"), "risk:beside_the_question"),
        )
    )
    judged = scored.withColumn("issues", issues)
    return judged.select(key, "context_relevance", "faithfulness", "issues", (~F.exists("issues", lambda i: F.startswith(i, F.lit("risk")))).alias("valid"))


def answer_quality(question: Column, answer: Column, context: Column) -> dict[str, Column]:
    """Relevance, context relevance and groundedness of an answer, and its status."""
    relevance, grounded = overlap_f1(question, answer), faithfulness(answer, [context])
    status = F.when((relevance >= 0.3) & (grounded >= 0.5), "ok").when((relevance >= 0.1) | (grounded >= 0.3), "attention").otherwise("degraded")
    return {"relevance": relevance, "context_relevance": overlap_f1(question, context), "groundedness": grounded, "status": status}


def history(turns: DataFrame, conv: str, turn: str, tokens: str, focus: Column, k: int = 2, back: int = 6) -> DataFrame:
    """Of the turns before, up to ``back``, the k with the best .58 overlap + .32 exp(-.45 distance) + .10 focus."""
    w = Window.partitionBy(conv).orderBy(turn).rowsBetween(-back, -1)
    past = F.collect_list(F.struct(F.col(turn).alias("t"), F.col(tokens).alias("tokens"), focus.cast("int").alias("focus"))).over(w)
    long = turns.withColumn("__past", past).select(conv, turn, tokens, F.explode("__past").alias("p"))
    share = F.coalesce(F.size(F.array_intersect(tokens, "p.tokens")) / F.nullif(F.size(tokens), F.lit(0)), F.lit(0.0))
    score = 0.58 * share + 0.32 * F.exp(-0.45 * (F.col(turn) - F.col("p.t"))) + 0.10 * F.col("p.focus")
    scored = long.select(conv, turn, F.col("p.t").alias("past"), F.round(score, 6).alias("score"))
    return top_per_group(scored, [conv, turn], [F.desc("score"), F.desc("past")], k)


def question_shortcut(asked: DataFrame, bank: DataFrame, keys: list[str], tokens: str, item: str) -> DataFrame:
    """H8: ``keys, score``: .75 recall + .15 precision of the best banked question that shares two tokens or more, else 0.

    Nearly every question shares two common tokens with some banked one, so that no key tells them apart: each is counted against all.
    """
    return best_match(asked, bank, keys, tokens)


def carry_entity(turns: DataFrame, conv: str, turn: str, entity: Column, back: int = 4) -> DataFrame:
    """Each turn's entity, or the nearest of the turns before."""
    w = Window.partitionBy(conv).orderBy(turn).rowsBetween(-back, 0)
    return turns.withColumn("__e", entity).withColumn("entity", F.last("__e", ignorenulls=True).over(w)).drop("__e")

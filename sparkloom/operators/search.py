"""Inverted index, vocabulary, and pool-local ranking of chunks for many queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ir_tokens, jaccard, kgrams, soundex_strict
from ..plans.cut import checkpoint, small
from .relational import top_per_group

#: Default weights of the zones and of the score's parts (fixed values).
ZONES = {"title": 0.28, "section": 0.24, "body": 0.28, "keywords": 0.12, "questions": 0.08}
K1, B = 1.5, 0.75
MU, LAMBDA = 1200.0, 0.2


def postings(texts: DataFrame, doc: str, tokens: Column) -> DataFrame:
    """``term, doc, places``: the places of each term of each document, from 0."""
    long = texts.select(doc, F.posexplode(tokens).alias("place", "term"))
    return long.groupBy("term", doc).agg(F.array_sort(F.collect_list("place")).alias("places"))


def vocabulary(index: DataFrame, doc: str) -> DataFrame:
    """``term, df``."""
    return index.groupBy("term").agg(F.count_distinct(doc).alias("df"))


def wildcard(vocab: DataFrame, pattern: str, first: int = 16, least: float = 0.18) -> DataFrame:
    """Terms that fit a pattern with *, the ``first`` by df, of which those whose 3-grams are near enough."""
    like = pattern.replace("%", r"\%").replace("_", r"\_").replace("*", "%")
    found = vocab.where(F.col("term").like(like)).orderBy(F.desc("df"), "term").limit(first)
    bare = F.lit(pattern.replace("*", ""))
    return found.withColumn("similarity", jaccard(kgrams(F.col("term")), kgrams(bare))).where(F.col("similarity") >= least)


def spelling(vocab: DataFrame, words: DataFrame, word: str, pool: int = 128, least: float = 0.18) -> DataFrame:
    """For each word of five or more letters the nearest term: same first letter, length within 2, distance up to 2.

    Of the ``pool`` most frequent candidates, the least distance wins, then the highest df.
    """
    w, t = F.col(word), F.col("term")
    # of each first letter and length, no more than the pool (and the word itself) can be among the candidates
    heads = vocab.withColumn("head", F.left("term", F.lit(1))).withColumn("size", F.length("term"))
    heads = top_per_group(heads, ["head", "size"], [F.desc("df"), F.asc("term")], pool + 1, "nth").drop("nth")
    asked = words.select(word).distinct().where(F.length(w) >= 5).withColumn("head", F.left(w, F.lit(1)))
    asked = asked.withColumn("size", F.explode(F.sequence(F.length(w) - 2, F.length(w) + 2)))
    near = asked.join(heads, ["head", "size"]).where(t != w)
    near = top_per_group(near, [word], [F.desc("df"), F.asc("term")], pool, "nth")
    near = near.withColumn("distance", F.levenshtein(w, t, 2)).where("distance >= 0")
    near = near.where(jaccard(kgrams(w), kgrams(t)) >= least)
    return top_per_group(near, [word], [F.asc("distance"), F.desc("df"), F.asc("term")], 1, "nth").select(word, "term", "distance", "df")


def sound_index(vocab: DataFrame) -> DataFrame:
    """``vocab`` with each term's first letter, length and Soundex code, the keys that candidates are found by."""
    return vocab.select("term", "df", F.left("term", F.lit(1)).alias("head"), F.length("term").alias("size"), soundex_strict(F.col("term")).alias("sound"))


def corrections(
    asked: DataFrame, vocab: DataFrame, index: DataFrame, doc: str, rare: int = 4, pool: int = 128, near_pool: int = 10, least: float = 0.18, most: int = 2
) -> DataFrame:
    """``word, left, right, term, tier, distance, context, df`` for the words that are corrected.

    ``asked`` holds words with their neighbours, ``left`` and ``right``, null where there is none. A word of five letters or more that
    ``rare`` documents or fewer hold is tried. Candidates begin with its letter, have a length within ``most`` of its own (three at least), and are
    the ``pool`` most frequent such terms, or the ``near_pool`` where the word has a neighbour; those whose 3-grams are too unlike go. Of those
    within ``most`` edits the least distance wins, then the number of documents in which the neighbours stand beside the candidate, then df.
    Where there is none, one with the same Soundex code does, by neighbours and df. A correction is adopted only if documents of ``index`` hold it.
    """
    words = asked.select("word", "left", "right").distinct().where((F.length("word") >= 5) & ~F.contains("word", F.lit(" ")))
    keyed = sound_index(vocab)
    held = words.join(keyed.select(F.col("term").alias("word"), F.col("df").alias("own")), "word", "left").where(F.coalesce("own", F.lit(0)) <= rare).drop("own")
    held = checkpoint(held)
    # of each first letter and length, no more than the pool can be among the candidates
    heads = top_per_group(keyed, ["head", "size"], [F.desc("df"), F.asc("term")], pool, "nth").drop("nth")
    length = F.length("word")
    sizes = F.sequence(F.greatest(F.lit(3), length - most), length + most)
    own = held.select("word").distinct().select("word", F.left("word", F.lit(1)).alias("head"), F.explode(sizes).alias("size"))
    near = own.join(heads, ["head", "size"]).drop("head", "size")
    near = top_per_group(near, ["word"], [F.desc("df"), F.asc("term")], pool, "nth").where(F.col("term") != F.col("word"))
    near = near.where(jaccard(kgrams(F.col("word")), kgrams(F.col("term"))) >= least)
    distance = F.levenshtein("word", "term", most)
    near = near.withColumn("distance", F.when(distance >= 0, distance)).withColumn("alike", F.coalesce(soundex_strict(F.col("word")) == F.col("sound"), F.lit(False)) & (F.col("sound") != ""))
    near = near.where(F.col("distance").isNotNull() | F.col("alike"))
    beside = F.col("left").isNotNull() | F.col("right").isNotNull()
    met = checkpoint(held.join(near, "word").where(~beside | (F.col("nth") <= near_pool)))
    pairs = met.select(F.col("left").alias("a"), F.col("term").alias("b")).union(met.select(F.col("term").alias("a"), F.col("right").alias("b"))).dropna()
    counted = checkpoint(bigram_counts(index, pairs, doc))
    before, after = counted.select(F.col("a").alias("left"), F.col("b").alias("term"), F.col("n").alias("n_left")), counted.select(F.col("a").alias("term"), F.col("b").alias("right"), F.col("n").alias("n_right"))
    scored = met.join(before, ["left", "term"], "left").join(after, ["term", "right"], "left")
    scored = scored.withColumn("context", F.coalesce("n_left", F.lit(0)) + F.coalesce("n_right", F.lit(0)))
    scored = scored.withColumn("tier", F.when(F.col("distance").isNotNull(), "edit").otherwise("sound")).withColumn("__l", F.coalesce("left", F.lit(""))).withColumn("__r", F.coalesce("right", F.lit("")))
    order = [F.asc("tier"), F.asc("distance"), F.desc("context"), F.desc("df"), F.asc("term")]
    best = top_per_group(scored, ["word", "__l", "__r"], order, 1, "first")
    adopted = best.join(index.select("term").distinct(), "term", "left_semi")
    return adopted.select("word", "left", "right", "term", "tier", "distance", "context", "df")


def bigram_counts(index: DataFrame, pairs: DataFrame, doc: str) -> DataFrame:
    """``a, b, n``: in how many documents the words of each pair ``(a, b)`` stand side by side in this order."""
    places = index.select("term", doc, F.explode("places").alias("place"))
    first = places.join(pairs.withColumnRenamed("a", "term").distinct(), "term").select(F.col("term").alias("a"), "b", doc, (F.col("place") + 1).alias("place"))
    met = first.join(places.withColumnRenamed("term", "b"), ["b", doc, "place"]).groupBy("a", "b").agg(F.count_distinct(doc).alias("n"))
    return pairs.distinct().join(met, ["a", "b"], "left").fillna({"n": 0})


def text_bigram_counts(texts: DataFrame, pairs: DataFrame, doc: str, tokens: Column) -> DataFrame:
    """B12 without an index: as ``bigram_counts``, of ``texts``, whose neighbouring tokens meet the pairs where they are read; only what meets is shuffled."""
    asked = small(checkpoint(pairs.dropna().distinct()))
    words = texts.select(doc, tokens.alias("__w"))
    beside = F.arrays_zip(F.col("__w").alias("a"), F.slice("__w", F.lit(2), F.greatest(F.size("__w") - 1, F.lit(0))).alias("b"))
    met = words.select(doc, F.explode(beside).alias("__p")).select(doc, "__p.a", "__p.b").join(asked, ["a", "b"])
    return pairs.distinct().join(met.groupBy("a", "b").agg(F.count_distinct(doc).alias("n")), ["a", "b"], "left").fillna({"n": 0})


def relaxed_union(strict: DataFrame, index: DataFrame, words: list[str], doc: str, explicit: bool, most: int = 16) -> DataFrame:
    """The strict result; where it is empty and the query has no operators of its own, documents with any of its first words."""
    if explicit:
        return strict
    loose = index.where(F.col("term").isin(list(dict.fromkeys(words))[:most])).select(doc).distinct()
    none = strict.limit(1).agg((F.count("*") == 0).alias("none"))
    return strict.union(loose.crossJoin(F.broadcast(none)).where("none").select(doc))


def zone_counts(chunks: DataFrame, doc: str, zones: dict[str, Column]) -> DataFrame:
    """``doc, zone, term, tf``."""
    long = None
    for name, text in zones.items():
        part = chunks.select(doc, F.lit(name).alias("zone"), F.explode(ir_tokens(F.coalesce(text, F.lit("")))).alias("term"))
        long = part if long is None else long.union(part)
    return long.groupBy(doc, "zone", "term").agg(F.count("*").alias("tf"))


def query_terms(queries: DataFrame, qid: str, text: Column, cap: int = 24) -> DataFrame:
    """``qid, term, qtf``: the most frequent terms, ties by first place."""
    long = queries.select(qid, F.posexplode(ir_tokens(text)).alias("place", "term"))
    counted = long.groupBy(qid, "term").agg(F.count("*").alias("qtf"), F.min("place").alias("place"))
    return top_per_group(counted, [qid], [F.desc("qtf"), F.asc("place")], cap, "nth").select(qid, "term", "qtf", "place")


def candidate_pool(terms: DataFrame, counts: DataFrame, qid: str, doc: str, pool: int) -> DataFrame:
    """Documents with any term of the query, the first ``pool`` of them by id.

    Only a term's first ``pool`` documents can be among them. Spark limits them before it shuffles, so that a term that most
    documents hold sends no more than that from each task.
    """
    asked = small(checkpoint(terms.select("term").distinct()))
    held = counts.join(asked, "term", "left_semi").select("term", doc).distinct()
    held = top_per_group(held, ["term"], [F.asc(doc)], pool, "nth").select("term", doc)
    hits = terms.select(qid, "term").join(held, "term").select(qid, doc).distinct()
    return top_per_group(hits, [qid], [F.asc(doc)], pool, "nth").select(qid, doc)


def prune_terms(terms: DataFrame, qid: str, idf: str = "idf", threshold: float = 1.15, least: int = 4) -> DataFrame:
    """Terms of idf ``threshold`` or more; where fewer than ``least`` are left, the ``least`` highest."""
    w = Window.partitionBy(qid)
    ranked = terms.withColumn("nth", F.row_number().over(w.orderBy(F.desc(idf), "place")))
    ranked = ranked.withColumn("strong", F.count_if(F.col(idf) >= threshold).over(w)).withColumn("all", F.count("*").over(w))
    few = F.col("strong") < F.least(F.col("all"), F.lit(least))
    return ranked.where(F.when(few, F.col("nth") <= least).otherwise(F.col(idf) >= threshold)).drop("nth", "strong", "all")


def min_max(value: Column, w) -> Column:
    """Scaled to 0..1 within a window; a constant gives 0."""
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return F.when(hi > lo, (value - lo) / (hi - lo)).otherwise(F.lit(0.0))


def ranked_min_max(value: Column, rank: Column, w) -> Column:
    """Scaled to 0..1 within a ranked list; a constant gives 1 - (rank - 1) / n."""
    lo, hi, n = F.min(value).over(w), F.max(value).over(w), F.count("*").over(w)
    return F.when(hi > lo, (value - lo) / (hi - lo)).otherwise(1.0 - (rank - 1) / n)


def features(queries: DataFrame, counts: DataFrame, qid: str, doc: str, text: Column, pool: int) -> DataFrame:
    """``qid, doc`` with cosine, zone, combined, bm25, bim, qlm (Dirichlet), qlm_jm, active and present over the query's pool.

    ``counts`` is a stored index as ``zone_counts`` makes it. All statistics (N, df, lengths, collection shares) are those of
    the pool, not of the corpus. Pools have a fixed size, so what is read of the index after the pool grows with the
    number of queries alone. ``active`` holds the query's terms that count, ``present`` how many of them the body holds.
    """
    terms = checkpoint(query_terms(queries, qid, text))
    pooled = checkpoint(candidate_pool(terms, counts, qid, doc, pool))
    counts = checkpoint(counts.join(small(pooled.select(doc).distinct()), doc, "left_semi"))
    lengths = counts.groupBy(doc).agg(F.greatest(F.lit(1), F.sum(F.when(F.col("zone") == "body", F.col("tf")).otherwise(0))).alias("len"))
    size = pooled.groupBy(qid).agg(F.count("*").alias("N"))
    mean = pooled.join(lengths, doc).groupBy(qid).agg(F.avg("len").alias("avg_len"))
    weight = F.create_map(*[x for z, v in ZONES.items() for x in (F.lit(z), F.lit(v))])[F.col("zone")]
    hit = terms.join(counts, "term").join(pooled, [qid, doc], "left_semi")
    hit = hit.groupBy(qid, "term", "qtf", "place", doc).agg(
        F.sum(weight * (1 + F.ln("tf"))).alias("sub"),
        F.sum(weight * F.col("tf")).alias("wtf"),
        F.sum(weight).alias("present"),
        F.bool_or(F.col("zone") == "body").alias("in_body"),
    )
    df = hit.groupBy(qid, "term").agg(F.count("*").alias("df"), F.sum("wtf").alias("ctf"))
    stats = terms.join(df, [qid, "term"], "left").join(size, qid).fillna({"df": 0, "ctf": 0.0})
    stats = stats.withColumn("idf", F.ln((F.col("N") + 1) / (F.col("df") + 1)) + 1)
    active = prune_terms(stats, qid)
    w = Window.partitionBy(qid)
    active = active.withColumn("qw", (1 + F.ln("qtf")) * F.col("idf"))
    active = active.withColumn("qnorm", F.sqrt(F.sum(F.col("qw") * F.col("qw")).over(w))).withColumn("n_terms", F.count("*").over(w))
    active = active.withColumn("active", F.array_sort(F.collect_list("term").over(w)))
    active = active.withColumn("cprob", F.greatest(F.lit(1e-12), F.col("ctf") / F.nullif(F.sum("ctf").over(w), F.lit(0.0))))
    rows = active.drop("qtf", "place").join(hit, [qid, "term"]).join(lengths, doc).join(mean, qid)
    n, d = F.col("N"), F.col("df")
    dw = F.col("sub") * F.col("idf")
    ratio = F.greatest(F.lit(1.0), F.col("len") / F.greatest(F.lit(1.0), F.col("avg_len")))
    bm25 = F.ln((n - d + 0.5) / (d + 0.5) + 1) * (F.col("wtf") * (K1 + 1)) / (F.col("wtf") + K1 * ((1 - B) + B * ratio))
    bim = F.ln(F.greatest(F.lit(1e-9), n - d + 0.5) / F.greatest(F.lit(1e-9), d + 0.5))
    dirichlet = (F.col("wtf") + MU * F.col("cprob")) / (F.col("len") + MU)
    jm = (1 - LAMBDA) * F.col("wtf") / F.col("len") + LAMBDA * F.col("cprob")
    out = rows.groupBy(qid, doc).agg(
        F.sum(F.col("qw") * dw).alias("dot"),
        F.sum(dw * dw).alias("sq"),
        F.first("qnorm").alias("qnorm"),
        (F.sum("present") / F.first("n_terms")).alias("zone"),
        F.sum(bm25).alias("bm25"),
        F.sum(bim).alias("bim"),
        F.sum(F.col("qtf") * F.ln(F.greatest(F.lit(1e-12), dirichlet))).alias("qlm"),
        F.sum(F.col("qtf") * F.ln(F.greatest(F.lit(1e-12), jm))).alias("qlm_jm"),
        F.first(F.col("len") / F.greatest(F.lit(1.0), F.col("avg_len"))).alias("rel_len"),
        F.first("active").alias("active"),
        F.count_if("in_body").alias("in_body"),
    )
    cosine = F.col("dot") / (F.sqrt("sq") * F.col("qnorm"))
    pivot = F.greatest(F.lit(0.2), 0.8 + 0.2 * F.col("rel_len"))
    return out.select(
        qid, doc, cosine.alias("cosine"), "zone", ((0.8 * cosine + 0.2 * F.col("zone")) / pivot).alias("combined"), "bm25", "bim", "qlm", "qlm_jm", "active", F.col("in_body").alias("present")
    )


#: What a source's headings add to its static quality.
SECTION_MARKERS = ("algoritmo", "validacion", "riesgos", "pasos")


def static_quality(title: Column, source: Column, section: Column, specialty: Column) -> Column:
    """How good a source is by its headings and place, from 0 to 1."""
    low = [F.lower(F.coalesce(c, F.lit(""))) for c in (title, source, section)]
    has = lambda c, w: F.contains(c, F.lit(w))
    marked = has(low[2], SECTION_MARKERS[0])
    for word in SECTION_MARKERS[1:]:
        marked = marked | has(low[2], word)
    parts = [
        (has(low[0], "motor operativo"), 0.45),
        (F.startswith(low[1], F.lit("docs/")), 0.20),
        (has(low[1], "pdf_raw"), 0.08),
        (marked, 0.10),
        (F.trim(F.coalesce(specialty, F.lit(""))) != "", 0.07),
        (has(low[2], "recomendacion") | has(low[2], "recommendation"), 0.10),
    ]
    return F.least(F.lit(1.0), sum((F.when(p, v).otherwise(0.0) for p, v in parts), F.lit(0.0)))


def proximity(scored: DataFrame, texts: DataFrame, qid: str, doc: str, tokens: Column, most: int = 24) -> DataFrame:
    """``scored (qid, doc, active, present)`` with ``span`` and ``proximity``: terms by span, at most 1.

    The span is the length of the shortest run of the document's tokens that holds all active terms, of which there must be two; it is
    sought only in documents that hold them all. A query has ``most`` terms at most. A shortest run ends at a place of a term and begins at the earliest of all
    terms' last places up to there.
    """
    whole = scored.where((F.size("active") >= 2) & (F.col("present") == F.size("active"))).select(qid, doc, "active")
    body = texts.join(small(checkpoint(whole.select(doc).distinct())), doc, "left_semi").select(doc, F.posexplode(tokens).alias("place", "term"))
    own = whole.select(qid, doc, F.posexplode("active").alias("k", "term"), F.size("active").alias("n"))
    at = own.join(body, [doc, "term"]).select(qid, doc, "k", "place", "n")
    # going through the places in order, the last one of each of the query's terms
    before = Window.partitionBy(qid, doc).orderBy("place")
    newest = F.array(*(F.last(F.when(F.col("k") == i, F.col("place")), ignorenulls=True).over(before) for i in range(most)))
    ends = at.withColumn("newest", newest).withColumn("newest", F.slice("newest", 1, F.col("n")))
    ends = ends.where(~F.exists("newest", lambda x: x.isNull()))
    best = ends.groupBy(qid, doc).agg(F.min(F.col("place") - F.array_min("newest") + 1).alias("span"))
    joined = scored.join(best, [qid, doc], "left")
    return joined.withColumn("proximity", F.when(F.col("span").isNull(), 0.0).otherwise(F.least(F.lit(1.0), F.size("active") / F.col("span"))))


def blend(scored: DataFrame, qid: str, quality: Column, proximity: Column) -> DataFrame:
    """Convex blends with bm25 (.65) and qlm (.30), then bim (.10), quality (.12) and proximity (.10) bonuses."""
    w = Window.partitionBy(qid)
    score = 0.35 * F.col("combined") + 0.65 * min_max(F.col("bm25"), w)
    score = 0.70 * score + 0.30 * min_max(F.col("qlm"), w)
    score = score + 0.10 * min_max(F.col("bim"), w) + 0.12 * quality + 0.10 * proximity
    return scored.withColumn("score", score).where("score > 0")

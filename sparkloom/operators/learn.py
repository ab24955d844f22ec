"""Classification and clustering over sparse term vectors, dense vectors and row features."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold
from ..plans.cut import checkpoint, small, tidy
from .relational import top_per_group
from .vector import dot


def term_counts(docs: DataFrame, doc: str, label: str | None, tokens: Column) -> DataFrame:
    """``doc, [label,] term, tf``."""
    keys = [doc, *([label] if label else [])]
    return docs.select(*keys, F.explode(tokens).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("tf"))


def class_priors(classes: DataFrame, label: str, specialty: str = "", domains: tuple[str, ...] = (), size: str | None = None) -> DataFrame:
    """``label, prior``: even (or the classes' shares of ``size``), more for the query's specialty (.35) and its domains (.20 each)."""
    even = F.lit(1.0) if size is None else F.col(size) / F.sum(size).over(Window.partitionBy(F.lit(1))) * F.count("*").over(Window.partitionBy(F.lit(1)))
    low = F.lower(F.trim(F.col(label).cast("string")))
    raw = even + F.when(low == specialty.strip().lower(), 0.35).otherwise(0.0)
    raw = raw + sum((F.when(low == d.strip().lower(), 0.20).otherwise(0.0) for d in domains), F.lit(0.0))
    boosted = classes.select(label, raw.alias("__w"))
    return boosted.crossJoin(F.broadcast(boosted.agg(F.sum("__w").alias("__all")))).select(label, (F.col("__w") / F.col("__all")).alias("prior"))


def multinomial_bayes(train: DataFrame, asked: DataFrame, doc: str, label: str, priors: DataFrame | None = None, alpha: float = 1.0) -> DataFrame:
    """``doc, label, score``: log prior plus log likelihood of the terms that training knows.

    ``train (label, term, tf)`` and ``asked (doc, term, tf)`` are counts, ``priors (label, prior)`` even by default. A term
    that a class lacks has the class's floor, so the join meets only terms a class has; the table of classes is broadcast
    after its size is checked, as is the model where it is small.
    """
    cell = checkpoint(train.groupBy(label, "term").agg(F.sum("tf").alias("n")))
    size = cell.groupBy(label).agg(F.sum("n").alias("total"))
    vocab = cell.agg(F.count_distinct("term").alias("V"))
    priors = class_priors(size, label) if priors is None else priors
    classes = size.join(priors, label).crossJoin(F.broadcast(vocab)).select(
        label, F.ln("prior").alias("prior"), F.ln(alpha / (F.col("total") + alpha * F.col("V"))).alias("floor"), "total", "V"
    )
    classes = small(checkpoint(classes))
    known = asked.join(cell.select("term").distinct(), "term", "left_semi")
    length = known.groupBy(doc).agg(F.sum("tf").alias("len"))
    logp = cell.join(classes, label).select(
        label, "term", (F.ln((F.col("n") + alpha) / (F.col("total") + alpha * F.col("V"))) - F.col("floor")).alias("gain")
    )
    gained = known.join(logp, "term").groupBy(doc, label).agg(F.sum(F.col("tf") * F.col("gain")).alias("gain"))
    grid = length.crossJoin(classes.select(label, "prior", "floor"))
    scored = grid.join(gained, [doc, label], "left")
    return scored.select(doc, label, (F.col("prior") + F.col("len") * F.col("floor") + F.coalesce("gain", F.lit(0.0))).alias("score"))


def bernoulli_bayes(train: DataFrame, asked: DataFrame, doc: str, label: str, priors: DataFrame | None = None, alpha: float = 1.0) -> DataFrame:
    """``doc, label, score`` with presence of terms alone, each class being one document, as a catalogue's classes are.

    A class starts from the score of a text without any term; each known term that a text holds changes it by the same
    amount for all classes that hold the term and by another for those that don't.
    """
    cell = checkpoint(train.select(label, "term").distinct())
    vocab = cell.agg(F.count_distinct("term").alias("V"))
    size = cell.groupBy(label).agg(F.count("*").alias("total"))
    priors = class_priors(size, label) if priors is None else priors
    here, away = (1 + alpha) / (1 + 2 * alpha), alpha / (1 + 2 * alpha)
    gain = {True: math.log(here) - math.log(1 - here), False: math.log(away) - math.log(1 - away)}
    bare = F.ln("prior") + F.col("total") * math.log(1 - here) + (F.col("V") - F.col("total")) * math.log(1 - away)
    classes = small(checkpoint(size.join(priors, label).crossJoin(F.broadcast(vocab)).select(label, bare.alias("bare"))))
    known = asked.select(doc, "term").distinct().join(cell.select("term").distinct(), "term", "left_semi")
    many = known.groupBy(doc).agg(F.count("*").alias("m"))
    own = known.join(cell, "term").groupBy(doc, label).agg(F.count("*").alias("h"))
    rows = many.crossJoin(classes).join(own, [doc, label], "left").fillna({"h": 0})
    return rows.select(doc, label, (F.col("bare") + F.col("h") * gain[True] + (F.col("m") - F.col("h")) * gain[False]).alias("score"))


def softmax(score: Column, w) -> Column:
    """Over a window."""
    e = F.exp(score - F.max(score).over(w))
    return e / F.sum(e).over(w)


def entropy(p: Column) -> Column:
    """Of probabilities in a group, to be summed."""
    return F.when(p > 0, -p * F.ln(p)).otherwise(0.0)


def certainty(scored: DataFrame, doc: str, label: str, score: str = "score") -> DataFrame:
    """``doc, top, probability, margin, entropy`` (0 to 1) of each row's softmax over its classes."""
    w = Window.partitionBy(doc)
    p = scored.select(doc, label, softmax(F.col(score), w).alias("p"))
    p = p.withColumn("n", F.row_number().over(w.orderBy(F.desc("p"), label)))
    both = p.groupBy(doc).agg(
        F.max(F.when(F.col("n") == 1, F.col(label))).alias("top"),
        F.max("p").alias("probability"),
        F.coalesce(F.max(F.when(F.col("n") == 2, F.col("p"))), F.lit(0.0)).alias("second"),
        (F.sum(entropy(F.col("p"))) / F.greatest(F.lit(1e-12), F.ln(F.greatest(F.lit(2), F.count("*"))))).alias("entropy"),
    )
    return both.select(doc, "top", "probability", (F.col("probability") - F.col("second")).alias("margin"), "entropy")


def uncertainty(probability: Column, margin: Column, entropy_: Column) -> Column:
    """C11: high, medium or low by the top class's probability, its lead and the normalised entropy."""
    high = (probability < 0.42) | (margin < 0.10) | (entropy_ > 0.80)
    return F.when(high, "high").when((probability < 0.56) | (margin < 0.18) | (entropy_ > 0.62), "medium").otherwise("low")


def prototype_posterior(rows: DataFrame, key: str, text: Column, prototypes: dict[str, tuple[str, ...]]) -> DataFrame:
    """C11: each text's likeness to classes given by features: ``key, top, probability, margin, entropy, coverage, ood, ood_level, uncertainty, abstain, priority``.

    A class's likelihood is .75 cosine of the text's features with all of the class's + .25 of 1 / (1 + their distance); priors are
    even. How far a text is out of all classes is 1 - .6 coverage - .4 probability of the best.
    """
    parts = []
    for name, features in prototypes.items():
        m, n = sum((F.contains(F.col("__x"), F.lit(f)).cast("int") for f in features), F.lit(0)), len(features)
        like = 0.75 * F.sqrt(m / n) + 0.25 / (1.0 + F.sqrt(F.lit(float(n)) - m))
        parts.append(F.struct(F.lit(name).alias("label"), F.greatest(F.lit(0.01), F.least(F.lit(0.99), like)).alias("like"), (m / n).alias("coverage")))
    long = rows.select(key, fold(text).alias("__x")).select(key, F.inline(F.array(*parts)))
    cover = long.select(key, F.col("label").alias("top"), "coverage")
    sure = certainty(long.withColumn("score", F.ln("like")), key, "label").join(cover, [key, "top"])
    ood = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - 0.6 * F.col("coverage") - 0.4 * F.col("probability")))
    sure = sure.withColumn("ood", ood).withColumn("uncertainty", uncertainty(F.col("probability"), F.col("margin"), F.col("entropy")))
    level = F.when(F.col("ood") >= 0.70, "high").when(F.col("ood") >= 0.45, "medium").otherwise("low")
    priority = F.when(F.col("probability") >= 0.75, "high").when(F.col("probability") >= 0.45, "medium").otherwise("low")
    return sure.select("*", level.alias("ood_level"), (F.col("uncertainty") == "high").alias("abstain"), priority.alias("priority"))


def cascade(first: Column, others: list[Column], most: int = 3) -> Column:
    """A list of classes re-ranked by several judges in turn: each judge's class is put in front, each class stays once, ``most`` in all."""
    out = first
    for judge in others:
        out = F.when(judge.isNull(), out).otherwise(F.array_distinct(F.concat(F.array(judge), out)))
    return F.slice(out, 1, most)


def question_gain(candidates: DataFrame, likelihoods: DataFrame, alpha: float = 0.5, beta: float = 0.35, gamma: float = 0.15) -> DataFrame:
    """C14: ``feature, gain, ig, div, con, rank``: how much an answer about each feature would tell between ``candidates (id, cluster, p)``.

    ``likelihoods (id, feature, p)`` are clipped to .05 .. .95, .5 where unknown. The gain is .5 of the expected fall of entropy
    (in bits) + .35 of 1, or .2 where yes and no point to the same cluster, + .15 of Simpson's diversity. Both tables are
    catalogues, checked to be small.
    """
    total = candidates.agg(F.sum("p").alias("__all"))
    own = candidates.crossJoin(F.broadcast(total)).select("id", "cluster", (F.col("p") / F.col("__all")).alias("prior"))
    grid = likelihoods.select("feature").distinct().crossJoin(small(checkpoint(own)))
    grid = grid.join(likelihoods.withColumnRenamed("p", "l"), ["id", "feature"], "left")
    clip = lambda c: F.greatest(F.lit(0.05), F.least(F.lit(0.95), c))
    l = F.coalesce("l", F.lit(0.5))  # noqa: E741
    grid = grid.withColumn("yes", F.col("prior") * clip(l)).withColumn("no", F.col("prior") * clip(1 - l))
    w = Window.partitionBy("feature")
    grid = grid.withColumn("yes", F.col("yes") / F.sum("yes").over(w)).withColumn("no", F.col("no") / F.sum("no").over(w))
    bits = lambda c: F.sum(F.when(F.col(c) > 0, -F.col(c) * F.log2(c)).otherwise(0.0))
    leader = lambda c: F.max_by("cluster", F.struct(F.round(c, 12), F.col("prior"), F.col("id")))
    both = grid.groupBy("feature").agg(
        bits("prior").alias("h"), bits("yes").alias("hy"), bits("no").alias("hn"), leader("yes").alias("cy"), leader("no").alias("cn"),
        (1 - F.sum(F.col("prior") * F.col("prior"))).alias("con"),
    )
    both = both.withColumn("ig", F.greatest(F.lit(0.0), F.col("h") - 0.5 * F.col("hy") - 0.5 * F.col("hn"))).withColumn("div", F.when(F.col("cy") == F.col("cn"), 0.2).otherwise(1.0))
    both = both.select("feature", F.round(alpha * F.col("ig") + beta * F.col("div") + gamma * F.col("con"), 4).alias("gain"), *(F.round(c, 4).alias(c) for c in ("ig", "div", "con")))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("gain"), "feature")))


def term_selection(docs: DataFrame, doc: str, label: str, tokens: Column, k: int = 256) -> DataFrame:
    """``term, chi2, mi``: the k terms with the highest chi-square over the classes, from one 2 x 2 table each."""
    has = docs.select(doc, label, F.explode(F.array_distinct(tokens)).alias("term"))
    cell = has.groupBy("term", label).agg(F.count("*").alias("a"))
    df = cell.groupBy("term").agg(F.sum("a").alias("df"))
    size = docs.groupBy(label).agg(F.count("*").alias("nc"))
    whole = size.agg(F.sum("nc").alias("n_docs"))
    t = cell.join(df, "term").join(small(size), label).crossJoin(F.broadcast(whole))
    n, a = F.col("n_docs").cast("double"), F.col("a").cast("double")
    b, c = F.col("df") - a, F.col("nc") - a
    d = n - a - b - c
    chi = n * (a * d - b * c) * (a * d - b * c) / F.nullif((a + b) * (c + d) * (a + c) * (b + d), F.lit(0.0))
    part = lambda x, r, s: F.when(x > 0, x / n * F.ln(x * n / (r * s))).otherwise(0.0)
    mi = part(a, a + b, a + c) + part(b, a + b, b + d) + part(c, c + d, a + c) + part(d, c + d, b + d)
    best = t.groupBy("term").agg(F.max(F.coalesce(chi, F.lit(0.0))).alias("chi2"), F.max(mi).alias("mi"))
    return best.select("term", F.round("chi2", 5).alias("chi2"), F.round("mi", 6).alias("mi")).orderBy(F.desc("chi2"), "term").limit(k)


def tfidf(counts: DataFrame, doc: str, n_docs: DataFrame) -> DataFrame:
    """C4: ``doc, term, w``: (1 + ln tf)(ln((1 + N) / (1 + df)) + 1), of unit length.

    Terms' frequencies are sent to all tasks where they are few enough; if ``counts`` lie by document, then nothing else is shuffled.
    """
    df = small(checkpoint(counts.groupBy("term").agg(F.count("*").alias("df"))))
    raw = counts.join(df, "term").crossJoin(F.broadcast(n_docs))
    raw = raw.withColumn("w", (1 + F.ln("tf")) * (F.ln((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1))
    norm = raw.groupBy(doc).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, doc).select(doc, "term", (F.col("w") / F.col("norm")).alias("w"))


def rocchio(vectors: DataFrame, labels: DataFrame, doc: str, label: str) -> DataFrame:
    """``doc, label, score``: cosine with each class's mean vector.

    Means are written once, by class and term; where they are few enough they are sent to all tasks, so that vectors are not shuffled by term.
    """
    lab = vectors.join(labels, doc)
    size = labels.groupBy(label).agg(F.count("*").alias("n"))
    mean = lab.groupBy(label, "term").agg(F.sum("w").alias("s")).join(small(size), label).select(label, "term", (F.col("s") / F.col("n")).alias("c"))
    mean = checkpoint(mean)
    tidy(vectors.sparkSession)
    norm = mean.groupBy(label).agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("norm"))
    unit = small(checkpoint(mean.join(small(checkpoint(norm)), label).select(label, "term", (F.col("c") / F.col("norm")).alias("c"))))
    return vectors.join(unit, "term").groupBy(doc, label).agg(F.sum(F.col("w") * F.col("c")).alias("score"))


def ova_svm(vectors: DataFrame, label: str, vec: str, key: str, epochs: int = 12, reg: float = 0.05, c: float = 1.0, sample: int = 4000) -> DataFrame:
    """``label, weights, bias, support, hinge``: one-versus-all linear SVM by stochastic subgradients in the order of ``key``.

    Steps follow one another, so a class is trained in one task, on ``sample`` rows at most, chosen by a hash of their key. Before
    a step's margin is taken, weights shrink; the bias moves with the step and doesn't shrink. ``support`` counts rows at or inside the margin.
    """
    drawn = checkpoint(vectors.orderBy(F.xxhash64(key), key).limit(sample).select(key, F.col(label).cast("string").alias("truth"), vec))

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(key)
        x, y = np.stack(frame[vec].to_list()).astype(float), np.where(frame["truth"] == frame["label"], 1.0, -1.0)
        w, b = np.zeros(x.shape[1]), 0.0
        order = np.tile(np.arange(len(x)), epochs)
        for step, i in enumerate(order, 1):
            rate = 1.0 / (reg * step)
            w *= max(0.0, 1 - rate * reg)
            if y[i] * (w @ x[i] + b) < 1:
                w += rate * c * y[i] * x[i]
                b += rate * c * y[i]
        far = y * (x @ w + b)
        loss = float(np.maximum(0, 1 - far).mean())
        return pd.DataFrame({"label": [frame["label"].iloc[0]], "weights": [w.tolist()], "bias": [b], "support": [int((far <= 1 + 1e-9).sum())], "hinge": [loss]})

    classes = small(checkpoint(drawn.select(F.col("truth").alias("label")).distinct()))
    rows = drawn.crossJoin(classes)
    return rows.groupBy("label").applyInPandas(fit, "label string, weights array<double>, bias double, support int, hinge double")


def svm_scores(rows: DataFrame, key: str, vec: str, model: DataFrame, priors: DataFrame) -> DataFrame:
    """``key, label, score``: the margin without the bias, and a tenth of the class's prior."""
    classes = small(checkpoint(model.select("label", "weights").join(priors, "label")))
    return rows.crossJoin(classes).select(key, "label", (dot(F.col("weights"), F.col(vec)) + 0.10 * F.col("prior")).alias("score"))


def kmeans(vectors: DataFrame, key: str, vec: str, k: int, rounds: int = 20) -> DataFrame:
    """K1: ``key, cluster``: unit vectors, seeds at places i * n / k in the order of ``key``, centroids of unit length.

    The k centroids are all that goes to the driver in a round; an empty cluster keeps its centroid; the end is when no
    centroid moves, or after ``rounds``.
    """
    n = vectors.count()
    if n == 0:
        return vectors.select(key, F.lit(0).alias("cluster"))
    # the seeds' keys are order statistics, found without sorting all rows in one place
    shares = ",".join(f"{(i * n // k + 0.5) / n:.15f}D" for i in range(k))
    keys = vectors.select(F.expr(f"percentile_disc(array({shares})) within group (order by {key})")).first()[0] if k > 0 else []
    seeds = vectors.where(F.col(key).isin(list(keys))).groupBy(key).agg(F.first(vec)).orderBy(key).collect()
    centre = np.array([r[1] for r in seeds], float)
    centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-12)

    def assigned(c: np.ndarray) -> DataFrame:
        table = F.array(*(F.array(*map(F.lit, row.tolist())) for row in c))
        sims = F.transform(table, lambda row: dot(row, F.col(vec)))
        return vectors.select(key, vec, (F.array_position(sims, F.array_max(sims)) - 1).cast("int").alias("cluster"))

    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    for _ in range(rounds):
        dense = assigned(centre).select("cluster", array_to_vector(F.transform(vec, lambda x: x.cast("double"))).alias("v"))
        sums = dense.groupBy("cluster").agg(Summarizer.sum(F.col("v"))).collect()
        new = centre.copy()
        for r in sums:
            v = r[1].toArray()
            new[r[0]] = v / (np.linalg.norm(v) or 1)
        moved, centre = np.abs(new - centre).max(), new
        if moved < 1e-9:
            break
    return assigned(centre).select(key, "cluster")


def agglomerate(vectors: np.ndarray, k: int, linkage: str = "average") -> np.ndarray:
    """K4: clusters of unit vectors by merging the most similar pair until k are left; ties go to the lowest places."""
    n = len(vectors)
    sim = vectors @ vectors.T
    np.fill_diagonal(sim, -np.inf)
    alive, sums, size = list(range(n)), vectors.copy(), np.ones(n)
    owner = np.arange(n)
    while len(alive) > max(1, k):
        sub = sim[np.ix_(alive, alive)]
        i, j = sorted(alive[x] for x in np.unravel_index(int(np.argmax(sub)), sub.shape))
        owner[owner == j] = i
        if linkage == "single":
            merged = np.maximum(sim[i], sim[j])
        elif linkage == "complete":
            merged = np.minimum(sim[i], sim[j])
        else:
            sums[i] += sums[j]
            total = size[i] + size[j]
            merged = (sums[i] @ sums.T) / (total * size)
        size[i] += size[j]
        alive.remove(j)
        sim[i, :] = merged
        sim[:, i] = merged
        sim[i, i] = -np.inf
    return np.unique(owner, return_inverse=True)[1]


def buckshot(vectors: DataFrame, key: str, vec: str, k: int, most: int = 400) -> DataFrame:
    """K6: ``key, cluster``: a sample of about the square root of n rows is clustered, all rows go to the nearest cluster."""
    n = vectors.count()
    m = max(k, min(most, int(np.ceil(np.sqrt(n)))))
    rows = vectors.orderBy(F.xxhash64(key), key).limit(m).select(vec).collect()
    x = np.array([r[0] for r in rows], float)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    got = agglomerate(x, k)
    centres = np.stack([x[got == c].mean(0) for c in range(got.max() + 1)])
    centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    table = F.array(*(F.array(*map(F.lit, row.tolist())) for row in centres))
    sims = F.transform(table, lambda row: dot(row, F.col(vec)))
    return vectors.select(key, (F.array_position(sims, F.array_max(sims)) - 1).cast("int").alias("cluster"))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logistic_risk(rows: DataFrame, features: dict[str, tuple[float, float, float, float]], bias: float) -> DataFrame:
    """Adds ``risk, anomaly, is_anomalous``; features are name: (median, mean, deviation, weight), missing ones imputed."""
    z = {n: (F.coalesce(F.col(n), F.lit(med)) - mean) / dev for n, (med, mean, dev, _) in features.items()}
    total = sum((w * z[n] for n, (*_, w) in features.items()), F.lit(bias))
    odd = sum((F.abs(v) for v in z.values()), F.lit(0.0)) / len(z)
    return rows.select("*", sigmoid(total).alias("risk"), odd.alias("anomaly"), (odd >= 1.75).alias("is_anomalous"))


def bayes_update(prior: DataFrame, likelihood: DataFrame, key: str, hypothesis: str) -> DataFrame:
    """C11, C14: ``key, hypothesis, posterior``: prior times the product of clipped likelihoods, normalised for each key."""
    clipped = F.ln(F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("p"))))
    joint = likelihood.groupBy(key, hypothesis).agg(F.sum(clipped).alias("l")).join(small(prior), hypothesis)
    w = Window.partitionBy(key)
    return joint.select(key, hypothesis, softmax(F.col("l") + F.ln("prior"), w).alias("posterior"))


def fechner(x: Column) -> Column:
    """C17: ln(1 + x) / ln 11 for x from 0 to 10."""
    return F.log1p(F.greatest(F.lit(0.0), F.least(F.lit(10.0), x))) / F.ln(F.lit(11.0))


def epidemiology(exposed_cases: Column, exposed: Column, other_cases: Column, others: Column) -> dict[str, Column]:
    """C20: incidences, risk ratio, absolute risk reduction and number needed to treat; null where a denominator is 0."""
    a, b = exposed_cases / F.nullif(exposed, F.lit(0)), other_cases / F.nullif(others, F.lit(0))
    return {"incidence": a, "control_incidence": b, "risk_ratio": a / F.nullif(b, F.lit(0.0)), "arr": b - a, "nnt": 1 / F.nullif(F.abs(b - a), F.lit(0.0))}


def soft_clusters(vectors: DataFrame, key: str, vec: str, k: int, rounds: int = 8, sharp: float = 6.0) -> DataFrame:
    """K2: ``key, cluster, weight``: soft clusters with weights in proportion to exp(-6 d^2) of unit vectors, from k-means' seeds.

    A round sends k weighted sums to the driver and ends when centroids move by 1e-6 or less in square.
    """
    hard = kmeans(vectors, key, vec, k, rounds=0)
    dims = vectors.select(F.size(vec)).first()
    if dims is None:
        return hard.select(key, "cluster", F.lit(1.0).alias("weight"))
    unit = vectors.select(key, vec, F.sqrt(dot(F.col(vec), F.col(vec))).alias("__norm")).where("__norm > 0")
    unit = unit.select(key, F.transform(vec, lambda x: x.cast("double") / F.col("__norm")).alias("__u"))
    first = unit.join(hard, key).groupBy("cluster").agg(*(F.avg(F.col("__u")[i]).alias(f"m{i}") for i in range(dims[0]))).orderBy("cluster").collect()
    centre = np.array([r[1:] for r in first], float)

    def weighed(c: np.ndarray) -> DataFrame:
        table = F.array(*(F.array(*map(F.lit, row.tolist())) for row in c))
        far = F.transform(table, lambda row: F.aggregate(F.zip_with(row, "__u", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
        raw = unit.withColumn("__e", far).withColumn("__e", F.transform("__e", lambda d: F.exp(-sharp * (d - F.array_min("__e")))))
        total = F.aggregate("__e", F.lit(0.0), lambda s, x: s + x)
        return raw.select(key, "__u", F.posexplode(F.transform("__e", lambda e: e / total)).alias("cluster", "weight"))

    for _ in range(rounds):
        sums = weighed(centre).groupBy("cluster").agg(F.sum("weight"), *(F.sum(F.col("weight") * F.col("__u")[i]) for i in range(dims[0]))).collect()
        new = centre.copy()
        for r in sums:
            if r[1] > 0:
                new[r[0]] = np.array(r[2:], float) / r[1]
        moved, centre = float(((new - centre) ** 2).sum()), new
        if moved <= 1e-6:
            break
    return weighed(centre).select(key, "cluster", "weight")


def divide(vectors: np.ndarray, k: int) -> np.ndarray:
    """K5: clusters of unit vectors by splitting the one with the widest spread until there are k.

    Spread is one minus the mean similarity to the centroid. A cluster is split about its member farthest from the centroid and the
    member most similar to that one; each row goes to the more similar of the two, ties to the first.
    """
    owner = np.zeros(len(vectors), int)
    while len(owner) and owner.max() + 1 < k:
        spread = []
        for c in range(owner.max() + 1):
            x = vectors[owner == c]
            mean = x.mean(0)
            norm = np.linalg.norm(mean)
            spread.append(1 - float((x @ mean / norm).mean()) if norm and len(x) > 1 else -1.0)
        c = int(np.argmax(spread))
        if spread[c] <= 0:
            break
        members = np.flatnonzero(owner == c)
        x = vectors[members]
        a = int(np.argmin(x @ x.mean(0)))
        near = x @ x[a]
        near[a] = -np.inf
        b = int(np.argmax(near))
        to_b = x @ x[b] > x @ x[a]
        to_b[b], to_b[a] = True, False
        owner[members[to_b]] = owner.max() + 1
    return owner


def choose_k(vectors: DataFrame, key: str, vec: str, vocabulary: int, least: int = 3, most: int = 8) -> int:
    """K3: the number of clusters with the least squared distances + 2 * vocabulary * k."""
    best = None
    for k in range(least, most + 1):
        found = vectors.join(kmeans(vectors, key, vec, k, rounds=5), key)
        dims = found.select(F.size(vec)).first()[0]
        mean = found.groupBy("cluster").agg(F.array(*(F.avg(F.col(vec)[i]) for i in range(dims))).alias("__m"))
        gap = F.aggregate(F.zip_with(vec, "__m", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
        cost = (found.join(F.broadcast(mean), "cluster").agg(F.sum(gap)).first()[0] or 0.0) + 2.0 * vocabulary * k
        best = min(best or (cost, k), (cost, k))
    return best[1]


def cluster_objective(f: Column, nmi: Column, purity: Column, k: int, least: int) -> Column:
    """K7: .5 F + .3 NMI + .2 purity, less .005 for each cluster beyond the least number."""
    return 0.5 * f + 0.3 * nmi + 0.2 * purity - 0.005 * max(0, k - least)


def cluster_terms(members: DataFrame, counts: DataFrame, doc: str, label: str, k: int = 3) -> DataFrame:
    """K8: ``cluster, size, dominant, terms``: the class that most of a cluster's rows have, and the terms that it holds most above the others.

    A term's score is its share of the cluster's tokens less its share of all others'; only terms above 0 count.
    """
    size = members.groupBy("cluster").agg(F.count("*").alias("size"))
    lead = members.groupBy("cluster", label).agg(F.count("*").alias("n"))
    lead = top_per_group(lead, ["cluster"], [F.desc("n"), F.asc(label)], 1, "r").select("cluster", F.col(label).alias("dominant"))
    cell = counts.join(members.select(doc, "cluster"), doc).groupBy("cluster", "term").agg(F.sum("tf").alias("n"))
    inside = cell.groupBy("cluster").agg(F.sum("n").alias("inside"))
    whole = cell.groupBy("term").agg(F.sum("n").alias("all"))
    total = inside.agg(F.sum("inside").alias("total"))
    rows = cell.join(whole, "term").join(inside, "cluster").crossJoin(F.broadcast(total))
    other = (F.col("all") - F.col("n")) / F.greatest(F.lit(1), F.col("total") - F.col("inside"))
    rows = rows.withColumn("score", F.round(F.col("n") / F.greatest(F.lit(1), "inside") - other, 9)).where("score > 0")
    best = top_per_group(rows, ["cluster"], [F.desc("score"), F.desc("term")], k, "r")
    terms = best.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "term"))), lambda s: s["term"]).alias("terms"))
    return size.join(lead, "cluster").join(terms, "cluster", "left")


def cluster_candidates(scores: DataFrame, members: DataFrame, qid: str, label: str, k: int = 3) -> DataFrame:
    """K9: ``qid, cluster, confidence, margin, classes, singleton``: the likeliest cluster of each query by softmax of its similarities.

    ``scores (qid, cluster, similarity)``; ``classes`` are the k most frequent of the cluster's members, ``singleton`` whether it has only one.
    """
    sure = certainty(scores.withColumnRenamed("similarity", "score"), qid, "cluster")
    cell = members.groupBy("cluster", label).agg(F.count("*").alias("n"))
    best = top_per_group(cell, ["cluster"], [F.desc("n"), F.asc(label)], k, "r")
    held = best.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", label))), lambda s: s[label]).alias("classes"))
    size = members.groupBy("cluster").agg((F.count("*") == 1).alias("singleton"))
    return sure.select(qid, F.col("top").alias("cluster"), F.col("probability").alias("confidence"), "margin").join(held, "cluster").join(size, "cluster")

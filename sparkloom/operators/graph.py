"""Web graph: links, shingles and least hashes, page rank, hubs and authorities."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from urllib.parse import urljoin

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.text import bind, canonical_url, fold
from ..plans.cut import checkpoint, tidy
from .link_tiles import TIDY, LinkTiles, stepped

ANCHOR = re.compile(r"<a\b[^>]*?\bhref\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)[^>]*>(.*?)</a\s*>", re.I | re.S)
TITLE = re.compile(r"<title[^>]*>(.*?)</title\s*>", re.I | re.S)
HIDDEN = re.compile(r"<(script|style|noscript)\b.*?</\1\s*>|<!--.*?-->", re.I | re.S)
TAG = re.compile(r"<[^>]*>")


def plain(markup: str) -> str:
    """Markup without tags, with references decoded and white space made even."""
    return " ".join(html.unescape(TAG.sub(" ", markup)).split())


def page_parts(pages: DataFrame, url: str, markup: str) -> DataFrame:
    """``url, title (180 characters at most), text, links array<struct<href, anchor>>``; scripts and styles are skipped.

    Links are resolved against the page and each target keeps its longest anchor.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for u, m in zip(frame[url], frame[markup]):
                bare = HIDDEN.sub(" ", m or "")
                title = TITLE.search(bare)
                links: dict[str, str] = {}
                for href, anchor in ANCHOR.findall(bare):
                    target = urljoin(u, html.unescape(href.strip("\"'")))
                    text = plain(anchor)
                    if target.startswith(("http://", "https://")) and len(text) >= len(links.get(target, "")):
                        links[target] = text
                rows.append((u, plain(title[1])[:180] if title else "", plain(TITLE.sub(" ", bare)), [{"href": k, "anchor": v} for k, v in links.items()]))
            yield pd.DataFrame(rows, columns=["url", "title", "text", "links"])

    return pages.select(url, markup).mapInPandas(run, "url string, title string, text string, links array<struct<href:string,anchor:string>>")


def edges(parts: DataFrame) -> DataFrame:
    """Distinct canonical ``src, dst`` with the longest anchor."""
    long = parts.select(canonical_url(F.col("url")).alias("src"), F.inline("links"))
    long = long.select("src", canonical_url(F.col("href")).alias("dst"), "anchor").where("src is not null and dst is not null")
    return long.groupBy("src", "dst").agg(F.max_by("anchor", F.struct(F.length("anchor"), F.col("anchor"))).alias("anchor"))


#: How far hosts and those below them are trusted.
AUTHORITIES = {
    "who.int": 1.00, "cdc.gov": 0.98, "nih.gov": 0.98, "pubmed.ncbi.nlm.nih.gov": 0.99, "nejm.org": 0.95, "thelancet.com": 0.94, "bmj.com": 0.93,
    "jamanetwork.com": 0.93, "scielo.org": 0.90,
}
#: Words of spam, and parts of addresses that hint at it.
SPAM_TERMS = (
    "miracle", "cure", "garantia", "garantizado", "sponsor", "sponsored", "promocion", "promo", "casino", "crypto", "bet", "click aqui", "click here",
    "buy now", "oferta",
)
SPAM_URL = ("redirect", "aff", "utm_", "click", "promo")


def host_authority(host: Column, hints: dict[str, float] = AUTHORITIES) -> Column:
    """.55, more for hosts at or below a trusted one and for .gov (.92) and .edu (.88)."""
    low = F.lower(host)
    known = [F.when((low == d) | F.endswith(low, F.lit(f".{d}")), v).otherwise(0.55) for d, v in hints.items()]
    kind = F.when(F.endswith(low, F.lit(".gov")), 0.92).when(F.endswith(low, F.lit(".edu")), 0.88).otherwise(0.55)
    return F.greatest(*known, kind)


def crawl_priority(host: Column, depth: Column, hints: dict[str, float] = AUTHORITIES) -> Column:
    """From 1 to 100: the host's authority in percent, eight less for each step of depth up to ten."""
    score = (host_authority(host, hints) * 100 - F.greatest(F.lit(0), F.least(F.lit(10), depth)) * 8).cast("int")
    return F.greatest(F.lit(1), F.least(F.lit(100), score))


def queue_of(priority: Column, queues: int) -> Column:
    """Which of the front queues a priority goes to, 0 the first."""
    return F.greatest(F.lit(0), F.least(F.lit(queues - 1), F.floor((100 - priority) * queues / 101))).cast("int")


def spam_points(title: Column, snippet: Column, low: Column, place: Column, size: Column, runs: Column) -> Column:
    """F14 over texts that are folded already: ``low`` (title and snippet), ``place`` (the address), ``size`` of the snippet, and whether there are long ``runs``."""
    both = F.concat_ws(" ", title, snippet)
    has = lambda c, words: sum((F.contains(c, F.lit(w)).cast("int") for w in words), F.lit(0))
    letters, capitals = F.regexp_count(both, F.lit(r"\p{L}")), F.regexp_count(both, F.lit(r"\p{Lu}"))
    loud = (letters > 24) & (capitals / F.nullif(letters, F.lit(0)) >= 0.45)
    cries = F.contains(snippet, F.lit("!!!")) | F.contains(snippet, F.lit("$$$"))
    return (
        (size < 40).cast("int")
        + 2 * cries.cast("int")
        + 2 * runs.cast("int")
        + F.least(F.lit(3), has(low, SPAM_TERMS))
        + F.coalesce(loud, F.lit(False)).cast("int")
        + (has(place, SPAM_URL) > 0).cast("int")
    )


def spam_score(title: Column, snippet: Column, url: Column) -> Column:
    """points for a short snippet, cries, long runs of a character, spam words (three at most), capitals and the address; spam from 3 on."""
    low = fold(F.concat_ws(" ", title, snippet))
    return spam_points(title, snippet, low, fold(url), F.length(fold(snippet)), F.rlike(low, F.lit(r"(.)\1{5,}")))


def bare_url(url: Column) -> Column:
    """Scheme, host and path alone, https where there is no scheme; an address without host in lower case."""
    trimmed = F.trim(F.coalesce(url, F.lit("")))
    scheme = F.lower(F.regexp_extract(trimmed, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    host = F.lower(F.regexp_extract(trimmed, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))
    path = F.regexp_replace(F.regexp_extract(trimmed, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#;]*)", 1), "/+$", "")
    whole = F.concat(F.when(scheme == "", "https").otherwise(scheme), F.lit("://"), host, F.when(path == "", "/").otherwise(path))
    return F.when(host == "", F.lower(trimmed)).otherwise(whole)


def shingles(text: Column, size: int = 3) -> Column:
    """Distinct runs of words of three or more a-z, 0-9; a short text is one shingle."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]{3,}"), F.lit(0))

    def runs(w: Column) -> Column:
        last = F.greatest(F.size(w) - (size - 1), F.lit(1))
        return F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(w, i, size), " ")))

    return bind(words, runs)


def signatures(rows: DataFrame, key: str, text: Column, seeds: int = 24) -> DataFrame:
    """``key, signature``: for each seed the least of the first 16 hexadecimal digits of the SHA-1 of seed:shingle.

    Shingles are exploded by seed, so that the generated code is one hash and one least number (for all seeds together it grows too
    large to be compiled), and least numbers are aggregated before the shuffle. A number of 64 bits is compared without its
    sign, by flipping the highest bit.
    """
    top = F.lit(-(2**63))
    long = rows.select(key, F.explode(shingles(text)).alias("s")).select(key, "s", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))).alias("k"))
    number = F.conv(F.left(F.sha1(F.concat(F.col("k").cast("string"), F.lit(":"), "s")), F.lit(16)), 16, -10).cast("long").bitwiseXOR(top)
    least = long.groupBy(key, "k").agg(F.min(number).alias("m"))
    ordered = F.array_sort(F.collect_list(F.struct("k", "m")))
    return least.groupBy(key).agg(ordered.alias("x")).select(
        key, F.transform("x", lambda x: F.lpad(F.lower(F.hex(x["m"].bitwiseXOR(top))), 16, "0")).alias("signature")
    )


def signature_similarity(a: Column, b: Column) -> Column:
    """The share of equal places."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x) / F.size(a)


def with_bands(found: DataFrame, key: str, seeds: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """``key, class`` (the smallest key with the same signature), and ``class, signature, bands`` of each class.

    Two signatures that reach the threshold differ in m places at most, so of m + 1 bands of places they agree on one.
    """
    apart = int((1 - threshold) * seeds + 1e-9)
    edges = [seeds * i // (apart + 1) for i in range(apart + 2)]
    classes = found.groupBy("signature").agg(F.min(key).alias("class"))
    bands = F.array(*(F.xxhash64(F.lit(i), F.slice("signature", a + 1, b - a)) for i, (a, b) in enumerate(zip(edges, edges[1:]))))
    return found.join(classes, "signature").select(key, "class"), classes.select("class", "signature", bands.alias("bands"))


def links_of(classes: DataFrame, threshold: float) -> DataFrame:
    """``a, b, similarity`` of all classes that share a band and reach the threshold."""
    banded = classes.select("class", "signature", F.explode("bands").alias("band"))
    a, b = banded.toDF("a", "sa", "band"), banded.toDF("b", "sb", "band")
    met = a.join(b, "band").where("a < b").withColumn("similarity", signature_similarity(F.col("sa"), F.col("sb")))
    return met.where(F.col("similarity") >= threshold).select("a", "b", F.round("similarity", 6).alias("similarity")).distinct()


def near_signatures(found: DataFrame, key: str, seeds: int = 24, threshold: float = 0.90) -> tuple[DataFrame, DataFrame]:
    """``key, class`` (the smallest key with the same signature) and links ``a, b, similarity`` between classes, none lost."""
    members, classes = with_bands(found, key, seeds, threshold)
    return members, links_of(classes, threshold)


#: Pairs for each class left that are made at once; a round of leaders that decides less than a tenth is the last one.
FEW_PAIRS = 20


def first_leaders(found: DataFrame, key: str, seeds: int = 24, threshold: float = 0.90, cut=checkpoint, most: int = 1000) -> DataFrame:
    """``key, kept``: a page stays unless it is like an earlier page that stays; copies of a page go.

    A class that is the first undecided one in all of its bands is like none before it that could stay, so it leads. A round compares
    every class with the leaders of its bands alone, and those that are like one go; so a band crowded with near copies costs one
    comparison each. Once few pairs are left, or a round decides little (classes that share a band and are not alike), the rest is linked and decided.
    """
    members, classes = with_bands(found, key, seeds, threshold)
    members, undecided = cut(members), cut(classes)
    kept = None
    for _ in range(most):
        banded = undecided.select("class", "signature", F.explode("bands").alias("band"))
        bands = cut(banded.groupBy("band").agg(F.min("class").alias("first"), F.count("*").alias("n")))
        size = bands.agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs")).first()
        if not size["n"] or size["pairs"] <= FEW_PAIRS * size["n"]:
            break
        places = banded.join(bands, "band")
        leaders = cut(places.groupBy("class", "signature").agg(F.bool_and(F.col("first") == F.col("class")).alias("leads")).where("leads"))
        kept = leaders.select("class") if kept is None else kept.unionByName(leaders.select("class"))
        of_band = bands.join(leaders.select(F.col("class").alias("first"), F.col("signature").alias("led_by")), "first").select("band", "first", "led_by")
        alike = banded.join(of_band, "band").where(F.col("class") != F.col("first")).where(signature_similarity(F.col("signature"), F.col("led_by")) >= threshold)
        out = alike.select("class").unionByName(leaders.select("class")).distinct()
        before = undecided.count()
        undecided = cut(undecided.join(out, "class", "left_anti"))
        if undecided.count() > 0.9 * before:
            break
    rest = first_wins(undecided.select("class", F.col("class").alias("page")), links_of(undecided, threshold), "page", cut, most)
    stays = rest.where("kept").select(F.col("page").alias("class"))
    stays = (stays if kept is None else stays.unionByName(kept)).withColumn("stays", F.lit(True))
    marked = members.join(stays, "class", "left")
    return marked.select(key, ((F.col(key) == F.col("class")) & F.col("stays").isNotNull()).alias("kept"))


def near_page_filter(pages: DataFrame, key: str, text: Column, seeds: int = 24, threshold: float = 0.90) -> DataFrame:
    """``key, kept`` of every page in the order of its key; a page without words, null or empty, is nobody's copy and stays."""
    worded = F.coalesce(F.rlike(F.lower(text), F.lit("[a-z0-9]{3,}")), F.lit(False))
    found = checkpoint(signatures(pages.where(worded), key, text, seeds))
    return first_leaders(found, key, seeds, threshold).unionByName(pages.where(~worded).select(key, F.lit(True).alias("kept")))


def first_wins(members: DataFrame, links: DataFrame, key: str, cut=checkpoint, most: int = 1000) -> DataFrame:
    """``key, kept``: a page stays unless it is like an earlier page that stays; copies of a page go.

    Decided in rounds: of the classes not decided yet, those without an earlier one among their links stay, and those linked to
    one that stays go. A round decides at least the first of each group.
    """
    open_ = cut(links.select("a", "b"))
    gone = None
    for _ in range(most):
        stays = open_.select(F.col("a").alias("c")).distinct().join(open_.select(F.col("b").alias("c")).distinct(), "c", "left_anti")
        out = open_.join(stays, open_["a"] == stays["c"]).select(F.col("b").alias("c")).distinct()
        out = cut(out)
        gone = out if gone is None else gone.union(out)
        rest = open_.join(out.withColumnRenamed("c", "a"), "a", "left_anti").join(out.withColumnRenamed("c", "b"), "b", "left_anti")
        rest = rest.join(stays.withColumnRenamed("c", "a"), "a", "left_anti")
        open_ = cut(rest.select("a", "b"))
        if not open_.limit(1).count():
            break
    else:
        raise RuntimeError(f"not decided after {most} rounds")
    marked = members.join(gone.distinct().select(F.col("c").alias("class"), F.lit(True).alias("__gone")), "class", "left")
    return marked.select(key, ((F.col(key) == F.col("class")) & F.col("__gone").isNull()).alias("kept"))


def nodes_of(links: DataFrame) -> DataFrame:
    return links.select(F.col("src").alias("id")).union(links.select(F.col("dst").alias("id"))).distinct()


def page_rank(links: DataFrame, personal: DataFrame | None = None, teleport: float = 0.15, rounds: int = 50, cut=checkpoint) -> DataFrame:
    """``id, rank``: teleport and dangling mass go by ``personal (id, weight)``, evenly without it; ranks sum to one.

    Links out of a node count once each.
    """
    graph = LinkTiles(links, cut)
    (found,) = page_ranks(graph, [personal], teleport, rounds)
    graph.close()
    return found


def page_ranks(graph: LinkTiles, personals: list[DataFrame | None], teleport: float = 0.15, rounds: int = 50) -> list[DataFrame]:
    """G9, G10 for several teleports at once, over one pass of the links a round; a round also sums the mass of nodes without links for the next."""
    m, size, nodes = len(personals), graph.size, graph.nodes
    weights = []
    for i, personal in enumerate(personals):
        if personal is None:
            nodes = nodes.withColumn(f"w{i}", F.lit(1.0))
        else:
            nodes = nodes.join(personal.select("id", F.col("weight").cast("double").alias(f"w{i}")), "id", "left").fillna({f"w{i}": 0.0})
    graph_nodes, graph.nodes = graph.nodes, graph.cut(nodes)
    totals = graph.nodes.agg(*(F.sum(f"w{i}").alias(f"w{i}") for i in range(m))).first() or [None] * m
    weights = [F.col(f"w{i}") / (totals[i] or 1.0) for i in range(m)]
    share = F.when(F.col("degree") > 0, 1.0 / F.col("degree")).otherwise(0.0)
    fixed = graph.vector(*weights, share, (F.col("degree") == 0).cast("double"))
    graph.nodes = graph_nodes
    schema = ", ".join(["b int", "v binary", "rank binary", *(f"loose{i} double" for i in range(m))])

    def given(rank: np.ndarray, own: np.ndarray) -> tuple:
        """What each node gives to each of its links, its rank, and the mass of nodes without links."""
        return rank * own[m], rank, *(rank * own[m + 1]).sum(1)

    def start(got, own: np.ndarray) -> tuple:
        return given(own[:m].copy(), own)

    state, loose = _seen(graph, stepped(fixed.limit(0), fixed, size, start, schema), [f"loose{i}" for i in range(m)])
    tiles = graph.tiles()
    for n in range(rounds):
        mass = np.array(loose)[:, None]

        def step(got, own: np.ndarray, mass=mass) -> tuple:
            return given(teleport * own[:m] + (1 - teleport) * (got + mass * own[:m]), own)

        state, loose = _seen(graph, stepped(graph.sums(tiles, state, m), fixed, size, step, schema), [f"loose{i}" for i in range(m)])
        if n % TIDY == TIDY - 1:
            tidy(graph.spark)
    names = [f"r{i}" for i in range(m)]
    found = graph.cut(graph.values(state.select("b", F.col("rank").alias("v")), names))
    norms = found.agg(*(F.sum(x) for x in names)).first()
    return [found.select("id", (F.col(x) / (norms[i] or 1.0)).alias("rank")) for i, x in enumerate(names)]


def _seen(graph: LinkTiles, state: DataFrame, names: list[str]) -> tuple[DataFrame, list[float]]:
    """``state`` written down, and sums of its columns from the same job."""
    seen = Observation()
    state = graph.cut(state.observe(seen, *(F.sum(x).alias(x) for x in names)))
    return state, [seen.get[x] or 0.0 for x in names]


def hits(links: DataFrame, rounds: int = 20, cut=checkpoint) -> DataFrame:
    """``id, hub, authority``: L2-normalised in each round, scaled to a maximum of 1 at the end."""
    graph = LinkTiles(links, cut)
    found = tiled_hits(graph, rounds)
    graph.close()
    return found


def tiled_hits(graph: LinkTiles, rounds: int = 20) -> DataFrame:
    """G11 over tiles. A job sums a step's squares while it writes it, and the next step divides by their root."""
    size, schema = graph.size, "b int, v binary, squares double"
    ones = graph.vector(F.lit(1.0))
    vector = {"hub": ones, "authority": ones}
    there, back = graph.tiles(), graph.tiles(back=True)
    norm = 1.0
    for n in range(rounds):
        for name, of, tiles in (("authority", "hub", there), ("hub", "authority", back)):

            def step(got, own: np.ndarray, norm=norm) -> tuple:
                new = np.zeros_like(own) + got / norm
                return new, (new * new).sum()

            vector[name], (squares,) = _seen(graph, stepped(graph.sums(tiles, vector[of]), ones, size, step, schema), ["squares"])
            norm = squares**0.5 or 1.0
        if n % TIDY == TIDY - 1:
            tidy(graph.spark)
    found = graph.values(vector["hub"], ["hub"]).join(graph.values(vector["authority"], ["authority"]), "id")
    found = graph.cut(found)
    most = found.agg(F.max("hub"), F.max("authority")).first()
    return found.select("id", (F.col("hub") / (most[0] or 1.0)).alias("hub"), (F.col("authority") / (most[1] or 1.0)).alias("authority"))


def anchor_relevance(anchors: DataFrame, asked: list[str]) -> DataFrame:
    """``id, anchor``: 1.5 times the share of the query's words among those of the anchors ``(id, words)`` that lead to a node, at most 1."""
    long = anchors.select("id", F.explode("words").alias("w"))
    share = F.count_if(F.col("w").isin(asked)) / F.count("*")
    return long.groupBy("id").agg(F.least(F.lit(1.0), 1.5 * share).alias("anchor"))


def base_set(links: DataFrame, anchors: DataFrame, candidates: DataFrame, asked: list[str], topic: DataFrame, most: int = 120) -> DataFrame:
    """``id``: the candidates, the nodes whose anchors have most of the query's words, and what these link to or are linked from.

    Half of ``most`` roots are taken by anchor words, then topic rank; neighbours fill up to ``most`` in the order of their roots' ranks.
    """
    hits_ = anchors.select("id", F.explode("words").alias("w")).where(F.col("w").isin(asked)).groupBy("id").agg(F.count("*").alias("n"))
    best = hits_.join(topic, "id", "left").orderBy(F.desc("n"), F.desc_nulls_last("rank"), F.desc("id")).limit(max(1, most // 2)).select("id")
    roots = candidates.select("id", F.lit(0).alias("o")).union(best.select("id", F.lit(1)))
    roots = roots.groupBy("id").agg(F.min("o").alias("o"))
    ahead = links.join(roots, links["src"] == roots["id"]).select(F.col("dst").alias("id"), (F.col("o") + 2).alias("o"))
    behind = links.join(roots, links["dst"] == roots["id"]).select(F.col("src").alias("id"), (F.col("o") + 2).alias("o"))
    every = roots.union(ahead).union(behind).groupBy("id").agg(F.min("o").alias("o")).join(topic, "id", "left")
    return every.orderBy("o", F.desc_nulls_last("rank"), F.desc("id")).limit(most).select("id")


def query_hits(links: DataFrame, base: DataFrame, rounds: int = 12, cut=checkpoint) -> DataFrame:
    """Hubs and authorities of the links within a base set."""
    inside = links.join(base.select(F.col("id").alias("src")), "src", "left_semi").join(base.select(F.col("id").alias("dst")), "dst", "left_semi")
    return hits(inside, rounds, cut)


def link_score(general: DataFrame, topical: DataFrame, hub_auth: DataFrame, anchor: DataFrame) -> DataFrame:
    """.30 rank + .35 topic rank + .20 authority + .10 hub + .05 anchor, each by its maximum."""
    both = general.withColumnRenamed("rank", "g").join(topical.withColumnRenamed("rank", "t"), "id").join(hub_auth, "id").join(anchor, "id", "left")
    most = both.agg(F.max("g").alias("mg"), F.max("t").alias("mt"))
    score = 0.30 * F.col("g") / F.col("mg") + 0.35 * F.col("t") / F.col("mt") + 0.20 * F.col("authority") + 0.10 * F.col("hub")
    return both.crossJoin(F.broadcast(most)).select("id", (score + 0.05 * F.coalesce("anchor", F.lit(0.0))).alias("score"))

"""Catalogue sources and the cache of vectors."""

import random
import re
import threading
import unicodedata

from pyspark.sql import functions as F

from sparkloom.operators import catalogue as C
from sparkloom.sources.vector_cache import VectorCache


def plain(text):
    return unicodedata.normalize("NFKD", text or "").encode("ascii", "ignore").decode().lower()


def brute(questions, matched, catalogue, sections, most):
    out = []
    for qid, text in questions:
        low = plain(text)
        own = set(re.findall("[a-z0-9]{3,}", low))
        has = lambda t, words: sum(w in t for w in words)
        ranked = []
        domains = sorted(x[1:] for x in matched if x[0] == qid)
        for d_nth, domain, label, summary in domains:
            seen = set()
            for nth, title, source in sorted(x[1:] for x in catalogue if x[0] == domain):
                best, chunk = 0, ""
                for _, body in sorted(x[1:] for x in sections if x[0] == source):
                    b = plain(body)
                    score = len(own & set(re.findall("[a-z0-9]{3,}", b)))
                    if has(low, C.GENERIC_QUESTION):
                        score += 2 * has(b, C.OPERATIONAL) - 2 * has(b, C.NOT_OPERATIONAL)
                        if not has(low, C.SPECIFIC):
                            score += 3 * has(b, C.NEUTRAL) - 3 * has(b, C.SPECIFIC)
                    if domain == C.ABDOMINAL_DOMAIN and has(low, C.ABDOMINAL_QUESTION):
                        score += 3 * has(b, C.ABDOMINAL)
                    if score > best:
                        best, chunk = score, body
                if best and source not in seen:
                    seen.add(source)
                    ranked.append((-best, d_nth, nth, domain, title, source, chunk[:280]))
        ranked.sort(key=lambda r: r[:3])
        if ranked:
            out += [(qid, i + 1, d, t, s, c, -b) for i, (b, _, _, d, t, s, c) in enumerate(ranked[:most])]
        else:
            out += [(qid, i + 1, d, label, "domain_catalog", summary[:280], 0) for i, (_, d, label, summary) in enumerate(domains[:most])]
    return sorted(out)


def test_sources_equal_all_sections(spark):
    rng = random.Random(6)
    words = ["alfa", "beta", "gamma", "delta", "Épsilon", "zeta", "manejo", "abdomen agudo", "perforación", "constantes", "validacion", "cirugia", "imagen", "hernia crural", "pasos"]
    text = lambda n: " ".join(rng.choices(words, k=rng.randint(0, n)))
    questions = [(i, text(5)) for i in range(30)] + [(30, None), (31, "nothing here matches"), (32, "que hacer abdomen")]
    domains = [C.ABDOMINAL_DOMAIN, "cardio", "neuro"]
    matched = [(q, i, d, d.upper(), f"summary of {d}") for q, _ in questions for i, d in enumerate(rng.sample(domains, rng.randint(1, 3)))]
    catalogue = [(d, i, f"{d} {i}", rng.choice(["a.md", "b.md", "c.md", "missing.md"])) for d in domains for i in range(4)]
    sections = [(s, i, text(9)) for s in ("a.md", "b.md", "c.md") for i in range(15)]
    frames = [
        spark.createDataFrame(questions, "qid long, text string"), spark.createDataFrame(matched, "qid long, nth int, domain string, label string, summary string"),
        spark.createDataFrame(catalogue, "domain string, nth int, title string, source string"), spark.createDataFrame(sections, "source string, section int, text string"),
    ]
    got = sorted(tuple(r)[:7] for r in C.catalogue_sources(*frames, "qid", most=3).collect())
    assert got == brute(questions, matched, catalogue, sections, 3)
    assert any(r[4] == "domain_catalog" for r in got)
    assert C.catalogue_sources(frames[0].limit(0), frames[1].limit(0), *frames[2:], "qid").collect() == []


def test_sections_of_sources(spark):
    long = "x" * 700
    rows = [("s", f"short\n\n{'word ' * 10}\nnext  line\n \n{long}\n\n" + "\n\n".join(f"paragraph number {i} of many paragraphs here" for i in range(300))), ("t", None), ("u", "")]
    got = C.sections_of(spark.createDataFrame(rows, "source string, body string"), "source", "body").orderBy("section").collect()
    assert len(got) == 250 and got[0]["text"] == ("word " * 10 + "next line") and len(got[1]["text"]) == 620


def test_second_run_computes_nothing(spark, tmp_path):
    cache = VectorCache(spark, str(tmp_path / "cache"))
    asked = []

    def compute(rows):
        asked.append(sorted(r["text"] for r in rows.select("text").collect()))
        return rows.select("key", F.array(F.length("text").cast("double")).alias("vector"))

    texts = spark.createDataFrame([(1, "a"), (2, "bb"), (3, None), (4, "a"), (5, "")], "id long, text string").withColumn("vector_of", F.lit("clash"))
    first = cache.with_vectors(texts, "text", compute).collect()
    assert {r["id"]: r["vector"] for r in first} == {1: [1.0], 2: [2.0], 3: None, 4: [1.0], 5: [0.0]}
    again = cache.with_vectors(texts, "text", compute).collect()
    assert len(again) == 5 and asked == [["", "a", "bb"]]
    more = spark.createDataFrame([(1, "a"), (9, "new")], "id long, text string")
    assert {r["id"]: r["vector"] for r in cache.with_vectors(more, "text", compute).collect()} == {1: [1.0], 9: [3.0]}
    assert asked[1:] == [["new"]]


def test_writers_at_the_same_time_and_unfinished_ones(spark, tmp_path):
    cache = VectorCache(spark, str(tmp_path / "cache"))
    keys = [F.sha2(F.col("id").cast("string"), 256).alias("key")]
    rows = [spark.range(0, 40).select(*keys, F.array(F.lit(float(n))).alias("vector")) for n in range(4)]
    jobs = [threading.Thread(target=cache.append, args=(r,)) for r in rows]
    for j in jobs:
        j.start()
    for j in jobs:
        j.join()
    (tmp_path / "cache" / "_aside" / "broken" / "prefix=ab").mkdir(parents=True)
    (tmp_path / "cache" / "_aside" / "broken" / "prefix=ab" / "part-0.parquet").write_bytes(b"half a file")
    found = {r["key"]: r["vector"] for r in cache.vectors().collect()}
    assert len(found) == 40 and len({tuple(v) for v in found.values()}) == 1  # one run counts for all of them
    assert cache.runs().count() == 160
    cache.compact()
    assert cache.runs().count() == 40 and {r["key"]: r["vector"] for r in cache.vectors().collect()} == found

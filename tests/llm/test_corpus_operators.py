"""Operators over the corpus: mixing, sharding, near duplicates, toxicity, Merkle fingerprints, the pipeline."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

from sparkloom.llm import components, merkle, mixing, queries, sharding, simhash, toxicity

SF = "/root/testdata/sf0.001"


def test_poisson_inverse_and_copies(spark, docs, empty):
    rows = [(i, "big" if i % 3 else "small", "w" * 10) for i in range(6000)]
    table = spark.createDataFrame(rows, "doc_id long, source string, text string")
    mixed = mixing.mix(table, weights={"big": 1.0, "small": 1.0}, epochs=1.0)
    count = {r.source: r["count"] for r in mixed.groupBy("source").count().collect()}
    assert abs(count["big"] - 3000) < 200 and abs(count["small"] - 3000) < 200
    got = {r.doc_id: r.n for r in mixed.groupBy("doc_id").agg({"copy": "max"}).withColumnRenamed("max(copy)", "n").collect()}
    for i in range(0, 6000, 97):
        u = (int(hashlib.md5(f"42:{i}:1".encode()).hexdigest()[:13], 16) + 0.5) / 16**13
        mean = 0.75 if i % 3 else 1.5
        assert got.get(i, 0) == sum(c <= u for c in mixing.poisson_cdf(mean))
    keys = [r.mix_key for r in mixed.select("mix_key").collect()]
    assert len(set(keys)) == len(keys)
    out = mixing.mix(docs)
    assert out.columns == [*docs.columns, "rate", "copy", "mix_key"]
    out.collect()
    assert mixing.mix(empty).count() == 0


def test_large_rates_are_sums_of_parts(spark):
    table = spark.createDataFrame([(1, "a", "x"), (2, "b", "y" * 999)], "doc_id long, source string, text string")
    mixed = mixing.mix(table, weights={"a": 1.0, "b": 1.0})
    n = mixed.where("doc_id = 1").count()
    assert 400 < n < 600  # mean 500


def brute_cuts(atoms, shards):
    def cut(c):
        starts, used = [], 0
        for h, x in atoms:
            if used + x > c:
                starts.append(h)
                used = 0
            used += x
        return starts

    low, high = max(x for _, x in atoms), sum(x for _, x in atoms)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if len(cut(mid)) < shards else (mid + 1, high)
    return low, cut(low)


@pytest.mark.parametrize("n,large,spread", [(1, 0, 63), (40, 0, 63), (3000, 10**6, 63), (3000, 0, 30)])
def test_minimax_cuts_equal_brute_force(spark, n, large, spread):
    r = random.Random(n + large)
    atoms = sorted((r.randrange(-(2**spread), 2**spread), r.randrange(1, 5000)) for _ in range(n))
    if large:
        atoms[n // 3] = (atoms[n // 3][0], large)
    starts, sizes = sharding.cuts(spark.createDataFrame(atoms, "hash long, size long"), 16)
    best, want = brute_cuts(atoms, 16)
    assert max(sizes) == best
    assert [sum(h >= s for s in starts) for h, _ in atoms] == [sum(h >= s for s in want) for h, _ in atoms]


def test_shards(spark, docs, empty):
    table = queries.table(spark, SF, "documents")
    rows = sharding.shard(table.select("doc_id", "text")).collect()
    text = {r.doc_id: r.text for r in table.collect()}
    assert len(rows) == len(text)
    by_text, slots = {}, {}
    for r in rows:
        data = text[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law) == (len(data) + 1, zlib.crc32(data), "bytes")
        assert by_text.setdefault(data, r.shard) == r.shard
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(16))
    assert sharding.shard(docs).count() == docs.count()
    assert {r.shard for r in sharding.shard(docs).where("doc_id in (3, 4)").collect()}.__len__() == 1
    assert sharding.shard(empty).count() == 0


def brute_fingerprint(text):
    import xxhash

    w = text.encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_and_groups_equal_brute_force(spark, docs, empty):
    r = random.Random(7)
    words = [f"w{i}" for i in range(60)]
    base = [[r.choice(words) for _ in range(r.randrange(1, 300))] for _ in range(60)]
    texts = [" ".join(b) for b in base]
    for b in base[:30]:
        for _ in range(6):
            c = list(b)
            c[r.randrange(len(c))] = "edited"
            texts.append(" ".join(c))
    rows = list(enumerate(texts)) + [(1000 + i, x.text) for i, x in enumerate(docs.collect())]
    got = {x.doc_id: x for x in simhash.groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, 2).collect()}
    fps = {i: brute_fingerprint(t or "") for i, t in rows}
    assert {i: x.fp % 2**64 for i, x in got.items()} == fps
    forest = simhash.Forest(len(rows))
    for a in range(len(rows)):
        for b in range(a):
            if (fps[rows[a][0]] ^ fps[rows[b][0]]).bit_count() <= 2:
                forest.join(a, b)
    least = {}
    for a, (i, _) in enumerate(rows):
        least[forest.root(a)] = min(i, least.get(forest.root(a), i))
    assert {i: x.component_id for i, x in got.items()} == {i: least[forest.root(a)] for a, (i, _) in enumerate(rows)}
    assert simhash.groups(docs, 3, 2).count() == docs.count()
    assert simhash.groups(empty, 3, 2).count() == 0


def test_large_tiles_are_cut_into_squares(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SQUARE", 8)
    r = random.Random(8)
    centre = r.getrandbits(64)
    fps = {centre ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(20)) for _ in range(150)}
    signed = [(f - 2**64 if f >= 2**63 else f,) for f in fps]
    found = components.connected_components(simhash.links(spark.createDataFrame(signed, "fp long"), 2))
    got = {x.node: x.component for x in found.collect()}
    forest = simhash.Forest(len(signed))
    for a in range(len(signed)):
        for b in range(a):
            if ((signed[a][0] ^ signed[b][0]) % 2**64).bit_count() <= 2:
                forest.join(a, b)
    least = {}
    for a, (f,) in enumerate(signed):
        least[forest.root(a)] = min(f, least.get(forest.root(a), f))
    assert {f: got.get(f, f) for (f,) in signed} == {f: least[forest.root(a)] for a, (f,) in enumerate(signed)}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5000, 5000), (7, 3)]
    got = {x.node: x.component for x in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[1000 + i] == 1000 for i in range(50))
    assert 5000 not in got or got[5000] == 5000


def test_tasks_of_a_round_follow_from_its_edges(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(2000 + i, 2000 + i // 2) for i in range(1, 90)]
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    sc = spark.sparkContext

    def run(group):
        sc.setJobGroup(group, group)
        rows = components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
        jobs = sc.statusTracker().getJobIdsForGroup(group)
        stages = {i for j in jobs for i in sc.statusTracker().getJobInfo(j).stageIds}
        infos = [sc.statusTracker().getStageInfo(i) for i in stages]
        return {x.node: x.component for x in rows}, sum(x.numCompletedTasks for x in infos if x)

    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got, tasks = run("few edges")
        assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(50)} | {2000 + i: 2000 for i in range(90)}
        assert tasks < 2400  # a round has about ten shuffles, each of 40 tasks if none is gathered
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        sc._jsc.clearJobGroup()


def test_one_of_each_group_of_near_copies_stays(spark, docs, empty):
    r = random.Random(9)
    words = [f"w{i}" for i in range(5000)]
    base = [[r.choice(words) for _ in range(120)] for _ in range(12)]
    rows = [(i, " ".join(b)) for i, b in enumerate(base)]
    for i, b in enumerate(base[:6]):
        c = list(b)
        c[60] = "edited"
        rows += [(100 + i, " ".join(b).upper()), (200 + i, " ".join(c))]  # equal but for case; similarity 0.92
    for i, b in enumerate(base[6:]):
        c = list(b)
        for k in range(0, 120, 12):
            c[k] = f"other{i}{k}"
        rows.append((300 + i, " ".join(c)))  # too many edits: stays
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(x.doc_id for x in kept.collect()) == [*range(12), *range(300, 306)]
    left = simhash.keep_one(docs)
    assert left.columns == docs.columns
    assert sorted(x.doc_id or 0 for x in left.collect()) == [0, 1, 3, 5, 6, 7, 8]
    assert simhash.keep_one(empty).count() == 0


def labelled(spark, n=1200):
    r = random.Random(10)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(3, 8))) for _ in range(800)]
    bad = ["zork", "zorkish", "vexum", "qualb"]
    rows, labels = [], []
    for i in range(n):
        w = [r.choice(words) for _ in range(r.randrange(5, 120))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(r.randrange(1, 4)):
                w[r.randrange(len(w))] = r.choice(bad)
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_of_held_out_rows(spark, docs, empty):
    texts, labels = labelled(spark)
    model = toxicity.train(texts, labels)
    rows = toxicity.score(texts, model).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.toxic for r in held) / len(held) > 0.97
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    kept = toxicity.reject(texts, model)
    assert kept.columns == texts.columns and kept.count() == sum(r.predicted == 0 for r in rows)
    assert toxicity.score(docs, model).count() == docs.count()
    assert toxicity.score(empty, model).count() == 0
    bare = toxicity.train(texts, labels.limit(0))
    assert toxicity.score(docs, bare).where("predicted = 1").count() == 0


def test_every_text_with_a_known_term_has_evidence_and_its_own_neighbours(spark):
    texts, labels = labelled(spark)
    model = toxicity.train(texts, labels)
    asked = spark.createDataFrame([(-1, "abc " * 3), (-2, "zork"), (-3, "qqqqqq wwwwww"), (-4, ""), (-5, None)], "doc_id long, text string")
    for x in texts.limit(200).union(asked.where("doc_id = -2")).collect():
        query = model.vectors.vectors([x.text])[0]
        assert (len(model.scores([x.text])[0][1]) > 0) == (query is not None and len(query[0]) > 0)
    got = {r.doc_id: r for r in toxicity.score(asked, model).collect()}
    assert got[-2].predicted == 1 and got[-3].evidence == got[-4].evidence == got[-5].evidence == []
    assert got[-4].score == got[-5].score == model.bare


def test_an_example_is_its_own_nearest(spark):
    texts, labels = labelled(spark)
    model = toxicity.train(texts, labels)
    by_id = {r.doc_id: r.text for r in texts.collect()}
    for place, name in list(enumerate(model.index.names))[:100]:
        (rows, cosine), = model.index.nearest(model.vectors.vectors([by_id[name]]), 15)
        assert abs(cosine[0] - 1) < 1e-4 and (rows[0] == place or by_id[model.index.names[rows[0]]] == by_id[name] or cosine[1] == cosine[0])


@pytest.mark.parametrize("frequent", [0, 5, 256])
def test_block_max_search_is_exact(monkeypatch, frequent):
    monkeypatch.setattr(toxicity, "FREQUENT", frequent)
    monkeypatch.setattr(toxicity, "OPENED", 2)
    r = np.random.default_rng(11)
    vectors = []
    for _ in range(500):
        t = np.unique(r.integers(0, 60, r.integers(1, 8)))
        w = r.random(len(t)) + 0.05
        vectors.append((t, np.rint(w / np.sqrt((w**2).sum()) / toxicity.UNIT) * toxicity.UNIT))
    index = toxicity.Index(vectors, [0] * 500, list(range(500)), 60)
    place = {name: i for i, name in enumerate(index.names)}
    asked = vectors[:60] + [(np.zeros(0, np.int64), np.zeros(0))]
    for q, (rows, cosine) in zip(asked, index.nearest(asked, 15)):
        dense = np.zeros(60)
        dense[q[0]] = q[1]
        all_ = [(-(dense[t] * w).sum(), place[i]) for i, (t, w) in enumerate(vectors) if len(np.intersect1d(t, q[0]))]
        assert [(-c, i) for c, i in zip(cosine.tolist(), rows.tolist())] == sorted(all_)[:15]


def test_sample_takes_one_row_of_a_repeated_id(spark):
    """A labelled id that 10,000 rows share brings one of them, the same whatever their order."""
    texts = [(i, f"text {i} of some words") for i in range(40)] + [(7, f"copy {n % 50} of the words") for n in range(10_000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("hash", F.lit(1))
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    taken = [sorted(map(tuple, toxicity.sample_labelled(d, labels, "toxic", 30, "doc_id", "text").select("id", "y", "text").collect())) for d in (docs, docs.repartition(7).orderBy(F.desc("text")))]
    assert taken[0] == taken[1] and len(taken[0]) <= 30 and len({i for i, _, _ in taken[0]}) == len(taken[0])
    assert toxicity.train(docs, labels).index.labels.size <= 40


def edited(texts, i):
    text, nxt = texts[i], texts[(i + 1) % len(texts)]
    q = len(text) // 4
    return text[: len(text) - q] + nxt[:q]


def test_merkle_edits(spark, docs, empty):
    rows = sorted((r.doc_id, r.text) for r in queries.table(spark, SF, "documents").collect())
    texts = [t for _, t in rows]
    got = {r.doc_id: r for r in merkle.edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    by_text = {}
    for i, (d, t) in enumerate(rows):
        r = got[d]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited(texts, i).encode()).hexdigest()
        assert by_text.setdefault(t, r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (r.fingerprint == r.edited_fingerprint) == (edited(texts, i) == t) == (r.edit_section is None)
    assert len(set(by_text.values())) == len(by_text)
    near = [got[d].near_edited for d, t in rows if len(t) > 100]
    assert np.mean(near) > 0.65 and np.mean([got[d].near_next for d, _ in rows]) < 0.3
    odd = merkle.edits(docs).collect()
    assert len(odd) == docs.count()
    assert merkle.edits(docs.where("doc_id = 1")).first().near_next == 1.0
    assert merkle.edits(empty).count() == 0


def test_merkle_locates_the_edit(spark):
    a = "one\ntwo\n\nthree\nfour\n\nfive"
    b = a.replace("four", "4")
    rows = spark.createDataFrame([(a, b)], "a string, b string")
    cut = [merkle.paragraph_nodes(merkle.paragraphs(rows[c])) for c in "ab"]
    r = rows.select(*cut).toDF("a", "b").select(
        merkle.first_difference(merkle.section_nodes(_c("a")), merkle.section_nodes(_c("b"))).alias("s"),
        merkle.first_difference(_c("a")[1], _c("b")[1]).alias("p"),
    ).first()
    assert (r.s, r.p) == (1, 1)


def _c(name):
    from pyspark.sql import functions as F

    return F.col(name)


def test_pipeline_stages(spark):
    import corpus_pipeline as P

    docs = queries.table(spark, SF, "documents")
    columns = docs.columns
    for name, stage in P.STAGES:
        out = stage(spark, docs, SF)
        if name != "sentencepiece":
            assert out.columns == columns
        before, after = docs.count(), out.count()
        assert 0 < after <= before or name == "mixing"
        docs = out
    assert docs.where("length(text) <> n_chars").count() == 0
    assert docs.select("doc_id").distinct().count() > 50

"""Cases that shorter ways of doing the job would miss."""

import random
import re
import time

import numpy as np
import pytest

from sparkloom.llm import gif, merkle, mixing, pii, sentencepiece, simhash


def shingles(text, words=5):
    w = text.lower().split()
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))}


def similarity(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def brute_groups(texts):
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if similarity(texts[i], texts[j]) >= 0.8:
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return [root(i) for i in range(len(texts))]


@pytest.mark.parametrize("kind", ["repeated lines", "short texts"])
def test_near_copies_with_distant_fingerprints_are_linked(spark, kind):
    r = random.Random(31)
    word = lambda: "".join(r.choice("abcdefghijkl") for _ in range(6))
    texts = []
    if kind == "repeated lines":
        for _ in range(25):
            body, line = [word() for _ in range(300)], [word() for _ in range(12)]
            texts += [" ".join(body + line), " ".join(body + line * 50)]
    else:
        for n in range(5, 13):
            for _ in range(40):
                w = [word() for _ in range(n)]
                texts += [" ".join(w), " ".join([*w, word()])]
    prints = [simhash.fingerprint(simhash.shingle_hashes(t, 5)) for t in texts]
    like = [similarity(a, b) >= 0.8 for a, b in zip(texts[::2], texts[1::2])]
    far = [(a ^ b).bit_count() > 20 for a, b in zip(prints[::2], prints[1::2])]
    assert any(x and y for x, y in zip(like, far))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = simhash.near_groups(rows).collect()
    of = {x["least"]: x["component_id"] for x in found}
    assert [of[i] for i in range(len(texts))] == brute_groups(texts)


def test_likeness_across_the_limit_of_short_texts(spark):
    r = random.Random(5)

    def prose(n):
        t = ""
        while len(t) < n:
            t += "".join(r.choice("abcdefgh") for _ in range(5)) + r.choice("    ,.") + " "
        return t[:n]

    base = prose(250)
    rows = [(1, base), (2, base + "ten more c"), (3, ""), (4, prose(200))]
    for k, n in enumerate((256, 290, 320, 341)):
        rows += [(10 + 2 * k, prose(n)), (11 + 2 * k, "")]
    rows += [(50, prose(100)), (51, prose(100))]
    got = {x.doc_id: x for x in merkle.edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].near_next > 0.8
    assert all(got[10 + 2 * k].near_edited > 0.6 for k in range(4))
    assert got[50].near_next < 0.3 and got[4].near_next < 0.3


def test_groups_of_the_whole_table_equal_brute_force(spark):
    """All pairs of similarity 0.8 or more of sf0.01, found through shared shingles and counted exactly."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    sets = {r.doc_id: shingles(r.text or "") if (r.text or "").split() else set() for r in rows}
    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    shared = {}
    for h in holders.values():
        for i in h:
            for j in h:
                if j < i:
                    shared[i, j] = shared.get((i, j), 0) + 1
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    empty = sorted(i for i, s in sets.items() if not s)
    pairs = [p for p, n in shared.items() if n >= 0.8 * (len(sets[p[0]]) + len(sets[p[1]]) - n)] + [(i, empty[0]) for i in empty[1:]]
    for i, j in pairs:
        a, b = sorted((root(i), root(j)))
        up[b] = a
    kept = {r.doc_id for r in simhash.keep_one(docs).collect()}
    assert kept == {i for i in sets if root(i) == i}


def test_large_groups_are_cut_into_parts(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SQUARE", 8)
    monkeypatch.setattr(simhash, "ELEMENTS", 900)
    r = random.Random(41)
    base = [f"w{r.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(150):  # a large group, and one whose texts chain to it through neighbours alone
        w = list(base)
        for k in range(i // 30):
            w[20 * k + 3 : 20 * k + 8] = [f"v{k}x{n}" for n in range(5)]
        w[-1] = f"end{i}"
        rows.append((i, " ".join(w)))
    found = simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    of = {x["least"]: x["component_id"] for x in found}
    assert [of[i] for i in range(150)] == brute_groups([t for _, t in rows])


def test_one_row_of_repeats_stays_whatever_the_columns_are_called(spark):
    rows = [(1, "same text of some words here", f"v{i}", i, "o") for i in range(6)] + [(2, "other words in this one here", "u", 0, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, own string, node int, row string")
    kept = [simhash.keep_one(docs.repartition(n)).collect() for n in (1, 5)]
    assert sorted(kept[0]) == sorted(kept[1]) and sorted(r.doc_id for r in kept[0]) == [1, 2]
    assert kept[0][0].asDict().keys() == set(docs.columns)


def cut_sign(c, spaced):
    """Whether a sign is one of those that cut, by the rule on its number."""
    o = ord(c)
    if spaced:
        return 0x21 <= o <= 0x7E and o % 4 == 0 or 0x80 <= o <= 0x2DFF and o // 8 % 4 == 0
    return any(a <= o <= b for a, b in ((0xE00, 0xEFF), (0x1000, 0x109F), (0x1780, 0x17FF))) and o % 8 == 0 or 0x2E80 <= o <= 0xD7FF and o // 16 % 8 == 0


def leaf_set(text):
    """The leaves of all paragraphs, word by word."""
    space, marks = " \t\n\x0b\f\r", "、。！，；？"
    dense = lambda c: any(a <= ord(c) <= b for a, b in ((0xE00, 0xEFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0xD7FF))) or c in marks
    out = set()
    for paragraph in re.split("(?<=\n)", text):
        kinds = ["space" if c in space else "dense" if dense(c) else "word" for c in paragraph]

        def run(i, most):
            j = i
            while j < len(paragraph) and kinds[j] == kinds[i] and j - i < most:
                j += 1
            return j

        at = 0
        while at < len(paragraph):
            end = at
            if kinds[at] == "dense":
                while end < len(paragraph) and kinds[end] == "dense" and end - at < 32 and not (paragraph[end] in marks or cut_sign(paragraph[end], False)):
                    end += 1
                if end < len(paragraph) and (paragraph[end] in marks or cut_sign(paragraph[end], False)):
                    end += 1
            elif kinds[at] == "space":
                end = run(at, 10**9)
            else:
                end, words = run(at, 32), 1
                while end < len(paragraph) and kinds[end] == "space":
                    then = run(end, 10**9)
                    if words == 5 or then == len(paragraph) or kinds[then] != "word" or cut_sign(paragraph[then], True):
                        end = then
                        break
                    end, words = run(then, 32), words + 1
            out.add(paragraph[at:end])
            at = end
    return out


def section_cut(text):
    """Sections of paragraphs, line by line."""
    lines = [x for x in re.split("(?<=\n)", text)]
    out = [[lines[0]]]
    for last, line in zip(lines, lines[1:]):
        sign = last[-2:-1]
        blank = last == "\n" and len(out[-1]) > 1 or text == ""
        cuts = sign and (cut_sign(sign, True) or ord(sign) > 127 and cut_sign(sign, False)) and not line.startswith("\n")
        if last == "\n" and (len(out) > 1 or len(out[-1]) > 1) or cuts or blank:
            out.append([])
        out[-1].append(line)
    return [[*s, ""] if s[-1].endswith("\n") else s for s in out]


def test_one_letter_changes_little(spark):
    """An insertion at the start, in the middle or before the end, in texts without punctuation and in scripts without spaces."""
    r = random.Random(8)
    english = " ".join("".join(r.choice("etaoinshrdlucmfw") for _ in range(r.randrange(2, 9))) for _ in range(400))
    chinese = "".join(chr(r.randrange(0x4E00, 0x9FA5)) for _ in range(2000))
    marked = "".join(chr(r.randrange(0x4E00, 0x9FA5)) + ("。" if i % 17 == 0 else "") for i in range(2000))
    cyrillic = " ".join("".join(chr(r.randrange(0x430, 0x450)) for _ in range(r.randrange(2, 9))) for _ in range(400))
    thai = "".join(chr(r.randrange(0xE01, 0xE3A)) for _ in range(2000))
    texts = [english, chinese, marked, cyrillic, thai]
    texts += [x.text for x in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("n_chars >= 500").collect()]
    rows = [(3 * i + k, t) for i, text in enumerate(texts) for k, t in enumerate((text, "q" + text))]
    got = {x.doc_id: x for x in merkle.edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    low = [i for i in range(len(texts)) if got[3 * i].near_next <= 0.9]
    assert low == [] and len(texts) > 500
    middle = [(2 * i + k, t) for i, text in enumerate(texts[:5]) for k, t in enumerate((text, text[:777] + "日" + text[777:]))]
    got = {x.doc_id: x for x in merkle.edits(spark.createDataFrame(middle, "doc_id long, text string")).collect()}
    assert all(got[2 * i].near_next > 0.9 for i in range(5))


def test_likeness_equals_that_of_the_leaves(spark):
    r = random.Random(77)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 8)))
    prose = lambda n: "".join(word() + r.choice([" "] * 6 + [", ", ".\n", ". "]) for _ in range(n))
    texts = [prose(r.choice([0, 1, 3, 10, 40, 45, 60, 2000])) for _ in range(80)]
    rows = spark.createDataFrame([(f"id{i:03}", t) for i, t in enumerate(texts)], "doc_id string, text string")
    got = {x.doc_id: x for x in merkle.edits(rows).collect()}
    for i, t in enumerate(texts):
        nxt = texts[(i + 1) % len(texts)]
        q = len(t) // 4
        new = t[: len(t) - q] + nxt[:q]
        row = got[f"id{i:03}"]
        for near, other in ((row.near_edited, new), (row.near_next, nxt)):
            a, b = leaf_set(t), leaf_set(other)
            want = 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0
            assert abs(near - want) < (1e-9 if len(a | b) <= merkle.SKETCH else 0.2), (i, near, want)
        assert len(row.fingerprint) <= 64 + 1 + 512
        a, b = section_cut(t), section_cut(new)
        want = []
        for k in range(max(len(a), len(b))):
            x, y = a[k] if k < len(a) else [], b[k] if k < len(b) else []
            unlike = [j for j in range(max(len(x), len(y))) if x[j : j + 1] != y[j : j + 1]]
            want += [(k, unlike)] if unlike else []
        assert [(s, list(p)) for s, p in row.edit_branches] == want


def test_levels_of_the_tree_hash_apart(spark):
    from pyspark.sql import functions as F

    cut = merkle.paragraph_nodes(merkle.paragraphs(F.lit("one")))
    p, s, r = spark.range(1).select(F.flatten(cut)[0], merkle.section_nodes(cut)[0], merkle.root(merkle.section_nodes(cut))).first()
    assert len({p, s, r}) == 3


def test_files_that_are_no_whole_gif_give_no_row(spark):
    good = gif.encode([(np.arange(64, dtype=np.uint8).reshape(8, 8), 100)], gif.GREY, (8, 8))
    at = good.index(b",\0\0", 781) + 10  # the bits of a sample
    bad = [good[:at] + bytes([n]) + good[at + 1 :] for n in (0, 9, 64, 200)]
    bad += [good[:6] + b"\xff\xff\xff\xff" + good[10:], good[:-30], b"", b"GIF89a", None]
    short = gif.encode([(np.zeros((4, 8), np.uint8), 0)], gif.GREY, (8, 8))
    tall = short.index(b",\0\0", 781) + 7
    bad.append(short[:tall] + b"\x08" + short[tall + 1 :])  # says 8 rows, holds 4
    rows = spark.createDataFrame([(i, m, "x") for i, m in enumerate([good, *bad])], "doc_id long, media binary, frames string")
    found = gif.gif_frames(rows, "doc_id").collect()
    assert [(f.doc_id, f.nth) for f in found] == [(0, 0)]
    assert gif.gif_frames(rows.limit(0), "doc_id").count() == 0


def test_any_characters_come_back_from_pieces():
    from sparkloom.llm.queries import tokenizer_path

    model = sentencepiece.load(tokenizer_path("piece_bpe_32k.model"))
    texts = ["a\ufdd0b", "\ufdd0", "\ufdd0▁ \ufdd0", "▁a▁ ▁", "x" * 300 + "▁" + "y" * 300]
    assert [sentencepiece.decode(np.frombuffer(x, "<i4"), model) for x in sentencepiece.encoder(model)(texts)] == texts


def test_candidates_of_one_long_text():
    text = " ".join(f"call 555-{i % 900 + 100}-{i % 9000 + 1000} or password=ab{i:06x}99ab3fab3f" for i in range(40_000))
    began = time.perf_counter()
    found = pii.candidates(text, pii.base_spans(text))
    assert time.perf_counter() - began < 60 and len(found) > 50_000
    spans = sorted((a, b) for _, a, b, _ in found)
    assert all(b <= c for (_, b), (c, _) in zip(spans, spans[1:]))


def test_reliabilities_equal_those_of_single_candidates():
    """The estimate over counted codes against the textbook loop over single candidates."""
    r = random.Random(3)
    kinds, votes = [], []
    for _ in range(400):
        truth, kind = r.random() < 0.4, r.randrange(len(pii.ADDED))
        kinds.append(kind)
        votes.append([1 if r.random() < 0.2 else 2 * (truth == (r.random() < 0.6 + 0.06 * i)) for i in range(pii.LABELERS)])
    codes = []
    for kind, v in zip(kinds, votes):
        code = 0
        for x in v:
            code = 3 * code + x
        codes.append((code * len(pii.ADDED) + kind) * pii.FORMS + r.randrange(3))
    unique = sorted(set(codes))
    got, table = pii.estimate(np.array(unique), np.array([codes.count(c) for c in unique], float))
    p = [1 / (1 + np.exp(-sum(x - 1 for x in v))) for v in votes]
    for _ in range(100):
        weight = [[1 - x for x in p], p]
        rate = [[[(0.5 + sum(w for w, v in zip(weight[t], votes) if v[i] == x)) / (1.5 + sum(weight[t])) for x in range(3)] for i in range(pii.LABELERS)] for t in (0, 1)]
        prior = [(1 + sum(x for x, k in zip(p, kinds) if k == kind)) / (2 + kinds.count(kind)) for kind in range(len(pii.ADDED))]
        new = []
        for kind, v in zip(kinds, votes):
            yes, no = prior[kind], 1 - prior[kind]
            for i, x in enumerate(v):
                yes, no = yes * rate[1][i][x], no * rate[0][i][x]
            new.append(yes / (yes + no))
        moved = max(abs(a - b) for a, b in zip(new, p))
        if moved < 1e-6:
            break
        p = new
    of = dict(zip(unique, got))
    assert max(abs(of[c] - x) for c, x in zip(codes, p)) < 1e-4
    assert abs(table[1, 2, 2] - rate[1][2][2]) < 1e-3


def test_more_sources_than_are_broadcast(spark, monkeypatch):
    rows = [(i, f"s{i % 300}" if i % 3 else "hot", "w" * (1 + i % 7), 1, 2, "k") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, parts int, size int, key string")
    want = sorted(map(tuple, mixing.mix(docs).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 10)
    got = mixing.mix(docs)
    assert sorted(map(tuple, got.collect())) == want and got.columns == [*docs.columns, "rate", "copy", "mix_key"]

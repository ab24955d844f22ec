"""Token alignment against the libraries over whole texts, with overlaps and counts by plain loops."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import token_align as align
from sparkloom.llm.queries import op12_align, tokenizer_path

BPE, PIECE = "byte_bpe_50k.json", "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def pair():
    with open(tokenizer_path(BPE), encoding="utf-8") as f, open(tokenizer_path(PIECE), "rb") as g:
        return align.Pair(f.read(), g.read())


def plain(pair, text):
    """Ids of the whole text, pairs of tokens whose byte ranges overlap, and groups; nothing if the bytes differ."""
    if not text:
        return [], [], []
    a, b = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
    bytes_a, bytes_b = ([table[i] for i in ids] for table, ids in ((pair.bytes_a, a), (pair.bytes_b, b)))
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return [], [], []

    def ends(parts):
        at, out = 0, []
        for p in parts:
            at += len(p)
            out.append(at)
        return out

    ends_a, ends_b = ends(bytes_a), ends(bytes_b)
    links, i, j = [], 0, 0
    while i < len(a):
        links.append((a[i], b[j]))
        x, y = ends_a[i], ends_b[j]
        i, j = i + (x <= y), j + (y <= x)
    both = set(ends_a) & set(ends_b)
    groups, own = [], ([], [])
    i = j = 0
    for end in sorted(both):
        while i < len(a) and ends_a[i] <= end:
            own[0].append(str(a[i]))
            i += 1
        while j < len(b) and ends_b[j] <= end:
            own[1].append(str(b[j]))
            j += 1
        groups.append("|".join(map(",".join, own)))
        own = ([], [])
    return a, b, links, groups


def brute(pair, docs):
    found = [(i, plain(pair, t)) for i, t in docs]
    held = Counter(link for _, f in found if f[0] for link in f[2])
    best = {}
    for (_, b), n in held.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for i, f in found:
        if not f[0]:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, links, groups = f
        out.append((i, len(a), len(b), len(groups), len(links), sum(held[x] == best[x[1]] for x in links), sum(held[x] for x in links),
                    hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=str)


ODD = ["a  b", " lead", "trail ", "trail  ", "a\n b", "a \n b", "a\n\n  b\n", "x▁y", "▁", "<|endoftext|> <s> <unk> <0x41>", "don't we'll", "naïve café 日本語 \U0001f600", "\x00 \x1f a", "a​ b", "a﻿ b c",
       "a　 b", "a\x85 b", "a᠎ b", "tab\t tab", "é ­ x", "   ", "\t", "}\r {\r\n x", "1234567 8,9.0", "ﬁ ﬂ ½ №"]


def test_odd_texts_equal_the_libraries(spark, pair):
    rng = random.Random(3)
    docs = list(enumerate(ODD + ["".join(rng.choices(ODD, k=4)) for _ in range(150)]))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert rows(align.score(frame, tokenizer_path(BPE), tokenizer_path(PIECE), block_bytes=300)) == sorted(brute(pair, docs), key=str)


def test_nulls_repeats_long_texts_and_empty_tables(spark, docs, empty, pair):
    own = [(r["doc_id"], r["text"]) for r in docs.collect()]
    more = docs.withColumn("block", F.lit("clash")).withColumn("pairs", F.lit(0))
    got = align.score(more, tokenizer_path(BPE), tokenizer_path(PIECE))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert rows(got) == sorted(brute(pair, own), key=str)
    assert align.score(empty, tokenizer_path(BPE), tokenizer_path(PIECE)).collect() == []
    none = align.score(docs.where("text IS NULL OR text = ''"), tokenizer_path(BPE), tokenizer_path(PIECE))
    assert rows(none) == [(3, 0, 0, 0, 0, 0, 0, ""), (4, 0, 0, 0, 0, 0, 0, "")]


def test_owner_arrays():
    """Bytes ab|c|def against a|bc|de|f: overlaps and the one inner cut."""
    sizes_a, sizes_b = np.array([2, 1, 3]), np.array([1, 2, 2, 1])
    at_a, at_b, cut = align.aligned(np.arange(3), np.arange(4), sizes_a, sizes_b)
    assert list(zip(at_a.tolist(), at_b.tolist())) == [(0, 0), (0, 1), (1, 1), (2, 2), (2, 3)]
    assert cut.tolist() == [0, 3]


def test_query_over_whole_tables(spark, pair):
    folder = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = rows(op12_align(spark, folder))
    assert got == sorted(brute(pair, docs), key=str)
    assert sum(r[1] > 0 for r in got) > 0.95 * len(got)

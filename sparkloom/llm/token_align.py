"""Alignment of the tokens of two tokenizers by byte-owner arrays.

Both tokenizers cut the same bytes. Repeating each token's index over its bytes gives two arrays of owners; wherever the
pair of owners changes, a new pair of tokens overlaps, and wherever both change at once, both tokenizations have a cut.
Between a sign that is no white space and a space neither tokenizer lets a token pass (``Pair`` makes sure of it), so
texts fall into chunks that are tokenized and aligned once in a worker, all new ones of a slice together.

Documents are worked on in blocks of bounded size. A block keeps its chunks' links once, and each document as a list of
its chunks; how many links hold a pair of ids is added up over all blocks, joined back to the blocks that hold the pair
and applied to the documents of each block.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, checkpoint, release, remove, slices, stored

#: Bytes of text of a block, and chunks that a worker keeps between blocks. Neither changes a result.
BLOCK_BYTES = 16 << 20
KEPT = 250_000
#: White space, with the signs on which libraries differ about that, and where a text may be cut.
SPACE = r"\s\x1c-\x1f\x85᠎​﻿"
CUT = re.compile(rf"(?<=[^{SPACE}])(?= )")
#: A text without this falls into chunks at every space.
SPACED = re.compile(rf"[{SPACE}] ")
MARK = "▁"


class Pair:
    """Two tokenizers: A byte-level BPE in a JSON file's text, B a SentencePiece model's bytes."""

    def __init__(self, bpe_json: str, piece_model: bytes) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_str(bpe_json)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
        vocab = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes_a[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.sizes_a, self.sizes_b = (np.array([len(t) for t in x], np.int64) for x in (self.bytes_a, self.bytes_b))
        spec = json.loads(bpe_json)
        if spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or not spec["pre_tokenizer"].get("use_regex", True):
            raise ValueError("A must be byte-level BPE over the pre-tokens of its pattern, which never pass from a sign to a space")
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
            raise ValueError("a piece of B passes from a sign to a space, so texts can't be cut there")

    def encode(self, chunks: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both tokenizers for chunks that begin with a space; B adds that space itself."""
        a = [e.ids for e in self.a.encode_batch_fast(chunks, add_special_tokens=False)]
        return a, self.b.encode([c[1:] for c in chunks], num_threads=1)


def chunks_of(text: str) -> list[str]:
    """A text, with a space before it, in chunks that begin with a space and have more than that."""
    if SPACED.search(text) or text.startswith(" "):
        found = CUT.split(" " + text)
    else:
        found = [" " + word for word in text.split(" ")]
    return [*found[:-2], found[-2] + " "] if found[-1] == " " else found


def owners(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The index of the token that owns each byte."""
    return np.repeat(np.arange(len(ids)), sizes[ids])


def aligned(a: np.ndarray, b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping tokens of A and B as two arrays of indices, and of these pairs the places of those that begin a group."""
    own_a, own_b = owners(a, sizes_a), owners(b, sizes_b)
    new_a, new_b = (np.r_[True, x[1:] != x[:-1]] if len(x) else np.zeros(0, bool) for x in (own_a, own_b))
    begins = np.flatnonzero(new_a | new_b)
    return own_a[begins], own_b[begins], np.flatnonzero((new_a & new_b)[begins])


class Chunks:
    """What a worker knows of the chunks that it met: numbers of tokens, groups and links, the groups' text, the links."""

    def __init__(self, pair: Pair) -> None:
        self.pair = pair
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.groups: list[str] = []
        self.parts: list[np.ndarray] = []
        self.links: list[np.ndarray] = []
        self.counts, self.link, self.begin = np.zeros((0, 5), np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64)

    def learn(self, chunks: Iterable[str]) -> None:
        """Tokenizes and aligns all these chunks at once."""
        new = list(set(chunks) - self.number.keys())
        if not new:
            return
        p = self.pair
        ids_a, ids_b = p.encode(new)
        whole = np.fromiter(
            (c.encode() == b"".join(map(p.bytes_a.__getitem__, x)) == b"".join(map(p.bytes_b.__getitem__, y)) for c, x, y in zip(new, ids_a, ids_b)), bool, len(new)
        )
        ids_a, ids_b = ([x if w else [] for x, w in zip(ids, whole)] for ids in (ids_a, ids_b))
        n_a, n_b = (np.fromiter(map(len, ids), np.int64, len(new)) for ids in (ids_a, ids_b))
        a, b = (np.fromiter((i for x in ids for i in x), np.int64, int(n.sum())) for ids, n in ((ids_a, n_a), (ids_b, n_b)))
        at_a, at_b, cut = aligned(a, b, p.sizes_a, p.sizes_b)
        # the first token of a chunk begins a group, so neither links nor groups pass from one chunk to the next
        end_a = np.cumsum(n_a)
        owner = np.searchsorted(end_a, at_a, side="right")
        n_links = np.bincount(owner, minlength=len(new))
        n_groups = np.bincount(owner[cut], minlength=len(new))
        text_a, text_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
        first_a, first_b = np.append(at_a[cut], len(a)).tolist(), np.append(at_b[cut], len(b)).tolist()
        groups = [
            f"{','.join(text_a[s:t])}|{','.join(text_b[u:v])}"
            for s, t, u, v in zip(first_a, first_a[1:], first_b, first_b[1:])
        ]
        at = 0
        for chunk, n in zip(new, n_groups.tolist()):
            self.number[chunk] = len(self.groups)
            self.groups.append(";".join(groups[at : at + n]))
            at += n
        self.parts.append(np.column_stack([n_a, n_b, n_groups, n_links, whole]))
        self.links.append(a[at_a] << 32 | b[at_b])

    def settle(self) -> None:
        """Joins what was learnt since the last call to the arrays."""
        if self.parts:
            self.counts = np.concatenate([self.counts, *self.parts])
            self.link = np.concatenate([self.link, *self.links])
            self.begin = np.r_[0, np.cumsum(self.counts[:, 3])]
            self.parts, self.links = [], []


@lru_cache(maxsize=1)
def known_chunks(bpe_json: str, piece_model: bytes) -> Chunks:
    """The chunks that this worker knows, whatever its task."""
    return Chunks(Pair(bpe_json, piece_model))


def ranges(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All places of the ranges begin[i] .. end[i], one after the other."""
    n = end - begin
    return np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())


def sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of these sizes, which may be 0."""
    total = np.cumsum(np.concatenate([np.zeros((1, *values.shape[1:]), np.int64), values]), 0)
    end = np.cumsum(sizes)
    return total[end] - total[end - sizes]


def align(docs: DataFrame, bpe_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, str]:
    """Blocks of aligned documents as a table in a folder, and the folder: rows for documents and one row for each block.

    A document has ``id_col, n_a, n_b, n_groups, n_links, groups_sha256`` and ``uses``, its chunks as places in its
    block's row; that one has ``pairs`` (A id << 32 | B id), how often the block's links hold each (``held``), and for
    its chunks ``sizes`` (links of each) and ``links`` (their pairs' places). Vocabularies are read on the driver and
    sent with the tasks; their size is fixed.
    """
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    ints, longs = T.ArrayType(T.IntegerType()), T.ArrayType(T.LongType())
    schema = T.StructType(
        [
            T.StructField("block", T.LongType()),
            rows.schema[0],
            *(T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups", "n_links")),
            T.StructField("groups_sha256", T.StringType()),
            T.StructField("uses", ints),
            T.StructField("pairs", longs),
            T.StructField("held", longs),
            T.StructField("sizes", ints),
            T.StructField("links", ints),
        ]
    )
    arrow = arrow_schema(schema)
    with open(bpe_path, encoding="utf-8") as f, open(piece_path, "rb") as g:
        shared = docs.sparkSession.sparkContext.broadcast((f.read(), g.read()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = known_chunks(*shared.value)
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for block in slices(batch, 1, block_bytes):
                if len(chunks.number) > KEPT:
                    chunks.clear()
                yield from aligned_block(block, number, chunks, arrow)
                number += 1
            release()

    return stored(rows.mapInArrow(run, schema))


def aligned_block(block: pa.RecordBatch, number: int, chunks: Chunks, arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The rows of a block."""
    uses: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    hashes: list[str] = []
    for part in slices(block, 1):
        cut = [chunks_of(t) if t else [] for t in part.column(1).to_pylist()]
        chunks.learn(c for own in cut for c in own)
        chunks.settle()
        for own in cut:
            of = np.fromiter(map(chunks.number.__getitem__, own), np.int64, len(own))
            if not chunks.counts[of, 4].all():  # a token's bytes are not the text's: no tokens
                of = of[:0]
            uses.append(of)
            counts.append(chunks.counts[of, :4].sum(0))
            hashes.append(hashlib.sha256(";".join(map(chunks.groups.__getitem__, of.tolist())).encode()).hexdigest() if len(of) else "")
    sizes = np.fromiter(map(len, uses), np.int64, len(uses))
    flat = np.concatenate(uses)
    times = np.bincount(flat, minlength=len(chunks.groups))
    known = np.flatnonzero(times)
    local = np.cumsum(times > 0) - 1
    size = chunks.counts[known, 3]
    link = chunks.link[ranges(chunks.begin[known], chunks.begin[known + 1])]
    pairs, place = np.unique(link, return_inverse=True)
    held = sums_by(place.ravel(), np.repeat(times[known], size), len(pairs))
    at = pa.array(np.r_[0, np.cumsum(sizes)], pa.int32())
    n = len(uses)
    own = {
        "block": pa.array(np.full(n, number)),
        arrow.names[1]: block.column(0),
        **{name: pa.array([c[i] for c in counts], pa.int64()) for i, name in enumerate(("n_a", "n_b", "n_groups", "n_links"))},
        "groups_sha256": pa.array(hashes, pa.string()),
        "uses": pa.ListArray.from_arrays(at, pa.array(local[flat], pa.int32())),
    }
    yield pa.RecordBatch.from_arrays([own[f.name].cast(f.type) if f.name in own else pa.nulls(n, f.type) for f in arrow], schema=arrow)
    if len(known):
        own = {"block": [number], "pairs": [pairs], "held": [held], "sizes": [size], "links": [place.ravel()]}
        yield pa.RecordBatch.from_arrays([pa.array(own.get(f.name, [None]), f.type) for f in arrow], schema=arrow)


def sums_by(place: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Whole sums of the values of each place."""
    out = np.zeros(size, np.int64)
    np.add.at(out, place, values)
    return out


def pair_counts(blocks: DataFrame) -> DataFrame:
    """``a, b, links, best``: how many links of the corpus hold each pair of ids, and whether none with the same ``b`` has more."""
    pairs = blocks.where("pairs IS NOT NULL").select(F.explode(F.arrays_zip("pairs", "held")).alias("x")).select("x.pairs", "x.held")
    links = pairs.groupBy("pairs").agg(F.sum("held").alias("links"))
    links = links.select("pairs", F.shiftright("pairs", 32).alias("a"), F.col("pairs").bitwiseAND(2**32 - 1).alias("b"), "links")
    most = links.groupBy("b").agg(F.max("links").alias("most"))  # one row for each piece of B at most
    return links.join(F.broadcast(most), "b").select("pairs", "a", "b", "links", (F.col("links") == F.col("most")).alias("best"))


def score(docs: DataFrame, bpe_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every whole text.

    A is byte-level BPE over a space and the text, B a SentencePiece model, which adds the space itself; special tokens'
    strings are plain text. Groups are cut where tokens of both end; links are overlapping pairs of tokens. ``n_best``
    counts links whose pair is the most frequent of the corpus for its B id, ``count_sum`` adds up how often each link's
    pair is linked in the corpus. Null and empty texts, and those that B does not give back (such as ones with U+2581), have no
    tokens: zeros and "". Repeated rows count and are returned as often as they are there; an empty table gives an empty
    one; other columns are ignored; very long texts are aligned whole. The intermediate table in the shared folder is
    deleted before this returns; the result is a checkpoint.
    """
    blocks, path = align(docs, bpe_path, piece_path, id_col, text_col, block_bytes)
    pairs = pair_counts(blocks)
    wanted = blocks.where("pairs IS NOT NULL").select(F.col("block").alias("of_block"), F.posexplode("pairs").alias("place", "pairs"))
    values = wanted.join(pairs, "pairs").select("of_block", "place", "links", "best")
    own = docs.select(id_col).schema[0]
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    schema = T.StructType([own, *(T.StructField(n, T.LongType()) for n in names), T.StructField("groups_sha256", T.StringType())])
    arrow = arrow_schema(schema)

    def apply(block: pa.Table, values: pa.Table) -> pa.Table:
        is_doc = block.column("uses").is_valid()
        documents = block.filter(is_doc).combine_chunks()
        table = block.filter(pc.invert(is_doc))
        found = np.zeros((documents.num_rows, 2), np.int64)
        if table.num_rows:
            value = np.zeros((values.num_rows, 2), np.int64)
            place = values.column("place").to_numpy()
            value[place, 0] = values.column("best").to_numpy().astype(np.int64)
            value[place, 1] = values.column("links").to_numpy()
            sizes, links = (table.column(n).combine_chunks().flatten().to_numpy() for n in ("sizes", "links"))
            chunk = sums(value[links], sizes.astype(np.int64))
            uses = documents.column("uses")
            flat = np.concatenate([c.flatten().to_numpy() for c in uses.chunks] or [np.zeros(0, np.int64)])
            found = sums(chunk[flat], pc.list_value_length(uses).to_numpy().astype(np.int64))
        made = {"n_best": pa.array(found[:, 0]), "count_sum": pa.array(found[:, 1])}
        return pa.Table.from_arrays([made[f.name] if f.name in made else documents.column(f.name).cast(f.type) for f in arrow], schema=arrow)

    scored = blocks.drop("pairs", "held").groupBy("block").cogroup(values.groupBy("of_block")).applyInArrow(apply, schema)
    kept = checkpoint(scored)
    remove(docs.sparkSession, path)
    return kept

"""Token counts of byte-level BPE vocabularies by rank-synchronous merging of ragged arrays.

Texts are cut into pre-tokens by the vocabulary's pattern. Pre-tokens that a task meets for the first time are held
together as one ragged array of symbols; in every round each sequence applies its own lowest-ranked pair at all places
at once, and the symbols that survive are counted. Since a merged symbol only takes part in merges of higher rank than
the one that made it, this gives the same symbols as merging one pair after the other.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts

#: Fixed value: the pre-token pattern of this family of vocabularies, with white space as its library defines it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Pieces of text that never share a pre-token: a word with the space before it, or white space alone.
CHUNK = re.compile(r" ?\S+|\s+(?!\S)|\s+")

#: Characters on which the two regular-expression libraries may differ about white space; rare, handled apart.
ODD_SPACE = re.compile(r"[\x1c-\x1f\x85\u180e\u200b\ufeff]")

#: Chunks whose counts a task keeps; when there are more, it starts anew. This changes no result.
KEPT = 150_000

NONE = np.int32(2**31 - 1)


@lru_cache(maxsize=4)
def load(path: str) -> dict:
    """The merge table of a tokenizer file: sorted pair keys with ranks and merged symbols, and each byte's symbol."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec["pre_tokenizer"]
    if model["type"] != "BPE" or pre["type"] != "ByteLevel" or spec["normalizer"] or model.get("ignore_merges"):
        raise ValueError("only byte-level BPE without normalisation is supported")
    vocab = model["vocab"]
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    char = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}
    pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
    width = max(vocab.values()) + 1
    keys = np.array([vocab[a] * width + vocab[b] for a, b in pairs], np.int64)
    order = np.argsort(keys, kind="stable")
    return {
        "keys": keys[order],
        "ranks": order.astype(np.int32),
        "merged": np.array([vocab[a + b] for a, b in pairs], np.int32)[order],
        "bytes": np.array([vocab[char[b]] for b in range(256)], np.int32),
        "width": width,
        "special": [x["content"] for x in spec["added_tokens"]],
        "prefix_space": pre["add_prefix_space"],
    }


def count_symbols(tokens: list[str], vocab: dict) -> np.ndarray:
    """The number of symbols of each pre-token after all merges; pre-tokens must not be empty."""
    coded = [t.encode() for t in tokens]
    sizes = np.fromiter(map(len, coded), np.int64, len(coded))
    symbols = vocab["bytes"][np.frombuffer(b"".join(coded), np.uint8)]
    owner = np.repeat(np.arange(len(coded)), sizes)
    counts = np.ones(len(coded), np.int64)
    keys, width, top = vocab["keys"], vocab["width"], len(vocab["keys"]) - 1

    def ranked(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of the pair that begins at each place, NONE where there is no merge."""
        nxt = np.minimum(at + 1, len(symbols) - 1)
        key = symbols[at].astype(np.int64) * width + symbols[nxt]
        found = np.minimum(np.searchsorted(keys, key), top)
        fits = (keys[found] == key) & (owner[nxt] == owner[at]) & (nxt > at)
        return np.where(fits, vocab["ranks"][found], NONE), vocab["merged"][found]

    rank, merged = ranked(np.arange(len(symbols)))
    while len(symbols):
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        least = np.minimum.reduceat(rank, starts)
        lengths = np.diff(np.r_[starts, len(symbols)])
        done = least == NONE
        if done.any():
            counts[owner[starts[done]]] = lengths[done]
            stay = np.repeat(~done, lengths)
            symbols, owner, rank, merged = symbols[stay], owner[stay], rank[stay], merged[stay]
            least, lengths = least[~done], lengths[~done]
            if not len(symbols):
                break
        at = np.flatnonzero(rank == np.repeat(least, lengths))
        if len(at) > 1:  # of pairs that overlap, as in "aaa", every second one is merged
            run = np.r_[True, np.diff(at) > 1]
            place = np.arange(len(at))
            at = at[(place - np.maximum.accumulate(np.where(run, place, 0))) % 2 == 0]
        symbols[at] = merged[at]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        symbols, owner, rank, merged = symbols[keep], owner[keep], rank[keep], merged[keep]
        here = at - np.arange(len(at))
        touched = np.r_[here, here[here > 0] - 1]
        rank[touched], merged[touched] = ranked(touched)
    return counts


def counter(vocab: dict) -> Callable[[list[str]], list[int]]:
    """A function that counts the tokens of each text of a list."""
    special = vocab["special"]
    apart = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
    find = regex.compile(PATTERN).findall
    kept: dict[str, int] = {}

    def chunks(text: str) -> tuple[list[str], int]:
        """Pieces that can be counted apart, and the number of special tokens between them."""
        if apart is not None and any(x in text for x in special):
            parts = apart.split(text)
            return [c for p in parts for c in chunks(p)[0]], len(parts) - 1
        if vocab["prefix_space"] and text[:1].strip():
            text = f" {text}"
        return find(text) if ODD_SPACE.search(text) else CHUNK.findall(text), 0

    def count(texts: list[str]) -> list[int]:
        if len(kept) > KEPT:
            kept.clear()
        cut = [chunks(t) for t in texts]
        new = list(set().union(*(c for c, _ in cut)) - kept.keys())
        if new:
            parts = [find(c) for c in new]
            tokens = list(set().union(*parts))
            size = dict(zip(tokens, count_symbols(tokens, vocab).tolist()))
            kept.update((c, sum(map(size.__getitem__, p))) for c, p in zip(new, parts))
        return [sum(map(kept.__getitem__, c)) + more for c, more in cut]

    return count


def count_tokens(
    docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Tokens of every text: ``id_col, n_bytes, n_tokens, over_limit``.

    The vocabulary is read on the driver and sent with the task (its size is fixed, about 1 MB), so executors need no
    copy. A null text counts as empty: no bytes, no tokens. Repeated rows give repeated rows; an empty table gives an
    empty one; other columns are ignored, whatever their names. Very long texts are counted whole.
    """
    vocab = load(path)
    name = docs.select(id_col).schema[0]
    schema = T.StructType(
        [
            name,
            T.StructField("n_bytes", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("over_limit", T.BooleanType()),
        ]
    )
    shared = docs.sparkSession.sparkContext.broadcast(vocab)

    def make():
        count = counter(shared.value)

        def work(part, texts):
            tokens = count(texts)
            return {
                id_col: part.column(0),
                "n_bytes": [len(t.encode()) for t in texts],
                "n_tokens": tokens,
                "over_limit": [n > limit for n in tokens],
            }

        return work

    return map_texts(docs.select(F.col(id_col), F.col(text_col).cast("string")), [id_col, text_col], text_col, make, schema)

"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

A model file gives the pieces. Each piece has a log score; the best segmentation of a text is the one whose scores sum
highest (on ties the one whose earlier piece is longer). A character that no piece covers is spelt in byte pieces.
Spaces become the marker U+2581 and one marker is put before the text; decoding turns markers into spaces and removes
that first one. A marker character that a text itself holds is spelt in bytes, so decoding gives back every text
exactly.

Encoding works on units, a word with the markers before it, which no piece crosses; that is checked when the model is
read. A task segments all units that are new to it at once: the trie is walked from all characters together, then
Viterbi goes over the units position by position, both in numpy.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts

MARK = "▁"

#: Units whose pieces a task keeps; when there are more, it starts anew. This changes no result.
KEPT = 120_000

#: Bytes up to which units are segmented together; longer ones are segmented one by one.
TOGETHER = 96

#: Scores are summed as whole multiples of this, so that equal sums are equal whatever the order of adding.
UNIT = 2.0**-20

#: An unknown character costs this much more than the worst piece (fixed value of the unigram model).
UNKNOWN_PENALTY = 10.0


def double_array(words: list[bytes], values: list[int]) -> dict[str, np.ndarray]:
    """``words`` as arrays ``base, check, value``: byte b leads from state s to t = base[s] + b where check[t] == s."""
    children: list[dict[int, int]] = [{}]
    final = {}
    for word, value in zip(words, values):
        node = 0
        for b in word:
            if b not in children[node]:
                children[node][b] = len(children)
                children.append({})
            node = children[node][b]
        final[node] = value
    size = 6 * len(children) + 4096
    base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    used = bytearray(size)
    used[0] = 1
    state, order = {0: 0}, [0]
    lone, several = 1, 1  # where the search for a free slot begins: the first hole, and behind the last wide node
    for node in order:
        codes = sorted(children[node])
        if not codes:
            continue
        at = max(lone if len(codes) == 1 else several, codes[0])
        while used[at] or any(used[at - codes[0] + c] for c in codes):
            at += 1
        if len(codes) > 1:
            several = at
        elif at > codes[0]:
            lone = at
        shift = at - codes[0]
        base[state[node]] = shift
        for c in codes:
            child = children[node][c]
            used[shift + c], check[shift + c], state[child] = 1, state[node], shift + c
            value[shift + c] = final.get(child, -1)
            order.append(child)
    end = max(state.values()) + 257
    return {"base": base[:end], "check": check[:end], "value": value[:end]}


@lru_cache(maxsize=4)
def load(path: str, scores: str = "rank") -> dict:
    """The pieces of a model file as a trie with scores.

    ``scores="stored"`` takes the scores in the file. Files of merge models hold no log probabilities but ranks; for
    these ``scores="rank"`` gives the piece of rank r the log probability of Zipf's law, -ln(r + 1) - ln(H), where H
    makes the probabilities sum to one.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kinds = [
        "byte" if model.is_byte(i) else "other" if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else "piece"
        for i in range(model.get_piece_size())
    ]
    text = [model.id_to_piece(i) for i in range(len(kinds))]
    ids = [i for i, k in enumerate(kinds) if k == "piece" and text[i]]
    if any(MARK in text[i].lstrip(MARK) for i in ids):
        raise ValueError("a piece has a marker after another character; units can't be segmented apart")
    score = np.zeros(len(kinds), np.float64)
    if scores == "stored":
        score[ids] = [model.get_score(i) for i in ids]
    else:
        score[ids] = -np.log(np.arange(1, len(ids) + 1))
        score[ids] -= np.log(np.exp(score[ids]).sum())
    coded = [text[i].encode() for i in ids]
    byte_ids = np.full(256, model.unk_id(), np.int32)
    spelt = [b""] * len(kinds)
    for i, k in enumerate(kinds):
        if k == "byte":
            byte_ids[int(text[i][3:-1], 16)] = i
            spelt[i] = bytes([int(text[i][3:-1], 16)])
    for i, x in zip(ids, coded):
        spelt[i] = x.replace(MARK.encode(), b" ")
    return double_array(coded, ids) | {
        "score": np.rint(score / UNIT).astype(np.int64),
        "unknown": round(float(score[ids].min() - UNKNOWN_PENALTY) / UNIT),
        "longest": max(map(len, coded)),
        "byte_ids": byte_ids,
        "spelt": spelt,
        "newline_apart": not any("\n" in text[i] for i in ids),
    }


def _edges(units: list[bytes], model: dict) -> dict[str, np.ndarray]:
    """All places where a piece fits: its unit, first and last node, piece (-1: a character to be spelt in bytes).

    Nodes number the gaps between bytes: unit u begins at node ``first[u]`` and ends at ``last[u]``.
    """
    sizes = np.fromiter(map(len, units), np.int64, len(units))
    data = np.frombuffer(b"".join(units), np.uint8)
    owner = np.repeat(np.arange(len(units)), sizes)
    begins = np.r_[0, np.cumsum(sizes)]
    place = np.flatnonzero((data & 0xC0) != 0x80)
    stop = begins[owner[place] + 1]
    width = np.minimum(np.r_[place[1:], len(data)], stop) - place
    base, check, value = model["base"], model["check"], model["value"]
    state, alive = np.zeros(len(place), np.int64), np.arange(len(place))
    covered = np.zeros(len(place), bool)
    found = []
    for depth in range(model["longest"]):
        alive = alive[place[alive] + depth < stop[alive]]
        if not len(alive):
            break
        s = state[alive]
        t = base[s] + data[place[alive] + depth].astype(np.int64)
        fits = check[t] == s
        alive, t = alive[fits], t[fits]
        state[alive] = t
        hit = value[t] >= 0
        if hit.any():
            found.append((alive[hit], np.full(int(hit.sum()), depth + 1), value[t[hit]]))
            covered[alive[hit][width[alive[hit]] == depth + 1]] = True
    bare = np.flatnonzero(~covered)
    found.append((bare, width[bare], np.full(len(bare), -1)))
    start, length, piece = (np.concatenate(x).astype(np.int64) for x in zip(*found))
    unit = owner[place[start]]
    node = place[start] + unit
    return {
        "from": node,
        "to": node + length,
        "piece": piece,
        "rel": place[start] - begins[unit],
        "gain": np.where(piece >= 0, model["score"][piece], model["unknown"]),
        "first": begins[:-1] + np.arange(len(units)),
        "last": begins[1:] + np.arange(len(units)),
        "data": data,
    }


def segment(units: list[bytes], model: dict) -> list[bytes]:
    """The best pieces of each unit as little-endian int32 ids; units are non-empty UTF-8."""
    if not units:
        return []
    e = _edges(units, model)
    order = np.lexsort((e["to"] - e["from"], e["rel"]))
    src, dst, gain = e["from"][order], e["to"][order], e["gain"][order]
    best = np.full(int(e["last"][-1]) + 1, -(2**62))
    best[e["first"]] = 0
    back = np.zeros(len(best), np.int64)
    if len(units) == 1:
        score, via = best.tolist(), back.tolist()
        for i, (a, b, g) in enumerate(zip(src.tolist(), dst.tolist(), gain.tolist())):
            if score[a] + g > score[b]:
                score[b], via[b] = score[a] + g, i
        back = np.array(via)
    else:
        step = e["rel"][order] * (model["longest"] + 8) + (dst - src)
        for i, j in zip(cuts := np.r_[0, np.flatnonzero(np.diff(step)) + 1, len(step)], cuts[1:]):
            reached = best[src[i:j]] + gain[i:j]
            better = np.flatnonzero(reached > best[dst[i:j]])
            at = dst[i:j][better]
            best[at] = reached[better]
            back[at] = better + i
    used = []
    unit, node = np.arange(len(units)), e["last"].copy()
    while len(unit):
        edge = back[node]
        used.append((unit, edge))
        node = src[edge]
        more = node > e["first"][unit]
        unit, node = unit[more], node[more]
    unit = np.concatenate([u for u, _ in used][::-1])
    edge = np.concatenate([x for _, x in used][::-1])
    edge = edge[np.argsort(unit, kind="stable")]
    owner = np.sort(unit)
    piece = e["piece"][order][edge]
    times = np.where(piece < 0, dst[edge] - src[edge], 1)
    ids = np.repeat(piece, times)
    spelt = np.flatnonzero(ids < 0)
    nth = np.arange(len(ids)) - np.repeat(np.cumsum(times) - times, times)
    node_of = np.repeat(src[edge], times) + nth - np.repeat(owner, times)
    ids[spelt] = model["byte_ids"][e["data"][node_of[spelt]]]
    ends = np.cumsum(np.bincount(np.repeat(owner, times), minlength=len(units))) * 4
    raw = ids.astype("<i4").tobytes()
    return [raw[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]


def encoder(model: dict) -> Callable[[list[str]], list[bytes]]:
    """A function from texts to their piece ids, as little-endian int32 bytes; an empty text has none."""
    units = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+" if model["newline_apart"] else f"{MARK}*[^{MARK}]+|{MARK}+").findall
    kept: dict[str, bytes] = {}
    spelling = model["byte_ids"][list(MARK.encode())].astype("<i4").tobytes()

    def learn(new: list[str]) -> None:
        together = [u for u in new if len(u) * 4 <= TOGETHER]
        kept.update(zip(together, segment([u.encode() for u in together], model)))
        for u in new:
            if u not in kept:
                kept[u] = segment([u.encode()], model)[0]

    def encode(texts: list[str]) -> list[bytes]:
        if len(kept) > KEPT:
            kept.clear()
        # a marker that a text holds parts it; between the parts it is spelt in bytes
        cut = [[units(part.replace(" ", MARK)) for part in f" {t}".split(MARK)] if t else [] for t in texts]
        new = {u for parts in cut for part in parts for u in part} - kept.keys()
        if new:
            learn(list(new))
        return [spelling.join(b"".join(map(kept.__getitem__, part)) for part in parts) for parts in cut]

    return encode


def decode(ids: np.ndarray, model: dict) -> str:
    """The text of piece ids."""
    text = b"".join(map(model["spelt"].__getitem__, ids.tolist())).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


def encode_decode(
    docs: DataFrame,
    path: str,
    scores: str = "rank",
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_ids: bool = True,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Piece ids of every whole text and the text decoded from them again.

    Returns ``id_col``, the columns named in ``keep``, then ``n_bytes, n_pieces, n_spelt (pieces that are bytes), piece_ids (array of int, if keep_ids),
    decoded, ids_sha256``. A null text counts as empty: no pieces, decoded "". Repeated rows give repeated rows, an
    empty table an empty one; other columns are ignored, whatever their names. The model is read on the driver and
    sent with the task: its size is that of its fixed vocabulary.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load(path, scores))
    fields = [
        *docs.select(id_col, *keep).schema,
        T.StructField("n_bytes", T.LongType()),
        T.StructField("n_pieces", T.LongType()),
        T.StructField("n_spelt", T.LongType()),
        *([T.StructField("piece_ids", T.ArrayType(T.IntegerType()))] if keep_ids else []),
        T.StructField("decoded", T.StringType()),
        T.StructField("ids_sha256", T.StringType()),
    ]

    def make():
        import pyarrow as pa

        model = shared.value
        encode = encoder(model)
        is_byte = np.zeros(len(model["score"]), bool)
        is_byte[model["byte_ids"]] = True

        def work(part, texts):
            raw = encode(texts)
            arrays = [np.frombuffer(x, "<i4") for x in raw]
            out = {
                **{c: part.column(i) for i, c in enumerate([id_col, *keep])},
                "n_bytes": [len(t.encode()) for t in texts],
                "n_pieces": [len(a) for a in arrays],
                "n_spelt": [int(is_byte[a].sum()) for a in arrays],
                "decoded": [decode(a, model) for a in arrays],
                "ids_sha256": [hashlib.sha256(x).hexdigest() for x in raw],
            }
            if keep_ids:
                ends = np.r_[0, np.cumsum([len(a) for a in arrays])].astype(np.int32)
                out["piece_ids"] = pa.ListArray.from_arrays(ends, np.concatenate([*arrays, np.zeros(0, "<i4")]).astype(np.int32))
            return out

        return work

    return map_texts(
        docs.select(id_col, *keep, F.col(text_col).cast("string").alias("__text")), [id_col, *keep, "__text"], "__text", make, T.StructType(fields)
    )

"""Near-duplicates by SimHash: tiled exact comparison with exclusive-or and bit counts in numpy.

Rows are first reduced to their distinct fingerprints. Two fingerprints within ``radius`` bits agree on at least
``BLOCKS - radius`` of the fingerprint's blocks, so each is sent to the tiles of all choices of that many blocks; a
link is found in the first of these where both agree and no link is lost. Within a tile, rows stand in the order of
their bit counts and are compared square by square by exclusive-or and bit count; squares whose bit counts lie further
apart than the radius are skipped. Groups that share a tile key in great number are cut into squares that are spread over the tasks.
A task hands on a spanning forest of what it links, so that a tile of n rows never yields more than n - 1 links for a square side.

``near_groups`` links texts by their sets of shingles: tiles are then bands of least hashes, the comparison in tiles finds
who may be alike, and the sets decide.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, map_texts, shuffle_partitions, slices
from .components import connected_components

SEED = 42
#: Rows of a square's side. A tile of more rows is cut into squares that go to different tasks.
SQUARE = 512
#: Large tiles up to which their table (16 bytes each) is broadcast.
BROADCAST_TILES = 1_000_000


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 (seed 42) of the text's word shingles, repeats included; A-Z count as a-z."""
    w = text.encode().lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    if len(w) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), SEED)], np.uint64)
    rows = map(b" ".join, zip(*(w[i:] for i in range(words))))
    return np.fromiter(map(xxhash.xxh64_intdigest, rows, repeat(SEED)), np.uint64, len(w) - words + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in more than half of the hashes; 0 for no hashes."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        part = hashes[i : i + (1 << 14)].astype("<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits((2 * counts > len(hashes)).astype(np.uint8), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, fp``: the fingerprint of each whole text as a long with the same 64 bits; null counts as empty."""
    schema = T.StructType([docs.select(id_col).schema[0], T.StructField("fp", T.LongType())])

    def make():
        def work(part, texts):
            fps = np.array([fingerprint(shingle_hashes(t, words)) for t in texts], np.uint64)
            return {id_col: part.column(0), "fp": fps.view(np.int64)}

        return work

    return map_texts(
        docs.select(F.col(id_col), F.col(text_col).cast("string")), [id_col, text_col], text_col, make, schema
    )


def block_choices(radius: int) -> tuple[list[tuple[int, int]], list[tuple[int, ...]]]:
    """Blocks (first bit, bits) and the choices of blocks of which two fingerprints within ``radius`` agree on one."""
    n = radius + 2
    edges = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])], list(combinations(range(n), 2))


def _squares(values: np.ndarray, other: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) with values[i] and other[j] within ``radius`` bits. Both must be in order of their bit counts."""
    left, right = [], []
    a, b = np.bitwise_count(values).astype(np.int64), np.bitwise_count(other).astype(np.int64)
    side = 256
    for i in range(0, len(values), side):
        part = values[i : i + side]
        lo = np.searchsorted(b, a[i] - radius)
        hi = np.searchsorted(b, a[min(i + side, len(a)) - 1] + radius, side="right")
        for j in range(int(lo), int(hi), SQUARE):
            near = np.bitwise_count(part[:, None] ^ other[None, j : min(j + SQUARE, int(hi))]) <= radius
            x, y = np.nonzero(near)
            left.append(x + i)
            right.append(y + j)
    empty = [np.zeros(0, np.int64)]
    return np.concatenate(left + empty), np.concatenate(right + empty)


class Forest:
    """Union-find over the rows of one task; ``join`` says whether two rows were apart."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def links(fps: DataFrame, radius: int) -> DataFrame:
    """``a, b``: links between distinct fingerprints ``fp`` that connect all that are chained by ``radius`` or fewer bits."""
    blocks, choices = block_choices(radius)
    keys = F.array(
        *(
            F.xxhash64(F.lit(k), *(F.shiftrightunsigned("fp", blocks[b][0]).bitwiseAND((1 << blocks[b][1]) - 1) for b in choice))
            for k, choice in enumerate(choices)
        )
    )
    keyed = fps.select(F.col("fp").alias("node"), "fp", F.explode(keys).alias("tile"))
    return compare(keyed, radius)


def squares(keyed: DataFrame, payload: list[str], weight: str | None = None, diagonal: bool = False) -> DataFrame:
    """``tile, x, y, part`` and ``payload`` of ``keyed (tile, node, ...)``, dealt and sorted by square (tile, x, y).

    Rows alone in their square have no partner there and go. A tile of more than ``SQUARE`` rows, or of more ``weight``
    than ``ELEMENTS``, is cut into parts; its squares are all pairs of parts, and a row stands in the squares of its
    part. With ``diagonal``, parts are not paired; the row whose ``pivot`` is true stands in all of them instead.
    """
    n = shuffle_partitions(keyed.sparkSession)
    heavy = F.sum(weight) / F.lit(ELEMENTS) if weight else F.lit(0.0)
    size = keyed.groupBy("tile").agg(F.ceil(F.greatest(F.count("*") / SQUARE, heavy)).cast("int").alias("parts"))
    # only large tiles have several parts; they are few, and none of their rows meet before they are dealt to squares
    large = checkpoint(size.where("parts > 1"))
    row = keyed.join(F.broadcast(large) if large.count() <= BROADCAST_TILES else large, "tile", "left").fillna({"parts": 1})
    row = row.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    if diagonal:
        own = F.when(F.col("pivot"), every).otherwise(F.array("part"))
        other = F.transform(own, lambda o: F.struct(o.alias("x"), o.alias("y")))
    else:
        other = F.transform(every, lambda o: F.struct(F.least(F.col("part"), o).alias("x"), F.greatest(F.col("part"), o).alias("y")))
    row = row.withColumn("s", F.explode(other)).select("tile", "s.x", "s.y", "part", *payload).repartition(n, "tile", "x", "y")
    square = Window.partitionBy("tile", "x", "y").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # the window's partitioning and order are those of the squares
    return row.withColumn("rows", F.count("*").over(square)).where("rows > 1").drop("rows")


def by_square(batches, columns: int):
    """The rows of each square, as arrays, from batches sorted by the first three columns."""
    held: list[list] = []
    now = None
    for batch in batches:
        keys = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        change = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
        for i, j in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows]):
            key = tuple(int(k[i]) for k in keys)
            if key != now and held:
                yield now, [pa.chunked_array(c) for c in zip(*held)]
                held = []
            now = key
            held.append([batch.column(c).slice(i, j - i) for c in range(3, columns)])
    if held:
        yield now, [pa.chunked_array(c) for c in zip(*held)]


def compare(keyed: DataFrame, radius: int) -> DataFrame:
    """``a, b``: links between nodes of a tile whose fingerprints differ in at most ``radius`` bits, for ``keyed (tile, node, fp)``.

    If ``keyed`` has ``s0, s1``, the sketches of two nodes must also differ in at most ``FAR_SYMBOLS`` places. Of the links of
    a square, a spanning forest is returned, which connects the same nodes.
    """
    more = [c for c in ("s0", "s1") if c in keyed.columns]
    def run(batches):
        out = []
        for (_, x, y), (part, node, fp, *sketches) in by_square(batches, 6 + len(more)):
            numbers = [c.to_numpy().view(np.uint64) for c in (fp, *sketches)]
            out.append(_square_links(x, y, part.to_numpy(), node.to_numpy(), numbers, radius))
            if sum(map(len, out)) > 10_000:
                yield _edges(out)
                out = []
        yield _edges(out)

    return squares(keyed, ["node", "fp", *more]).mapInArrow(run, "a long, b long")


def _edges(out: list[np.ndarray]) -> pa.RecordBatch:
    found = np.concatenate([*out, np.zeros((0, 2), np.int64)])
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[:, i])) for i in range(2)], names=["a", "b"])


#: One bit of each two-bit symbol of a sketch.
SYMBOLS = np.uint64(0x5555555555555555)


def _square_links(x: int, y: int, part: np.ndarray, node: np.ndarray, numbers: list[np.ndarray], radius: int) -> np.ndarray:
    """A spanning forest of the links of one square; of a square beside the diagonal, only those between its parts count.

    ``numbers`` are the fingerprints and, if there are any, both halves of the sketches.
    """
    order = np.lexsort((np.bitwise_count(numbers[0]), part))
    part, node, (fp, *sketches) = part[order], node[order], (c[order] for c in numbers)
    cut = int(np.searchsorted(part, y)) if x != y else 0
    i, j = _squares(fp[:cut] if x != y else fp, fp[cut:], radius)
    j = j + cut
    i, j = i[i < j], j[i < j]
    if sketches:
        apart = [h[i] ^ h[j] for h in sketches]
        far = sum(np.bitwise_count((d | d >> np.uint64(1)) & SYMBOLS).astype(np.int64) for d in apart)
        i, j = i[far <= FAR_SYMBOLS], j[far <= FAR_SYMBOLS]
    return _forest_of(i, j, node)


def _forest_of(i: np.ndarray, j: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Links of a spanning forest of the pairs (i, j), as nodes."""
    forest = Forest(len(node))
    pairs = [p for p in zip(i.tolist(), j.tolist()) if forest.join(*p)]
    return node[np.array(pairs, np.int64).reshape(-1, 2)]


def groups(docs: DataFrame, words: int, radius: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, fp, component_id``: near-duplicate groups of whole texts, named by their smallest id.

    Null texts and texts without words have the fingerprint 0 and are linked like all others. A null id takes part in
    linking but never names a group that has other ids. Repeated rows stay; an empty table gives an empty one; other
    columns are ignored.
    """
    fps = checkpoint(fingerprints(docs, words, id_col, text_col))
    distinct = fps.groupBy("fp").agg(F.min(id_col).alias("least"))
    found = connected_components(links(distinct.select("fp"), radius))
    rooted = distinct.join(found, distinct["fp"] == found["node"], "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("root")
    )
    rooted = checkpoint(rooted)
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(named, "root").select(F.col("fp").alias("own"), "component_id")
    return fps.join(classes, F.col("fp") == F.col("own")).select(id_col, "fp", "component_id")


#: Bands of least hashes by which texts of similarity 0.8 share a tile with a chance of 1 - (1 - 0.8**3)**20 = 1 - 6e-7.
BANDS, BAND_ROWS = 20, 3
#: What two texts of similarity 0.8 may differ in: bits of the fingerprint (more differ in 1 of 900,000 pairs of sets of 4
#: and 5 shingles, and in fewer of larger sets) and symbols of the sketch (more differ in 2 of 10,000,000 pairs).
NEAR_BITS, FAR_SYMBOLS = 28, 26
#: Shingles of the sets in a part of a square, which bounds memory.
ELEMENTS = 500_000


def sketch(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """``id, digest, fp, s0, s1, bands, n`` of every text, all from its set of word shingles.

    ``digest`` is half of the text's SHA-256, ``fp`` the fingerprint of the distinct shingles, ``s0`` and ``s1`` 64 symbols of
    two bits, each of one least hash, ``bands`` the keys of ``BANDS`` times ``BAND_ROWS`` least hashes and ``n`` the size.
    """
    schema = T.StructType(
        [
            T.StructField("id", docs.schema[id_col].dataType),
            T.StructField("digest", T.BinaryType()),
            *(T.StructField(c, T.LongType()) for c in ("fp", "s0", "s1")),
            T.StructField("bands", T.ArrayType(T.LongType())),
            T.StructField("n", T.LongType()),
        ]
    )
    rows = max(64, BANDS * BAND_ROWS)
    factors = np.array([xxhash.xxh64_intdigest(str(i), SEED) | 1 for i in range(rows)], np.uint64)
    places = np.arange(32, dtype=np.uint64) * np.uint64(2)

    def signs(distinct: np.ndarray) -> np.ndarray:
        """Both sketches and all band keys."""
        if not len(distinct):
            return np.zeros(2 + BANDS, np.uint64)
        least = np.full(rows, ~np.uint64(0))
        for i in range(0, len(distinct), 512):
            least = np.minimum(least, (distinct[None, i : i + 512] * factors[:, None]).min(1))
        grouped = least[: BANDS * BAND_ROWS].reshape(BANDS, BAND_ROWS)
        mixed = np.zeros(BANDS, np.uint64)
        for k in range(BAND_ROWS):
            mixed = (mixed ^ grouped[:, k]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        symbols = (least[:64] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(62)).reshape(2, 32) << places
        return np.r_[np.bitwise_or.reduce(symbols, 1), mixed + np.arange(BANDS, dtype=np.uint64)]

    def make():
        def work(part, texts):
            hashes = [np.unique(shingle_hashes(t, words)) for t in texts]
            made = np.array([signs(h) for h in hashes], np.uint64).reshape(-1, 2 + BANDS).view(np.int64)
            ends = np.arange(len(texts) + 1, dtype=np.int32) * BANDS
            return {
                "id": part.column(0),
                "digest": part.column(2),
                "fp": np.array([fingerprint(h) for h in hashes], np.uint64).view(np.int64),
                "s0": np.ascontiguousarray(made[:, 0]),
                "s1": np.ascontiguousarray(made[:, 1]),
                "bands": pa.ListArray.from_arrays(ends, pa.array(made[:, 2:].ravel())),
                "n": [len(h) for h in hashes],
            }

        return work

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), text_digest(text_col).alias("digest"))
    return map_texts(own, ["id", "text", "digest"], "text", make, schema)


def text_digest(text_col: str):
    """Half of the text's SHA-256, which names it; a null text counts as empty."""
    return F.unhex(F.left(F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256), F.lit(32)))


def near_groups(
    docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``digest, least, copies, component_id`` for each distinct text: its smallest id, how many rows have both, and the group's smallest id.

    Texts are linked if the Jaccard similarity of their sets of word shingles is ``similarity`` or more. Tiles hold texts
    that share a band of least hashes; those whose fingerprints and sketches are near form loose groups. Within these the
    shingle sets decide: first within parts of a group, which all hold its first text, then, where a group is not yet
    one, between all its parts. A pair of similarity 0.8 or more is missed with a chance of 2e-6 at most, the sum of those
    stated at ``BANDS`` and ``NEAR_BITS``. Texts that ASCII case or white space alone distinguish have equal shingles and
    are linked.
    """
    made = ("fp", "s0", "s1", "bands", "n")
    rows = sketch(docs, words, id_col, text_col).groupBy("digest", "id").agg(F.count("*").alias("copies"), *(F.min(c).alias(c) for c in made))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "copies")).alias("first")
    texts = rows.groupBy("digest").agg(first, *(F.min(c).alias(c) for c in made))
    # texts go by numbers; should two texts have the same 64 bits, the second takes the number after
    short = F.xxhash64("digest")
    nth = F.row_number().over(Window.partitionBy(short).orderBy("digest")) - 1
    texts = checkpoint(texts.select("digest", (short + nth).alias("node"), F.col("first.id").alias("least"), F.col("first.copies").alias("copies"), *made))
    keyed = texts.select("node", "fp", "s0", "s1", F.explode("bands").alias("tile"))
    loose = connected_components(compare(keyed, NEAR_BITS))
    sets = checkpoint(_sets(docs, loose.join(texts.select("digest", "node", "least", "n"), "node"), words, id_col, text_col))
    sure = connected_components(_verified(sets.withColumn("root", F.col("node")), similarity, diagonal=True))
    rooted = sets.select("node", "component").join(sure.withColumnRenamed("component", "root"), "node", "left")
    rooted = checkpoint(rooted.select("node", "component", F.coalesce("root", "node").alias("root")))
    mixed = rooted.groupBy("component").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a != b").select("component")
    left = rooted.join(mixed, "component").select("node", "root")
    joined = connected_components(_verified(sets.join(left, "node"), similarity, diagonal=False))
    ends = rooted.join(joined.select(F.col("node").alias("root"), F.col("component").alias("end")), "root", "left")
    ends = ends.select("node", F.coalesce("end", "root").alias("root"))
    known = texts.select("digest", "node", "least", "copies").join(ends, "node", "left").withColumn("root", F.coalesce("root", "node"))
    known = checkpoint(known)
    named = known.groupBy("root").agg(F.min("least").alias("component_id"))
    return known.join(named, "root").select("digest", "least", "copies", "component_id")


def _sets(docs: DataFrame, asked: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """``node, component, n, words``: the sorted shingle hashes of each text in ``asked (digest, node, component, least, n)``."""
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), text_digest(text_col).alias("own"))
    held = own.join(asked.select("digest", "node", "least"), (F.col("own") == F.col("digest")) & F.col("id").eqNullSafe(F.col("least"))).select("node", "text")

    def code(batches):
        for batch in batches:
            for part in slices(batch, 1):
                coded = [np.unique(shingle_hashes(t, words)).tobytes() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(coded, pa.binary())], names=["node", "words"])

    # repeated rows of one id and text are one node
    coded = held.mapInArrow(code, "node long, words binary").dropDuplicates(["node"])
    return asked.select("node", "component", "n").join(coded, "node")


def _verified(sets: DataFrame, similarity: float, diagonal: bool) -> DataFrame:
    """``a, b``: links between roots of ``sets (node, component, root, n, words)`` for texts of a component whose sets are similar enough."""
    dealt = sets.withColumn("tile", F.xxhash64("component")).withColumn("pivot", F.col("node") == F.col("component"))

    def verify(batches):
        for (_, x, y), (part, root, coded) in by_square(batches, 6):
            held = [np.frombuffer(c.as_py(), np.uint64) for c in coded]
            yield _edges([_set_links(x, y, part.to_numpy(), root.to_numpy(), held, similarity)])

    return squares(dealt, ["root", "words"], "n", diagonal).mapInArrow(verify, "a long, b long")


def _shared(sets: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """How many elements each two sets have in common, by products of incidence matrices of ``width`` elements at a time."""
    n = len(sets)
    element = np.concatenate(sets)
    order = np.argsort(element, kind="stable")
    element = element[order]
    row = np.repeat(np.arange(n, dtype=np.int32), [len(s) for s in sets])[order]
    fresh = np.r_[True, element[1:] != element[:-1]][: len(element)]
    column = np.cumsum(fresh) - 1
    common = np.bincount(column)[column] > 1  # an element of one set alone is shared by no pair
    row = row[common]
    column = np.unique(column[common], return_inverse=True)[1]
    size = int(column.max(initial=-1)) + 1
    both = np.zeros((n, n), np.float32)  # exact up to 2 ** 24
    for c in range(0, size, width):
        i, j = np.searchsorted(column, [c, c + width])
        held = np.zeros((n, min(width, size - c)), np.float32)
        held[row[i:j], column[i:j] - c] = 1
        both += held @ held.T
    return both


def _set_links(x: int, y: int, part: np.ndarray, node: np.ndarray, sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """A spanning forest of the pairs of one square whose nodes differ and whose sets are similar enough."""
    size = np.array([len(s) for s in sets], float)
    both = _shared(sets)
    # the small term keeps products such as 0.8 * 15 from being a little more than the whole number
    near = both >= similarity * (size[:, None] + size[None, :] - both) - 1e-6
    _, number = np.unique(node, return_inverse=True)
    near &= number[:, None] != number[None, :]
    if x != y:
        near &= part[:, None] != part[None, :]
    return _forest_of(*np.nonzero(np.triu(near, 1)), node)


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near copies: the one with the smallest id (a null id only if there is no other).

    Of rows that repeat that id and text, one stays, the same at every run. Columns stay as they are, whatever their
    names. An empty table gives an empty one; null and empty texts are copies of each other; texts without words have
    empty sets, which are alike.
    """
    found = near_groups(docs, words, similarity, id_col, text_col)
    kept = found.where(F.col("least").eqNullSafe(F.col("component_id"))).groupBy("component_id").agg(F.min(F.struct("digest", "copies")).alias("k"))
    kept = checkpoint(kept.select(F.col("component_id").alias("id"), "k.digest", "k.copies"))
    rows = docs.select(F.struct("*").alias("row"), text_digest(text_col).alias("own"))
    same = (F.col("own") == F.col("digest")) & F.col(f"row.{id_col}").eqNullSafe(F.col("id"))
    once = rows.join(kept.where("copies = 1"), same, "left_semi").select("row")
    if kept.where("copies > 1").limit(1).count():
        again = rows.join(kept.where("copies > 1"), same)
        once = once.union(again.groupBy("own", "id").agg(F.min_by("row", F.struct(F.xxhash64(F.to_json("row")), F.to_json("row"))).alias("row")).select("row"))
    return once.select("row.*")

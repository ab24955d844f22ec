"""Sums over the links of a large graph, round after round, in tiles of its adjacency matrix.

Nodes have places in the order of their hashes, so that blocks of places are alike, and a vector over all nodes is a row of
doubles for each block. A tile holds the links from one block to another as two arrays of 32-bit places, eight bytes a link, and
stays where it is: in each round it meets the vector's block, and only sums over blocks are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.cut import checkpoint, remove, small, stored, tidy
from ..plans.rank import global_rank

#: Places in a block at most, links in a row of tiles and in a partition of them, sums that a task holds before it gives them away, and
#: doubles of a vector that are sent to all executors; longer vectors are shuffled to the tiles.
BITS = 17
BLOCK, ROW_LINKS, PART_LINKS, HELD, SENT = 1 << BITS, 1 << 20, 2 << 20, 32, 1 << 24
#: Rounds after which files that nothing needs any more are deleted.
TIDY = 8


class LinkTiles:
    """The distinct links of ``links (src, dst)``. ``nodes`` is ``id, at, degree``: places from 0, and the number of links out."""

    def __init__(self, links: DataFrame, cut=checkpoint) -> None:
        self.cut, self.spark = cut, links.sparkSession
        edges, self._path = stored(links.select("src", "dst").dropna().distinct(), "links")
        self._edges = edges
        ends = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
        others = edges.select(F.col("dst").alias("id")).distinct().withColumn("degree", F.lit(0).cast("long"))
        nodes = ends.union(others).groupBy("id").agg(F.max("degree").alias("degree"))
        self.nodes = cut(global_rank(nodes, [F.xxhash64("id"), F.col("id")], "at").select("id", (F.col("at") - 1).alias("at"), "degree"))
        self.n, self.links = self.nodes.count(), edges.count()
        self.size = min(BLOCK, max(1024, -(-self.n // 8)))
        self._made: dict[bool, tuple[DataFrame, str]] = {}

    def close(self) -> None:
        """Deletes what only the rounds need."""
        for path in [self._path, *(p for _, p in self._made.values())]:
            remove(self.spark, path)
        self._made.clear()
        tidy(self.spark)

    def tiles(self, back: bool = False) -> DataFrame:
        """``a, b, tile``: the places of links' sources in block ``a`` and of their ends in ``b``, or, ``back``, the other way round."""
        if back not in self._made:
            size, blocks = self.size, -(-self.n // self.size)
            if back:
                links = self.tiles().mapInArrow(lambda batches: _turned(batches, blocks), "k long")
            else:
                place = small(self.nodes.select("id", "at"))
                at = lambda end, name: place.select(F.col("id").alias(end), F.col("at").alias(name))
                placed = self._edges.join(at("src", "s"), "src").drop("src").join(at("dst", "d"), "dst")
                pair = F.floor(F.col("d") / size) * blocks + F.floor(F.col("s") / size)
                links = placed.select((F.shiftleft(pair, 2 * BITS) + F.shiftleft(F.col("s") % size, BITS) + F.col("d") % size).alias("k"))
            # places are those of hashes, so that equal ranges of keys hold about as many links
            parts = max(self.spark.sparkContext.defaultParallelism, -(-self.links // PART_LINKS))
            whole = float(max(1, blocks * blocks) << (2 * BITS))
            inside = F.shiftright("k", 2 * BITS) + F.shiftright(F.col("k").bitwiseAND((1 << 2 * BITS) - 1), BITS) / float(size)
            part = F.least(F.floor(inside * (float(1 << (2 * BITS)) * parts / whole)).cast("int"), F.lit(parts - 1))
            dealt = links.repartitionById(parts, part).sortWithinPartitions("k")
            made = stored(dealt.mapInArrow(lambda batches: _pack(batches, blocks), "a int, b int, tile binary"), "tiles")
            self._made[back] = made
            tidy(self.spark)
        return self._made[back][0]

    def vector(self, *columns: Column) -> DataFrame:
        """``b, v``: columns of ``nodes``, one after the other, as doubles of each block; places beyond the last node hold 0."""
        n, size = len(columns), self.size
        rows = self.nodes.select(F.floor(F.col("at") / size).cast("int").alias("b"), (F.col("at") % size).cast("int").alias("x"), *(c.cast("double").alias(f"c{i}") for i, c in enumerate(columns)))

        def fill(table: pa.Table) -> pa.Table:
            out = np.zeros((n, size))
            out[:, table["x"].to_numpy()] = [table[f"c{i}"].to_numpy() for i in range(n)]
            return pa.table({"b": pa.array([table["b"][0].as_py()], pa.int32()), "v": pa.array([out.tobytes()], pa.binary())})

        return self.cut(rows.groupBy("b").applyInArrow(fill, "b int, v binary"))

    def sums(self, tiles: DataFrame, vector: DataFrame, columns: int = 1) -> DataFrame:
        """``b, v``: for each place of block ``b``, the sum of ``vector`` over the places that ``tiles`` lead from; several rows of a block add up."""
        size = self.size
        met = vector.select(F.col("b").alias("a"), "v")
        met = tiles.join(F.broadcast(met) if self.n * columns <= SENT else met, "a").select("b", "tile", "v")

        def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            for batch in batches:
                for b, tile, v in zip(batch.column("b").to_pylist(), batch.column("tile"), batch.column("v")):
                    if b not in held and len(held) >= HELD:
                        yield from _rows(held)
                        held = {}
                    own = held.setdefault(b, np.zeros((columns, size)))
                    x, y = np.frombuffer(tile.as_buffer(), np.int32).reshape(2, -1)
                    for c, values in enumerate(np.frombuffer(v.as_buffer()).reshape(columns, size)):
                        own[c] += np.bincount(y, values[x], size)
            yield from _rows(held)

        return met.mapInArrow(add, "b int, v binary")

    def values(self, blocks: DataFrame, names: list[str]) -> DataFrame:
        """``id`` and a column for each row of doubles of ``blocks (b, v)``."""
        size = self.size

        def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b, v in zip(batch.column("b").to_pylist(), batch.column("v")):
                    rows = np.frombuffer(v.as_buffer()).reshape(len(names), size)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(size) + b * size), *map(pa.array, rows)], names=["at", *names])

        return self.nodes.select("id", "at").join(blocks.select("b", "v").mapInArrow(spread, "at long, " + ", ".join(f"{x} double" for x in names)), "at").drop("at")


def _pack(batches: Iterable[pa.RecordBatch], blocks: int) -> Iterator[pa.RecordBatch]:
    """Sorted links as rows of tiles, one or more for each pair of blocks. A link is one number: the pair, the inner place of its source, that of its end."""
    held: list[np.ndarray] = []
    count = 0
    for batch in batches:
        held.append(batch.column("k").to_numpy())
        count += batch.num_rows
        if count >= ROW_LINKS:
            yield from _runs(np.concatenate(held), blocks)
            held, count = [], 0
    if count:
        yield from _runs(np.concatenate(held), blocks)


def _runs(k: np.ndarray, blocks: int) -> Iterator[pa.RecordBatch]:
    pair, inner = k >> 2 * BITS, (1 << BITS) - 1
    places = np.stack([k >> BITS & inner, k & inner]).astype(np.int32)
    ends = [*(np.flatnonzero(np.diff(pair)) + 1).tolist(), len(k)]
    for first, last in zip([0, *ends], ends):
        b, a = divmod(int(pair[first]), blocks)
        yield pa.RecordBatch.from_arrays([pa.array([a], pa.int32()), pa.array([b], pa.int32()), pa.array([places[:, first:last].tobytes()], pa.binary())], names=["a", "b", "tile"])


def _turned(batches: Iterable[pa.RecordBatch], blocks: int) -> Iterator[pa.RecordBatch]:
    """The links of tiles the other way round."""
    for batch in batches:
        for a, b, tile in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("tile")):
            x, y = np.frombuffer(tile.as_buffer(), np.int32).reshape(2, -1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((a * blocks + b << 2 * BITS) + (y << BITS) + x)], names=["k"])


def _rows(held: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for b, v in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([v.tobytes()], pa.binary())], names=["b", "v"])


def stepped(sums: DataFrame, fixed: DataFrame, size: int, step, schema: str) -> DataFrame:
    """``step(block, sum of its rows in sums, its row in fixed)`` for each block of ``fixed``, as rows of ``schema``: rows of doubles and numbers."""
    both = sums.select("b", F.lit(0).alias("kind"), "v").union(fixed.select("b", F.lit(1).alias("kind"), "v"))
    names = [f.split()[0] for f in schema.split(", ")]

    def run(table: pa.Table) -> pa.Table:
        got, own = 0.0, None
        for kind, v in zip(table["kind"].to_pylist(), table["v"]):
            values = np.frombuffer(v.as_buffer()).reshape(-1, size)
            if kind:
                own = values
            else:
                got = got + values
        out = step(got, own)
        cells = [pa.array([x.tobytes()], pa.binary()) if isinstance(x, np.ndarray) else pa.array([float(x)]) for x in out]
        return pa.table(dict(zip(names, [pa.array([table["b"][0].as_py()], pa.int32()), *cells])))

    return both.groupBy("b").applyInArrow(run, schema)

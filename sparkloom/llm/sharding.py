"""Sharding by minimax contiguous partition.

Groups of equal texts are atoms, in the order of a hash of their text. The smallest capacity for which a greedy walk
over the atoms needs at most the wanted number of shards is found by binary search, and the atoms are cut there. The
walk needs only sums of sizes over ranges of the hash, so the driver holds ranges, not atoms: the search runs once with
ranges taken as divisible and once as atoms, which brackets the answer, and only the ranges in which the two disagree
are split further, until single atoms decide.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

#: Bits of the hash by which a range is split: 1024 parts.
SPLIT_BITS = 10
#: Sub-ranges into which the rows of a range are dealt to number them, so that copies of one text don't meet in a task.
SPREAD = 64


class Ranges:
    """Sizes over consecutive ranges of the hash: a list of (first hash, bits left, size, number of atoms, largest atom)."""

    def __init__(self, rows: list[tuple[int, int, int, int, int]]) -> None:
        self.rows = sorted(rows)
        self.total = [0, *accumulate(r[2] for r in self.rows)]

    def walk(self, capacity: int, shards: int, divisible: bool) -> list[int] | None:
        """Where each shard ends, as sums of sizes, or None if ``shards`` are not enough."""
        ends, at = [], 0
        for _ in range(shards):
            if at >= self.total[-1]:
                break
            i = bisect_right(self.total, at + capacity) - 1
            reach = self.total[i]
            if divisible and i < len(self.rows) and self.rows[i][3] > 1:
                reach = max(reach, at + capacity)
            if reach <= at:
                return None
            at = min(reach, self.total[-1])
            ends.append(at)
        return ends if at >= self.total[-1] else None

    def smallest(self, shards: int, divisible: bool) -> int:
        """The smallest capacity that will do, by binary search."""
        low = max([1, *(r[4] for r in self.rows), -(-self.total[-1] // shards)])
        high = max(low, self.total[-1])
        while low < high:
            mid = (low + high) // 2
            if self.walk(mid, shards, divisible) is None:
                low = mid + 1
            else:
                high = mid
        return low

    def open(self, shards: int) -> list[int]:
        """The ranges of several atoms in which a cut may fall for any capacity that may be the answer."""
        lo, hi = self.smallest(shards, True), self.smallest(shards, False)
        least, most = self.walk(lo, shards, False) or [], self.walk(hi, shards, True) or []
        found = set()
        for k in range(shards):
            # the k-th cut lies between where the shortest and the longest steps lead
            a = least[k] if k < len(least) else self._reach(lo, k + 1)
            b = most[k] if k < len(most) else self.total[-1]
            for i in range(bisect_right(self.total, min(a, b)) - 1, bisect_right(self.total, max(a, b))):
                if i < len(self.rows) and self.rows[i][3] > 1:
                    found.add(i)
        return sorted(found)

    def _reach(self, capacity: int, steps: int) -> int:
        """How far ``steps`` greedy steps over whole ranges lead at least; a range wider than a step is passed by none."""
        at = 0
        for _ in range(steps):
            i = bisect_right(self.total, at + capacity) - 1
            at = max(at, self.total[i])
        return at


def cuts(atoms: DataFrame, shards: int) -> tuple[list[int], list[int]]:
    """The first hash of each shard but the first, and the sizes of all, for ``atoms (hash, size, rows)``."""

    def measure(parts: list[tuple[int, int]]) -> list[tuple[int, int, int, int, int]]:
        """Split ranges of (first hash, bits left), where hashes are shifted to be unsigned."""
        bits = parts[0][1]
        width = bits - min(SPLIT_BITS, bits)
        starts = [a for a, _ in parts]
        # signed order is kept: the hash is compared after flipping its highest bit
        top = F.shiftright("hash", bits) if bits < 64 else F.lit(0).cast("long")
        chosen = atoms if bits == 64 else atoms.where(top.isin([(a - 2**63) >> bits for a in starts]))
        low = F.shiftright("hash", width) if width else F.col("hash")
        rows = chosen.groupBy(low.alias("part")).agg(F.sum("size"), F.count("*"), F.max("size")).collect()
        return [((r[0] << width) + 2**63, width, r[1], r[2], r[3]) for r in rows]

    ranges = Ranges(measure([(0, 64)]))
    while wide := ranges.open(shards):
        bits = max(ranges.rows[i][1] for i in wide)
        if bits == 0:
            break
        split = [i for i in wide if ranges.rows[i][1] == bits]
        fresh = measure([ranges.rows[i][:2] for i in split])
        ranges = Ranges([r for i, r in enumerate(ranges.rows) if i not in set(split)] + fresh)
    ends = ranges.walk(ranges.smallest(shards, False), shards, False) or []
    starts = [ranges.rows[bisect_right(ranges.total, e) - 1][0] - 2**63 for e in ends if e < ranges.total[-1]]
    return starts, [b - a for a, b in zip([0, *ends], ends)]


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows dealt to ``shards`` shards so that the largest shard is as small as it can be with equal texts together.

    Returns ``id_col, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null)``. A row's size is the bytes of
    its text plus 1; a null text has the size 1, the CRC 0 and stands with the empty texts. ``slot`` numbers the rows of
    a shard from 0 without gaps, in the order of hash range, spread of ids, hash and id. Repeated rows are numbered one
    after the other; with fewer groups than shards some shards stay empty; an empty table gives an empty one; other
    columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("hash"),
    )
    rows = checkpoint(rows)
    atoms = checkpoint(rows.groupBy("hash").agg(F.sum("size").alias("size")))
    starts, _ = cuts(atoms, shards)
    number = F.lit(0)
    for start in starts:
        number = number + (F.col("hash") >= start).cast("int")
    spread = F.pmod(F.xxhash64(F.col("id"), F.lit(1)), F.lit(SPREAD)).cast("int")
    placed = rows.select("*", number.alias("shard"), F.shiftright("hash", 64 - SPLIT_BITS).cast("int").alias("range"), spread.alias("spread"))
    cell = ["shard", "range", "spread"]
    # a bounded table: at most shards + 1024 ranges, each of SPREAD cells
    before = placed.groupBy(*cell).agg(F.count("*").alias("n"))
    before = before.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("range", "spread").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    nth = F.row_number().over(Window.partitionBy(*cell).orderBy("hash", "id"))
    numbered = placed.withColumn("nth", nth).join(F.broadcast(before.drop("n")), cell)
    return numbered.select(
        F.col("id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("before") + F.col("nth") - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )

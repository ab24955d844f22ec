"""Places of rows in one order of a whole table, without a task that sees all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cut import checkpoint


def global_rank(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """``rows`` with their places from 1 by ``order``, which must end in a key.

    Rows are dealt out by ranges of the order and sorted within them; a row's place is that within its range and the sizes of the
    ranges before, of which there is one number for each partition. Rows that agree in the whole order stand together, in any order.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # the id of a row is its partition's number and, in the low 33 bits, its place there
    placed = checkpoint(dealt.withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", 33).cast("int")
    sizes = sorted((r["part"], r["n"]) for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    before, offsets = 0, []
    for p, n in sizes:
        offsets.append((p, before))
        before += n
    table = rows.sparkSession.createDataFrame(offsets, "__part int, __before long")
    joined = placed.join(F.broadcast(table), part == F.col("__part"))
    return joined.withColumn(name, F.col("__before") + F.col("__id").bitwiseAND((1 << 33) - 1) + 1).drop("__id", "__part", "__before")

"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, shuffle_partitions

#: Edges of a node from which on its join is spread over several tasks; a larger table has a higher bound, so that at most
#: 100,000 such nodes, a few MB, are ever broadcast.
HOT = 1000
#: Edges of a task. Fewer edges than shuffle partitions times this are handled by fewer tasks, but by one for each core at least:
#: what a round leaves on disk grows with its tasks, however few rows they have.
EDGES = 50_000


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``node, component`` for every node of ``edges (a, b)``: the component is its smallest node.

    Alternates large-star and small-star steps until the edges no longer change, which takes about log(n) rounds even
    for long chains. A node's neighbours are never gathered: their minimum is aggregated first, and the join that hands
    it to them is spread where a node has many. Every round is checkpointed in the shared folder, and the tasks of a round
    follow from its edges. Node values must be orderable and not null; loops and repeated edges do no harm.
    """
    links = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    links = checkpoint(links)
    before = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    for _ in range(max_rounds):
        hot, tasks = max(HOT, before[0] // 100_000), _tasks(links, before[0])
        links = _gathered(links, tasks)
        # large star: every larger neighbour u of v is linked to the smallest of v and its neighbours; repeats go with those of the small star
        least = links.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "v")
        large = _beside(links, "v", "u", least, _crowded(links, "v", hot, tasks), hot).select("u", F.coalesce("m", "v").alias("v"))
        large = _gathered(large, tasks)
        # small star: every smaller neighbour v of u, and u itself, is linked to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        rest = _beside(large, "u", "v", low, _crowded(links, "u", hot, tasks), hot).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        both = _gathered(rest, tasks).union(_gathered(low.select("u", F.col("m").alias("v")), tasks))
        links = checkpoint(_gathered(both.distinct(), tasks))
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def _tasks(links: DataFrame, edges: int) -> int | None:
    """Tasks for so many edges, if they are fewer than those of a shuffle."""
    spark = links.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, -(-edges // EDGES))
    return tasks if tasks < shuffle_partitions(spark) else None


def _gathered(rows: DataFrame, tasks: int | None) -> DataFrame:
    """``rows`` in so many partitions at most."""
    return rows.coalesce(tasks) if tasks else rows


def _crowded(links: DataFrame, key: str, hot: int, tasks: int | None) -> DataFrame | None:
    """``key, parts``: nodes with more than ``hot`` edges at their ``key`` end, and over how many tasks to spread them; none if there are none.

    The large star never adds edges at the ``u`` end, so what ``links`` has there bounds the small star as well.
    """
    found = links.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > hot).select(key, F.ceil(F.col("n") / hot).cast("int").alias("parts"))
    found = _gathered(found, tasks)
    return found if found.limit(1).count() else None


def _beside(links: DataFrame, key: str, other: str, found: DataFrame, crowded: DataFrame | None, hot: int) -> DataFrame:
    """``links`` with the ``m`` that ``found (key, m)`` has for ``key``, or null; edges of ``crowded`` nodes go to several tasks."""
    if crowded is None:
        return links.join(found, key, "left")
    spread, one = F.broadcast(crowded), F.coalesce("parts", F.lit(1))
    left = links.join(spread, key, "left").withColumn("salt", F.pmod(F.xxhash64(other), one).cast("int"))
    right = found.join(spread, key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), one - 1)))
    return left.select("u", "v", "salt").join(right.select(key, "salt", "m"), [key, "salt"], "left")

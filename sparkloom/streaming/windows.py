"""Session windows and joins within an interval, over tables and over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, key: str, time: str, gap: str, late: str | None = None) -> DataFrame:
    """``key, start, end, n``: runs of a key's events with less than ``gap`` between them.

    Over a stream, ``late`` is how far events may lag behind the newest one: such rows still extend, open or join sessions, later
    ones are dropped, and a session comes out once the watermark has passed its end. Spark sums up a key's rows of a task
    before they are shuffled.
    """
    rows = events if late is None else events.withWatermark(time, late)
    found = rows.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"))
    return found.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def within(left: DataFrame, right: DataFrame, keys: tuple[str, str], times: tuple[str, str], seconds: int, late: str | None = None) -> DataFrame:
    """Pairs of a left row and a right row of the same key, the right one at the same time or up to ``seconds`` later: all columns of both.

    Rows meet by key and slice of time, the left one in its own slice and the next, so that a key's rows are split by time and
    never all meet each other. Over streams, with ``late`` the state of both sides ends by their watermarks: a row is kept for as long as a
    partner may still come, and rows that are later than that are dropped. The columns of the two sides must be named apart.
    """
    if late is not None:
        left, right = left.withWatermark(times[0], late), right.withWatermark(times[1], late)

    def part(name: str):
        return F.floor(F.unix_seconds(F.col(name).cast("timestamp")) / max(1, seconds))

    own = left.withColumn("__slice", F.explode(F.array(part(times[0]), part(times[0]) + 1)))
    other = right.withColumn("__other", part(times[1]))
    near = (F.col(times[1]) >= F.col(times[0])) & (F.col(times[1]) <= F.col(times[0]) + F.expr(f"INTERVAL {int(seconds)} SECONDS"))
    met = own.join(other, (F.col(keys[0]) == F.col(keys[1])) & (F.col("__slice") == F.col("__other")) & near)
    return met.drop("__slice", "__other")

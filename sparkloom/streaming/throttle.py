"""Login throttle as a keyed state machine, over a table and over a stream; windowed gauges of a stream."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scan import segmented_scan

#: A window of five minutes from the first failure; five failures block for ten minutes.
WINDOW_S, LIMIT, BLOCK_S = 300, 5, 600

#: (first failure, failures, blocked until), in seconds; zeros where there is none.
State = tuple[float, int, float]


def step(state: State, at: float, failed: bool) -> tuple[State, bool]:
    """The state after an attempt, and whether the attempt was blocked."""
    first, count, until = state
    if until and at < until:
        return state, True
    if not failed:
        return (0.0, 0, 0.0), False
    if not count or until or at - first > WINDOW_S:
        first, count = at, 0
    count += 1
    return (first, count, at + BLOCK_S if count >= LIMIT else 0.0), False


class Throttle:
    """The throttle as a machine of ``plans.scan`` over rows ``__at`` (microseconds) and ``__failed``, in order.

    From a fresh start at an attempt, the next fresh one is known without what came before: behind the next success, at the first
    failure after the window, or at the first attempt after the block. These links are found for all attempts of a segment at
    once and followed from its end. A state that comes in is settled by the first five attempts and the block after them; so
    the map holds the attempts of the first window and two blocks, and the final state of a fresh start at each.
    """

    start: State = (0.0, 0, 0.0)

    def summarise(self, rows: pd.DataFrame) -> tuple:
        at, failed = rows["__at"].to_numpy(np.float64) / 1e6, rows["__failed"].fillna(False).to_numpy(bool)
        n = len(at)
        places = np.arange(n)
        fails, ends = np.append(np.flatnonzero(failed), n), np.append(np.flatnonzero(~failed), n)
        nth = np.searchsorted(fails, places)
        limit = fails[np.minimum(nth + LIMIT - 1, len(fails) - 1)]
        success = ends[np.searchsorted(ends, places)]
        late = fails[np.searchsorted(fails, np.searchsorted(at, at + WINDOW_S, side="right"))]
        blocks = (limit < success) & (limit < late)
        free = np.searchsorted(at, at[np.minimum(limit, n - 1)] + BLOCK_S)
        then = np.where(~failed, places + 1, np.where(blocks, free, np.minimum(success + 1, late)))
        final: list[State] = [self.start] * n
        for i, to in zip(range(n - 1, -1, -1), then[::-1].tolist()):
            if to < n:
                final[i] = final[to]
            else:  # the segment ends within a few steps or a block
                for j in range(i, int(limit[i]) + 1 if blocks[i] else n):
                    final[i] = step(final[i], at[j], failed[j])[0]
        near = min(n, int(np.searchsorted(at, at[0] + WINDOW_S + 2 * BLOCK_S, side="right")) + LIMIT + 1)
        return n, at[:near], failed[:near], final[:near]

    def apply(self, summary: tuple, state: State) -> State:
        n, at, failed, final = summary
        i = 0
        while i < n and state[1] and not state[2]:  # at most LIMIT attempts within an open window
            state, i = step(state, at[i], failed[i])[0], i + 1
            if state[1] == 1 and not state[2]:  # a fresh start at this attempt
                return final[i - 1]
        if state[2]:
            i = max(i, int(np.searchsorted(at, state[2])))
        return final[i] if i < n else state

    def replay(self, rows: pd.DataFrame, state: State) -> dict[str, list]:
        blocked, failures = [], []
        for at, bad in zip((rows["__at"] / 1e6).tolist(), rows["__failed"].fillna(False).tolist()):
            state, stopped = step(state, at, bool(bad))
            blocked.append(stopped)
            failures.append(state[1])
        return {"blocked": blocked, "failures": failures}


def throttle(events: DataFrame, key: str, time: str, event: str, failed: str, rows_a_part: int = 1_000_000) -> DataFrame:
    """``key, event, blocked, failures`` for every attempt of a table, each key's in order of time and event.

    A key's attempts are split over as many tasks as they need (``plans.scan``). Attempts without a time come first in their key's
    order and count as of time 0; a null ``failed`` is no failure.
    """
    rows = events.select(key, event, F.coalesce(F.unix_micros(F.col(time).cast("timestamp")), F.lit(0)).alias("__at"), F.col(failed).cast("boolean").alias("__failed"))
    return segmented_scan(rows, key, ["__at", event], Throttle(), "blocked boolean, failures int", rows_a_part).drop("__at", "__failed")


def throttle_stream(events: DataFrame, key: str, time: str, failed: str) -> DataFrame:
    """The same over a stream: ``key, attempts, blocked`` of each key and micro-batch; the state outlives the batch."""
    types = {f.name: f.dataType.simpleString() for f in events.schema}
    rows = events.select(key, (F.unix_micros(F.col(time).cast("timestamp")) / 1e6).alias("at"), F.col(failed).cast("boolean").alias("failed"))

    def fold(k, frames, state):
        now = tuple(state.get) if state.exists else (0.0, 0, 0.0)
        frame = pd.concat(list(frames)).sort_values("at")
        blocked = 0
        for at, bad in zip(frame["at"], frame["failed"]):
            now, stopped = step(now, float(at), bool(bad))
            blocked += stopped
        state.update(now)
        yield pd.DataFrame({key: [k[0]], "attempts": [len(frame)], "blocked": [blocked]})

    return rows.groupBy(key).applyInPandasWithState(
        fold, f"{key} {types[key]}, attempts long, blocked long", "first double, count int, until double", "append", "NoTimeout"
    )


def gauges(events: DataFrame, time: str, late: str, width: str, by: str) -> DataFrame:
    """Counts of each window and kind of a stream; rows later than ``late`` are dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count("*").alias("n"))

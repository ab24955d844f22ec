"""The login throttle over a stream in the order of event time, with state that ends."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .throttle import BLOCK_S, WINDOW_S, step

#: Milliseconds without an attempt after which nothing of a key's state can matter.
IDLE_MS = 1000 * (WINDOW_S + BLOCK_S)


class Attempts(StatefulProcessor):
    """Attempts wait until the watermark has passed them and are then folded in order; a timer ends the state of an idle key."""

    def __init__(self, names: tuple[str, str]) -> None:
        self.names = names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "first double, count int, until double, last long")
        self.waiting = handle.getListState("waiting", "at long, event string, failed boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for frame in rows:
            # by place: the optimiser may rename computed columns
            new = [(int(a), str(e), bool(f)) for e, a, f in zip(frame.iloc[:, 1], frame.iloc[:, 3], frame.iloc[:, 4])]
            self.waiting.appendList(new)
            for at in {a for a, _, _ in new}:
                self.handle.registerTimer(at // 1000 + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted(tuple(x) for x in self.waiting.get()) if self.waiting.exists() else []
        due, later = [x for x in held if x[0] < mark], [x for x in held if x[0] >= mark]
        first, count, until, last = tuple(self.now.get()) if self.now.exists() else (0.0, 0, 0.0, 0)
        if due:
            out, state = [], (first, count, until)
            for at, event, failed in due:
                state, blocked = step(state, at / 1e6, failed)
                out.append((key[0], event, blocked, state[1]))
            self.waiting.clear()
            if later:
                self.waiting.put(later)
            last = due[-1][0] // 1000
            self.now.update((*map(float, state[:1]), int(state[1]), float(state[2]), last))
            self.handle.registerTimer(last + IDLE_MS)
            yield pd.DataFrame(out, columns=[self.names[0], self.names[1], "blocked", "failures"])
        elif last and not later and expiredTimerInfo.getExpiryTimeInMs() >= last + IDLE_MS:
            self.now.clear()
            self.waiting.clear()

    def close(self) -> None:
        pass


def ordered_throttle(events: DataFrame, key: str, time: str, event: str, failed: str, late: str) -> DataFrame:
    """``key, event (as text), blocked, failures`` of every attempt of a stream, folded in the order of time and event.

    An attempt comes out once the watermark, ``late`` behind the newest time seen, has passed it; attempts that come when it has
    are dropped, as Spark does. A key's state is given up a window and a block after its last attempt. Needs the RocksDB state store.
    """
    types = {f.name: f.dataType for f in events.schema}
    rows = events.select(
        key, F.col(event).cast("string").alias("__event"), time, F.unix_micros(F.col(time).cast("timestamp")).alias("__at"), F.coalesce(F.col(failed).cast("boolean"), F.lit(False)).alias("__failed")
    )
    schema = T.StructType([T.StructField(key, types[key]), T.StructField(event, T.StringType()), T.StructField("blocked", T.BooleanType()), T.StructField("failures", T.IntegerType())])
    return rows.withWatermark(time, late).groupBy(key).transformWithStateInPandas(Attempts((key, event)), schema, "append", "eventTime")

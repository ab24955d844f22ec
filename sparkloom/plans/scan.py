"""Folds over the ordered rows of each key, split over tasks so that a key with any share of the rows takes many of them.

Rows are dealt out by ranges of key and order, so that a hot key's rows lie in consecutive partitions. What a machine does in
its key's rows of one partition, a segment, is told as a map from the state before to the state after it; maps of a key are
applied one after the other, which costs a step for each partition, and then every segment is replayed from its true state.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cut import checkpoint


class Machine(Protocol):
    """What is folded. States and maps can be pickled; maps must be small whatever a segment's size."""

    start: Any

    def summarise(self, rows: pd.DataFrame) -> Any:
        """The map of a segment."""

    def apply(self, summary: Any, state: Any) -> Any:
        """The state after a segment, from the state before it."""

    def replay(self, rows: pd.DataFrame, state: Any) -> dict[str, Any]:
        """The output columns of a segment's rows, from the state before it."""


def partitions_for(rows: DataFrame, rows_a_part: int) -> int:
    return max(1, -(-rows.count() // rows_a_part))


def segmented_scan(rows: DataFrame, key: str, order: list[str], machine: Machine, outputs: str, rows_a_part: int = 1_000_000) -> DataFrame:
    """``rows`` with the columns ``outputs`` (DDL) of ``machine``, folded over each key's rows in order.

    A partition holds about ``rows_a_part`` rows in memory, of one key or of many. Each has one segment that may begin in the
    middle of a key, its first; so the states that are sent to all tasks are one for each partition. Rows that agree in key and
    order may be folded in any order. A null key is a key of its own; an empty table gives an empty one.
    """
    spark = rows.sparkSession
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    dealt = rows.repartitionByRange(partitions_for(rows, rows_a_part), key, *order).sortWithinPartitions(key, *order)
    # read from files from here on, so that every pass sees the same partitions
    fixed = checkpoint(dealt.withColumn("__part", F.spark_partition_id()))

    def segments(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Runs of rows of one key."""
        whole = [f for f in frames if len(f)]
        if not whole:
            return
        frame = pd.concat(whole, ignore_index=True)
        of = frame[key]
        new = (of != of.shift()) & ~(of.isna() & of.shift().isna())
        new.iloc[0] = True
        starts = [*new.to_numpy().nonzero()[0].tolist(), len(frame)]
        for a, b in zip(starts, starts[1:]):
            yield frame.iloc[a:b].reset_index(drop=True)

    def edges(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = list(segments(frames))
        for n, rows_ in [*enumerate(found)][:1] + [*enumerate(found)][1:][-1:]:
            out = rows_[[key, "__part"]].iloc[:1].copy()
            out["first"], out["map"] = n == 0, [pickle.dumps(machine.summarise(rows_))]
            yield out

    kind = rows.schema[key].dataType.simpleString()
    told = fixed.mapInPandas(edges, f"`{key}` {kind}, __part int, first boolean, map binary")

    def chain(own: pd.DataFrame) -> pd.DataFrame:
        """The state before each of a key's segments."""
        own = own.sort_values("__part")
        states, state = [], machine.start
        for summary in own["map"]:
            states.append(pickle.dumps(state))
            state = machine.apply(pickle.loads(summary), state)
        return pd.DataFrame({"__part": own["__part"], "first": own["first"], "state": states})

    before = told.groupBy(key).applyInPandas(chain, "__part int, first boolean, state binary").where("first")
    entered = spark.sparkContext.broadcast({r["__part"]: bytes(r["state"]) for r in before.collect()})  # a row for each partition

    def replay(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for n, rows_ in enumerate(segments(frames)):
            state = machine.start if n else pickle.loads(entered.value[int(rows_["__part"].iloc[0])])
            yield rows_.drop(columns="__part").assign(**machine.replay(rows_, state))

    return fixed.mapInPandas(replay, f"{schema}, {outputs}")

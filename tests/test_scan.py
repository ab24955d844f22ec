"""Segmented scans against plain folds, with one key over many partitions."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import assistant
from sparkloom.streaming import throttle as Z

START = dt.datetime(2024, 1, 1)


def fold(events):
    out = {}
    states = {}
    for user, at, event, failed in sorted(events, key=lambda e: (str(e[0]), e[1], e[2])):
        state, blocked = Z.step(states.get(user, (0.0, 0, 0.0)), at.replace(tzinfo=dt.timezone.utc).timestamp(), bool(failed))
        states[user] = state
        out[event] = (user, blocked, state[1])
    return out


def attempts(seed, n, users, gap, share):
    rng = random.Random(seed)
    at, out = START, []
    for i in range(n):
        at += dt.timedelta(seconds=rng.choice([0, 1, 1, 2, 7, gap]))
        out.append((rng.choice(users), at, i, rng.random() < share))
    return out


@pytest.mark.parametrize("seed, gap, share", [(1, 40, 0.95), (2, 300, 0.8), (3, 700, 1.0), (4, 100, 0.5)])
def test_one_user_with_nearly_all_attempts(spark, seed, gap, share):
    events = attempts(seed, 1500, ["hot"] * 30 + ["cold", None], gap, share)
    events += [("late", START + dt.timedelta(days=i), 5000 + i, i % 2 == 0) for i in range(5)]
    frame = spark.createDataFrame(events, "user string, ts timestamp, event long, failed boolean").withColumn("map", F.lit("clash")).repartition(3)
    got = Z.throttle(frame, "user", "ts", "event", "failed", rows_a_part=60)
    assert got.withColumn("p", F.spark_partition_id()).select("p").distinct().count() > 10
    assert {r["event"]: (r["user"], r["blocked"], r["failures"]) for r in got.collect()} == fold(events)
    assert any(blocked for _, blocked, _ in fold(events).values())


@pytest.mark.parametrize("seed", range(12))
def test_map_of_a_segment_equals_the_fold(seed):
    """The map gives the final state for every state that may come in."""
    rng = random.Random(seed)
    machine = Z.Throttle()
    at, rows = 1000.0, []
    for _ in range(rng.choice([1, 2, 5, 40, 200])):
        at += rng.choice([0, 1, 5, 30, 120, 400, 900])
        rows.append((at * 1e6, rng.random() < rng.choice([0.5, 0.9, 1.0])))
    frame = pd.DataFrame(rows, columns=["__at", "__failed"])
    summary = machine.summarise(frame)
    first = rows[0][0] / 1e6
    states = [(0.0, 0, 0.0)] + [(first - rng.randint(0, 500), rng.randint(1, 4), 0.0) for _ in range(60)]
    states += [(first - 300, 5, first + rng.randint(-700, 600)) for _ in range(60)]
    for state in states:
        wanted = state
        for a, bad in rows:
            wanted = Z.step(wanted, a / 1e6, bad)[0]
        assert machine.apply(summary, state) == wanted, state


def test_throttle_of_odd_rows(spark):
    schema = "user string, ts timestamp, event long, failed boolean"
    rows = [("u", None, 1, True), ("u", START, 2, None), (None, START, 3, True), ("u", START, 2, None)]
    assert sorted((r["event"], r["blocked"], r["failures"]) for r in Z.throttle(spark.createDataFrame(rows, schema), "user", "ts", "event", "failed").collect()) == [(1, False, 1), (2, False, 0), (2, False, 0), (3, False, 1)]
    assert Z.throttle(spark.createDataFrame([], schema), "user", "ts", "event", "failed").collect() == []


def test_alerts_over_many_partitions(spark):
    rng = random.Random(4)
    held = [rng.random() < 0.8 for _ in range(400)]
    samples = [(START + dt.timedelta(minutes=i), int(h)) for i, h in enumerate(held)]
    rules = (("A", "warning", "h > 0", 2), ("B", "critical", "h >= 0", 5), ("C", "critical", "h < 0", 1), ("D", "warning", "h IS NULL OR h < 1", 3))
    frame = spark.createDataFrame(samples, "t timestamp, h int").repartition(5)
    got = {(r["alert"], (r["t"] - START).total_seconds() // 60) for r in assistant.held_alerts(frame, "t", rules, rows_a_part=50).collect()}
    wanted = set()
    for name, _, _, minutes in rules:
        run = None
        for i, h in enumerate(held):
            holds = {"A": h, "B": True, "C": False, "D": not h}[name]
            run = (i if run is None else run) if holds else None
            if run is not None and i - run >= minutes:
                wanted.add((name, float(i)))
    assert got == wanted
    assert assistant.held_alerts(frame.limit(0), "t", rules).collect() == []

"""Streams of files that bring rows late and out of order."""

import datetime as dt
import random
import time

import pytest

from sparkloom.streaming import ordered, throttle, windows

START = dt.datetime(2024, 1, 1)


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


@pytest.fixture
def stream(spark, tmp_path):
    """Streams whose batches are lists of rows, one file each, and what they bring."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def make(batches, schema, name="in"):
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
            time.sleep(0.05)
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))

    def run(frame, name, mode="append"):
        query = frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"c-{name}")).start()
        try:
            query.processAllAvailable()
            rows = spark.table(name).collect()
            return rows, query.lastProgress
        finally:
            query.stop()

    yield make, run
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_sessions_with_late_rows(stream, spark):
    make, run = stream
    schema = "user string, ts timestamp"
    batches = [
        [("a", at(0)), ("a", at(5)), ("b", at(1))],
        [("a", at(40)), ("b", at(45))],
        [("a", at(12)), ("a", at(50))],  # 12 is late, but not by 60 minutes
        [("a", at(300))],
        [("b", at(301))],  # Spark drops late rows by the watermark of the batch before
        [("a", at(20)), ("b", at(310))],  # far behind the watermark: dropped
        [("z", at(900))],
    ]
    rows, _ = run(windows.sessions(make(batches, schema), "user", "ts", "10 minutes", "60 minutes"), "sessions")
    got = {(r["user"], (r["start"] - START).seconds // 60, r["n"]) for r in rows}
    kept = [r for b in batches for r in b if r != ("a", at(20))]
    batch = windows.sessions(spark.createDataFrame(kept, schema), "user", "ts", "10 minutes").collect()
    wanted = {(r["user"], (r["start"] - START).seconds // 60, r["n"]) for r in batch if r["user"] != "z"}
    assert got == wanted  # 12 came late but in time and joined the session of 5; 20 was too late
    assert ("a", 0, 3) in got and not any(start == 20 for _, start, _ in got)


def test_interval_join_of_two_streams(stream, spark):
    make, run = stream
    clicks = [[(1, "u", at(0)), (2, "u", at(30))], [(3, "v", at(40))], [(4, "u", at(500))], [(7, "v", at(501))], [(5, "u", at(2))], [(6, "u", at(900))]]
    buys = [[(11, "u", at(10))], [(12, "u", at(60)), (13, "v", at(100))], [(14, "u", at(505))], [(17, "x", at(506))], [(15, "v", at(41))], [(16, "u", at(905))]]
    a, b = "c_id long, c_user string, c_ts timestamp", "p_id long, p_user string, p_ts timestamp"
    found = windows.within(make(clicks, a, "c"), make(buys, b, "p"), ("c_user", "p_user"), ("c_ts", "p_ts"), 3600, "30 minutes")
    rows, progress = run(found.select("c_id", "p_id"), "pairs")
    got = {tuple(r) for r in rows}
    flat = lambda batches, drop: [r for batch in batches for r in batch if r[0] not in drop]
    whole = windows.within(spark.createDataFrame(flat(clicks, {5}), a), spark.createDataFrame(flat(buys, {15}), b), ("c_user", "p_user"), ("c_ts", "p_ts"), 3600)
    assert got == {tuple(r) for r in whole.select("c_id", "p_id").collect()} == {(1, 11), (1, 12), (2, 12), (3, 13), (4, 14), (6, 16)}
    assert sum(s["numRowsTotal"] for s in progress["stateOperators"]) < 8  # old rows of both sides are given up


def test_throttle_in_order_of_time_with_state_that_ends(stream):
    make, run = stream
    rng = random.Random(2)
    rows = [("u", START + dt.timedelta(seconds=20 * i), i, i % 9 != 8) for i in range(60)] + [("v", at(3), 100, True)]
    mixed = rows[:]
    rng.shuffle(mixed)  # all within 20 minutes, so that none is late
    batches = [mixed[:30], mixed[30:], [("w", at(60), 200, True)], [("w", at(61), 203, True)], [("u", at(1), 300, True), ("w", at(200), 201, True)], [("w", at(400), 202, True)]]
    schema = "user string, ts timestamp, event long, failed boolean"
    found, progress = run(ordered.ordered_throttle(make(batches, schema), "user", "ts", "event", "failed", "25 minutes"), "ordered")
    wanted, states = {}, {}
    for user, ts, event, failed in sorted(rows + [("w", at(60), 200, True), ("w", at(61), 203, True), ("w", at(200), 201, True)], key=lambda r: (r[0], r[1])):
        state, blocked = throttle.step(states.get(user, (0.0, 0, 0.0)), ts.replace(tzinfo=dt.timezone.utc).timestamp(), failed)
        states[user] = state
        wanted[str(event)] = (user, blocked, state[1])
    assert {r["event"]: (r["user"], r["blocked"], r["failures"]) for r in found} == wanted  # 300 was too late, 202 waits
    assert any(blocked for _, blocked, _ in wanted.values())
    assert sum(s["numRowsTotal"] for s in progress["stateOperators"]) <= 6  # what is left is of w alone

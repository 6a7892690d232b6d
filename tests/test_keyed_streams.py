"""Streams with state per parameter: lagging and silent parameters, restarts, rows out of order."""

import datetime as dt
import json
import time

import pytest
from pyspark.sql import functions as F

from procwatch.operators import breach, features
from procwatch.streaming import keyed

START = dt.datetime(2024, 1, 1, 12, 0, 0)
READING = "param string, ts timestamp, value double, asset string, batch_id string, zone string"
ZONES = ("control", "alert", "alarm", "trip", None)


def _readings(param, seconds):
    return [{"param": param, "ts": (START + dt.timedelta(seconds=s)).isoformat(), "value": None if s % 11 == 5 else s * 0.37 % 7,
             "asset": None if s % 5 else "BR-12", "batch_id": f"B{s % 3}", "zone": ZONES[s % 5]} for s in seconds]


def _drop(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in rows))
    time.sleep(0.05)


def _columns(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(
        "param", "window_start", "window_end", "n_rows", "v_avg", "v_min", "v_max", "v_std", "v_delta",
        F.coalesce("asset", F.lit("")), "batch_id", F.coalesce("zone", F.lit("")), F.coalesce("zone_worst", F.lit(""))).collect())


def _windows(spark, tmp_path, idle, done, seconds=40):
    """Run until `done(closed windows)` or time is up; returns the windows closed so far."""
    arriving = spark.readStream.schema(READING).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    found = keyed.windows_per_parameter(arriving, "10 seconds", "5 seconds", idle)
    query = (found.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out"))
             .option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="300 milliseconds").start())
    try:
        until = time.monotonic() + seconds   # a query with timers always has another batch to come
        while True:
            if (tmp_path / "out" / "_spark_metadata").exists():
                closed = spark.read.schema(found.schema).parquet(str(tmp_path / "out"))
                if done(closed) or time.monotonic() > until:
                    return closed
            assert query.isActive and time.monotonic() < until + 20, query.exception()
            time.sleep(0.5)
    finally:
        query.stop()


def test_lagging_and_silent_parameters(spark, tmp_path):
    fast, slow = _readings("fast", range(0, 300, 3)), _readings("slow", range(0, 90, 4))
    folder = tmp_path / "in"
    _drop(folder, "1.json", fast[:50] + [{"param": None, "ts": START.isoformat()}, {"param": "fast"}])
    _drop(folder, "2.json", fast[50:])
    _drop(folder, "3.json", slow[:12])   # far behind the other
    _drop(folder, "4.json", slow[12:])
    closed = _windows(spark, tmp_path, "4 seconds", lambda d: d.agg(F.sum("n_rows")).first()[0] == len(fast + slow))
    whole = spark.read.schema(READING).json(str(folder)).where("param IS NOT NULL AND ts IS NOT NULL")
    assert _columns(closed) == _columns(breach.window_aggregates(whole, "10 seconds"))


def test_restart_keeps_open_windows_and_drops_late_rows(spark, tmp_path):
    rows, folder = _readings("temp", range(0, 60, 2)), tmp_path / "in"
    _drop(folder, "1.json", rows[:12])   # up to second 22: the window up to 10 is closed, 10 to 20 not yet (delay)
    first = _windows(spark, tmp_path, "1 hour", lambda d: d.count() > 0)
    assert [r["n_rows"] for r in first.collect()] == [5]
    _drop(folder, "2.json", rows[12:] + [{**rows[0], "value": 99.0}])   # and one of a closed window
    closed = _windows(spark, tmp_path, "2 seconds", lambda d: d.agg(F.sum("n_rows")).first()[0] >= len(rows))
    whole = spark.createDataFrame([(r["param"], dt.datetime.fromisoformat(r["ts"]), r["value"], r["asset"], r["batch_id"],
                                    r["zone"]) for r in rows], READING)
    assert _columns(closed) == _columns(breach.window_aggregates(whole, "10 seconds"))


def _rolling(spark, tmp_path, schema):
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    (keyed.online_rolling(arriving, ["ts", "event_id"], features=["k"]).writeStream.outputMode("append")
     .format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check"))
     .trigger(availableNow=True).start().awaitTermination(120))
    return spark.read.parquet(str(tmp_path / "out"))


def test_rolling_as_readings_arrive(spark, tmp_path):
    schema = "param string, ts long, event_id long, value double, k double"
    rows = [{"param": p, "ts": i // 2, "event_id": i, "value": None if i % 37 == 0 else (i * 7919 % 101) / 7,
             "k": None if i % 53 == 0 else float(i % 13)} for i in range(200) for p in ("a", "b")][:-31]
    folder = tmp_path / "in"
    for n in range(3):
        _drop(folder, f"{n}.json", list(reversed(rows[n * 60:n * 60 + 60])))
    _rolling(spark, tmp_path, schema)
    _drop(folder, "3.json", rows[180:] + [{**rows[20], "value": 1e9}, {"param": "a"}, {"param": None, "ts": 1, "event_id": 1}])
    got = _rolling(spark, tmp_path, schema)   # started again
    batch = spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    want = features.rolling_features(batch, ["ts", "event_id"], features=["k"])
    names = ["param", "ts", "event_id", "v_avg", "v_std", "v_delta", "k_mean"]
    got, want = (sorted(tuple(r) for r in d.select(*names).collect()) for d in (got, want))
    assert [r[:3] for r in got] == [r[:3] for r in want] and len(got) > 200
    for a, b in zip(got, want):
        assert a == pytest.approx(b, abs=1e-9) if isinstance(a[0], float) else a[3:] == pytest.approx(b[3:], abs=1e-9)


def test_intervals():
    assert keyed.micros("10 seconds") == 10_000_000 and keyed.micros("1 hour") == 3_600_000_000

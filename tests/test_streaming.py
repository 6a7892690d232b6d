"""The continuous query: late rows, restart, replay, side outputs, live view."""

import datetime as dt
import json
import os

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from procwatch.operators import audit, breach, models
from procwatch.plans import inputs
from procwatch.sources import tables, telemetry
from procwatch.streaming import breaches
from conftest import SF

ONCE = {"availableNow": True}
START = dt.datetime(2024, 1, 1, 12, 0, 0)


def _lines(*readings):
    """(param, second, value) as JSON lines."""
    return "\n".join(json.dumps({
        "param": p, "asset": "BR-12", "value": v, "unit": "u", "zone": z, "batch_id": "B1",
        "ts": (START + dt.timedelta(seconds=s)).isoformat(timespec="milliseconds") + "+00:00",
        "features": {"f": 1.0}}) for p, s, v, z in readings) + "\n"


def _drop(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text)


def _run(spark, dim, tmp_path, **options):
    stream = telemetry.telemetry_stream(telemetry.json_file_stream(spark, str(tmp_path / "in"), 1))
    query = breaches.start(stream, dim, str(tmp_path / "out"), str(tmp_path / "check"),
                           trigger=ONCE, **options)
    query.awaitTermination(120)
    return query


def test_late_rows_restart_and_outputs(spark, dim, tmp_path):
    folder = tmp_path / "in"
    _drop(folder, "1.json", _lines(("temp", 0, 38.3, "alarm"), ("temp", 9, 38.3, "alarm"), ("ph", 3, 7.0, "control"))
          + "not json\n" + '{"param": "temp"}\n')
    _drop(folder, "2.json", _lines(("temp", 60, 37.0, "control")))
    _run(spark, dim, tmp_path)
    # second run: first a row behind the watermark, then one that moves time on
    _drop(folder, "3.json", _lines(("temp", 1, 39.0, "trip"), ("temp", 61, 37.0, "control")))
    _drop(folder, "4.json", _lines(("temp", 2, 39.0, "trip"), ("temp", 120, 37.0, "control")))
    query = _run(spark, dim, tmp_path)
    assert breaches.late_rows(query) >= 1
    events = tables.latest_state(spark, str(tmp_path / "out" / "breach_events"), ["event_id"]).collect()
    epoch = int(START.replace(tzinfo=dt.timezone.utc).timestamp())
    assert [(e["event_id"], e["n_rows"], e["zone"]) for e in events] == [(f"evt-temp-{epoch}", 2, "alarm")]
    assert events[0]["emitted_at"] is not None
    features = spark.read.parquet(str(tmp_path / "out" / "features"))
    assert features.groupBy("param", "window_start").count().where("count > 1").count() == 0
    assert {r["param"] for r in features.collect()} == {"temp", "ph"}
    log = spark.read.parquet(str(tmp_path / "out" / "audit"))
    assert [(a["action"], json.loads(a["detail"])["param"]) for a in log.collect()] == [("breach.detected", "temp")]
    assert [(r["n_rows"], r["n_broken"]) for r in audit.verify_chain(log, "chain", "ts").collect()] == [(1, 0)]


def test_replayed_batch_replaces_itself(spark, dim, tmp_path):
    windows = breach.score_windows(breach.window_aggregates(inputs.telemetry(spark, SF), "6 hours"), dim)
    write = breaches.write_batch(str(tmp_path / "out"))
    for _ in range(2):
        write(windows, 3)
    stored = spark.read.parquet(str(tmp_path / "out" / "breach_events"))
    assert stored.count() == stored.select("event_id").distinct().count() > 0


def test_stream_equals_batch_on_closed_windows(spark, dim, tmp_path):
    readings = inputs.telemetry(spark, SF)
    wide = readings.withColumn("unit", F.lit("u"))
    text = telemetry.to_keyed_json(wide.select("param", "asset", "value", "unit", "zone", "batch_id", "ts"))
    text.orderBy(F.get_json_object("value", "$.ts")).select("value").coalesce(1).write.text(str(tmp_path / "in"))
    _run(spark, dim, tmp_path, size="1 hour")
    got = spark.read.parquet(str(tmp_path / "out" / "breach_events")).select(
        "event_id", "n_rows", "zone", "v_avg", "p_breach")
    # the JSON keeps milliseconds; windows and values are those of the batch query
    want = breach.breach_events(readings, dim, "1 hour")
    last = want.agg(F.max("window_start")).first()[0]
    want = want.where(F.col("window_start") < last).select(*got.columns)
    assert want.exceptAll(got).count() == 0 and got.count() >= want.count() > 100


def test_json_sink(spark, dim, tmp_path):
    _drop(tmp_path / "in", "1.json", _lines(("ph", 0, 7.5, "alarm"), ("ph", 60, 7.0, "control")))
    stream = telemetry.telemetry_stream(telemetry.json_file_stream(spark, str(tmp_path / "in")))
    breaches.start_json_sink(stream, dim, str(tmp_path / "out"), str(tmp_path / "check"),
                             trigger=ONCE).awaitTermination(120)
    rows = [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert [(r["param"], r["zone"], r["n_rows"]) for r in rows] == [("ph", "alarm", 1)]


def test_live_view_keeps_the_latest(spark, tmp_path):
    view = breaches.live_view(str(tmp_path / "view"), 3)

    def batch(*seconds):
        return spark.createDataFrame([("temp", START + dt.timedelta(seconds=s), float(s)) for s in seconds],
                                     "param string, ts timestamp, value double")

    view(batch(1, 2), 0)
    view(batch(4, 3), 1)
    view(batch(4, 3), 1)  # replay
    view(batch(0), 2)
    got = sorted(r["value"] for r in breaches.read_live_view(spark, str(tmp_path / "view")).collect())
    assert got == [2.0, 3.0, 4.0]


FAST_AND_SLOW = (("temp", 600, 37.0, "control"), ("temp", 700, 37.0, "control"), ("hum", 5, 60.0, "alarm"),
                 ("temp", 800, 37.0, "control"), ("hum", 900, 47.0, "control"))


def _send_one_by_one(spark, dim, tmp_path, **watermarks):
    for i, line in enumerate(FAST_AND_SLOW):
        _drop(tmp_path / "in", f"{i}.json", _lines(line))
        stream = telemetry.telemetry_stream(telemetry.json_file_stream(spark, str(tmp_path / "in"), 1), **watermarks)
        breaches.start(stream, dim, str(tmp_path / "out"), str(tmp_path / "check"), trigger=ONCE).awaitTermination(120)
    return spark.read.parquet(str(tmp_path / "out" / "features"))


def test_one_watermark_follows_the_fastest_parameter(spark, dim, tmp_path):
    assert _send_one_by_one(spark, dim, tmp_path).where("param = 'hum'").count() == 0


def test_a_longer_delay_keeps_a_slow_parameter(spark, dim, tmp_path):
    stored = _send_one_by_one(spark, dim, tmp_path, delay="15 minutes")
    assert stored.where("param = 'hum'").count() == 0  # not closed yet, but not lost
    _drop(tmp_path / "in", "9.json", _lines(("temp", 3000, 37.0, "control")))
    stream = telemetry.telemetry_stream(telemetry.json_file_stream(spark, str(tmp_path / "in"), 1), "15 minutes")
    breaches.start(stream, dim, str(tmp_path / "out"), str(tmp_path / "check"), trigger=ONCE).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out" / "features")).where("param = 'hum'").count() == 2


def test_own_watermarks_lose_no_row(spark, dim, tmp_path):
    for i, line in enumerate(FAST_AND_SLOW):
        _drop(tmp_path / "in", f"{i}.json", _lines(line))
        os.utime(tmp_path / "in" / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))  # their order
    stream = telemetry.telemetry_stream(telemetry.json_file_stream(spark, str(tmp_path / "in"), 1),
                                        groups=[["temp"], ["hum"]])
    breaches.start(stream, dim, str(tmp_path / "out"), str(tmp_path / "check"), trigger=ONCE).awaitTermination(120)
    stored = spark.read.parquet(str(tmp_path / "out" / "features"))
    # a silent parameter holds all windows open; once it moves on, the rest is closed
    assert {(r["param"], r["n"]) for r in stored.groupBy("param").agg(F.count("*").alias("n")).collect()} == {
        ("hum", 1), ("temp", 2)}


def test_chain_goes_on_over_batches_and_replays(spark, tmp_path):
    def batch(*ids):
        return spark.createDataFrame([("ph", START + dt.timedelta(seconds=i), "warn", "a", f"e{i}", "{}") for i in ids],
                                     "chain string, ts timestamp, level string, action string, event_id string, detail string")

    folder = str(tmp_path / "log")
    for number, ids in ((0, (0, 1)), (1, (2, 3)), (1, (2, 3)), (2, ()), (3, (4,)), (3, (4,))):
        breaches.append_audit(batch(*ids), folder, number)
    log = spark.read.parquet(f"{folder}/audit")
    whole = audit.build_chain(batch(0, 1, 2, 3, 4), "chain", "ts")
    assert {r["row_hash"] for r in log.collect()} == {r["row_hash"] for r in whole.collect()}
    assert tables.generations(spark, f"{folder}/audit_heads") == [2, 3]


def test_two_topics_are_routed(spark, dim, tmp_path):
    reading = _lines(("temp", 5, 37.5, "control")).strip()
    event = json.dumps({"event_id": "e1", "param": "ph", "v_avg": 7.5, "window_start": "2024-01-01T00:00:00"})
    rows = [("scada.telemetry", reading), ("scada.telemetry", "{cut"), ("pdm.breaches", event), ("pdm.breaches", "[]")]
    consume = breaches.consume(str(tmp_path / "c"), dim)
    for number in (0, 1, 1):
        consume(spark.createDataFrame(rows, "topic string, value string"), number)
    assert breaches.read_live_view(spark, str(tmp_path / "c" / "live")).count() == 2
    events = tables.latest_state(spark, str(tmp_path / "c" / "events"), ["event_id"]).collect()
    assert [(e["event_id"], e["asset"], e["zone"]) for e in events] == [("e1", "BR-12", "alarm")]
    bad = spark.read.parquet(str(tmp_path / "c" / "quarantine")).groupBy("of").count().collect()
    assert {(r["of"], r["count"]) for r in bad} == {("telemetry", 2), ("breach", 2)}
    log = spark.read.parquet(str(tmp_path / "c" / "audit"))
    assert [(r["n_rows"], r["n_broken"]) for r in audit.verify_chain(log, "chain", "ts").collect()] == [(2, 0)]


def test_quarantine_is_counted(spark, tmp_path):
    _drop(tmp_path / "in", "1.json", _lines(("ph", 0, 7.5, "alarm")) + "{cut\n" + '{"param": "ph"}\n'
          + '{"ts": "2024-01-01T00:00:00"}\n')
    raw = telemetry.json_file_stream(spark, str(tmp_path / "in"))
    breaches.start_quarantine(raw, str(tmp_path / "bad"), str(tmp_path / "check"), trigger=ONCE).awaitTermination(120)
    assert {tuple(r) for r in breaches.quarantined(spark, str(tmp_path / "bad")).collect()} == {
        ("unreadable", 1), ("no time", 1), ("no parameter", 1)}


def test_state_is_read_once_however_many_models(spark, dim, tmp_path):
    rows = spark.createDataFrame([(float(i % 7), 0.1, 0.2, float(i % 2)) for i in range(40)],
                                 "v_avg double, v_std double, v_delta double, label double")
    columns = VectorAssembler(inputCols=models.SERVING, outputCol="_x", handleInvalid="keep")
    model = Pipeline(stages=[columns, LogisticRegression(featuresCol="_x")]).fit(rows)
    fitted = dict.fromkeys(("temp", "ph", "press", "cond", "hum"), model)
    readings = [(p, s, 37.0, "control") for p in fitted for s in range(0, 240, 10)]
    _drop(tmp_path / "in", "1.json", _lines(*readings))
    query = _run(spark, dim, tmp_path, fitted=fitted)
    updated = [op["numRowsUpdated"] for p in query.recentProgress for op in p["stateOperators"]]
    assert sum(updated) == 5 * 24
    assert spark.read.parquet(str(tmp_path / "out" / "features")).count() >= 5 * 22


def test_the_view_stays_small(spark, tmp_path):
    folder = str(tmp_path / "view")
    view = breaches.live_view(folder, 3)
    for n in range(6):
        view(spark.createDataFrame([("temp", START + dt.timedelta(seconds=n), float(n))],
                                   "param string, ts timestamp, value double"), n)
    assert tables.generations(spark, folder) == [4, 5]
    assert sorted(r["value"] for r in breaches.read_live_view(spark, folder).collect()) == [3.0, 4.0, 5.0]

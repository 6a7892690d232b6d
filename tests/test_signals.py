"""Bands, zones, score, windows, SQL functions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from procwatch import fixed_values as fv
from procwatch.functions import bands, sql_functions
from procwatch.operators import breach
from procwatch.sources import telemetry

PARAMS = {p["id"]: p for p in fv.PARAMETERS}


@pytest.mark.parametrize("param", fv.PARAM_IDS)
def test_bands_nest_and_five_features(param):
    p = PARAMS[param]
    assert p["trip"][0] <= p["alarm"][0] < p["control"][0]
    assert p["control"][1] < p["alarm"][1] <= p["trip"][1]
    assert len(p["features"]) == 5


def test_dimension_equals_fixed_values(dim):
    rows = {r["param"]: r for r in dim.collect()}
    assert list(rows) == fv.PARAM_IDS
    for key, p in PARAMS.items():
        assert (rows[key]["trip_lo"], rows[key]["trip_hi"]) == p["trip"]
        assert rows[key]["features"] == p["features"]


def _values(spark, dim, param, values):
    df = spark.createDataFrame([(param, float(v)) for v in values], "param string, value double")
    return bands.with_bands(df, dim).orderBy("value")


@pytest.mark.parametrize("param", fv.PARAM_IDS)
def test_zone_on_and_beyond_every_limit(spark, dim, param):
    p, eps = PARAMS[param], 1e-6
    cases = {}
    for band, zone, on_limit in (("trip", "trip", "trip"), ("alarm", "alarm", "alarm")):
        low, high = p[band]
        inner = "alarm" if band == "trip" else "control"
        inner_display = "alarm" if band == "trip" else "normal"
        cases[low - eps] = cases[high + eps] = (zone, zone)
        cases[low] = cases[high] = (inner, on_limit)
        cases[low + eps] = cases[high - eps] = (inner, inner_display)
    got = _values(spark, dim, param, cases).select(
        "value", bands.zone(F.col("value")).alias("s"),
        bands.zone(F.col("value"), inclusive=True).alias("i")).collect()
    assert {r["value"]: (r["s"], r["i"]) for r in got} == cases


def test_zone_and_breach_differ_between_control_and_alarm(spark, dim):
    row = _values(spark, dim, "temp", [37.8]).select(
        bands.zone(F.col("value")).alias("z"), bands.breach_now(F.col("value")).alias("b")).first()
    assert row["z"] == "control" and row["b"] is True


def test_missing_reading_is_no_breach(spark, dim):
    df = spark.createDataFrame([("temp", None)], "param string, value double")
    assert bands.with_bands(df, dim).select(bands.breach_now(F.col("value"))).first()[0] is False


def _score(spark, dim, *rows):
    df = spark.createDataFrame(rows, "param string, m double, s double")
    return [r[0] for r in bands.with_bands(df.coalesce(1), dim).select(
        bands.pdm_score(F.col("m"), F.col("s"))).collect()]


def test_score_properties(spark, dim):
    low, a, b, c, far = _score(spark, dim, ("temp", 37.0, 0.05), ("temp", 37.4, 0.05),
                               ("temp", 37.9, 0.05), ("temp", 38.3, 0.05), ("temp", 999.0, 0.05))
    assert low < 0.1 and c > 0.6 and [low, a, b, c] == sorted([low, a, b, c])
    assert 0.0 <= low and far == 1.0
    calm, shaky = _score(spark, dim, ("temp", 37.8, 0.02), ("temp", 37.8, 0.4))
    assert shaky > calm
    assert _score(spark, dim, ("nope", 1.0, 1.0), ("temp", None, 1.0)) == [0.0, 0.0]


def test_score_low_side_equals_high_side(spark, dim):
    high, low = _score(spark, dim, ("hum", 47.5 + 9, 1.0), ("hum", 47.5 - 9, 1.0))
    assert high == pytest.approx(low)


def test_sql_functions_agree_with_columns(spark, dim):
    sql_functions.register(spark)
    rows = [(p, v, s) for p in (*fv.PARAM_IDS, "nope") for v in (None, 7.1, 37.9, 105.0, 950.0)
            for s in (None, 0.3)]
    df = bands.with_bands(spark.createDataFrame(rows, "param string, m double, s double"), dim)
    bad = df.where(F.abs(F.expr("PDM_SCORE(param, m, s, 0D)")
                         - bands.pdm_score(F.col("m"), F.col("s"))) > 1e-12)
    assert bad.count() == 0
    assert spark.sql("SELECT TOP_DRIVER('cond', 1D), TOP_DRIVER('x', 1D)").first()[:] == (
        "feed_composition", "unknown")


def _readings(spark, rows):
    start = dt.datetime(2024, 1, 1)
    return spark.createDataFrame(
        [(p, "A", "B", start + dt.timedelta(seconds=s), float(v), z) for p, s, v, z in rows],
        "param string, asset string, batch_id string, ts timestamp, value double, zone string")


def test_string_maximum_hides_alarms(spark, dim):
    rows = [("temp", 0, 37.0, "control")] + [("temp", i, 38.2, "alarm") for i in range(1, 9)]
    window = breach.window_aggregates(_readings(spark, rows)).first()
    assert (window["zone"], window["zone_worst"], window["n_rows"]) == ("control", "alarm", 9)


def test_window_of_one_row_and_event_id(spark, dim):
    events = breach.breach_events(_readings(spark, [("ph", 12, 7.5, "alarm")]), dim).collect()
    assert len(events) == 1
    event = events[0]
    epoch = int(dt.datetime(2024, 1, 1, 0, 0, 10, tzinfo=dt.timezone.utc).timestamp())
    assert event["event_id"] == f"evt-ph-{epoch}"
    assert (event["v_std"], event["v_delta"], event["top_driver"]) == (0.0, 0.0, "acid_base_dose_rate")


def test_quiet_windows_are_dropped(spark, dim):
    rows = [("temp", 0, 37.0, "control"), ("temp", 1, 37.05, "control")]
    assert breach.breach_events(_readings(spark, rows), dim).count() == 0


def test_one_shuffle_on_param_and_window(spark, dim):
    events = breach.breach_events(_readings(spark, [("ph", 1, 7.5, "alarm")]), dim)
    plan = events._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "BroadcastHashJoin" in plan or "LocalTableScan" in plan
    assert "Python" not in plan


def test_kafka_rows_are_keyed_by_parameter(spark):
    df = _readings(spark, [("ph", 1, 7.5, "alarm")])
    row = telemetry.to_keyed_json(df).first()
    assert row["key"] == "ph" and '"value":7.5' in row["value"]
    back = telemetry.parse_json(telemetry.to_keyed_json(df).select("value"), "value").first()
    assert back["value"] == 7.5 and back["ts"] == dt.datetime(2024, 1, 1, 0, 0, 1)


def test_topics_are_told_apart(spark):
    df = spark.createDataFrame([("a", "1"), ("b", "2")], "topic string, value string")
    assert telemetry.by_topic(df, "b").collect()[0][:] == ("2",)

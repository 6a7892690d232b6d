"""Registered queries over telemetry: zones, windows, scores, breach events."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from procwatch.functions import bands
from procwatch.operators import breach
from procwatch.plans import inputs, sql

CHECK_WINDOW = "1 hour"
NUDGE = 1e-9


def _epoch(name: str):
    return F.unix_timestamp(name).alias(name)


def _seconds(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.unix_timestamp(n) for n in names})


def _windows(spark, sf_dir):
    return breach.window_aggregates(inputs.telemetry(spark, sf_dir), CHECK_WINDOW)


def _scored(spark, sf_dir):
    return breach.score_windows(_windows(spark, sf_dir), bands.dimension(spark))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breach events at one-hour windows, the input of the governance queries."""
    return breach.breach_events(inputs.telemetry(spark, sf_dir), bands.dimension(spark),
                                CHECK_WINDOW, nudge=NUDGE)


def breach_windows(spark, sf_dir):
    df = events(spark, sf_dir)
    return _seconds(df, "window_start", "window_end").withColumns(
        {c: F.round(F.col(c) + F.lit(NUDGE), 6) for c in ("v_min", "v_max")})


def windowed_features(spark, sf_dir):
    return _seconds(breach.windowed_features(
        inputs.telemetry(spark, sf_dir), bands.dimension(spark), CHECK_WINDOW, NUDGE),
        "window_start")


def tumbling_windows(spark, sf_dir):
    df = breach.window_aggregates(inputs.telemetry(spark, sf_dir), "10 seconds")
    return _seconds(df, "window_start", "window_end").select(
        "param", "window_start", "window_end", "n_rows",
        F.round(F.col("v_avg") + F.lit(NUDGE), 4).alias("v_avg"))


def zone_worst(spark, sf_dir):
    df = _windows(spark, sf_dir)
    return (df.groupBy("param", "zone", "zone_worst")
            .agg(F.count(F.lit(1)).alias("windows"), F.sum("n_rows").alias("readings")))


def _banded(spark, sf_dir):
    return bands.with_bands(inputs.telemetry(spark, sf_dir).drop("asset"),
                            bands.dimension(spark), "asset")


def zone_classify(spark, sf_dir):
    return _banded(spark, sf_dir).select(
        "event_id", "param", bands.zone(F.col("value")).alias("zone"))


def zone_flag_inclusive(spark, sf_dir):
    zone = bands.zone(F.round(F.col("value") + F.lit(NUDGE), 2), inclusive=True)
    return (_banded(spark, sf_dir).select("event_id", "param", zone.alias("zone"))
            .withColumn("flag", bands.traffic_flag(F.col("zone"))))


def breach_now(spark, sf_dir):
    return _banded(spark, sf_dir).select(
        "event_id", "param", bands.breach_now(F.col("value")).cast("int").alias("breach"))


def alarm_trip_filter(spark, sf_dir):
    return (inputs.telemetry(spark, sf_dir).where(F.col("zone").isin("alarm", "trip"))
            .select("event_id", "param", "zone"))


def join_bands(spark, sf_dir):
    return _banded(spark, sf_dir).select(
        "event_id", "param", "asset", "control_lo", "control_hi", "alarm_lo", "alarm_hi",
        "trip_lo", "trip_hi")


def breach_direction(spark, sf_dir):
    df = bands.with_bands(_windows(spark, sf_dir), bands.dimension(spark))
    return df.select("param", _epoch("window_start"),
                     bands.breach_direction(F.col("v_avg")).alias("direction"))


def normalized_deviation(spark, sf_dir):
    return _banded(spark, sf_dir).select(
        "event_id", F.round(bands.normalized_deviation(F.col("value")) + F.lit(NUDGE), 6)
        .alias("deviation"))


def pdm_score(spark, sf_dir):
    return _scored(spark, sf_dir).select(
        "param", _epoch("window_start"),
        F.round(F.col("p_raw") + F.lit(NUDGE), 6).alias("p_raw"))


def top_driver(spark, sf_dir):
    return (_scored(spark, sf_dir).groupBy("param", "top_driver")
            .agg(F.count(F.lit(1)).alias("windows")))


def why_drivers(spark, sf_dir):
    joined = bands.with_bands(inputs.telemetry(spark, sf_dir), bands.dimension(spark), "features")
    return (joined.where(F.col("zone") != "control")
            .select("event_id", F.concat_ws(",", bands.why_drivers()).alias("why")))


def predict_batch(spark, sf_dir):
    windows = _windows(spark, sf_dir).select("param", "window_start", "v_avg", "v_std", "v_delta")
    scored = breach.predict_batch(windows, bands.dimension(spark), NUDGE)
    return _seconds(scored, "window_start").drop("v_avg", "v_std", "v_delta")


QUERIES = {f.__name__: f for f in (
    breach_windows, windowed_features, tumbling_windows, zone_worst, zone_classify,
    zone_flag_inclusive, breach_now, alarm_trip_filter, join_bands, breach_direction,
    normalized_deviation, pdm_score, top_driver, why_drivers, predict_batch)}

_V = "v + 1e-9::DOUBLE"
ORACLES = {
    "breach_windows": sql.with_events("""
        SELECT event_id, param, asset, batch_id, window_start, window_start + 3600 AS window_end,
               v_avg, round(v_min + 1e-9::DOUBLE, 6) AS v_min, round(v_max + 1e-9::DOUBLE, 6) AS v_max,
               v_std, v_delta, n_rows, zone, zone_worst, p_breach, top_driver FROM ev"""),
    "windowed_features": sql.with_events("""
        SELECT param, window_start, round(v_avg + 1e-9::DOUBLE, 4) AS v_avg,
               round(v_std + 1e-9::DOUBLE, 4) AS v_std, round(v_delta + 1e-9::DOUBLE, 4) AS v_delta,
               zone, round(p_raw + 1e-9::DOUBLE, 4) AS p_breach FROM scored"""),
    "tumbling_windows": sql.with_telemetry("""
        SELECT param, CAST(epoch(w) AS BIGINT) AS window_start,
               CAST(epoch(w) AS BIGINT) + 10 AS window_end, count(*) AS n_rows,
               round(avg(v) + 1e-9::DOUBLE, 4) AS v_avg
        FROM (SELECT *, time_bucket(INTERVAL '10 seconds', ts) AS w FROM telem)
        GROUP BY param, w"""),
    "zone_worst": sql.with_events("""
        SELECT param, zone, zone_worst, count(*) AS windows, CAST(sum(n_rows) AS BIGINT) AS readings
        FROM scored GROUP BY ALL"""),
    "zone_classify": sql.with_telemetry("SELECT event_id, param, zone FROM telem"),
    "zone_flag_inclusive": sql.with_telemetry("""
        , r AS (SELECT *, round(v + 1e-9::DOUBLE, 2) AS x FROM telem),
        z AS (SELECT event_id, param, CASE WHEN x <= tl OR x >= th THEN 'trip'
                     WHEN x <= al OR x >= ah THEN 'alarm' ELSE 'normal' END AS zone FROM r)
        SELECT *, CASE zone WHEN 'trip' THEN 'RED' WHEN 'alarm' THEN 'AMBER' ELSE 'GREEN' END AS flag
        FROM z"""),
    "breach_now": sql.with_telemetry(
        "SELECT event_id, param, CASE WHEN v < cl OR v > ch THEN 1 ELSE 0 END AS breach FROM telem"),
    "alarm_trip_filter": sql.with_telemetry(
        "SELECT event_id, param, zone FROM telem WHERE zone IN ('alarm', 'trip')"),
    "join_bands": sql.with_telemetry("""
        SELECT event_id, param, asset, cl AS control_lo, ch AS control_hi, al AS alarm_lo,
               ah AS alarm_hi, tl AS trip_lo, th AS trip_hi FROM telem"""),
    "breach_direction": sql.with_events("""
        SELECT param, window_start, CASE WHEN v_avg > ch THEN 'above' ELSE 'below' END AS direction
        FROM scored"""),
    "normalized_deviation": sql.with_telemetry("""
        SELECT event_id, round((v - (cl + ch) / 2::DOUBLE) / greatest((ah - al) / 2::DOUBLE, 1e-9::DOUBLE)
               + 1e-9::DOUBLE, 6) AS deviation FROM telem"""),
    "pdm_score": sql.with_events(
        "SELECT param, window_start, round(p_raw + 1e-9::DOUBLE, 6) AS p_raw FROM scored"),
    "top_driver": sql.with_events(
        "SELECT param, top_driver, count(*) AS windows FROM scored GROUP BY ALL"),
    "why_drivers": sql.with_telemetry("""
        SELECT event_id, CASE param
               WHEN 'temp' THEN 'coolant_flow_rate,jacket_temperature,steam_valve_position'
               WHEN 'ph' THEN 'acid_base_dose_rate,co2_accumulation,agitator_speed'
               WHEN 'press' THEN 'filter_dp,gas_exhaust_flow,pump_speed_hz'
               WHEN 'cond' THEN 'water_flow_rate,resin_bed_dp,regeneration_cycle_count'
               ELSE 'hvac_fan_speed,cooling_coil_temp,hepa_dp' END AS why
        FROM telem WHERE zone <> 'control'"""),
    "predict_batch": sql.with_events("""
        SELECT param, window_start, round(p_raw + 1e-9::DOUBLE, 4) AS p_breach,
               CASE WHEN v_avg < tl OR v_avg > th THEN 'trip'
                    WHEN v_avg < al OR v_avg > ah THEN 'alarm' ELSE 'control' END AS zone,
               top_driver FROM scored"""),
}

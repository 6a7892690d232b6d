"""Tumbling windows, breach score and breach events. Batch and stream alike."""

from pyspark.sql import Column, DataFrame, functions as F

from procwatch import fixed_values as fv
from procwatch.functions import bands


def window_aggregates(telemetry: DataFrame, size: str = fv.WINDOW_SIZE) -> DataFrame:
    """One row per parameter and tumbling window.

    All aggregates combine map-side, so five parameters do not mean five busy
    tasks: the shuffle carries one row per (task, param, window). `zone` is the
    largest zone by name, `zone_worst` the most severe one.
    """
    grouped = telemetry.groupBy("param", F.window("ts", size).alias("w")).agg(
        F.max("asset").alias("asset"),
        F.max("batch_id").alias("batch_id"),
        F.avg("value").alias("v_avg"),
        F.min("value").alias("v_min"),
        F.max("value").alias("v_max"),
        F.stddev_pop("value").alias("v_std"),
        F.count(F.lit(1)).alias("n_rows"),
        F.max("zone").alias("zone"),
        F.max(bands.severity(F.col("zone"))).alias("severity"),
    )
    return grouped.select(
        "param", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
        "asset", "batch_id", "v_avg", "v_min", "v_max", "v_std",
        (F.col("v_max") - F.col("v_min")).alias("v_delta"),
        "n_rows", "zone", bands.zone_of_severity(F.col("severity")).alias("zone_worst"),
    )


def score_windows(windows: DataFrame, dim: DataFrame) -> DataFrame:
    """Add the unrounded score `p_raw` and the primary driver."""
    joined = bands.with_bands(windows, dim, "primary_driver")
    return joined.select(
        *windows.columns,
        bands.pdm_score(F.col("v_avg"), F.col("v_std")).alias("p_raw"),
        F.coalesce("primary_driver", F.lit("unknown")).alias("top_driver"),
    )


def breach_candidates(scored: DataFrame, threshold: float = fv.BREACH_THRESHOLD) -> DataFrame:
    """Keep windows with a worrying score or a zone other than control."""
    return scored.where((F.col("p_raw") > threshold) | (F.col("zone") != "control"))


def event_id() -> Column:
    return F.concat(F.lit("evt-"), F.col("param"), F.lit("-"),
                    F.unix_timestamp("window_start").cast("string"))


def _rounded(name: str, nudge: float, source: str | None = None) -> Column:
    return F.round(F.col(source or name) + F.lit(nudge), 4).alias(name)


def emit_events(candidates: DataFrame, nudge: float = 0.0) -> DataFrame:
    """The published shape. `nudge` moves half-way cases off the rounding edge
    when results are compared with another engine."""
    return candidates.select(
        event_id().alias("event_id"), "param", "asset", "batch_id", "window_start", "window_end",
        _rounded("v_avg", nudge), "v_min", "v_max", _rounded("v_std", nudge),
        _rounded("v_delta", nudge), "n_rows", "zone", "zone_worst",
        _rounded("p_breach", nudge, "p_raw"), "top_driver",
    )


def breach_events(telemetry: DataFrame, dim: DataFrame, size: str = fv.WINDOW_SIZE,
                  threshold: float = fv.BREACH_THRESHOLD, nudge: float = 0.0) -> DataFrame:
    """The continuous query: windows, score, keep candidates, publish."""
    scored = score_windows(window_aggregates(telemetry, size), dim)
    return emit_events(breach_candidates(scored, threshold), nudge)


def windowed_features(telemetry: DataFrame, dim: DataFrame, size: str = fv.WINDOW_SIZE,
                      nudge: float = 0.0) -> DataFrame:
    """Every window, kept or not, for the feature table."""
    return score_windows(window_aggregates(telemetry, size), dim).select(
        "param", "window_start", _rounded("v_avg", nudge), _rounded("v_std", nudge),
        _rounded("v_delta", nudge), "zone", _rounded("p_breach", nudge, "p_raw"))


def predict_batch(requests: DataFrame, dim: DataFrame, nudge: float = 0.0) -> DataFrame:
    """Score rows of (param, v_avg, v_std, v_delta): probability, zone and driver."""
    scored = bands.with_bands(requests, dim, "primary_driver")
    return scored.select(
        *requests.columns,
        F.round(bands.pdm_score(F.col("v_avg"), F.col("v_std")) + F.lit(nudge), 4).alias("p_breach"),
        bands.zone(F.col("v_avg")).alias("zone"),
        F.coalesce("primary_driver", F.lit("unknown")).alias("top_driver"))

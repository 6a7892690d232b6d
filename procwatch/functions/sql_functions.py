"""The breach score and the driver as SQL functions, for queries written in SQL."""

from pyspark.sql import SparkSession

from procwatch import fixed_values as fv


def _case(values: dict[str, str], otherwise: str) -> str:
    arms = " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items())
    return f"CASE param {arms} ELSE {otherwise} END"


def register(spark: SparkSession) -> None:
    """Define PDM_SCORE(param, v_avg, v_std, v_delta) and TOP_DRIVER(param, v_avg).

    They are SQL expressions that the optimizer unfolds in place; no Python runs.
    """
    centre = _case({p["id"]: f"{sum(p['control']) / 2!r}D" for p in fv.PARAMETERS}, "NULL")
    half = _case({p["id"]: f"{max((p['alarm'][1] - p['alarm'][0]) / 2, fv.MIN_HALF_WIDTH)!r}D"
                  for p in fv.PARAMETERS}, "NULL")
    raw = (f"(abs(v_avg - ({centre})) / ({half}) - {fv.SCORE_OFFSET}D) / {fv.SCORE_SPAN}D "
           f"+ least(coalesce(v_std, 0D) / ({half}), {fv.VOLATILITY_CAP}D) "
           f"* {fv.VOLATILITY_WEIGHT}D")
    # a null deviation must give 0; greatest and least would skip it
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION PDM_SCORE("
              "param STRING, v_avg DOUBLE, v_std DOUBLE, v_delta DOUBLE) RETURNS DOUBLE "
              f"RETURN CASE WHEN v_avg IS NULL OR ({centre}) IS NULL THEN 0D "
              f"ELSE greatest(0D, least(1D, {raw})) END")
    drivers = _case({p["id"]: f"'{p['primary_driver']}'" for p in fv.PARAMETERS}, "'unknown'")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION TOP_DRIVER(param STRING, v_avg DOUBLE) "
              f"RETURNS STRING RETURN {drivers}")


def continuous_query(source: str, size: str = fv.WINDOW_SIZE,
                     threshold: float = fv.BREACH_THRESHOLD) -> str:
    """The breach query as SQL over a telemetry view; works on a streaming view too."""
    return f"""
        SELECT concat('evt-', param, '-', unix_timestamp(w.start)) AS event_id, param, asset,
               batch_id, w.start AS window_start, w.end AS window_end, round(m, 4) AS v_avg,
               v_min, v_max, round(s, 4) AS v_std, round(v_max - v_min, 4) AS v_delta, n_rows, zone,
               round(p, 4) AS p_breach, TOP_DRIVER(param, m) AS top_driver,
               current_timestamp() AS emitted_at
        FROM (SELECT *, PDM_SCORE(param, m, s, v_max - v_min) AS p
              FROM (SELECT param, window(ts, '{size}') AS w, max(asset) AS asset,
                           max(batch_id) AS batch_id, avg(value) AS m, min(value) AS v_min,
                           max(value) AS v_max, stddev_pop(value) AS s, count(*) AS n_rows,
                           max(zone) AS zone
                    FROM {source} GROUP BY param, window(ts, '{size}')))
        WHERE p > {threshold}D OR zone <> 'control'"""

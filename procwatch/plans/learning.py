"""Registered queries over training sets, splits, metrics and latest rows."""

from pyspark.sql import functions as F

from procwatch.functions import bands
from procwatch.operators import breach, features, latest, metrics, ordering
from procwatch.plans import inputs, sql
from procwatch.plans.signals import CHECK_WINDOW, NUDGE
from procwatch.session import materialize

ORDER = ["ts", "event_id"]
SEGMENT = 300  # small, so that the checked parameters have many segments


def _r(name, digits=6):
    return F.round(F.col(name) + F.lit(NUDGE), digits).alias(name)


def _history(spark, sf_dir):
    df = inputs.telemetry_with_features(spark, sf_dir)
    return df.select("param", "ts", "event_id", "value", F.element_at("features", "k").alias("k"))


def _training(spark, sf_dir):
    return features.training_set(_history(spark, sf_dir), bands.dimension(spark), ORDER,
                                 features=["k"], segment_rows=SEGMENT)


def row_numbers(spark, sf_dir):
    """The place of each reading in the order of its parameter."""
    numbered = ordering.number_rows(_history(spark, sf_dir).select("param", *ORDER), ["param"], ORDER)
    return numbered.select("param", "event_id", F.col("_idx").alias("place"))


def rolling_features(spark, sf_dir):
    df = features.rolling_features(_history(spark, sf_dir), ORDER, features=["k"],
                                   segment_rows=SEGMENT)
    return df.select("param", "event_id", _r("v_avg"), _r("v_std"), _r("v_delta"), _r("k_mean"))


def forward_label(spark, sf_dir):
    df = features.forward_label(_history(spark, sf_dir), bands.dimension(spark), ORDER,
                                segment_rows=SEGMENT)
    return df.select("param", "event_id", "label")


def training_set(spark, sf_dir):
    return _training(spark, sf_dir).select(
        "param", "event_id", _r("v_avg"), _r("v_std"), _r("v_delta"), "label")


def windowed_training_set(spark, sf_dir):
    windows = breach.window_aggregates(inputs.telemetry(spark, sf_dir), CHECK_WINDOW)
    df = features.windowed_training_set(windows, bands.dimension(spark), segment_rows=SEGMENT)
    return df.select("param", F.unix_timestamp("window_start").alias("window_start"), "label")


def label_classes(spark, sf_dir):
    return (features.class_counts(_training(spark, sf_dir), "label", "param")
            .select("param", "n_rows", "n_classes"))


def label_positive_rate(spark, sf_dir):
    return (features.class_counts(_training(spark, sf_dir), "label", "param")
            .select("param", _r("positive_rate")))


def stratified_split(spark, sf_dir):
    rows = materialize(_training(spark, sf_dir).select("param", "event_id", "label"), "training")
    return features.stratified_split(rows, ["event_id"], ["param", "label"])


def _predictions(spark, sf_dir):
    """The breach score of each training row, rounded so that ties are ties anywhere."""
    scored = bands.with_bands(_training(spark, sf_dir), bands.dimension(spark))
    p = bands.pdm_score(F.col("v_avg"), F.col("v_std"))
    return scored.select("param", "label", F.round(p + F.lit(NUDGE), 6).alias("p"))


def classification_metrics(spark, sf_dir):
    df = metrics.classification_metrics(_predictions(spark, sf_dir), "label", "p", ["param"])
    return df.select("param", "n", _r("accuracy"), _r("precision"), _r("recall"))


def roc_auc(spark, sf_dir):
    return metrics.roc_auc(_predictions(spark, sf_dir), "label", "p", ["param"]).select(
        "param", _r("auc"))


def importance_shares(spark, sf_dir):
    """Mean absolute contribution of each serving column, as shares, best first."""
    rows = _training(spark, sf_dir).select(
        "param", F.explode(F.create_map(
            F.lit("v_avg"), F.col("v_avg"), F.lit("v_std"), F.col("v_std"),
            F.lit("v_delta"), F.col("v_delta"))).alias("feature", "contribution"))
    means = metrics.mean_absolute(rows, "feature", "contribution", ["param"])
    return (metrics.importance_shares(means, "importance", ["param"], nudge=NUDGE)
            .orderBy("param", F.desc("share"), "feature").select("param", "feature", "share"))


def latest_n_per_param(spark, sf_dir):
    df = inputs.telemetry(spark, sf_dir).select("param", "event_id", "ts", "zone")
    return latest.latest_per_key(df, ["param"], [F.desc("ts"), F.desc("event_id")]).select(
        "param", "event_id", "zone")


def latest_n_overall(spark, sf_dir):
    df = inputs.telemetry(spark, sf_dir).select("param", "event_id", "ts", "zone")
    return latest.latest_overall(df.where(F.col("zone").isin("alarm", "trip")),
                                 [F.desc("ts"), F.desc("event_id")]).select(
        "param", "event_id", "zone")


def upsert_latest_by_key(spark, sf_dir):
    """One row per batch and parameter: the last reading written wins."""
    df = inputs.telemetry(spark, sf_dir).select("param", "batch_id", "event_id", "ts", "value")
    return latest.last_by_key(df, ["param", "batch_id"], [F.desc("ts"), F.desc("event_id")]).select(
        "param", "batch_id", "event_id", _r("value"))


QUERIES = {f.__name__: f for f in (
    row_numbers, rolling_features, forward_label, training_set, windowed_training_set, label_classes,
    label_positive_rate, stratified_split, classification_metrics, roc_auc, importance_shares,
    latest_n_per_param, latest_n_overall, upsert_latest_by_key)}

_TRAIN = """,
h AS (SELECT param, event_id, ts, v, cl, ch, al, ah, CAST(json_extract(props, '$.k') AS DOUBLE) AS k,
             CASE WHEN v < cl OR v > ch THEN 1 ELSE 0 END AS br FROM telem),
f AS (SELECT *, count(k) OVER r AS n_k, avg(v) OVER r AS v_avg, stddev_pop(v) OVER r AS v_std,
             max(v) OVER r - min(v) OVER r AS v_delta, avg(k) OVER r AS k_mean,
             count(*) OVER (PARTITION BY param ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 14 FOLLOWING) AS ahead,
             max(br) OVER (PARTITION BY param ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND 15 FOLLOWING) AS mx
      FROM h WINDOW r AS (PARTITION BY param ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
lab AS (SELECT *, CASE WHEN ahead < 15 THEN 0 ELSE coalesce(mx, 0) END AS label FROM f),
train AS (SELECT * FROM lab WHERE n_k = 10)
"""
_PRED = _TRAIN + """,
pred AS (SELECT param, label, round(greatest(0::DOUBLE, least(1::DOUBLE,
        (abs(v_avg - (cl + ch) / 2::DOUBLE) / greatest((ah - al) / 2::DOUBLE, 1e-9::DOUBLE) - 0.30::DOUBLE) / 0.85::DOUBLE
        + least(v_std / greatest((ah - al) / 2::DOUBLE, 1e-9::DOUBLE), 0.5::DOUBLE) * 0.35::DOUBLE)) + 1e-9::DOUBLE, 6) AS p
      FROM train)
"""
_R = "round({0} + 1e-9::DOUBLE, 6) AS {0}"
_ROLL = ", ".join(_R.format(c) for c in ("v_avg", "v_std", "v_delta"))
ORACLES = {
    "row_numbers": sql.with_telemetry("""
        SELECT param, event_id, row_number() OVER (PARTITION BY param ORDER BY ts, event_id) - 1 AS place FROM telem"""),
    "rolling_features": sql.with_telemetry(
        _TRAIN + f"SELECT param, event_id, {_ROLL}, {_R.format('k_mean')} FROM train"),
    "forward_label": sql.with_telemetry(_TRAIN + "SELECT param, event_id, label FROM lab"),
    "training_set": sql.with_telemetry(
        _TRAIN + f"SELECT param, event_id, {_ROLL}, label FROM train"),
    "windowed_training_set": sql.with_events("""
        , x AS (SELECT param, window_start, CASE WHEN v_avg < cl OR v_avg > ch THEN 1 ELSE 0 END AS br
                FROM scored),
        y AS (SELECT param, window_start,
             count(*) OVER (PARTITION BY param ORDER BY window_start ROWS BETWEEN CURRENT ROW AND 14 FOLLOWING) AS ahead,
             max(br) OVER (PARTITION BY param ORDER BY window_start ROWS BETWEEN 1 FOLLOWING AND 15 FOLLOWING) AS mx
             FROM x)
        SELECT param, window_start, CASE WHEN ahead < 15 THEN 0 ELSE coalesce(mx, 0) END AS label FROM y"""),
    "label_classes": sql.with_telemetry(
        _TRAIN + "SELECT param, count(*) AS n_rows, count(DISTINCT label) AS n_classes FROM train GROUP BY param"),
    "label_positive_rate": sql.with_telemetry(
        _TRAIN + "SELECT param, round(avg(label) + 1e-9::DOUBLE, 6) AS positive_rate FROM train GROUP BY param"),
    "stratified_split": sql.with_telemetry(_TRAIN + """
        SELECT param, event_id, label, CASE WHEN
            row_number() OVER (PARTITION BY param, label ORDER BY substr(md5(CAST(event_id AS VARCHAR)), 1, 15), event_id)
            <= floor(count(*) OVER (PARTITION BY param, label) * 0.25::DOUBLE + 0.5::DOUBLE)
            THEN 'test' ELSE 'train' END AS split FROM train"""),
    "classification_metrics": sql.with_telemetry(_PRED + """
        , c AS (SELECT param, count(*) AS n, sum(CASE WHEN (p >= 0.5) = (label = 1) THEN 1 ELSE 0 END) AS ok,
               sum(CASE WHEN p >= 0.5 THEN 1 ELSE 0 END) AS said, sum(label) AS actual,
               sum(CASE WHEN p >= 0.5 AND label = 1 THEN 1 ELSE 0 END) AS hits FROM pred GROUP BY param)
        SELECT param, n, round(ok / n::DOUBLE + 1e-9::DOUBLE, 6) AS accuracy,
               round(coalesce(hits / nullif(said, 0)::DOUBLE, 0) + 1e-9::DOUBLE, 6) AS precision,
               round(coalesce(hits / nullif(actual, 0)::DOUBLE, 0) + 1e-9::DOUBLE, 6) AS recall FROM c"""),
    "roc_auc": sql.with_telemetry(_PRED + """
        , k AS (SELECT param, label, rank() OVER (PARTITION BY param ORDER BY p)
                + (count(*) OVER (PARTITION BY param, p) - 1) / 2::DOUBLE AS r FROM pred),
        s AS (SELECT param, sum(CASE WHEN label = 1 THEN r ELSE 0 END) AS rs,
                     CAST(sum(label) AS DOUBLE) AS np, CAST(count(*) - sum(label) AS DOUBLE) AS nn
              FROM k GROUP BY param)
        SELECT param, round((rs - np * (np + 1) / 2) / (np * nn) + 1e-9::DOUBLE, 6) AS auc FROM s"""),
    "importance_shares": sql.with_telemetry(_TRAIN + """
        , u AS (SELECT param, unnest(['v_avg', 'v_std', 'v_delta']) AS feature,
                       unnest([v_avg, v_std, v_delta]) AS x FROM train),
        g AS (SELECT param, feature, avg(abs(x)) AS imp FROM u GROUP BY ALL)
        SELECT param, feature, round(imp / sum(imp) OVER (PARTITION BY param) + 1e-9::DOUBLE, 4) AS share
        FROM g"""),
    "latest_n_per_param": sql.with_telemetry("""
        SELECT param, event_id, zone FROM telem
        QUALIFY row_number() OVER (PARTITION BY param ORDER BY ts DESC, event_id DESC) <= 240"""),
    "latest_n_overall": sql.with_telemetry("""
        SELECT param, event_id, zone FROM telem WHERE zone IN ('alarm', 'trip')
        ORDER BY ts DESC, event_id DESC LIMIT 200"""),
    "upsert_latest_by_key": sql.with_telemetry("""
        SELECT param, CAST(user_id AS VARCHAR) AS batch_id, event_id,
               round(v + 1e-9::DOUBLE, 6) AS value FROM telem
        QUALIFY row_number() OVER (PARTITION BY param, user_id ORDER BY ts DESC, event_id DESC) = 1"""),
}

"""Registered queries that fit models.

What a fit gives has no SQL. The queries return what has: the held-out rows, counts and rates,
and 1 where a probability or share is one. Labels of the test tables hardly follow from their
readings, so the models learn a planted label: whether the mean of a parameter's last readings
lies above a mark, turned round for one row in twenty. Held-out predictions are compared with
the rule itself; a constant or a random model fails.
"""

import hashlib
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from procwatch.functions import bands, sql_functions
from procwatch.operators import contributions, metrics, models
from procwatch.plans import inputs, learning, signals, sql
from procwatch.session import file_system, materialize, session_dir
from procwatch.sources import tables

EACH = {"temp": "gbm", "ph": "random_forest", "press": "gbm", "cond": "svm", "hum": "ann"}


MARK = 0.1712345   # of half the alarm band above the control centre; no mean of readings is equal to it
TURNED = "0d"      # rows whose hash begins below it have the other label: 13 in 256
MIN_AGREEMENT, MIN_AUC = 0.9, 0.85
LEADING = "v_avg"  # the column that the rule looks at


def _rule():
    return F.round("v_avg", 6) > bands.control_centre() + F.lit(MARK) * bands.half_alarm()


def _training(spark, sf_dir):
    rows = bands.with_bands(learning._training(spark, sf_dir), bands.dimension(spark))
    turned = F.substring(F.md5(F.concat(F.lit("turned:"), F.col("event_id").cast("string"))), 1, 2) < TURNED
    return rows.select("param", "event_id", *models.SERVING, (_rule() != turned).cast("int").alias("label"))


def _fit(spark, sf_dir, *params):
    """Models and predictions of the parameters, fitted once for a session and stored in its folder:
    several queries look at the same models."""
    folder = f"{session_dir(spark)}/models/{hashlib.md5(sf_dir.encode()).hexdigest()}"
    missing = [p for p in params if not _is_there(spark, f"{folder}/{p}/done")]
    if missing:
        training = materialize(_training(spark, sf_dir), "training")

        def fit(p):
            fitted = models.fit_parameter(training, p, ["event_id"])
            if fitted:
                models.save({p: fitted}, f"{folder}/{p}")
                fitted.test.write.mode("overwrite").parquet(f"{folder}/{p}/test")
                tables.write_json(models.metrics_table(spark, {p: fitted}), f"{folder}/{p}/metrics")
            spark.range(int(bool(fitted))).write.mode("overwrite").parquet(f"{folder}/{p}/done")

        models.side_by_side(spark, fit, missing)
    return {p: f"{folder}/{p}" for p in params
            if spark.read.schema("id long").parquet(f"{folder}/{p}/done").count()}


def _is_there(spark, path):
    files, folder = file_system(spark, path)
    return files.exists(folder)


def _held_out(spark, sf_dir, *params):
    parts = [spark.read.parquet(f"{folder}/test") for folder in _fit(spark, sf_dir, *params).values()]
    empty = spark.createDataFrame(
        [], "param string, event_id long, v_avg double, v_std double, v_delta double, label int, p double")
    return reduce(DataFrame.unionByName, [x.select(*empty.columns) for x in parts], empty)


def _predictions(spark, sf_dir, *params):
    """The held-out rows, with 1 where the probability is one and where the model has found the rule."""
    rows = _held_out(spark, sf_dir, *params)
    sides = bands.with_bands(rows, bands.dimension(spark)).withColumn("_right", (F.col("p") >= 0.5) == _rule())
    told = sides.groupBy("param").agg(
        (F.avg(F.col("_right").cast("int")) >= MIN_AGREEMENT).cast("int").alias("rule_found"))
    return rows.join(told, "param").select(
        "param", "event_id", "label", F.col("p").between(0, 1).cast("int").alias("p_valid"), "rule_found")


def model_gbt(spark, sf_dir):
    return _predictions(spark, sf_dir, "temp", "press")


def model_rf(spark, sf_dir):
    return _predictions(spark, sf_dir, "ph")


def model_svm(spark, sf_dir):
    return _predictions(spark, sf_dir, "cond")


def model_mlp(spark, sf_dir):
    return _predictions(spark, sf_dir, "hum")


def train_all(spark, sf_dir):
    """What was measured, as far as it does not hang on the fit; the rest as 1 where it is possible."""
    schema = models.metrics_table(spark, {}).schema
    folders = [f"{folder}/metrics" for folder in _fit(spark, sf_dir, *inputs.PARAM_ORDER).values()]
    table = spark.read.schema(schema).json(folders) if folders else spark.createDataFrame([], schema)
    shares = F.aggregate(F.map_values("importance"), F.lit(0.0), lambda a, b: a + b)
    return table.select(
        "param", "model", "n_train", "n_test", F.round(F.col("positive_rate") + F.lit(1e-9), 6).alias("positive_rate"),
        (F.col("auc") >= MIN_AUC).cast("int").alias("auc_above_bound"),
        (F.col("accuracy").between(0, 1) & F.col("precision").between(0, 1) & F.col("recall").between(0, 1))
        .cast("int").alias("scores_valid"), shares.between(0.999, 1.001).cast("int").alias("shares_sum_to_one"))


def permutation_importance(spark, sf_dir):
    """Of all five models, on all held-out rows; `leads` is 1 where a column matters most."""
    empty = spark.createDataFrame([], "feature string, importance double, param string")
    parts = [models.permutation_importance(models.load(folder, [p])[p], spark.read.parquet(f"{folder}/test"),
                                           ["event_id"]).withColumn("param", F.lit(p))
             for p, folder in _fit(spark, sf_dir, *inputs.PARAM_ORDER).items()]
    found = materialize(reduce(DataFrame.unionByName, parts, empty), "importances")
    first = found.groupBy("param").agg(F.max_by("feature", "importance").alias("_first"))
    return found.join(first, "param").select(
        "param", "feature", F.col("importance").between(0, 1).cast("int").alias("valid"),
        (F.col("feature") == F.col("_first")).cast("int").alias("leads"))


def tree_contributions(spark, sf_dir):
    """What each column adds to the score of every held-out row of the tree models.

    1 where the parts add up to the score minus its mean over the held-out rows, and where the
    column that the rule looks at has the largest mean absolute part of its parameter.
    """
    parts = [spark.createDataFrame([], "param string, event_id long, score double, base double, "
                                   + ", ".join(f"c_{c} double" for c in models.SERVING))]
    for p, folder in _fit(spark, sf_dir, "temp", "press", "ph").items():
        model, rows = models.load(folder, [p])[p], spark.read.parquet(f"{folder}/test")
        found = contributions.contributions(model, rows, rows, models.SERVING)
        score = F.col("p") if models.KINDS[p] == "random_forest" else F.log(F.col("p") / (1 - F.col("p"))) / 2
        parts.append(found.select(
            "param", "event_id", score.alias("score"), "base",
            *[f"c_{c}" for c in models.SERVING]))
    explained = materialize(reduce(DataFrame.unionByName, parts), "contributions")
    each = explained.select("param", F.explode(F.create_map(*[
        x for c in models.SERVING for x in (F.lit(c), F.col(f"c_{c}"))])).alias("feature", "part"))
    means = metrics.mean_absolute(each, "feature", "part", ["param"])
    leads = means.groupBy("param").agg(
        (F.max_by("feature", "importance") == LEADING).cast("int").alias("leads"))
    total = sum((F.col(f"c_{c}") for c in models.SERVING), F.lit(0.0))
    return explained.join(leads, "param").select(
        "param", "event_id", (F.abs(total - (F.col("score") - F.col("base"))) < 1e-6).cast("int").alias("adds_up"),
        "leads")


def predict_with_models(spark, sf_dir):
    """All windows scored by the models of all parameters."""
    windows = materialize(signals._windows(spark, sf_dir).select(
        "param", "window_start", "v_avg", "v_std", "v_delta"), "windows")
    fitted = {p: models.load(folder, [p])[p] for p, folder in _fit(spark, sf_dir, *inputs.PARAM_ORDER).items()}
    scored = models.predict(windows, bands.dimension(spark), fitted)
    return scored.select("param", F.unix_timestamp("window_start").alias("window_start"), "zone", "top_driver",
                         "source", F.col("p_breach").between(0, 1).cast("int").alias("p_valid"))


def sql_breach_query(spark, sf_dir):
    """The breach query written in SQL with the registered functions."""
    sql_functions.register(spark)
    inputs.telemetry(spark, sf_dir).createOrReplaceTempView("procwatch_telemetry")
    df = spark.sql(sql_functions.continuous_query("procwatch_telemetry", signals.CHECK_WINDOW))
    return df.select("event_id", "n_rows", "zone", "top_driver", "batch_id")


QUERIES = {f.__name__: f for f in (
    model_gbt, model_rf, model_svm, model_mlp, train_all, permutation_importance, tree_contributions,
    predict_with_models, sql_breach_query)}
_SPLIT = learning._TRAIN + f""",
planted AS (SELECT * REPLACE (CASE WHEN (round(v_avg, 6) > (cl + ch) / 2::DOUBLE
                + {MARK}::DOUBLE * greatest((ah - al) / 2::DOUBLE, 1e-9::DOUBLE))
                <> (substr(md5('turned:' || CAST(event_id AS VARCHAR)), 1, 2) < '{TURNED}') THEN 1 ELSE 0 END AS label)
            FROM train),
two AS (SELECT param FROM planted GROUP BY param HAVING count(DISTINCT label) > 1),
spl AS (SELECT param, event_id, label, row_number() OVER (PARTITION BY param, label
            ORDER BY substr(md5(CAST(event_id AS VARCHAR)), 1, 15), event_id)
        <= floor(count(*) OVER (PARTITION BY param, label) * 0.25::DOUBLE + 0.5::DOUBLE) AS held
        FROM planted WHERE param IN (SELECT param FROM two)),
kinds AS (SELECT * FROM (VALUES ('temp', 'gbm'), ('ph', 'random_forest'), ('press', 'gbm'), ('cond', 'svm'),
                                ('hum', 'ann')) t(param, model))"""


def _held(*params):
    names = ", ".join(f"'{p}'" for p in params)
    return sql.with_telemetry(
        _SPLIT + f"SELECT param, event_id, label, 1 AS p_valid, 1 AS rule_found FROM spl WHERE held AND param IN ({names})")


ORACLES = {
    "model_gbt": _held("temp", "press"), "model_rf": _held("ph"), "model_svm": _held("cond"), "model_mlp": _held("hum"),
    "train_all": sql.with_telemetry(_SPLIT + """
        SELECT param, model, count(*) FILTER (NOT held) AS n_train, count(*) FILTER (held) AS n_test,
               round(avg(label) + 1e-9::DOUBLE, 6) AS positive_rate, 1 AS auc_above_bound, 1 AS scores_valid,
               1 AS shares_sum_to_one
        FROM spl JOIN kinds USING (param) GROUP BY param, model"""),
    "permutation_importance": sql.with_telemetry(_SPLIT + """
        SELECT param, unnest(['v_avg', 'v_std', 'v_delta']) AS feature, 1 AS valid,
               unnest([1, 0, 0]) AS leads FROM two"""),
    "tree_contributions": sql.with_telemetry(
        _SPLIT + "SELECT param, event_id, 1 AS adds_up, 1 AS leads FROM spl WHERE held AND param IN ('temp', 'press', 'ph')"),
    "predict_with_models": sql.with_ctes(sql.EVENTS + _SPLIT[_SPLIT.index(",\nh AS"):], """
        SELECT scored.param, scored.window_start,
               CASE WHEN v_avg < tl OR v_avg > th THEN 'trip' WHEN v_avg < al OR v_avg > ah THEN 'alarm'
                    ELSE 'control' END AS zone, top_driver,
               CASE WHEN two.param IS NULL THEN 'analytic fallback' ELSE model || ' (trained)' END AS source,
               1 AS p_valid
        FROM scored JOIN kinds USING (param) LEFT JOIN two ON two.param = scored.param"""),
    "sql_breach_query": sql.with_events(
        "SELECT event_id, n_rows, zone, top_driver, batch_id FROM ev"),
}

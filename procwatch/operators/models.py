"""One classifier per parameter: fit, score, evaluate, explain."""

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from math import ceil
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier,
    RandomForestClassifier)
from pyspark.ml.feature import Bucketizer, SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from procwatch import fixed_values as fv
from procwatch.functions import bands
from procwatch.operators import features, metrics, ordering
from procwatch.session import materialize

SERVING = ["v_avg", "v_std", "v_delta"]
FOURIER_FEATURES = 96
FIT_ROWS = 50_000  # training rows a partition of a fit; bagging is seeded per partition, so fits depend on it
DENSE_ROWS, DENSE_PARTS = 4_000, 24  # of the fits without bagging, whose rows cost far more, until FIT_ROWS asks for more
BUNDLE_FROM = 100_000  # training rows of a parameter beyond which those that trees cannot tell apart go bundled
MARKED = 32  # values a column of bundles takes, as many as the bins of Spark's trees
APART = 5  # rows of a cell that are never bundled; a leaf's least rows are counted as without bundles
KINDS = {p["id"]: p["model"] for p in fv.PARAMETERS}


def fit_parts(n_train: int, kind: str = "gbm") -> int:
    """Partitions that the training rows of a fit lie in."""
    parts = max(2, ceil(n_train / FIT_ROWS))
    return parts if kind in ("gbm", "random_forest") else max(parts, min(ceil(n_train / DENSE_ROWS), DENSE_PARTS))


def side_by_side(spark, work: Callable, items: Iterable) -> list:
    """work(item) of all items, each in a thread of its own.

    A fit is a long row of short jobs, so one alone leaves most of the cluster idle.
    """
    items = list(items)
    if not items:
        return []
    with ThreadPool(len(items)) as pool:
        return pool.map(inheritable_thread_target(spark)(work), items, chunksize=1)


def balanced_weights(train: DataFrame, label: str = "label") -> DataFrame:
    """Add `weight` = n / (2 x rows of the class) for each of a row's `n_rows` (1 if it has none),
    so both classes weigh the same."""
    rows = F.col("n_rows") if "n_rows" in train.columns else F.lit(1)
    counts = {r[label]: r["n"] for r in train.groupBy(label).agg(F.sum(rows).alias("n")).collect()}
    total = sum(counts.values())
    by_class = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, total / (2.0 * n))])
    return train.withColumn("weight", F.element_at(by_class, F.col(label)) * rows)


def _marked_values(sample: DataFrame, columns: list[str]) -> dict[str, list[float]]:
    """Per column at most `MARKED` values: all there are, or the middles of as many equal shares."""
    middles = F.array(*[F.lit((i + 0.5) / MARKED) for i in range(MARKED)])
    real = [F.when(~F.isnan(c), F.col(c)) for c in columns]
    row = sample.agg(*[F.slice(F.array_sort(F.collect_set(v)), 1, MARKED + 1).alias(f"all_{c}") for c, v in zip(columns, real)],
                     *[F.percentile(v, middles).alias(f"mid_{c}") for c, v in zip(columns, real)]).first()
    return {c: row[f"all_{c}"] if len(row[f"all_{c}"]) <= MARKED else sorted(set(row[f"mid_{c}"])) for c in columns}


def bundles(train: DataFrame, key: list[str], n_train: int, columns: list[str] = SERVING) -> DataFrame:
    """(columns, label, n_rows): the training rows as trees see them, which look at bins only.

    Each value counts as the nearest marked value of its column, so Spark's trees find their marks
    half-way between those, where the cells meet. Rows of one cell and label are the same to a tree; they go
    in bundles of equal size, each weighing its rows. No row is left out, and no more than some `BUNDLE_FROM`
    bundles are made, besides `APART` a cell. Marked values come from rows picked by the hash of their key,
    ten times as many as Spark looks at. Bagging draws bundles instead of rows.
    """
    step = ceil(n_train / BUNDLE_FROM)
    marked = _marked_values(train.where(F.pmod(F.xxhash64(*key), F.lit(step)) == 0), columns)
    # the mark itself belongs below, as in a tree; a column of missing values has no marks
    splits = [[-np.inf, *[float(np.nextafter((a + b) / 2, np.inf)) for a, b in zip(marked[c], marked[c][1:])], np.inf]
              for c in columns]
    splits = [x if len(x) > 2 else [-np.inf, 0.0, np.inf] for x in splits]
    cut = Bucketizer(inputCols=columns, outputCols=[f"_c{i}" for i in range(len(columns))], splitsArray=splits,
                     handleInvalid="keep").transform(train)
    cells = cut.groupBy("label", *[f"_c{i}" for i in range(len(columns))]).agg(F.count(F.lit(1)).alias("_n"))
    values = []
    for i, c in enumerate(columns):
        known = marked[c] if len(marked[c]) > 1 else [*marked[c], *marked[c]] or [float("nan")] * 2
        values.append(F.get(F.array(*[F.lit(float(v)) for v in [*known, float("nan")]]), F.col(f"_c{i}").cast("int")).alias(c))
    many = F.least("_n", F.greatest(F.lit(APART), F.ceil(F.col("_n") / step)))
    return cells.withColumn("_many", many).select(
        *values, "label", "_n", "_many", F.explode(F.sequence(F.lit(1).cast("long"), "_many")).alias("bundle")).select(
        *columns, "label", "bundle", (F.floor(F.col("_n") / F.col("_many"))
                                      + (F.col("bundle") <= F.col("_n") % F.col("_many")).cast("long")).alias("n_rows"))


def _assembler(columns: list[str], out: str) -> VectorAssembler:
    return VectorAssembler(inputCols=columns, outputCol=out, handleInvalid="keep")


def _fourier(train: DataFrame, gamma: float, n: int) -> SQLTransformer:
    """Random Fourier features of the scaled columns: their inner products approach an
    RBF kernel of width `gamma`, so a linear machine on them approaches the kernel one."""
    row = train.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(SERVING)],
                    *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(SERVING)]).first()
    rng = np.random.default_rng(fv.SEED)
    directions = rng.normal(0.0, np.sqrt(2.0 * gamma), (n, len(SERVING)))
    shifts = rng.uniform(0.0, 2.0 * np.pi, n)
    height = float(np.sqrt(2.0 / n))
    terms = []
    for j in range(n):
        inner = " + ".join(
            f"{directions[j, i]!s}D * ({c} - ({row[f'm{i}']!s}D)) / {row[f's{i}'] or 1.0!s}D"
            for i, c in enumerate(SERVING))
        terms.append(f"{height!s}D * cos({inner} + {shifts[j]!s}D) AS _f{j}")
    return SQLTransformer(statement=f"SELECT *, {', '.join(terms)} FROM __THIS__")


def _svm(train: DataFrame, c: float = fv.KERNEL_COST) -> PipelineModel:
    made = [_fourier(train, 1.0 / len(SERVING), FOURIER_FEATURES),
            _assembler([f"_f{j}" for j in range(FOURIER_FEATURES)], "_x")]
    # written, so that the tasks of some hundred short jobs read vectors and do not carry the plan of all terms
    rows = materialize(PipelineModel(stages=made).transform(balanced_weights(train)).select(
        "_x", "label", "weight"), "kernel-features")
    margin = LinearSVC(featuresCol="_x", weightCol="weight", maxIter=100, tol=1e-3,
                       regParam=1.0 / (c * max(rows.count(), 1)), rawPredictionCol="_margin",
                       predictionCol="_side").fit(rows)
    platt = LogisticRegression(featuresCol="_margin", weightCol="weight").fit(margin.transform(rows))
    return PipelineModel(stages=[*made, margin, platt])


def fit(train: DataFrame, kind: str) -> PipelineModel:
    """Fit a model of `kind` to (v_avg, v_std, v_delta, label); trees also take bundles with `n_rows`."""
    if kind == "svm":
        return _svm(train)
    if kind == "gbm":
        # subsample 0.9 of rows; three columns, so all are looked at in each split
        weighed = {"weightCol": "n_rows"} if "n_rows" in train.columns else {}
        model = GBTClassifier(featuresCol="_x", seed=fv.SEED, **weighed, **fv.BOOSTING)
        return Pipeline(stages=[_assembler(SERVING, "_x"), model]).fit(train)
    if kind == "random_forest":
        model = RandomForestClassifier(featuresCol="_x", weightCol="weight", seed=fv.SEED, **fv.FOREST)
        return Pipeline(stages=[_assembler(SERVING, "_x"), model]).fit(balanced_weights(train))
    if kind == "ann":
        model = MultilayerPerceptronClassifier(
            featuresCol="_x", layers=[len(SERVING), *fv.NETWORK_LAYERS, 2], seed=fv.SEED, **fv.NETWORK)
        return Pipeline(stages=[
            _assembler(SERVING, "_raw"),
            StandardScaler(inputCol="_raw", outputCol="_x", withMean=True), model]).fit(train)
    raise ValueError(f"unknown model kind: {kind}")


def score(model: PipelineModel, df: DataFrame, name: str = "p") -> DataFrame:
    """Add the probability of a breach."""
    scored = model.transform(df)
    return scored.select(*df.columns, vector_to_array("probability")[1].alias(name))


@dataclass(frozen=True)
class Fitted:
    """A fitted model and what was measured on its held-out rows."""

    param: str
    kind: str
    model: PipelineModel
    test: DataFrame
    metrics: dict
    importance: dict


def fit_parameter(training: DataFrame, param: str, key: list[str], parts: int | None = None
                  ) -> Fitted | None:
    """Split, fit, evaluate and explain one parameter; None when there is but one class.

    `training` is best a written table: it is read a few times. The rows of a fit lie in
    `parts` partitions by the hash of their key, by default as many as `fit_parts` says. Beyond
    `BUNDLE_FROM` training rows trees are fitted to `bundles`, which hold every row.
    """
    rows = training.where(F.col("param") == param).select("param", *key, *SERVING, "label")
    rows = materialize(features.stratified_split(rows, key, ["param", "label"]), "split")
    shape = rows.agg(F.countDistinct("label").alias("classes"),
                     F.avg("label").alias("positive_rate"),
                     F.count_if(F.col("split") == "train").alias("n_train"),
                     F.count_if(F.col("split") == "test").alias("n_test")).first()
    if shape["classes"] < 2:
        return None
    kind = KINDS[param]
    train, by, n = rows.where("split = 'train'").withColumn("label", F.col("label").cast("double")), key, shape["n_train"]
    kept = [*SERVING, "label"]
    if kind in ("gbm", "random_forest") and n > BUNDLE_FROM:
        train = materialize(bundles(train, key, n), "bundles")
        by, n, kept = [*SERVING, "label", "bundle"], train.count(), [*kept, "n_rows"]
    model = fit(train.repartition(parts or fit_parts(n, kind), *by).sortWithinPartitions(*by).select(*kept), kind)
    test = materialize(score(model, rows.where("split = 'test'")), "predictions")
    measured = {**metrics.classification_metrics(test, "label", "p", ["param"]).first().asDict(),
                **metrics.roc_auc(test, "label", "p", ["param"]).first().asDict()}
    measured.update(n_train=shape["n_train"], n_test=shape["n_test"],
                    positive_rate=shape["positive_rate"])
    return Fitted(param, kind, model, test, measured, importance(model, test, key))


def importance(model: PipelineModel, test: DataFrame, key: list[str]) -> dict:
    """Shares of the serving columns: the model's own, else by permutation."""
    own = getattr(model.stages[-1], "featureImportances", None)
    if own is not None:
        raw = dict(zip(SERVING, own.toArray().tolist()))
    else:
        raw = {r["feature"]: r["importance"] for r in
               permutation_importance(model, test, key).collect()}
    total = sum(raw.values()) or 1.0
    return {c: round(raw[c] / total, 4) for c in SERVING}


def permutation_importance(model: PipelineModel, test: DataFrame, key: list[str],
                           repeats: int = 4) -> DataFrame:
    """(feature, importance): how often shuffling a column changes the model's answer.

    All rows of `test`, `repeats` shuffles per column. A shuffle pairs each row with the row
    at the same place in a hash order, so it is the same every time. Rows are numbered in
    blocks, so neither a column nor a shuffle has to fit into a task.
    """
    rows = test.select(*key, *SERVING)
    said = score(model, rows, "_p0").withColumn("_before", F.col("_p0") >= 0.5).drop("_p0")
    runs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(i).alias("run"))
                               for c in SERVING for i in range(repeats)])).alias("_run")
    source = F.create_map(*[x for c in SERVING for x in (F.lit(c), F.col(c))])
    copies = rows.select(*key, *SERVING, runs).select(
        *key, "_run.feature", "_run.run", F.element_at(source, F.col("_run.feature")).alias("_value")).withColumn(
        "_mixed", F.xxhash64(F.lit(fv.SEED), "feature", "run", *key))
    # the order of the keys is that of every run, so it is numbered once
    plain = ordering.number_rows(said.withColumn("_all", F.lit(0)), ["_all"], key).drop("_all")
    shuffled = ordering.number_rows(copies, ["feature", "run"], ["_mixed", *key])
    given = shuffled.select("feature", "run", "_idx", "_value")
    exchanged = plain.join(given, "_idx").select(
        "feature", "run", "_before", *[F.when(F.col("feature") == c, F.col("_value"))
                                       .otherwise(F.col(c)).alias(c) for c in SERVING])
    after = score(model, exchanged, "_p1").withColumn("_after", F.col("_p1") >= 0.5)
    changed = after.groupBy("feature", "run").agg(
        F.avg((F.col("_after") != F.col("_before")).cast("int")).alias("drop"))
    return changed.groupBy("feature").agg(F.avg("drop").alias("importance"))


def fit_all(training: DataFrame, key: list[str], params: list[str] | None = None
            ) -> dict[str, Fitted]:
    """One distributed fit per parameter, side by side; parameters with a single class are left out."""
    fitted = side_by_side(training.sparkSession, lambda p: fit_parameter(training, p, key), params or fv.PARAM_IDS)
    return {f.param: f for f in fitted if f}


def metrics_table(spark, fitted: dict[str, Fitted]) -> DataFrame:
    """One row per fitted model."""
    rows = [(f.param, f.kind, *[float(f.metrics[m]) for m in
                                ("auc", "accuracy", "precision", "recall", "positive_rate")],
             int(f.metrics["n_train"]), int(f.metrics["n_test"]), f.importance)
            for f in fitted.values()]
    return spark.createDataFrame(
        rows, "param string, model string, auc double, accuracy double, precision double, "
              "recall double, positive_rate double, n_train long, n_test long, "
              "importance map<string,double>")


def model_probability(df: DataFrame, models: dict[str, PipelineModel], name: str) -> DataFrame:
    """Add `name`, the probability by the model of the row's parameter; null without a model.

    Missing inputs count as 0 for the model; the rows keep them as they are. `df` is read once
    for each model: give it rows that are written.
    """
    known = F.coalesce(F.col("param").isin(list(models)), F.lit(False))
    out = df.where(~known).withColumn(name, F.lit(None).cast("double"))
    for param, model in models.items():
        filled = df.where(F.col("param") == param).withColumns(
            {f"_in_{c}": F.col(c) for c in SERVING}).withColumns(
            {c: F.coalesce(c, F.lit(0.0)) for c in SERVING})
        back = [F.col(f"_in_{c}").alias(c) if c in SERVING else F.col(c) for c in df.columns]
        out = out.unionByName(score(model, filled, name).select(*back, name))
    return out


def rescore(windows: DataFrame, models: dict[str, PipelineModel]) -> DataFrame:
    """Scored windows with `p_raw` by the models where there is one."""
    scored = model_probability(windows, models, "_p")
    return scored.withColumn("p_raw", F.coalesce("_p", "p_raw")).select(*windows.columns)


def predict(requests: DataFrame, dim: DataFrame, models: dict[str, PipelineModel]) -> DataFrame:
    """Score rows of (param, v_avg, v_std, v_delta) with each parameter's model.

    Parameters without a model get the analytic score; `source` tells which.
    """
    joined = bands.with_bands(requests, dim, "primary_driver", "model")
    rows = joined.select(
        *requests.columns, bands.zone(F.col("v_avg")).alias("zone"),
        F.coalesce("primary_driver", F.lit("unknown")).alias("top_driver"),
        bands.pdm_score(F.col("v_avg"), F.col("v_std")).alias("_analytic"),
        F.col("model").alias("_kind"))
    return model_probability(rows, models, "_p").select(
        *requests.columns, "zone", "top_driver",
        F.round(F.coalesce("_p", "_analytic"), 4).alias("p_breach"),
        F.when(F.col("_p").isNotNull(), F.concat("_kind", F.lit(" (trained)")))
        .otherwise("analytic fallback").alias("source"))


def save(fitted: dict[str, Fitted], folder: str) -> None:
    for param, f in fitted.items():
        f.model.write().overwrite().save(f"{folder.rstrip('/')}/{param}")


def load(folder: str, params: list[str]) -> dict[str, PipelineModel]:
    return {p: PipelineModel.load(f"{folder.rstrip('/')}/{p}") for p in params}

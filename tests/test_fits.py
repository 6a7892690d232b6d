"""How fits and permutations are spread."""

from threading import Barrier

from pyspark.sql import functions as F

from procwatch.operators import models


def _rows(spark, n=120):
    return spark.range(n).select(
        F.col("id").alias("event_id"), ((F.col("id") * 7 % 100) / 100.0).alias("v_avg"),
        ((F.col("id") * 11 % 13) / 100.0).alias("v_std"), ((F.col("id") * 3 % 11) / 50.0).alias("v_delta"),
        (F.col("id") * 7 % 100 > 40).cast("double").alias("label"))


def test_fits_run_side_by_side(spark):
    together = Barrier(3, timeout=60)

    def work(n):
        together.wait()  # breaks when one waits for the end of another
        return spark.range(n).count()

    assert models.side_by_side(spark, work, [3, 1, 2]) == [3, 1, 2]
    assert models.side_by_side(spark, work, []) == []


def test_fits_of_many_columns_have_more_partitions():
    assert models.fit_parts(90_000, "gbm") == models.fit_parts(90_000, "random_forest") == 2
    assert models.fit_parts(90_000, "svm") == models.fit_parts(90_000, "ann") == 23
    assert models.fit_parts(5_000_000, "svm") == models.fit_parts(5_000_000, "gbm") == 100


def test_kernel_features_are_written_before_the_fit(spark, monkeypatch):
    labels, real = [], models.materialize
    monkeypatch.setattr(models, "materialize", lambda df, label, *by: labels.append(label) or real(df, label, *by))
    model = models._svm(_rows(spark).select(*models.SERVING, "label"))
    assert labels == ["kernel-features"]
    right = model.transform(_rows(spark)).where("prediction = label").count()
    assert right >= 108


def test_bundles_hold_every_row_and_cells_meet_where_trees_split(spark, monkeypatch):
    """what a tree fit works on is bounded, however many rows there are."""
    monkeypatch.setattr(models, "BUNDLE_FROM", 400)
    rows = spark.range(40_000).selectExpr(
        "id AS event_id", "rand(5) AS v_avg", "CASE WHEN id % 1000 = 3 THEN double('nan') ELSE id % 3 END AS v_std",
        "0D AS v_delta", "cast(id % 7 = 0 AS double) AS label").localCheckpoint()
    made = models.bundles(rows, ["event_id"], 40_000).localCheckpoint()
    assert {r["label"]: r["n"] for r in made.groupBy("label").agg(F.sum("n_rows").alias("n")).collect()} == {
        r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert made.count() < 400 + models.APART * made.select(*models.SERVING, "label").distinct().count()
    assert made.agg(F.min("n_rows")).first()[0] >= 1 and made.agg(F.max("n_rows")).first()[0] <= 100
    assert {str(r[0]) for r in made.select("v_std").distinct().collect()} == {"0.0", "1.0", "2.0", "nan"}
    middles = sorted(r[0] for r in made.select("v_avg").distinct().collect())
    assert len(middles) == models.MARKED
    marks = [(a + b) / 2 for a, b in zip(middles, middles[1:])]
    for below in (0, 10, 30):
        assert (made.where(F.col("v_avg") <= marks[below]).agg(F.sum("n_rows")).first()[0]
                == rows.where(F.col("v_avg") <= marks[below]).count())


def test_trees_learn_from_bundles_what_they_learn_from_rows(spark, monkeypatch):
    monkeypatch.setitem(models.fv.FOREST, "numTrees", 10)
    monkeypatch.setitem(models.fv.BOOSTING, "maxIter", 5)
    rows = spark.range(30_000).selectExpr(
        "id AS event_id", "rand(5) AS v_avg", "floor(3 * rand(6)) * 0.5D AS v_std", "0.25D AS v_delta").withColumn(
        "label", ((F.col("v_avg") > 0.37) != (F.rand(8) < 0.05)).cast("int")).localCheckpoint()
    sizes, real = [], models.fit
    monkeypatch.setattr(models, "fit", lambda train, kind: sizes.append(train.count()) or real(train, kind))
    for param in ("ph", "temp"):
        found = []
        for most in (100_000, 1_000):
            monkeypatch.setattr(models, "BUNDLE_FROM", most)
            fitted = models.fit_parameter(rows.withColumn("param", F.lit(param)), param, ["event_id"])
            truth = F.col("v_avg") > 0.37
            found.append(fitted.test.agg(F.avg(((F.col("p") >= 0.5) == truth).cast("int"))).first()[0])
            assert 22_499 <= fitted.metrics["n_train"] <= 22_501 and found[-1] > 0.97
            assert fitted.importance["v_avg"] == max(fitted.importance.values())
        assert abs(found[0] - found[1]) < 0.02 and sizes[-1] < 2_000 < sizes[-2]


def test_few_rows_are_not_bundled(spark, monkeypatch):
    monkeypatch.setattr(models, "bundles", None)
    monkeypatch.setitem(models.fv.FOREST, "numTrees", 2)
    rows = _rows(spark).withColumn("param", F.lit("ph"))
    assert models.fit_parameter(rows, "ph", ["event_id"]).metrics["n_train"] == 90

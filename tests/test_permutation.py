"""Permutation importance numbers each order once."""

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from procwatch.operators import models, ordering


def test_the_order_of_the_keys_is_numbered_once(spark, monkeypatch):
    rows = spark.range(120).select(
        F.col("id").alias("event_id"), ((F.col("id") * 7 % 100) / 100.0).alias("v_avg"),
        ((F.col("id") * 11 % 13) / 100.0).alias("v_std"), ((F.col("id") * 3 % 11) / 50.0).alias("v_delta"),
        (F.col("id") * 7 % 100 > 40).cast("double").alias("label"))
    model = Pipeline(stages=[VectorAssembler(inputCols=models.SERVING, outputCol="_x"),
                             LogisticRegression(featuresCol="_x")]).fit(rows)
    numbered, real = [], ordering.number_rows
    monkeypatch.setattr(ordering, "number_rows", lambda df, *by: numbered.append(df.count()) or real(df, *by))
    found = {r["feature"]: r["importance"] for r in
             models.permutation_importance(model, rows, ["event_id"], repeats=2).collect()}
    assert sorted(numbered) == [120, 720]  # 720 twice before
    assert max(found, key=found.get) == "v_avg" and 0.2 < found["v_avg"] < 0.8

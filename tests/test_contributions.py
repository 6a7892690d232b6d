"""Contributions of columns to a score against sums over all subsets."""

import math
import random
from itertools import combinations

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LinearSVC, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from procwatch.operators import contributions

COLUMNS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(11)
    made = []
    for i in range(240):
        a, b, c = (rng.gauss(0, 1) for _ in COLUMNS)
        made.append((i, a, b, c, float(a + b * c + rng.gauss(0, 0.3) > 0)))
    return spark.createDataFrame(made, "id long, a double, b double, c double, label double").repartition(3, "id")


def _fit(rows, model):
    return Pipeline(stages=[VectorAssembler(inputCols=COLUMNS, outputCol="_x", handleInvalid="keep"), model]).fit(rows)


MODELS = {
    "boosted": lambda: GBTClassifier(featuresCol="_x", maxIter=6, maxDepth=4, seed=1),
    "forest": lambda: RandomForestClassifier(featuresCol="_x", numTrees=8, maxDepth=5, seed=1)}


def _expected(found, x, known):
    """The score where only the columns in `known` are looked at."""
    total = 0.0
    for leaf in found:
        part = leaf.value
        for j, share in leaf.share.items():
            inside = (x[j] <= leaf.high.get(j, math.inf)) and not x[j] <= leaf.low.get(j, -math.inf)
            part *= float(inside) if j in known else share
        total += part
    return total


def _all_subsets(found, x):
    out, n = [], len(x)
    for i in range(n):
        others, value = [j for j in range(n) if j != i], 0.0
        for size in range(n):
            weight = math.factorial(size) * math.factorial(n - 1 - size) / math.factorial(n)
            value += sum(weight * (_expected(found, x, {*s, i}) - _expected(found, x, set(s)))
                         for s in combinations(others, size))
        out.append(value)
    return out


@pytest.mark.parametrize("kind", sorted(MODELS))
def test_equal_to_sums_over_all_subsets(rows, kind):
    model = _fit(rows, MODELS[kind]())
    got = contributions.contributions(model, rows, rows, COLUMNS).orderBy("id").collect()
    found = contributions.leaves(model.stages[-1], model.stages[0].transform(rows))
    for r in got[::12]:
        want = _all_subsets(found, [r[c] for c in COLUMNS])
        assert [r[f"c_{c}"] for c in COLUMNS] == pytest.approx(want, abs=1e-10)


@pytest.mark.parametrize("kind", sorted(MODELS))
def test_add_up_to_the_score_minus_its_mean(rows, kind):
    model = _fit(rows, MODELS[kind]())
    raw = vector_to_array("rawPrediction")[1] if kind == "boosted" else vector_to_array("probability")[1]
    scores = {r["id"]: r["s"] for r in model.transform(rows).select("id", raw.alias("s")).collect()}
    mean = sum(scores.values()) / len(scores)
    got = contributions.contributions(model, rows, rows, COLUMNS).collect()
    assert len(got) == len(scores)
    for r in got:
        assert r["base"] == pytest.approx(mean, abs=1e-9)
        assert sum(r[f"c_{c}"] for c in COLUMNS) == pytest.approx(scores[r["id"]] - mean, abs=1e-9)


def test_missing_values_and_empty_tables(rows):
    model = _fit(rows, MODELS["boosted"]())
    gaps = rows.withColumn("b", F.when(F.col("id") % 2 == 0, F.col("b")))
    scores = {r["id"]: r["s"] for r in model.transform(gaps).select(
        "id", vector_to_array("rawPrediction")[1].alias("s")).collect()}
    for r in contributions.contributions(model, gaps, rows, COLUMNS).collect():
        assert r["raw_score"] == pytest.approx(scores[r["id"]], abs=1e-9)
    nothing = rows.where("id < 0")
    assert contributions.contributions(model, nothing, rows, COLUMNS).count() == 0
    assert contributions.contributions(model, rows, nothing, COLUMNS).count() == 240


def test_a_tree_of_one_leaf_adds_nothing(rows):
    model = _fit(rows.withColumn("label", F.lit(1.0)).unionByName(rows.limit(1).withColumn("label", F.lit(0.0))),
                 RandomForestClassifier(featuresCol="_x", numTrees=2, maxDepth=0, seed=1))
    got = contributions.contributions(model, rows, rows, COLUMNS).first()
    assert [got[f"c_{c}"] for c in COLUMNS] == [0.0, 0.0, 0.0]


def test_other_models_are_refused(rows):
    with pytest.raises(ValueError):
        contributions.contributions(_fit(rows, LinearSVC(featuresCol="_x")), rows, rows, COLUMNS)


def test_a_cell_is_explained_once(rows, monkeypatch):
    model, seen = _fit(rows, MODELS["forest"]()), {}
    real = contributions.materialize

    def noted(df, label, *partition):
        seen[label] = real(df, label, *partition)
        return seen[label]

    monkeypatch.setattr(contributions, "materialize", noted, raising=False)
    many = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(5))))
    got = contributions.contributions(model, many, many, COLUMNS)
    assert got.count() == 5 * 240 and got.columns[:6] == [*rows.columns, "copy"]
    assert seen["explained-cells"].count() <= 240
    assert got.groupBy("id").agg(F.countDistinct("raw_score", "c_a", "c_b", "c_c").alias("n")).where("n > 1").count() == 0

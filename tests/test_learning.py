"""Ordered frames, labels, splits, metrics: plain and segmented ways agree with loops."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from procwatch.operators import features, latest, metrics, ordering

SMALL = {"segment_rows": 30}


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    out = []
    for param, n in (("temp", 400), ("ph", 7), ("hum", 61)):
        base = {"temp": 37.0, "ph": 7.0, "hum": 47.0}[param]
        out += [(param, i, base + rnd.gauss(0, 0.3), None if rnd.random() < 0.02 else rnd.random())
                for i in range(n)]
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "param string, at long, value double, f double").repartition(5)


def _expected(rows, window=10, horizon=15):
    limits = {"temp": (36.5, 37.5), "ph": (6.8, 7.2), "hum": (40.0, 55.0)}
    out = {}
    frame = pd.DataFrame(rows, columns=["param", "at", "value", "f"])
    for param, part in frame.groupby("param"):
        part = part.sort_values("at").reset_index(drop=True)
        roll = part["value"].rolling(window, min_periods=window)
        mean, std, span = roll.mean(), roll.std(ddof=0), roll.max() - roll.min()
        fmean = part["f"].rolling(window, min_periods=window).mean()
        lo, hi = limits[param]
        outside = list((part["value"] < lo) | (part["value"] > hi))
        for i in range(len(part)):
            label = 0 if i + horizon > len(part) else int(any(outside[i + 1:i + 1 + horizon]))
            out[param, i] = (mean[i], std[i], span[i], fmean[i], label)
    return out


@pytest.mark.parametrize("limits", [{}, SMALL])
def test_training_set_equals_pandas(df, dim, rows, limits):
    got = features.training_set(df, dim, ["at"], features=["f"], **limits).collect()
    want = {k: v for k, v in _expected(rows).items() if not any(pd.isna(x) for x in v[:4])}
    assert {(r["param"], r["at"]) for r in got} == set(want)
    for r in got:
        *numbers, label = want[r["param"], r["at"]]
        assert [r["v_avg"], r["v_std"], r["v_delta"], r["f_mean"]] == pytest.approx(numbers, abs=1e-7)
        assert r["label"] == label


@pytest.mark.parametrize("limits", [{}, SMALL])
def test_label_tail(df, dim, rows, limits):
    want = {k: v[4] for k, v in _expected(rows).items()}
    got = features.forward_label(df, dim, ["at"], **limits).collect()
    assert {(r["param"], r["at"]): r["label"] for r in got} == want
    dropped = features.forward_label(df, dim, ["at"], drop_incomplete=True, **limits)
    assert dropped.groupBy("param").count().collect()
    assert dropped.where("param = 'ph'").count() == 0  # shorter than the horizon
    assert dropped.where("param = 'hum'").count() == 61 - 14


def test_row_numbers_and_totals(spark, df, rows):
    got = {(r["param"], r["at"]): r["_idx"] for r in
           ordering.number_rows(df, ["param"], ["at"]).collect()}
    assert got == {(p, at): at for p, at, *_ in rows}
    total = ordering.running_total(df, ["param"], ["at"], "at", "below")
    assert all(r["below"] == r["at"] * (r["at"] - 1) // 2 for r in total.collect())


def test_null_keys_are_kept(spark):
    df = spark.createDataFrame([(k, i) for k in ("a", None) for i in range(50)], "param string, at long")
    got = ordering.number_rows(df, ["param"], ["at"]).collect()
    assert len(got) == 100 and all(r["_idx"] == r["at"] for r in got)
    assert ordering.number_copies(df, ["param"], "n").where("n = 49").count() == 2


def test_copies_are_numbered(spark):
    df = spark.createDataFrame([("hot",)] * 500 + [("a",), ("b",), ("b",)], "k string").repartition(6)
    got = ordering.number_copies(df, ["k"], "n").collect()
    assert sorted(r["n"] for r in got if r["k"] == "hot") == list(range(500))
    assert sorted(r["n"] for r in got if r["k"] == "b") == [0, 1]


def test_segment_smaller_than_frame_is_refused(df):
    with pytest.raises(ValueError):
        ordering.framed(df, ["param"], ["at"], 9, 0, lambda w: {}, segment_rows=5)


@pytest.mark.parametrize("digits", [1, 4])
def test_split_is_exact_per_stratum(spark, digits):
    df = spark.createDataFrame([(i, i % 3, int(i % 10 == 0)) for i in range(1003)],
                               "id long, param int, label int")
    out = features.stratified_split(df, ["id"], ["param", "label"], digits=digits)
    for r in out.groupBy("param", "label").agg(F.count("*").alias("n"),
                                               F.count_if(F.col("split") == "test").alias("t")).collect():
        assert r["t"] == int(r["n"] * 0.25 + 0.5)
    again = features.stratified_split(df.repartition(7), ["id"], ["param", "label"], digits=digits)
    assert out.exceptAll(again).count() == 0


def test_metrics_against_loops(spark):
    rnd = random.Random(5)
    rows = [("a", rnd.randint(0, 1), round(rnd.random(), 1)) for _ in range(300)]
    rows += [("one", 1, 0.3), ("one", 1, 0.7)]
    df = spark.createDataFrame(rows, "param string, label int, p double")
    pos = [p for g, y, p in rows if g == "a" and y]
    neg = [p for g, y, p in rows if g == "a" and not y]
    want = sum((x > y) + 0.5 * (x == y) for x in pos for y in neg) / (len(pos) * len(neg))
    got = {r["param"]: r["auc"] for r in metrics.roc_auc(df, "label", "p", ["param"]).collect()}
    assert got["a"] == pytest.approx(want) and got["one"] is None
    m = {r["param"]: r for r in metrics.classification_metrics(df, "label", "p", ["param"]).collect()}
    said = [(y, p >= 0.5) for g, y, p in rows if g == "a"]
    assert m["a"]["precision"] == pytest.approx(sum(y for y, s in said if s) / sum(s for _, s in said))
    assert m["a"]["recall"] == pytest.approx(sum(s for y, s in said if y) / sum(y for y, _ in said))
    none = spark.createDataFrame([("z", 0, 0.1)], "param string, label int, p double")
    row = metrics.classification_metrics(none, "label", "p", ["param"]).first()
    assert (row["accuracy"], row["precision"], row["recall"]) == (1.0, 0.0, 0.0)


def test_shares_of_nothing(spark):
    df = spark.createDataFrame([("a", "x", 0.0), ("a", "y", 0.0), ("b", "x", 1.0), ("b", "y", 3.0)],
                               "param string, feature string, importance double")
    got = {(r["param"], r["feature"]): r["share"] for r in
           metrics.importance_shares(df, "importance", ["param"]).collect()}
    assert got == {("a", "x"): 0.0, ("a", "y"): 0.0, ("b", "x"): 0.25, ("b", "y"): 0.75}


def test_latest_rows_are_cut_before_the_shuffle(df):
    out = latest.latest_per_key(df, ["param"], [F.desc("at")], 5)
    assert {(r["param"], r["count"]) for r in out.groupBy("param").count().collect()} == {
        ("temp", 5), ("ph", 5), ("hum", 5)}
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()

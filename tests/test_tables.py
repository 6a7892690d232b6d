"""Sources, keyed tables, data sets, models on small inputs."""

import os

import pytest
from pyspark.sql import functions as F

from procwatch import session
from procwatch.operators import models, profile
from procwatch.sources import files, tables, telemetry


def _rows(spark, *r):
    return spark.createDataFrame(r, "id string, shelf string, v int, at int")


def test_upsert_keeps_one_row_per_key(spark, tmp_path):
    path = str(tmp_path / "t")

    def upsert(*r):
        tables.upsert(_rows(spark, *r), path, ["id"], [F.desc("at")], parts=3)

    upsert(("a", "x", 1, 1), ("b", "x", 1, 1), ("c", "y", 1, 5))
    upsert(("a", "y", 2, 2), ("a", "z", 3, 3), ("n", "x", 9, 1))  # a payload may change, a key may come twice
    upsert(("c", "late", 8, 4), ("a", "y", 2, 2))                 # older versions that arrive late
    got = {r["id"]: (r["shelf"], r["v"]) for r in tables.read_upserted(spark, path).collect()}
    assert got == {"a": ("z", 3), "b": ("x", 1), "c": ("y", 1), "n": ("x", 9)}


def test_upsert_rewrites_touched_partitions_only(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(f"k{i}", "x", 1, 1) for i in range(60)]
    tables.upsert(_rows(spark, *rows), path, ["id"], [F.desc("at")], parts=6)
    before = {p: os.listdir(f"{path}/{p}") for p in os.listdir(path) if p.startswith("key_part")}
    tables.upsert(_rows(spark, ("k0", "x", 2, 2)), path, ["id"], [F.desc("at")], parts=6)
    changed = [p for p, files in before.items() if os.listdir(f"{path}/{p}") != files]
    assert len(before) == 6 and len(changed) == 1 and tables.read_upserted(spark, path).count() == 60


def test_compaction_survives_a_replayed_batch(spark, tmp_path):
    path = str(tmp_path / "b")

    def batch(number, *ids):
        tables.append_batch(spark.createDataFrame([(i, number) for i in ids], "id string, v int"), path, number)

    for n in range(5):
        batch(n, "a", f"only{n}")
    tables.compact(spark, path, ["id"])
    assert tables.generations(spark, path) == [3, 4]
    batch(4, "a", "only4")
    tables.compact(spark, path, ["id"])
    got = {r["id"]: r["v"] for r in tables.latest_state(spark, path, ["id"]).collect()}
    assert got == {"a": 4, **{f"only{n}": n for n in range(5)}}


def test_promotion_moves_the_staged_set(spark, tmp_path):
    folder = str(tmp_path / "u")
    for v in (1, 2):
        tables.stage_dataset(_rows(spark, ("a", "x", v, v)), folder, "temp")
        assert tables.is_staged(spark, folder, "temp")
        assert [r["v"] for r in tables.promote_dataset(spark, folder, "temp").collect()] == [v]
        assert not tables.is_staged(spark, folder, "temp")
    with pytest.raises(ValueError):
        tables.promote_dataset(spark, folder, "temp")
    assert tables.read_if_there(spark, f"{folder}/saved/param=temp").count() == 1


def test_metrics_are_written_as_json(spark, tmp_path):
    tables.write_json(_rows(spark, ("a", "x", 1, 1)), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).first()["shelf"] == "x"


def test_batches_are_idempotent_and_last_wins(spark, tmp_path):
    path = str(tmp_path / "b")
    df = spark.createDataFrame([("a", 1), ("b", 1)], "id string, v int")
    tables.append_batch(df, path, 0)
    for _ in range(2):
        tables.append_batch(df.where("id = 'a'").withColumn("v", F.lit(2)), path, 1)
    assert spark.read.parquet(path).count() == 3
    assert {r["id"]: r["v"] for r in tables.latest_state(spark, path, ["id"]).collect()} == {"a": 2, "b": 1}
    assert tables.read_if_there(spark, str(tmp_path / "none")) is None


def test_bad_json_is_null_not_an_error(spark):
    df = spark.createDataFrame([('{"param": "ph", "ts": "2024-01-01T00:00:00.250+02:00", "value": 7}',),
                                ("{bad",), ('{"param": "ph", "ts": "?", "value": 1}',), (None,)], "body string")
    usable, rest = telemetry.split_usable(telemetry.parse_json(df, "body"))
    row = usable.select("value", F.unix_millis("ts").alias("ms")).collect()
    assert [r[:] for r in row] == [(7.0, 1704060000250)] and rest.count() == 3


def test_historian_reads_one_parameter(spark, tmp_path):
    path = str(tmp_path / "h")
    spark.createDataFrame([("ph", 1.0), ("temp", 2.0)], "param string, value double").write.partitionBy(
        "param").parquet(path)
    df = files.historian(spark, path, "ph")
    assert [r["value"] for r in df.collect()] == [1.0]
    assert "PartitionFilters: [isnotnull(param" in df._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        files.historian(spark, "x.csv", "ph")


def test_json_array_or_object(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"x": 1}, {"x": 2}]')
    (tmp_path / "b.json").write_text('{"x": 3}')
    df = files.json_records(spark, str(tmp_path), "x int")
    assert sorted(r["x"] for r in df.collect()) == [1, 2, 3]


def test_param_is_identified_by_column_or_first_row(spark):
    df = spark.createDataFrame([("hum", 1.0)], "param string, other double")
    assert profile.identify_param(df) == "hum"
    assert profile.identify_param(df.withColumnRenamed("other", "conductivity_us_cm")) == "cond"
    assert profile.identify_param(df.drop("param")) is None
    assert profile.identify_param(df.withColumn("param", F.lit("x"))) is None


def test_roles_and_descriptions(spark):
    columns = ["timestamp", "ph", "humidity_pct", "breach_within_15", "co2_accumulation", "my_col"]
    assert [profile.column_role(c, columns, "ph") for c in columns] == [
        "metadata", "dependent", "other", "label", "independent", "independent"]
    names = spark.createDataFrame([("my_col",), ("zone",), ("agitator_speed",)], "name string")
    said = {r["name"]: r["description"] for r in profile.described(names, "ph").collect()}
    assert said["my_col"] == "Process / context variable: my col."
    assert said["zone"].startswith("Operating zone") and said["agitator_speed"].startswith("Agitator RPM")


def test_columns_are_adapted_by_prefix(spark):
    df = spark.createDataFrame([(7.1, 1.0, 2.0)], "ph double, acid_base_dose_rate_l double, agitator double")
    assert profile.feature_sources(["agitator", "agitator_speed_rpm"], "ph")["agitator_speed"] == "agitator"
    assert profile.feature_sources(["agitator_speed_rpm", "agitator"], "ph")["agitator_speed"] == "agitator_speed_rpm"
    row = profile.adapt_columns(df, "ph").first().asDict()
    assert row == {"value": 7.1, "acid_base_dose_rate": 1.0, "co2_accumulation": 0.0, "agitator_speed": 2.0,
                   "probe_drift_mv": 0.0, "dissolved_oxygen": 0.0, "param": "ph"}


def test_types(spark):
    df = spark.createDataFrame([(i, "2024-01-0%d" % (1 + i % 9) if i % 4 else "n/a", None, True, 1.5, "x",
                                 "2024-01-01" if i < 10 else "n/a") for i in range(20)],
                               "i int, d string, e string, b boolean, f double, s string, first string")
    got = {r["name"]: r["type"] for r in profile.infer_types(df).collect()}
    assert got == {"i": "integer", "d": "datetime", "e": "string", "b": "boolean", "f": "float", "s": "string",
                   "first": "string"}


def test_shared_folder_is_the_one_the_session_names(spark, tmp_path):
    spark.conf.set("spark.checkpoint.dir", str(tmp_path)) if spark.conf.isModifiable(
        "spark.checkpoint.dir") else None
    folder = session.shared_dir(spark)
    df = session.materialize(spark.range(5).toDF("x"), "probe")
    assert df.count() == 5 and all(f.startswith("file:") and folder in f for f in df.inputFiles())


@pytest.fixture(scope="module")
def training(spark):
    df = spark.range(600).select(
        F.lit("ph").alias("param"), F.col("id").alias("event_id"),
        (F.lit(7.0) + (F.col("id") % 50) / 100.0).alias("v_avg"),
        ((F.col("id") * 7 % 13) / 100.0).alias("v_std"), ((F.col("id") * 3 % 11) / 50.0).alias("v_delta"))
    return df.withColumn("label", (F.col("v_avg") > 7.3).cast("int"))


@pytest.mark.parametrize("param", ["ph", "hum", "cond"])
def test_models_learn_and_fall_back(spark, dim, training, param, tmp_path):
    rows = training.withColumn("param", F.lit(param))
    fitted = models.fit_all(rows, ["event_id"], [param, "press"])
    assert set(fitted) == {param}  # a parameter without rows has no model
    best = fitted[param]
    assert best.metrics["auc"] > 0.9 and best.metrics["n_test"] == 150
    assert max(best.importance, key=best.importance.get) == "v_avg"
    assert sum(best.importance.values()) == pytest.approx(1.0, abs=1e-3)
    models.save(fitted, str(tmp_path))
    loaded = models.load(str(tmp_path), [param])
    requests = spark.createDataFrame([(param, 7.45, 0.1, 0.1), ("press", 117.0, 0.1, 0.1), ("nope", 1.0, 0.0, 0.0),
                                      (param, None, None, None)],
                                     "param string, v_avg double, v_std double, v_delta double")
    got = {(r["param"], r["v_avg"]): r for r in models.predict(requests, dim, loaded).collect()}
    assert len(got) == 4 and got[param, 7.45]["p_breach"] > 0.5
    assert got[param, 7.45]["source"].endswith("(trained)")
    assert got["press", 117.0]["source"] == "analytic fallback" and got["press", 117.0]["zone"] == "alarm"
    assert got["nope", 1.0]["p_breach"] == 0.0
    assert 0.0 <= got[param, None]["p_breach"] <= 1.0
    windows = requests.withColumn("p_raw", F.lit(0.125))
    again = {(r["param"], r["v_avg"]): r["p_raw"] for r in models.rescore(windows, loaded).collect()}
    assert again["press", 117.0] == 0.125 and again[param, 7.45] > 0.5


def test_one_class_is_skipped(training):
    assert models.fit_parameter(training.withColumn("label", F.lit(0)), "ph", ["event_id"]) is None

"""Keyed tables of runs: merge on read, what a batch writes, replays, dead writers, lookups."""

import os

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from procwatch.sources import deltas


def newest():
    return [F.desc("at")]


def _rows(spark, rows):
    return spark.createDataFrame(rows, "id string, v int, at int")


def _read(spark, path):
    rows = [tuple(r) for r in deltas.read(spark, path, ["id"], newest()).select("id", "v", "at").collect()]
    found = {r[0]: r[1:] for r in rows}
    assert len(found) == len(rows)
    return found


row = st.tuples(st.sampled_from([None, "", "a", "b", "c", "d"]), st.integers(0, 99), st.integers(0, 3))


@given(st.lists(st.lists(row, min_size=1, max_size=4, unique_by=lambda r: (r[0], r[2])), min_size=1, max_size=5))
@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_against_a_plain_table(spark, tmp_path_factory, batches):
    path, want = str(tmp_path_factory.mktemp("t")), {}
    for batch in batches:
        deltas.upsert(_rows(spark, batch), path, ["id"], newest(), fanout=2)
        best = {}
        for key, v, at in sorted(batch, key=lambda r: r[2]):
            best[key] = (v, at)
        for key, (v, at) in best.items():
            if key not in want or at >= want[key][1]:
                want[key] = (v, at)
        assert _read(spark, path) == want
    levels = [r["level"] for r in deltas.manifest(spark, path).runs]
    assert levels == sorted(levels, reverse=True) and len(set(levels)) == len(levels)


def _bytes(path):
    return sum(os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(f"{path}/runs") for f in names)


def test_what_is_written_follows_the_batch(spark, tmp_path):
    written = {}
    for n in (2_000, 60_000):
        path = str(tmp_path / str(n))
        deltas.upsert(spark.range(n).select(F.col("id").cast("string"), F.lit(1).alias("v"), F.lit(1).alias("at")),
                      path, ["id"], newest())
        before = _bytes(path)
        assert deltas.upsert(_rows(spark, [("7", 2, 2), ("8", 0, 0), ("new", 3, 1)]), path, ["id"], newest())
        written[n] = _bytes(path) - before
        found = _read(spark, path)
        assert len(found) == n + 1 and (found["7"], found["8"], found["new"]) == ((2, 2), (1, 1), (3, 1))
    assert written[60_000] < 1.2 * written[2_000]


def test_replays_and_empty_batches(spark, tmp_path):
    path = str(tmp_path / "t")
    for number, v in [(0, 1), (1, 2), (1, 9), (0, 9)]:
        stored = deltas.upsert(_rows(spark, [("a", v, 1)]), path, ["id"], newest(), batch_no=number)
        assert stored == (v != 9)
    deltas.upsert(_rows(spark, []), path, ["id"], newest())
    assert _read(spark, path) == {"a": (2, 1)} and deltas.manifest(spark, path).batch_no == 2


def test_a_run_without_manifest_does_not_count(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    deltas.upsert(_rows(spark, [("a", 1, 1)]), path, ["id"], newest())

    def die(*_):
        raise RuntimeError("dead")
    with monkeypatch.context() as broken:
        broken.setattr(deltas, "_publish", die)
        with pytest.raises(RuntimeError):
            deltas.upsert(_rows(spark, [("a", 2, 2)]), path, ["id"], newest())
    assert len(os.listdir(f"{path}/runs")) == 2 and _read(spark, path) == {"a": (1, 1)}
    deltas.upsert(_rows(spark, [("b", 3, 3)]), path, ["id"], newest())
    assert len(os.listdir(f"{path}/runs")) == 2 and _read(spark, path) == {"a": (1, 1), "b": (3, 3)}


def test_readers_of_the_state_before_go_on(spark, tmp_path):
    path = str(tmp_path / "t")
    deltas.upsert(_rows(spark, [("a", 1, 1)]), path, ["id"], newest(), fanout=2)
    held = deltas.read(spark, path, ["id"], newest())
    deltas.upsert(_rows(spark, [("a", 2, 2)]), path, ["id"], newest(), fanout=2)  # merges the run that is read
    assert [r["v"] for r in held.collect()] == [1]


def test_later_columns_are_null_in_older_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    deltas.upsert(_rows(spark, [("a", 1, 1)]), path, ["id"], newest())
    deltas.upsert(_rows(spark, [("b", 1, 1)]).withColumn("zone", F.lit("z")), path, ["id"], newest())
    assert {r["id"]: r["zone"] for r in deltas.read(spark, path, ["id"], newest()).collect()} == {"a": None, "b": "z"}


def test_lookup_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    base = spark.range(20_000).select(F.col("id").cast("string"), F.lit(1).alias("v"), F.lit(1).alias("at"))
    deltas.upsert(base, path, ["id"], newest(), file_rows=2_000)
    deltas.upsert(_rows(spark, [("7", 2, 2), (None, 5, 5)]), path, ["id"], newest())
    found = deltas.lookup(spark.createDataFrame([("7",), ("8",), (None,), ("none",)], "id string"), path, ["id"], newest())
    assert {tuple(r) for r in found.select("id", "v").collect()} == {("7", 2), ("8", 1), (None, 5)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(_key_hash" in plan or "PushedFilters: [Or(" in plan
    many = deltas.lookup(base.select("id").where("id < 50"), path, ["id"], newest())
    assert {r["id"]: r["v"] for r in many.collect()} == {str(i): 2 if i == 7 else 1 for i in range(50)}
    with pytest.raises(ValueError):
        deltas.read(spark, f"{path}/none", ["id"], newest())

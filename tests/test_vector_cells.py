"""Vectors in cells: equal to all pairs, few files read, ties, odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from procwatch.operators import search, vector_cells


def _frame(spark, vectors, name="id"):
    return spark.createDataFrame([(i, v if v is None else [None if x is None else float(x) for x in v])
                                  for i, v in enumerate(vectors)], f"{name} long, v array<double>")


def _rows(df):
    return sorted(map(tuple, df.select("query_id", "id", "rank", "cosine").collect()))


def _clustered(n, groups, seed=3, spread=0.1):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(groups, 12))
    return middles[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, 12))


@pytest.mark.parametrize("spread,broadcast", [(0.1, 64 << 20), (3.0, 64 << 20), (0.1, 0)])
def test_equal_to_all_pairs(spark, tmp_path, monkeypatch, spread, broadcast):
    monkeypatch.setattr(vector_cells, "BROADCAST_BYTES", broadcast)
    base, queries = _frame(spark, _clustered(700, 12, spread=spread)), _frame(spark, _clustered(40, 12, 4, spread), "q")
    index = vector_cells.build(base, "id", "v", f"{tmp_path}/i", cells=20)
    got = vector_cells.nearest(vector_cells.open_cells(spark, f"{tmp_path}/i"), queries, "q", "v", 7, "id")
    assert len(index.ranges) == 20 and sum(n for n, *_ in index.ranges.values()) == 700
    assert _rows(got) == _rows(search.nearest(base, queries, "id", "v", "q", 7))


def test_few_files_are_read(spark, tmp_path, monkeypatch):
    base = _frame(spark, _clustered(2000, 16, spread=0.02))
    index = vector_cells.build(base, "id", "v", f"{tmp_path}/i", cells=24)
    files, scan = [], vector_cells._scan

    def recorded(*args):
        df = scan(*args)
        files.append({r[0] for r in df.select(F.input_file_name()).distinct().collect()})
        return df
    monkeypatch.setattr(vector_cells, "_scan", recorded)
    queries = base.where("id IN (3, 4)").withColumnRenamed("id", "q")
    got = vector_cells.nearest(index, queries, "q", "v", 5, "id")
    assert _rows(got) == _rows(search.nearest(base, queries, "id", "v", "q", 5))
    every = {r[0] for r in spark.read.parquet(f"{tmp_path}/i/vectors").select(F.input_file_name()).distinct().collect()}
    assert len(files) == 2 and len(files[0] | files[1]) <= len(every) / 3


def test_ties_and_odd_vectors(spark, tmp_path):
    inf = float("inf")
    vectors = [[1, 0], [2, 0], [0, 0], None, [1, None], [inf, 1], [0, 3], [-1, 0], [1e-12, 0], [3, 0], [1, 0], []]
    base, queries = _frame(spark, vectors), _frame(spark, [[1, 0], [0, 0], None, [-1, -1], [float("nan"), 1]], "q")
    index = vector_cells.build(base, "id", "v", f"{tmp_path}/i", cells=3)
    for k in (1, 3, 50):
        got = vector_cells.nearest(index, queries, "q", "v", k, "id")
        usable = base.where("id NOT IN (3, 4, 5, 11)")
        want = search.nearest(usable, queries.where("q IN (0, 1, 3)"), "id", "v", "q", k)
        assert _rows(got) == _rows(want)


def test_empty_tables(spark, tmp_path):
    base = _frame(spark, [[1, 0]])
    empty = vector_cells.build(base.where("id > 9"), "id", "v", f"{tmp_path}/e")
    assert vector_cells.nearest(empty, base.withColumnRenamed("id", "q"), "q", "v", 2).count() == 0
    index = vector_cells.build(base, "id", "v", f"{tmp_path}/i")
    assert vector_cells.nearest(index, base.where("id > 9").withColumnRenamed("id", "q"), "q", "v", 2).count() == 0

"""Exact top-k against plain integers, and on odd rows."""

import math
import random

import numpy as np
import pyarrow.parquet as pq

from conftest import SF
from procwatch.llm import topk


def by_hand(rows, step, k):
    good = {(i, tuple(v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    scaled = [(i, [math.floor(64 * x) for x in v]) for i, v in good]
    out = {}
    for q, a in scaled:
        if q % step == 0:
            mine = out.setdefault(q, {})
            for c, b in scaled:
                if c != q and len(a) == len(b):
                    mine[c] = max(mine.get(c, -10**30), sum(x * y for x, y in zip(a, b)))
    return sorted((q, n + 1, c, s) for q, mine in out.items()
                  for n, (s, c) in enumerate(sorted(((s, c) for c, s in mine.items()), key=lambda x: (-x[0], x[1]))[:k]))


def found(spark, rows, step=5, k=20):
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = vectors.where(f"vec_id % {step} = 0")
    return sorted(map(tuple, topk.search(queries, vectors, k).collect()))


def test_against_plain_integers(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 30)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 64)
    rng = random.Random(3)
    centres = [[rng.gauss(0, 0.3) for _ in range(24)] for _ in range(6)]
    rows = [(i, [x + rng.gauss(0, 0.05) for x in centres[i % 6]]) for i in range(400)]
    assert found(spark, rows) == by_hand(rows, 5, 20)
    assert found(spark, rows, 7, 3) == by_hand(rows, 7, 3)


def test_odd_rows(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5]) for _ in range(5)]) for i in range(60)]  # many ties
    rows += [(0, rows[0][1]), (5, rows[7][1]), (None, [1.0] * 5), (100, None), (105, [1.0, None, 0.0, 0.0, 0.0]),
             (110, [math.nan] * 5), (115, [math.inf] * 5), (120, []), (125, []), (130, [1.0] * 3), (135, [2.0] * 3),
             (140, [1e9] * 5), (145, [-1e9] * 5)]
    assert found(spark, rows) == by_hand(rows, 5, 20)


def test_empty_tables(spark):
    assert found(spark, []) == []
    assert found(spark, [(0, [1.0])]) == []
    assert found(spark, [(1, [1.0]), (2, [1.0])]) == []


def test_bounds_leave_few_exact_scores():
    """On the given vectors, whose axes hardly differ in spread; less on vectors whose axes do."""
    table = pq.read_table(SF.replace("sf0.001", "sf0.1") + "/embeddings.parquet")
    rows = np.array(table["embedding"].to_pylist(), float)
    matrix, ids = np.floor(topk.SCALE * rows), table["vec_id"].to_numpy()
    asked = ids % 20 == 0
    best = topk.Best(ids[asked], matrix[asked], 20, topk.rotations(rows.tolist())[rows.shape[1]])
    best.add(ids, matrix)
    assert best.met == asked.sum() * len(ids)
    assert best.scored < 0.3 * best.met
    scores = matrix[asked] @ matrix.T
    scores[ids[asked][:, None] == ids[None, :]] = -np.inf
    assert best.limit.tolist() == np.sort(scores, 1)[:, -20].tolist()

    rng = np.random.default_rng(5)
    steep = rng.normal(size=(4000, 64)) * 0.9 ** np.arange(64) @ np.linalg.qr(rng.normal(size=(64, 64)))[0]
    scaled = np.floor(topk.SCALE * steep)
    best = topk.Best(np.arange(100), scaled[:100], 20, topk.rotations(steep[:2000].tolist())[64])
    best.add(np.arange(4000), scaled)
    assert best.scored < 0.15 * best.met


def test_any_rotation_gives_the_same_rows(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 10.0 ** (j % 4)) for j in range(9)]) for i in range(150)]
    want = by_hand(rows, 5, 20)
    assert found(spark, rows) == want
    monkeypatch.setattr(topk, "ROTATION_SAMPLE", 3)
    assert found(spark, rows) == want
    monkeypatch.setattr(topk, "ROTATION_WIDTH", 4)
    assert found(spark, rows) == want

"""Exact Shapley values of tree ensembles: what each column adds to a row's score.

A tree is the sum of its leaves, and a leaf is a product of conditions, one per column on its
path. Of such a product the Shapley values have a closed form: with `in_j` 1 where column j
meets the leaf's condition, and `share_j` the share of background rows that go the leaf's way at
the splits on j, column j adds

    value * (in_j - share_j) * sum_k c_k * k! (d - 1 - k)! / d!

where c_k are the coefficients of the product of (share_i + in_i * t) over the other columns of
the path. So no subset of columns is ever listed. The shares come from the rows that are given
as background: Spark counts them per leaf, and the values of a row add up to its score minus the
mean score of the background.

Only the model goes through the driver. Rows that lie between the same marks of all columns go the
same way in every tree, so each such cell is counted and explained once, however many rows it has,
and rows get the values of their cell.
"""

import re
from collections.abc import Iterator
from dataclasses import dataclass
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, RandomForestClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, functions as F, types as T

from procwatch.session import materialize

CELLS_A_TASK = 1000
_SPLIT = re.compile(r"If \(feature (\d+) <= (\S+)\)")


@dataclass
class Leaf:
    """One leaf: per column of its path the half-open range (low, high] it takes, and the share
    of background rows that follow it at the splits on that column."""

    tree: int
    value: float
    low: dict[int, float]
    high: dict[int, float]
    share: dict[int, float]


def _structure(text: str):
    """The tree of a printed model: (column, mark, left, right), or None for a leaf."""
    lines = iter([line.strip() for line in text.splitlines() if line.strip().startswith(("If", "Else", "Predict"))])

    def node():
        line = next(lines)
        if line.startswith("Predict"):
            return None
        found = _SPLIT.fullmatch(line)
        if not found:
            raise ValueError(f"only splits of numbers are explained: {line}")
        left = node()
        next(lines)  # the other side of the same split
        return int(found[1]), float(found[2]), left, node()

    return node()


def _n_leaves(node) -> int:
    return 1 if node is None else _n_leaves(node[2]) + _n_leaves(node[3])


def _point(low: dict[int, float], high: dict[int, float], width: int) -> list[float]:
    """Some row that falls into a leaf."""
    return [high[j] if high.get(j, np.inf) < np.inf
            else float(np.nextafter(low[j], np.inf)) if j in low else 0.0 for j in range(width)]


def leaf_counts(model, rows: DataFrame, weight: str | None = None) -> dict[tuple[int, int], int]:
    """Background rows (or the sum of their `weight`) per tree and leaf, counted by Spark; as many
    numbers as the model has leaves."""
    with_leaf = model.copy().setLeafCol("_leaf").transform(rows)
    n = F.col(weight) if weight else F.lit(1)
    met = with_leaf.select(n.alias("_n"), F.posexplode(vector_to_array("_leaf")).alias("tree", "leaf"))
    counts = met.groupBy("tree", "leaf").agg(F.sum("_n").alias("n"))
    return {(r["tree"], int(r["leaf"])): r["n"] for r in counts.collect()}


def leaves(model, rows: DataFrame, weight: str | None = None) -> list[Leaf]:
    """All leaves of a fitted ensemble, with shares of the background `rows` (assembled columns)."""
    forest = isinstance(model, RandomForestClassificationModel)
    if not forest and not isinstance(model, GBTClassificationModel):
        raise ValueError("only ensembles of trees are explained")
    counts, width, found = leaf_counts(model, rows, weight), model.numFeatures, []
    weights = [1.0 / len(model.trees)] * len(model.trees) if forest else model.treeWeights

    for number, (tree, weight) in enumerate(zip(model.trees, weights)):
        def walk(node, at: int, low: dict, high: dict, share: dict) -> int:
            """Rows below a node whose first leaf has number `at`."""
            if node is None:
                point = Vectors.dense(_point(low, high, width))
                value = tree.predictProbability(point)[1] if forest else tree.predict(point)
                found.append(Leaf(number, weight * value, low, high, share))
                return
            column, mark, left, right = node
            middle, end = at + _n_leaves(left), at + _n_leaves(node)
            n_left = sum(counts.get((number, i), 0) for i in range(at, middle))
            n_right = sum(counts.get((number, i), 0) for i in range(middle, end))
            goes_left = n_left / (n_left + n_right) if n_left + n_right else 0.5
            before = share.get(column, 1.0)
            walk(left, at, low, high | {column: min(mark, high.get(column, np.inf))},
                 share | {column: before * goes_left})
            walk(right, middle, low | {column: max(mark, low.get(column, -np.inf))}, high,
                 share | {column: before * (1.0 - goes_left)})

        walk(_structure(tree.toDebugString), 0, {}, {}, {})
    return found


def base_value(found: list[Leaf]) -> float:
    """The mean score of the background."""
    return float(sum(leaf.value * np.prod(list(leaf.share.values())) for leaf in found))


def shapley(found: list[Leaf], x: np.ndarray) -> np.ndarray:
    """rows x columns: Shapley values of the sum of the leaves."""
    out = np.zeros(x.shape)
    for leaf in found:
        columns = sorted(leaf.share)
        d = len(columns)
        if not d:
            continue
        met = np.ones((len(x), d), bool)
        for i, j in enumerate(columns):  # missing values go right, as in the model
            if j in leaf.high:
                met[:, i] &= x[:, j] <= leaf.high[j]
            if j in leaf.low:
                met[:, i] &= ~(x[:, j] <= leaf.low[j])
        # rows that meet the same conditions get the same values
        cases, case = np.unique(np.packbits(met, axis=1), axis=0, return_inverse=True)
        inside = np.unpackbits(cases, axis=1)[:, :d].astype(float)
        share = np.array([leaf.share[j] for j in columns])
        weight = np.array([factorial(k) * factorial(d - 1 - k) / factorial(d) for k in range(d)])
        values = np.zeros(inside.shape)
        for i in range(d):
            poly = np.zeros((len(cases), d))
            poly[:, 0] = 1.0
            for other in range(d):
                if other != i:
                    moved = poly[:, :-1] * inside[:, other:other + 1]
                    poly = poly * share[other]
                    poly[:, 1:] += moved
            values[:, i] = leaf.value * (inside[:, i] - share[i]) * (poly @ weight)
        out[:, columns] += values[case.reshape(-1)]
    return out


def marks(model) -> list[np.ndarray]:
    """Per column all marks at which some tree splits, in order."""
    found: list[set[float]] = [set() for _ in range(model.numFeatures)]
    for tree in model.trees:
        for column, mark in _SPLIT.findall(tree.toDebugString):
            found[int(column)].add(float(mark))
    return [np.array(sorted(values)) for values in found]


def _with_cell(rows: DataFrame, columns: list[str], at: list[np.ndarray]) -> DataFrame:
    """`rows` with `_cell`: per column how many marks lie below the value; all, where it is missing."""
    schema = T.StructType([*rows.schema.fields, T.StructField("_cell", T.ArrayType(T.IntegerType()))])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.stack([np.searchsorted(m, batch[c].cast(pa.float64()).to_numpy(zero_copy_only=False))
                              for c, m in zip(columns, at)], 1).astype(np.int32)
            ends = pa.array(np.arange(len(found) + 1, dtype=np.int32) * len(columns))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.ListArray.from_arrays(ends, pa.array(found.reshape(-1)))], names=schema.names)

    return rows.mapInArrow(place, schema)


def _points(cells: np.ndarray, at: list[np.ndarray]) -> np.ndarray:
    """A row that lies in each of the cells."""
    return np.stack([np.append(m, np.nextafter(m[-1], np.inf) if len(m) else 0.0)[cells[:, j]]
                     for j, m in enumerate(at)], 1)


def contributions(pipeline: PipelineModel, rows: DataFrame, background: DataFrame, columns: list[str]) -> DataFrame:
    """`rows` with `base`, `raw_score` and one column `c_<name>` for each column of the model.

    The score is the share of trees' votes of a forest, and the sum of trees of a boosted model
    (half the log odds). `columns` are those the pipeline assembles, in its order; missing values
    count as the model counts them. An empty background gives each side of a split half.
    """
    model = pipeline.stages[-1]
    if not isinstance(model, (RandomForestClassificationModel, GBTClassificationModel)):
        raise ValueError("only ensembles of trees are explained")
    assembled, at = PipelineModel(stages=pipeline.stages[:-1]), marks(model)
    counted = _with_cell(background.select(*columns), columns, at).groupBy("_cell").agg(F.count(F.lit(1)).alias("_n"))
    value = [T.StructField(name, T.DoubleType()) for name in columns]
    pointed = T.StructType([*value, T.StructField("_n", T.LongType())])

    def cells_of(batch: pa.RecordBatch) -> np.ndarray:
        return batch["_cell"].flatten().to_numpy(zero_copy_only=False).reshape(-1, len(columns))

    def point(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _points(cells_of(batch), at)
            yield pa.RecordBatch.from_arrays([*map(pa.array, x.T.copy()), batch["_n"]], names=pointed.names)

    found = leaves(model, assembled.transform(materialize(counted.mapInArrow(point, pointed), "background-cells")), "_n")
    base = base_value(found)
    added = ["base", "raw_score", *[f"c_{name}" for name in columns]]
    placed = materialize(_with_cell(rows, columns, at), "placed-rows")
    explained = T.StructType([placed.schema["_cell"], *[T.StructField(name, T.DoubleType()) for name in added]])

    def explain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = shapley(found, _points(cells_of(batch), at))
            yield pa.RecordBatch.from_arrays(
                [batch["_cell"], pa.array(np.full(len(values), base)), pa.array(base + values.sum(1)),
                 *[pa.array(values[:, i]) for i in range(len(columns))]], names=explained.names)

    # a cell costs as much as the model is large, so few of them make a task
    cells = placed.select("_cell").distinct()
    cells = materialize(cells.repartition(max(1, -(-cells.count() // CELLS_A_TASK)), "_cell").mapInArrow(
        explain, explained), "explained-cells")
    return placed.join(cells, "_cell").select(*rows.columns, *added)

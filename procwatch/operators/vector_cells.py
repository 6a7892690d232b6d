"""Stored vectors in cells around centres: exact nearest vectors from few files.

Unit vectors lie in the cell of their nearest centre, stored as one folder per cell and sorted by
their distance from it. By the triangle inequality no vector of a cell is nearer to a query than
the query's distance from the centre lies outside the cell's range of distances. A query first
meets the cells nearest to it that hold enough vectors; the last of the best found there is its
limit, and only cells, and in them only vectors, that may lie within the limit are met then.

Centres are fitted to a bounded sample (`SAMPLE` vectors with the smallest key hashes) and decide
what is read, never what is found. The driver holds centres and ranges, `CELLS` rows at most.
"""

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from procwatch import fixed_values as fv
from procwatch.operators.search import (BROADCAST_BYTES, QUERY_BLOCK, SCORE_DIGITS, SLICE_ROWS, BestRows,
                                        _ranked)
from procwatch.session import materialize

CELLS, SAMPLE, ROUNDS = 1024, 16_384, 8
LOOSE = -1            # the cell of vectors too short to have a direction; it is always met
SLICE_DEALS = 64      # deals of slices that more queries than fit a broadcast are copied to
_HELD_BLOCKS = 256
_DISTANCE_MARGIN, _SQUARE_MARGIN = 1e-6, 1e-8  # beyond rounding of distances, and of scores


@dataclass
class Cells:
    """A stored index: its folder, the columns of its vectors, centres by cell, and per cell (number of
    vectors, least and largest distance)."""

    folder: str
    schema: str
    centres: np.ndarray
    ranges: dict[int, tuple[int, float, float]]


def _usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False)) & (F.size(vector) > 0)


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length one, and which of the given ones were long enough to become that."""
    if not len(column):
        return np.zeros((0, 1)), np.zeros(0, bool)
    rows = pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)
    norms = np.linalg.norm(rows, axis=1)
    return rows / np.maximum(norms, fv.MIN_NORM)[:, None], norms >= fv.MIN_NORM


def _distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    squares = (rows * rows).sum(1)[:, None] + (centres * centres).sum(1) - 2 * rows @ centres.T
    return np.sqrt(np.maximum(squares, 0))


def _fit(sample: np.ndarray, n: int) -> np.ndarray:
    """At most `n` centres of a sample, by a few rounds of moving centres to the mean of their cell."""
    distinct = np.unique(sample, axis=0)
    rng = np.random.default_rng(5)
    centres = distinct[rng.permutation(len(distinct))[:n]]
    for _ in range(ROUNDS if len(centres) else 0):
        cell = _distances(sample, centres).argmin(1)
        sums, counts = np.zeros_like(centres), np.bincount(cell, minlength=len(centres))
        np.add.at(sums, cell, sample)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def build(base: DataFrame, key: str, vector: str, folder: str, cells: int | None = None) -> Cells:
    """Store the vectors of `base` by cells under `folder`.

    Null vectors and those with null or non-finite components take no part; all others have the
    same length. A cell that holds many vectors has many files, dealt by their distance. `cells`
    is the square root of the number of vectors where it is not given, `CELLS` at most.
    """
    spark = base.sparkSession
    rows = base.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")).where(_usable(F.col("v")))
    n = min(CELLS, cells or max(1, isqrt(rows.count())))
    sample = rows.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).select("v").toArrow()["v"].combine_chunks()
    units, long_enough = _matrix(sample)
    centres = _fit(units[long_enough], n)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units, long_enough = _matrix(batch["v"])
            cell, dist = np.full(len(units), LOOSE, np.int32), np.zeros(len(units))
            if len(centres) and len(units):
                # not the matrix product's distances: its rounding would blur short ones
                cell = np.where(long_enough, _distances(units, centres).argmin(1), LOOSE).astype(np.int32)
                dist = np.where(long_enough, np.linalg.norm(units - centres[cell], axis=1), 0.0)
            yield pa.RecordBatch.from_arrays([batch["key"], batch["v"], pa.array(dist), pa.array(cell)],
                                             names=["key", "v", "dist", "cell"])

    schema = f"key {rows.schema['key'].dataType.simpleString()}, v array<double>, dist double, cell int"
    (rows.mapInArrow(assign, schema).repartitionByRange("cell", "dist").sortWithinPartitions("cell", "dist")
     .write.partitionBy("cell").parquet(f"{folder}/vectors"))
    stored = spark.read.schema(schema).parquet(f"{folder}/vectors")
    ranges = stored.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("dist").alias("low"), F.max("dist").alias("high"))
    ranges.coalesce(1).write.parquet(f"{folder}/ranges")
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, v array<double>").coalesce(1).write.parquet(
        f"{folder}/centres")
    spark.createDataFrame([(schema,)], "columns string").coalesce(1).write.parquet(f"{folder}/layout")
    return open_cells(spark, folder)


def open_cells(spark: SparkSession, folder: str) -> Cells:
    """An index stored earlier."""
    centres = [r["v"] for r in spark.read.parquet(f"{folder}/centres").orderBy("cell").collect()]
    ranges = {r["cell"]: (r["n"], r["low"], r["high"]) for r in spark.read.parquet(f"{folder}/ranges").collect()}
    schema = spark.read.parquet(f"{folder}/layout").first()[0]
    return Cells(folder, schema, np.array(centres, float) if centres else np.zeros((0, 1)), ranges)


def _scan(spark: SparkSession, index: Cells, cells: list[int]) -> DataFrame:
    """The vectors of some cells; other folders are not listed among the files of the scan."""
    return spark.read.schema(index.schema).parquet(f"{index.folder}/vectors").where(F.col("cell").isin(cells))


def _plan(queries: DataFrame, index: Cells, k: int, again: bool) -> DataFrame:
    """Queries with the cells they meet: those nearest to them at first; `again`, with `limit` (the least
    score that counts, or null) and `met`, all others that may hold a vector within the limit."""
    cells = sorted(index.ranges)
    real = [c for c in cells if c != LOOSE]
    sizes, low, high = (np.array([index.ranges[c][i] for c in real], float) for i in range(3))
    centres = index.centres[real] if real else np.zeros((0, 1))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units, long_enough = _matrix(batch["v"])
            chosen = []
            for i, (unit, fine) in enumerate(zip(units, long_enough)):
                away = np.linalg.norm(centres - unit, axis=1) if real else np.zeros(0)
                if again:
                    outside = np.maximum(np.maximum(low - away, away - high) - _DISTANCE_MARGIN, 0)
                    limit = batch["limit"][i].as_py()
                    near = np.ones(len(real), bool) if limit is None or not fine else (
                        outside ** 2 <= 2 - 2 * limit + _SQUARE_MARGIN)
                    met = set(batch["met"][i].as_py())
                    chosen.append([c for c, n in zip(real, near) if n and c not in met]
                                  + [LOOSE] * (LOOSE in index.ranges and LOOSE not in met))
                else:
                    order = np.argsort(away, kind="stable")
                    enough = int(np.searchsorted(np.cumsum(sizes[order]), k)) + 1
                    chosen.append([real[j] for j in order[:enough]])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chosen, pa.list_(pa.int32()))],
                                             names=[*batch.schema.names, "cells"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in queries.schema.fields)
    return queries.mapInArrow(choose, f"{schema}, cells array<int>")


def _hits(planned: DataFrame, index: Cells, k: int, n_blocks: int) -> DataFrame:
    """The best `k` vectors each task finds for its queries in the cells that these are to meet."""
    spark = planned.sparkSession
    wanted = planned.select("query_id", "v", "limit", F.explode("cells").alias("cell")).withColumn(
        "block", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).cast("int"))

    def pack_queries(group: pd.DataFrame) -> pd.DataFrame:
        cell = int(group["cell"].iloc[0])
        units, long_enough = _matrix(pa.array(group["v"].tolist(), pa.list_(pa.float64())))
        limits = np.where(long_enough, group["limit"].astype(float).fillna(-np.inf), -np.inf)
        away = np.zeros(len(units)) if cell == LOOSE else np.linalg.norm(units - index.centres[cell], axis=1)
        content = {"ids": group["query_id"].tolist(), "units": units, "away": away,
                   "squares": np.full(len(units), np.inf) if cell == LOOSE else 2 - 2 * limits + _SQUARE_MARGIN}
        return pd.DataFrame({"cell": [cell], "block": [int(group["block"].iloc[0])], "payload": [pickle.dumps(content)]})

    blocks = materialize(wanted.groupBy("cell", "block").applyInPandas(
        pack_queries, "cell int, block int, payload binary"), "cell-blocks")
    cells = [r[0] for r in blocks.select("cell").distinct().collect()]  # `CELLS` and one at most

    def pack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch["cell"].to_numpy()
            cuts = np.flatnonzero(np.diff(numbers)) + 1
            for start, end in zip([0, *cuts], [*cuts, len(numbers)]):
                for at in range(start, end, SLICE_ROWS):
                    part = batch.select(["key", "v", "dist"]).slice(at, min(SLICE_ROWS, end - at))
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, part.schema) as writer:
                        writer.write_batch(part)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([numbers[at]], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
                        names=["cell", "slice"])

    stored = _scan(spark, index, cells).select("key", "v", "dist", "cell")
    slices = stored.mapInArrow(pack_rows, "cell int, slice binary")
    if (blocks.agg(F.sum(F.length("payload"))).first()[0] or 0) <= BROADCAST_BYTES:
        pairs = slices.join(F.broadcast(blocks), "cell")
    else:  # a cell's vectors are dealt out, so that no task has all of a large one
        deal = F.pmod(F.xxhash64("slice"), F.lit(SLICE_DEALS)).cast("int")
        copied = blocks.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(SLICE_DEALS - 1))))
        pairs = slices.withColumn("deal", deal).join(copied.hint("merge"), ["cell", "deal"])

    kinds = {"query_id": planned.schema["query_id"].dataType,
             "key": stored.schema["key"].dataType}
    arrow = {name: to_arrow_type(kind) for name, kind in kinds.items()}

    def rows_of(held: dict) -> pa.RecordBatch:
        found = [(query, row[1], -row[0]) for best, ids in held.values()
                 for query, best_of in zip(ids, best.rows) for row in best_of]
        columns = list(zip(*found)) or [[]] * 3
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], arrow["query_id"]), pa.array(columns[1], arrow["key"]),
             pa.array(columns[2], pa.float64())], names=["query_id", "key", "score"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {}
        for batch in batches:
            for cell, block, payload, raw in zip(batch["cell"].to_pylist(), batch["block"].to_pylist(),
                                                 batch["payload"], batch["slice"]):
                content = pickle.loads(payload.as_buffer())
                if (cell, block) not in held and len(held) >= _HELD_BLOCKS:
                    yield rows_of(held)
                    held.clear()
                best = held.setdefault((cell, block), (BestRows(len(content["ids"]), k), content["ids"]))[0]
                with pa.ipc.open_stream(raw.as_buffer()) as reader:
                    part = reader.read_next_batch()
                gap = np.abs(part["dist"].to_numpy()[:, None] - content["away"]) - _DISTANCE_MARGIN
                near = np.maximum(gap, 0) ** 2 <= content["squares"]
                some = np.flatnonzero(near.any(1))
                if not len(some):
                    continue
                part, near = part.take(pa.array(some)), near[some]
                cosine = np.round(_matrix(part["v"])[0] @ content["units"].T, SCORE_DIGITS) + 0.0
                for q in range(cosine.shape[1]):
                    mine = np.flatnonzero(near[:, q])
                    if len(mine):
                        best.add(q, part["key"].take(pa.array(mine)), cosine[mine, q])
        if held:
            yield rows_of(held)

    return pairs.select("cell", "block", "payload", "slice").mapInArrow(
        search, f"query_id {kinds['query_id'].simpleString()}, key {kinds['key'].simpleString()}, score double")


def nearest(index: Cells, queries: DataFrame, query_key: str, vector: str, k: int, key: str = "key") -> DataFrame:
    """The `k` nearest stored vectors of each query by cosine, exactly: (query_id, key, rank, cosine).

    Cosines are rounded to nine digits before they are ranked, ties go to the smaller key. Vectors
    without length have a cosine of 0 with all. Queries that are null or not finite get no rows;
    an index of fewer than `k` vectors gives all of them.
    """
    rows = materialize(queries.select(F.col(query_key).alias("query_id"), F.col(vector).cast("array<double>").alias("v"))
                       .where(_usable(F.col("v"))), "cell-queries")
    n_blocks = max(1, ceil(rows.count() / QUERY_BLOCK))
    no_limit = F.lit(None).cast("double")
    first = materialize(_plan(rows, index, k, False).withColumn("limit", no_limit), "cell-first")
    found = materialize(_hits(first, index, k, n_blocks), "cell-found")
    last = _ranked(found, "query_id", "key", k).where(F.col("rank") == k - 1).select("query_id", F.col("score").alias("limit"))
    again = first.drop("limit").withColumnRenamed("cells", "met").join(last, "query_id", "left")
    more = _hits(_plan(again, index, k, True), index, k, n_blocks)
    return _ranked(found.unionByName(more), "query_id", "key", k).select(
        "query_id", F.col("key").alias(key), "rank", F.col("score").alias("cosine"))

"""Ordered work on keys that may hold a large share of all rows.

A window function partitioned by such a key runs in one task. Here the rows are
range-partitioned by (key, order) instead, numbered through small per-block
counts, and cut into segments of bounded size, at every size alike. Each segment
also gets the few neighbouring rows its frames look at, so results are those of
the plain window.
"""

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from procwatch.session import materialize

SEGMENT_ROWS = 500_000
_BLOCK_BITS = 33  # monotonically_increasing_id: partition number above, row number below


def _blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows with the block they fall in and their position in it, written once."""
    ranged = (df.repartitionByRange(*keys, *order)
              .sortWithinPartitions(*keys, *order)
              .withColumn("_ord_at", F.monotonically_increasing_id()))
    return materialize(ranged, "ordered").select(
        *df.columns,
        F.shiftright("_ord_at", _BLOCK_BITS).alias("_ord_block"),
        F.col("_ord_at").bitwiseAND(F.lit((1 << _BLOCK_BITS) - 1)).alias("_ord_pos"))


def _with_starts(rows: DataFrame, starts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with what is known of their key and block; a null key is a key like any other."""
    by = [*keys, "_ord_block"]
    named = starts.select(*[F.col(c).alias(f"_ord_k{i}") for i, c in enumerate(by)],
                          *[c for c in starts.columns if c not in by])
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_ord_k{i}")) for i, c in enumerate(by)])
    return rows.join(named, same).drop(*[f"_ord_k{i}" for i in range(len(by))])


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add `_idx`, the row's number from 0 within its key. `order` must be unique per key."""
    rows = _blocks(df, keys, order)
    before = Window.partitionBy(*keys).orderBy("_ord_block").rowsBetween(
        Window.unboundedPreceding, -1)
    starts = (rows.groupBy(*keys, "_ord_block")
              .agg(F.min("_ord_pos").alias("_ord_first"), F.count(F.lit(1)).alias("_ord_n"))
              .select(*keys, "_ord_block", "_ord_first",
                      F.coalesce(F.sum("_ord_n").over(before), F.lit(0)).alias("_ord_offset")))
    return (_with_starts(rows, starts, keys)
            .withColumn("_idx", F.col("_ord_offset") + F.col("_ord_pos") - F.col("_ord_first"))
            .select(*df.columns, "_idx"))


def framed(df: DataFrame, keys: Sequence[str], order: Sequence[str], before: int, after: int,
           build: Callable[[Window], dict[str, Column]],
           segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Add window columns whose frames reach `before` rows back and `after` rows ahead.

    `build` gets the window (partitioned and ordered, no frame) and returns the
    columns. No window holds more than segment_rows + before + after rows.
    """
    if segment_rows < max(before, after):
        raise ValueError("segment_rows must cover the frame")
    numbered = number_rows(df, keys, order)
    place = F.col("_idx") % segment_rows
    home = F.floor(F.col("_idx") / segment_rows).cast("long")
    copies = F.array_compact(F.array(
        home,
        F.when(place >= segment_rows - before, home + 1),
        F.when((place < after) & (home > 0), home - 1)))
    cut = numbered.withColumn("_ord_home", home).withColumn("_ord_seg", F.explode(copies))
    out = cut.withColumns(build(Window.partitionBy(*keys, "_ord_seg").orderBy("_idx")))
    return out.where(F.col("_ord_seg") == F.col("_ord_home")).drop("_ord_seg", "_ord_home", "_idx")


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str,
                  name: str) -> DataFrame:
    """Add `name`, the sum of `value` over all earlier rows of the key."""
    within = Window.partitionBy(*keys, "_ord_block").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1)
    rows = _blocks(df, keys, order)
    before = Window.partitionBy(*keys).orderBy("_ord_block").rowsBetween(
        Window.unboundedPreceding, -1)
    heads = (rows.groupBy(*keys, "_ord_block").agg(F.sum(value).alias("_ord_sum"))
             .select(*keys, "_ord_block", F.coalesce(F.sum("_ord_sum").over(before), F.lit(0))
                     .alias("_ord_offset")))
    return (_with_starts(rows, heads, keys)
            .withColumn(name, F.col("_ord_offset")
                        + F.coalesce(F.sum(value).over(within), F.lit(0)))
            .select(*df.columns, name))


def number_copies(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Add `name`, which numbers the rows of a key from 0 in no particular order.

    Rows stay where they lie: each input partition numbers its own rows of a key,
    starting after the counts of the partitions before it. A key may hold any share
    of the rows.
    """
    rows = materialize(df.withColumn("_ord_at", F.monotonically_increasing_id()), "copies")
    rows = rows.withColumn("_ord_block", F.shiftright("_ord_at", _BLOCK_BITS))
    before = Window.partitionBy(*keys).orderBy("_ord_block").rowsBetween(
        Window.unboundedPreceding, -1)
    starts = (rows.groupBy(*keys, "_ord_block").agg(F.count(F.lit(1)).alias("_ord_n"))
              .select(*keys, "_ord_block", F.coalesce(F.sum("_ord_n").over(before), F.lit(0))
                      .alias("_ord_offset")))
    local = F.row_number().over(Window.partitionBy(*keys, "_ord_block").orderBy("_ord_at")) - 1
    return (_with_starts(rows.withColumn("_ord_local", local), starts, keys)
            .withColumn(name, F.col("_ord_offset") + F.col("_ord_local"))
            .select(*df.columns, name))

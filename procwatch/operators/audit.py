"""Hash-chained audit log: build and continue, anchor, verify, compare with a snapshot.

Hashing along a chain is sequential. So a chain is cut into segments of a fixed
number of rows, each starting from its own mark; the last hashes and row counts of
the segments, the anchors, are chained in turn. Which segment a row falls in depends
on its number in the chain alone, so a log built at once and one built by appending
are the same.
"""

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from procwatch import fixed_values as fv
from procwatch.operators import ordering

SEGMENT_ROWS = 200_000


def entry_text() -> Column:
    """What a row commits to besides its predecessor: time, action, event, detail."""
    return F.concat(F.col("ts").cast("string"), F.lit("+00"), F.col("action"),
                    F.coalesce(F.col("event_id").cast("string"), F.lit("")),
                    F.coalesce(F.col("detail"), F.lit("{}")))


def row_hash(previous: Column) -> Column:
    return F.sha2(F.concat(previous, entry_text()), 256)


def segment_start(segment: Column) -> Column:
    """What stands in for the predecessor of a segment's first row."""
    return F.when(segment == 0, F.lit(fv.GENESIS)).otherwise(
        F.concat(F.lit(fv.GENESIS + ":"), segment.cast("string")))


def heads(chained: DataFrame, chain: str, order: str) -> DataFrame:
    """Where each chain ends: rows so far, its last hash, its last order value."""
    return chained.groupBy(chain).agg(
        F.count(F.lit(1)).alias("n_rows"), F.max_by("row_hash", order).alias("last_hash"),
        F.max(order).alias("last_order"))


def build_chain(rows: DataFrame, chain: str, order: str, segment_rows: int = SEGMENT_ROWS,
                stored: DataFrame | None = None) -> DataFrame:
    """Add `segment`, `prev_hash` and `row_hash` to audit rows.

    `order` is unique within a chain. With the `heads` of a stored log the rows continue
    its chains: only they are hashed, and they must come after what is stored.
    """
    texts = rows.withColumn("_text", entry_text())
    numbered = ordering.number_rows(texts, [chain], [order])
    if stored is None:
        placed = numbered.withColumns({"_before": F.lit(0).cast("long"),
                                       "_last": F.lit(None).cast("string")})
    else:
        known = stored.select(F.col(chain).alias("_chain"), F.col("n_rows").alias("_before"),
                              F.col("last_hash").alias("_last"))
        placed = numbered.join(known, F.col(chain).eqNullSafe(F.col("_chain")), "left").drop(
            "_chain").withColumn("_before", F.coalesce("_before", F.lit(0)))
    place = F.col("_before") + F.col("_idx")
    segment = F.floor(place / segment_rows).cast("long")
    # the first new row follows the last stored one, unless a segment begins with it
    follows = (F.col("_idx") == 0) & (place % segment_rows != 0)
    cut = placed.withColumns({
        "segment": segment, "_first": F.when(follows, F.col("_last"))
        .when(place % segment_rows == 0, segment_start(segment))})
    kept = [*rows.columns, "segment"]
    schema = T.StructType([*rows.schema.fields, T.StructField("segment", T.LongType()),
                           T.StructField("prev_hash", T.StringType()),
                           T.StructField("row_hash", T.StringType())])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = ""
        for batch in batches:
            before, after = [], []
            for first, text in zip(batch["_first"].to_pylist(), batch["_text"].to_pylist()):
                before.append(last if first is None else first)
                last = hashlib.sha256((before[-1] + text).encode()).hexdigest()
                after.append(last)
            yield pa.RecordBatch.from_arrays(
                [*[batch[c] for c in kept], pa.array(before, pa.string()),
                 pa.array(after, pa.string())], names=schema.names)

    # whole segments per task, streamed in order: a task holds one batch and the last hash
    return (cut.repartition(chain, "segment").sortWithinPartitions(chain, "segment", "_idx")
            .select(*kept, "_first", "_text").mapInArrow(link, schema))


def _anchor_rows(chained: DataFrame, chain: str, order: str) -> DataFrame:
    tails = chained.groupBy(chain, "segment").agg(
        F.max_by("row_hash", order).alias("_hash"), F.max("ts").alias("ts"),
        F.count(F.lit(1)).alias("_n"))
    return tails.select(chain, F.col("segment").alias("of_segment"), "ts",
                        F.lit("segment.close").alias("action"),
                        F.col("segment").cast("string").alias("event_id"),
                        F.concat_ws(":", F.col("_n").cast("string"), "_hash").alias("detail"))


def anchor_segments(chained: DataFrame, chain: str, order: str,
                    segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Row count and last hash of every segment, chained along the segments."""
    return build_chain(_anchor_rows(chained, chain, order), chain, "of_segment", segment_rows)


def _broken(chained: DataFrame, chain: str, order: str) -> DataFrame:
    """Rows with `_bad`: a hash does not follow from the row and its predecessor.

    Every stored hash is recomputed from its row and the stored predecessor hash,
    and compared along the segment, whose size is bounded. No row waits for another.
    """
    along = Window.partitionBy(chain, "segment").orderBy(order)
    expected = F.coalesce(F.lag("row_hash").over(along), segment_start(F.col("segment")))
    good = (F.col("prev_hash") == expected) & (F.col("row_hash") == row_hash(F.col("prev_hash")))
    return chained.withColumn("_bad", ~F.coalesce(good, F.lit(False)))


def verify_chain(chained: DataFrame, chain: str, order: str, anchors: DataFrame | None = None
                 ) -> DataFrame:
    """Per chain: rows, broken rows, first broken row; with anchors, wrong segments too.

    A segment is wrong if it is gone, has lost rows at its end, or is not what its anchor
    says; a broken or missing anchor counts as a wrong segment. What is missing after the last
    anchor shows only against `heads` kept elsewhere.
    """
    found = _broken(chained, chain, order).groupBy(chain).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if("_bad").alias("n_broken"),
        F.min(F.when(F.col("_bad"), F.col(order))).alias("first_broken"))
    if anchors is None:
        return found
    said = _broken(anchors, chain, "of_segment").select(
        F.col(chain).alias("_chain"), "of_segment", F.col("detail").alias("_said"), "_bad")
    are = _anchor_rows(chained, chain, order).select(chain, F.col("of_segment").alias("_segment"), "detail")
    both = said.join(are, F.col("_chain").eqNullSafe(F.col(chain))
                     & (F.col("of_segment") == F.col("_segment")), "full")
    wrong = both.select(
        F.coalesce("_chain", chain).alias("_key"), F.coalesce("of_segment", "_segment").alias("_segment"),
        (F.coalesce("_bad", F.lit(True)) | ~F.col("_said").eqNullSafe(F.col("detail"))).alias("_wrong"))
    segments = wrong.groupBy("_key").agg(
        F.count_if("_wrong").alias("n_wrong_segments"),
        F.min(F.when(F.col("_wrong"), F.col("_segment"))).alias("first_wrong_segment"))
    joined = found.join(segments, F.col(chain).eqNullSafe(F.col("_key")), "full")
    return joined.select(F.coalesce(chain, "_key").alias(chain),
                         *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_rows", "n_broken")], "first_broken",
                         F.coalesce("n_wrong_segments", F.lit(0)).alias("n_wrong_segments"), "first_wrong_segment")


def rewritten_rows(before: DataFrame, now: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of an earlier snapshot that are gone or changed, and keys that appear twice.

    An append-only log gives an empty result.
    """
    lost = (before.join(now.select(*key, "row_hash"), [*key, "row_hash"], "left_anti")
            .select(*key, F.lit("changed or missing").alias("problem")))
    twice = (now.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
             .select(*key, F.lit("duplicate").alias("problem")))
    return lost.unionByName(twice)


def summary(rows: DataFrame) -> DataFrame:
    """Rows per level and action."""
    return rows.groupBy("level", "action").agg(F.count(F.lit(1)).alias("n_rows"))

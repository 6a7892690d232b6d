"""Consistency proofs: a stored snapshot of a log is a prefix of the log of today.

The complete segments of a chain are the leaves of a Merkle mountain range: node (level, place)
stands for leaves place * 2**level up to the next node's and hashes its two halves. Nodes never
change as a log grows; the `peaks`, one for each binary digit 1 of the number of leaves, commit
to all of them. Whoever keeps the few peaks of a snapshot can check a later log from the siblings
on the way from the old peaks to the new ones: no row of either log is read, and the proof grows
with the logarithm of the number of segments.
"""

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from procwatch.session import materialize

SPAN = 10  # levels that are built at a time: a group has at most 2**SPAN nodes


def _parent(left: str, right: str) -> str:
    return hashlib.sha256(f"node:{left}{right}".encode()).hexdigest()


def segment_leaves(chained: DataFrame, chain: str, order: str, segment_rows: int) -> DataFrame:
    """(chain, level 0, place, hash): one leaf for each complete segment of a hashed log."""
    tails = chained.groupBy(chain, "segment").agg(
        F.count(F.lit(1)).alias("_n"), F.max_by("row_hash", order).alias("_hash"))
    return tails.where(F.col("_n") == segment_rows).select(
        chain, F.lit(0).alias("level"), F.col("segment").alias("place"),
        F.sha2(F.concat_ws(":", F.lit("leaf"), F.col("_n").cast("string"), "_hash"), 256).alias("hash"))


def nodes(leaves: DataFrame, chain: str, span: int = SPAN) -> DataFrame:
    """All nodes over the leaves (chain, level, place, hash), `span` levels at a time.

    A node is there once both its halves are. Each step is one shuffle of 2**-span of the nodes
    of the step before. A task takes its nodes in order and keeps one waiting left half a level, so
    neither many short chains nor a long one cost more than their nodes.
    """
    schema, columns = leaves.schema, leaves.columns

    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, at = {}, None
        for batch in batches:
            of, made = batch[chain].to_pylist(), []
            for i, (key, level, place, value) in enumerate(
                    zip(of, *[batch[c].to_pylist() for c in ("level", "place", "hash")])):
                if key != at and (key == key or at == at):  # a NaN is a chain like any other
                    waiting, at = {}, key
                top = level + span
                while level < top and place & 1 and waiting.get(level, (None,))[0] == place - 1:
                    value = _parent(waiting[level][1], value)
                    level, place = level + 1, place >> 1
                    made.append((i, level, place, value))
                if not place & 1:
                    waiting[level] = place, value
            row, levels, places, hashes = zip(*made) if made else ((), (), (), ())
            found = {"level": levels, "place": places, "hash": hashes}
            yield pa.RecordBatch.from_arrays(
                [batch[c].take(pa.array(row, pa.int64())) if c == chain else pa.array(found[c], batch[c].type)
                 for c in columns], names=columns)

    current = materialize(leaves, "consistency-leaves")
    out, level = current, 0
    while not current.isEmpty():
        placed = current.withColumn("_group", F.shiftright("place", span)).repartition(chain, "_group")
        above = materialize(placed.sortWithinPartitions(chain, "_group", "place").select(*columns)
                            .mapInArrow(climb, schema), "consistency-nodes")
        out, level = out.unionByName(above), level + span
        current = above.where(F.col("level") == level)
    return out


def commitment(all_nodes: DataFrame, chain: str) -> DataFrame:
    """(chain, n_segments, peaks): what is kept of a snapshot; at most 63 peaks a chain."""
    sizes = all_nodes.where("level = 0").groupBy(chain).agg((F.max("place") + 1).alias("n_segments"))
    # a chain that lacks a segment lacks the peak over it, so it fails its check
    peak = F.expr("shiftright(n_segments, level) % 2 = 1 AND place = shiftright(n_segments, level + 1) * 2")
    found = _with_sizes(all_nodes, sizes, chain).where(peak).groupBy(chain).agg(
        F.sort_array(F.collect_list(F.struct("level", "place", "hash")), asc=False).alias("peaks"))
    return _left(sizes, found, chain, "peaks")


def _with_sizes(rows: DataFrame, sizes: DataFrame, chain: str) -> DataFrame:
    keyed = sizes.withColumnRenamed(chain, "_chain")
    return rows.join(keyed, F.col(chain).eqNullSafe(F.col("_chain"))).drop("_chain")


def _left(rows: DataFrame, more: DataFrame, chain: str, *columns: str) -> DataFrame:
    keyed = more.select(F.col(chain).alias("_chain"), *columns)
    return rows.join(keyed, F.col(chain).eqNullSafe(F.col("_chain")), "left").drop("_chain")


def proof(all_nodes: DataFrame, before: DataFrame, now: DataFrame, chain: str) -> DataFrame:
    """(chain, siblings): the nodes of today's log that lead from the peaks of `before` to those of `now`."""
    sizes = _left(before.select(chain, F.col("n_segments").alias("_old")),
                  now.withColumnRenamed("n_segments", "_new"), chain, "_new").where("_new IS NOT NULL")
    # above the lowest digit 1 of the old size all old peaks lie under one node of a level
    sibling = F.expr("""
        shiftleft(shiftright(place, 1) + 1, level + 1) <= _new
        AND ((shiftright(_old, level) % 2 = 1 AND (place ^ 1) = shiftright(_old, level + 1) * 2)
             OR (_old % shiftleft(1L, level) <> 0 AND (place ^ 1) = shiftright(_old, level)))""")
    return _with_sizes(all_nodes, sizes, chain).where(sibling).groupBy(chain).agg(
        F.collect_list(F.struct("level", "place", "hash")).alias("siblings"))


def follows(n_before: int, old: list[dict], n_now: int, new: list[dict], siblings: list[dict]) -> bool:
    """Whether the siblings lead from the old peaks to the new ones."""
    if n_now < n_before or len(old) != n_before.bit_count() or len(new) != n_now.bit_count():
        return False
    given = {(s["level"], s["place"]): s["hash"] for s in siblings}
    kept = {(p["level"], p["place"]): p["hash"] for p in old}
    goal = {(p["level"], p["place"]): p["hash"] for p in new}
    given |= kept  # what the snapshot says counts, not what the proof says of it
    for at, value in kept.items():
        while at not in goal:
            level, place = at
            other = given.get((level, place ^ 1))
            if other is None or level > 62:
                return False
            value = _parent(value, other) if place % 2 == 0 else _parent(other, value)
            at = level + 1, place >> 1
        if goal[at] != value:
            return False
    return True


def check(before: DataFrame, now: DataFrame, proofs: DataFrame, chain: str) -> DataFrame:
    """(chain, n_before, n_now, consistent) from two commitments and the proofs alone.

    A chain that had no complete segment is consistent with any log, one that is gone with none.
    """
    old = before.select(F.col(chain).alias("_old"), F.col("n_segments").alias("n_before"), F.col("peaks").alias("_old_peaks"))
    both = now.select(chain, F.col("n_segments").alias("n_now"), F.col("peaks").alias("_new_peaks")).join(
        old, F.col(chain).eqNullSafe(F.col("_old")), "full")
    rows = both.select(
        F.coalesce(chain, "_old").alias(chain), F.coalesce("n_before", F.lit(0).cast("long")).alias("n_before"),
        F.coalesce("n_now", F.lit(0).cast("long")).alias("n_now"), "_old_peaks", "_new_peaks")
    schema = T.StructType([rows.schema[chain], rows.schema["n_before"], rows.schema["n_now"],
                           T.StructField("consistent", T.BooleanType())])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [follows(r["n_before"], r["_old_peaks"] or [], r["n_now"], r["_new_peaks"] or [], r["siblings"] or [])
                    for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*[batch[c] for c in (chain, "n_before", "n_now")], pa.array(said, pa.bool_())], names=schema.names)

    return _left(rows, proofs, chain, "siblings").mapInArrow(decide, schema)

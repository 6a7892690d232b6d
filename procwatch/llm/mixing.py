"""Mixing sources to target weights by weighted fair queueing (DataFrame functions only).

Every source is a queue of its documents in shuffled order, passed through up to
three times. A copy's virtual finish time is the source's tokens up to and
including it, divided by the source's target; copies leave in order of that time
until the total budget is used.

Cumulative sums never need a whole source in one task: the shuffle order is a hash,
so a source is cut into `BLOCKS` ranges of it, whose totals give the offsets, and a
window runs within a range. The global order is cut into ranges of virtual time in
the same way; only the one range in which the budget ends is sorted.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from procwatch.llm.inputs import numbered_columns
from procwatch.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MAX_PASSES = 3
TIME_RANGES = 4096          # ranges of virtual time per unit
LAST_RANGE = 4 * TIME_RANGES  # later copies share one range
_HASH_DIGITS = 3            # 16**3 ranges of the shuffle order per source


def size_of(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


@dataclass
class Budget:
    """Where the mix ends: all copies in earlier time ranges, and those up to a copy of this range."""

    time_range: int
    until: tuple | None  # (virtual time, source key, shuffle key) of the last copy taken


def queued(docs: DataFrame, doc_id: str, text: str, source: str, seed: int) -> DataFrame:
    """Add size, source key, place in the shuffled order and range of that order.

    The place is a hash of the id and, for repeated ids, of the text, so that it is the
    same in every run and for every layout of the input.
    """
    by_id = F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(f":{seed}")))
    key = F.concat(by_id, F.lpad(F.hex(F.xxhash64(F.col(text))), 16, "0"))
    return docs.withColumns({
        "_wfq_size": size_of(F.col(text)), "_wfq_key": key,
        "_wfq_src": F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("~"))
    }).withColumn("_wfq_block", F.substring("_wfq_key", 1, _HASH_DIGITS))


def source_targets(sizes: DataFrame, source: str, size: str, null_last: Column,
                   weights: tuple = WEIGHTS, limit: int = MAX_PASSES) -> DataFrame:
    """Add `target` to one row per source: shares by weight, none above `limit` times its size.

    Reweighting the excess until no target is above its limit ends at one level:
    target = min(limit * size, level * weight), and the level is the largest of those
    found by taking the sources with the smallest limits per weight as full.
    """
    by_name = Window.orderBy(null_last, source)
    place = (F.row_number().over(by_name) - 1) % len(weights) + 1
    weighted = sizes.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), place.cast("int")))
    weighted = weighted.withColumn("_cap", F.col(size) * limit)
    fullest = Window.orderBy(F.col("_cap") / F.col("_w"), null_last, source)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    earlier = fullest.rowsBetween(Window.unboundedPreceding, -1)
    later = fullest.rowsBetween(0, Window.unboundedFollowing)
    left = F.sum(size).over(every) - F.coalesce(F.sum("_cap").over(earlier), F.lit(0))
    levels = weighted.withColumn("_level", left.cast("double") / F.sum("_w").over(later))
    level = F.greatest(F.max("_level").over(every), F.lit(0.0))
    return (levels.withColumn("target", F.least(F.col("_cap").cast("double"), level * F.col("_w")))
            .drop("_w", "_cap", "_level"))


def _offsets(sized: DataFrame) -> DataFrame:
    """One row per source and range of its order: tokens before it, source size, target."""
    blocks = sized.groupBy("_wfq_src", "_wfq_block").agg(F.sum("_wfq_size").alias("_n"))
    sources = blocks.groupBy("_wfq_src").agg(F.sum("_n").alias("source_size"))
    targets = source_targets(sources, "_wfq_src", "source_size", F.col("_wfq_src") == "~")
    before = (Window.partitionBy("_wfq_src").orderBy("_wfq_block")
              .rowsBetween(Window.unboundedPreceding, -1))
    return (blocks.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
            .join(targets, "_wfq_src").drop("_n"))


def _with_place(rows: DataFrame, offsets: DataFrame) -> DataFrame:
    """Rows with their source's size and target and the tokens up to and including them."""
    within = (Window.partitionBy("_wfq_src", "_wfq_block").orderBy("_wfq_key")
              .rowsBetween(Window.unboundedPreceding, 0))
    return (rows.withColumn("_within", F.sum("_wfq_size").over(within))
            .join(offsets, ["_wfq_src", "_wfq_block"])
            .withColumn("_wfq_until", F.col("_before") + F.col("_within"))
            .drop("_before", "_within"))


def _finish(passed: Column | int) -> Column:
    """Virtual finish time of a copy in the given pass."""
    tokens = F.lit(passed) * F.col("source_size") if isinstance(passed, int) else passed * F.col("source_size")
    return F.try_divide((tokens + F.col("_wfq_until")).cast("double"), F.col("target"))


def _time_range(finish: Column) -> Column:
    return F.least(F.floor(finish * TIME_RANGES), F.lit(LAST_RANGE)).cast("long")


def find_budget(placed: DataFrame) -> Budget:
    """Where the copies in order of finish time reach the size of all documents. Driver: two rows."""
    copies = (placed.where("_wfq_size > 0")
              .withColumn("_pass", F.explode(F.array(*[F.lit(i) for i in range(MAX_PASSES)])))
              .withColumn("_time", _finish(F.col("_pass")))
              .withColumn("_range", _time_range(F.col("_time"))))
    total = placed.agg(F.sum("_wfq_size")).first()[0] or 0
    along = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    ranges = (copies.groupBy("_range").agg(F.sum("_wfq_size").alias("_n"))
              .withColumn("_upto", F.sum("_n").over(along)))
    over = ranges.where(F.col("_upto") > total).orderBy("_range").limit(1).collect()
    if not over:
        return Budget(LAST_RANGE + 1, None)
    row = over[0]
    order = ["_time", "_wfq_src", "_wfq_key"]
    inside = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    fits = (copies.where(F.col("_range") == row["_range"])
            .withColumn("_sum", F.sum("_wfq_size").over(inside))
            .where(F.col("_sum") <= total - (row["_upto"] - row["_n"]))
            .orderBy(*[F.col(c).desc() for c in order]).select(*order).limit(1).collect())
    return Budget(row["_range"], tuple(fits[0]) if fits else None)


def _is_taken(passed: int, budget: Budget) -> Column:
    time = _finish(passed)
    taken = _time_range(time) < budget.time_range
    if budget.until is None:
        return taken
    last, source, key = budget.until
    up_to = (time < last) | ((time == last) & (
        (F.col("_wfq_src") < source) | ((F.col("_wfq_src") == source) & (F.col("_wfq_key") <= key))))
    return taken | ((_time_range(time) == budget.time_range) & up_to)


ADDED = ("size", "source_size", "target", "copies", "taken")


def _decided(docs: DataFrame, doc_id: str, text: str, source: str, seed: int) -> tuple[DataFrame, dict[str, str]]:
    """Rows of `docs` with the added columns, under the names of `numbered_columns`."""
    own, names = numbered_columns(docs)
    rows = queued(own, names[doc_id], names[text], names[source], seed)
    sized = materialize(rows.select("_wfq_src", "_wfq_block", "_wfq_key", "_wfq_size"), "mix-sizes")
    offsets = materialize(_offsets(sized), "mix-offsets")
    budget = find_budget(materialize(_with_place(sized, offsets), "mix-places"))
    copies = sum((F.when(_is_taken(i, budget), 1).otherwise(0) for i in range(MAX_PASSES)), F.lit(0))
    decided = (_with_place(rows, offsets)
               .withColumn("copies", F.when(F.col("_wfq_size") > 0, copies).otherwise(0))
               .select(*names.values(), F.col("_wfq_size").alias("size"), "source_size", "target", "copies",
                       (F.col("copies") * F.col("_wfq_size")).alias("taken")))
    return decided, names


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        seed: int = 7) -> DataFrame:
    """Every document with `size`, `source_size`, `target`, `copies` (0 to 3) and `taken`.

    Budget: the size of all documents. Sources by code point, null last, weigh 1, 2, 3 in
    turn. Null and empty texts, and texts of white space, have size 0 and no copies. A null
    id is an id like any other. Repeated rows are rows of their own; equal ones may take each
    other's place. Columns of the input keep their values, except that the five named here
    replace input columns of the same names. No rows give no rows.
    """
    decided, names = _decided(docs, doc_id, text, source, seed)
    return decided.select(*[F.col(n).alias(c) for c, n in names.items() if c not in ADDED], *ADDED)


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
                    seed: int = 7) -> DataFrame:
    """The mix itself: rows of `docs`, each as many times as it is taken.

    All columns keep their values, those named like a column of `mix`, too. Rows without words go;
    nulls, ties, repeated rows and empty tables as in `mix`.
    """
    decided, names = _decided(docs, doc_id, text, source, seed)
    return (decided.where("copies > 0")
            .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
            .select(*[F.col(n).alias(c) for c, n in names.items()]))

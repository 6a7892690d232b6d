"""Exact duplicates by two-pass Bloom filtering (DataFrame functions only).

First pass: every text sets two bits of a filter, and the bits that are set more than
once are kept. Second pass: a text whose bits are both among them may be repeated, and
only such rows are shuffled, by SHA-256; all others are alone and pass straight through.

The filter has `BITS_PER_TEXT` bits a row, in buckets of 4 KB; both bits of a text lie in
one bucket, so a row looks its bucket up once. It is broadcast and never exceeds
`MAX_BUCKETS` buckets (64 MB). Beyond some 33 million rows it fills up instead of growing:
more rows are then taken for repeated ones and shuffled; the result is the same.
"""

from math import ceil, log2

from pyspark.sql import Column, DataFrame, functions as F

from procwatch.llm.inputs import free_name
from procwatch.session import materialize

BITS_PER_TEXT = 16
BUCKET_BITS = 4096 * 8  # of Spark's bitmap functions
MAX_BUCKETS = 1 << 14
ADDED = ("keep_id", "group_size", "kept", "text_sha256")


def bucket_count(rows: int) -> int:
    """Buckets of the filter: a power of two, for `rows` texts."""
    wanted = max(1, rows * BITS_PER_TEXT / BUCKET_BITS)
    return min(MAX_BUCKETS, 1 << ceil(log2(wanted)))


def _probes(text: Column, n_buckets: int) -> tuple[Column, Column, Column]:
    """Bucket and two places in it."""
    h = F.xxhash64(text)
    return (h.bitwiseAND(F.lit(n_buckets - 1)),
            F.shiftrightunsigned(h, 20).bitwiseAND(F.lit(BUCKET_BITS - 1)),
            F.shiftrightunsigned(h, 40).bitwiseAND(F.lit(BUCKET_BITS - 1)))


def repeated_bits(texts: DataFrame, text: str, n_buckets: int) -> DataFrame:
    """(bucket, bits): the bits that more than one text, or one text twice, sets."""
    bucket, one, other = _probes(F.col(text), n_buckets)
    hits = texts.select(bucket.alias("bucket"), F.explode(F.array(one, other)).alias("place"))
    twice = hits.groupBy("bucket", "place").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return twice.groupBy("bucket").agg(F.bitmap_construct_agg("place").alias("bits"))


def set_bits(values: DataFrame, column: str, n_buckets: int) -> DataFrame:
    """(bucket, bits): a filter of all values of a column."""
    bucket, one, other = _probes(F.col(column), n_buckets)
    return (values.select(bucket.alias("bucket"), F.explode(F.array(one, other)).alias("place"))
            .groupBy("bucket").agg(F.bitmap_construct_agg("place").alias("bits")))


def maybe_in(rows: DataFrame, column: str, bits: DataFrame, n_buckets: int) -> DataFrame:
    """The rows whose value may be in a filter: all that are, and few others. Nothing is shuffled."""
    bucket, held = free_name(rows, "_bloom_bucket"), free_name(rows, "_bloom_bits")
    at, one, other = _probes(F.col(column), n_buckets)
    filter_ = bits.select(F.col("bucket").alias(bucket), F.col("bits").alias(held))
    return (rows.withColumn(bucket, at).join(F.broadcast(filter_), bucket)  # at most 64 MB
            .where(_is_set(F.col(held), one) & _is_set(F.col(held), other)).select(*rows.columns))


def _is_set(bits: Column, place: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]),
                                        (place % 8).cast("int") + 1)) != 0


def mark_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                carry: list[str] | None = None) -> DataFrame:
    """Every row of `docs` with `keep_id`, `group_size`, `kept` and `text_sha256`.

    Texts are equal if identical, whatever their length; a null text is an empty one. Of equal
    texts the row with the largest id stays (`kept`), and `keep_id` is its id; a null id is
    smaller than any. Of rows with equal text and id one stays. `carry` names the columns of
    `docs` to return, all if not given; those named like an added column are replaced. No rows
    give no rows.
    """
    columns = [c for c in (docs.columns if carry is None else carry) if c not in ADDED]
    whole, bucket, bits, row, best = (free_name(docs, f"_copy_{n}") for n in ("text", "bucket", "bits", "row", "best"))
    texts = docs.withColumn(whole, F.coalesce(F.col(text), F.lit("")))
    n_buckets = bucket_count(docs.count())
    found = materialize(repeated_bits(texts, whole, n_buckets), "repeated-bits")
    filter_ = found.select(F.col("bucket").alias(bucket), F.col("bits").alias(bits))
    at, one, other = _probes(F.col(whole), n_buckets)
    tested = texts.withColumn(bucket, at).join(F.broadcast(filter_), bucket, "left")  # at most 64 MB
    maybe = F.coalesce(_is_set(F.col(bits), one) & _is_set(F.col(bits), other), F.lit(False))
    digest = F.sha2(F.col(whole), 256)
    alone = tested.where(~maybe).select(
        *columns, F.col(doc_id).alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), digest.alias("text_sha256"))
    id_ = free_name(docs, "_copy_id")
    shuffled = materialize(tested.where(maybe).select(
        *columns, F.col(doc_id).alias(id_), F.monotonically_increasing_id().alias(row),
        digest.alias("text_sha256")), "maybe-repeated")
    # written, so that Spark can split the rows of a text that is everywhere when it joins
    groups = materialize(shuffled.groupBy("text_sha256").agg(
        F.max(F.struct(id_, row)).alias(best), F.count(F.lit(1)).alias("group_size")), "copy-groups")
    grouped = shuffled.join(groups, "text_sha256").select(
        *columns, F.col(best)[id_].alias("keep_id"), "group_size",
        (F.col(row) == F.col(best)[row]).alias("kept"), "text_sha256")
    return alone.unionByName(grouped)


def without_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of `docs`, one of each group of equal texts: the one with the largest id.

    Nulls, ties, repeated rows and empty tables as in `mark_copies`; columns that are named
    like one of those keep their values.
    """
    names = {c: free_name(docs, f"_own_{c}") for c in docs.columns if c in ADDED}
    own = docs.withColumnsRenamed(names)
    marked = mark_copies(own, names.get(doc_id, doc_id), names.get(text, text))
    return marked.where("kept").select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])

"""Exact deduplication against a dictionary, with small filters, and on odd rows."""

import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from procwatch.llm import exact_dedup

SCHEMA = "doc_id long, text string"


def by_hand(rows):
    groups = defaultdict(list)
    for doc, text in rows:
        groups[text or ""].append(doc)
    return sorted((doc, max(groups[text or ""]), len(groups[text or ""]), doc == max(groups[text or ""]),
                   hashlib.sha256((text or "").encode()).hexdigest()) for doc, text in rows)


def found(df):
    return sorted(tuple(r) for r in df.select("doc_id", *exact_dedup.ADDED).collect())


def some_rows(n):
    rng = random.Random(3)
    return [(i, None if i % 50 == 0 else "hot" if i % 3 == 0 else f"text {rng.randrange(n)}" + "é" * (i % 4))
            for i in range(n)]


def test_like_a_dictionary(spark):
    rows = some_rows(3000)
    assert found(exact_dedup.mark_copies(spark.createDataFrame(rows, SCHEMA).repartition(7))) == by_hand(rows)


def test_full_filter_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BITS_PER_TEXT", 0.001)
    monkeypatch.setattr(exact_dedup, "BUCKET_BITS", 64)
    rows = some_rows(2000)
    assert exact_dedup.bucket_count(2000) == 1
    assert found(exact_dedup.mark_copies(spark.createDataFrame(rows, SCHEMA))) == by_hand(rows)


def test_filter_is_bounded():
    assert exact_dedup.bucket_count(0) == 1
    assert exact_dedup.bucket_count(10 ** 12) == exact_dedup.MAX_BUCKETS


def test_single_rows_are_not_shuffled(spark):
    texts = spark.createDataFrame([(i, f"t{i}") for i in range(20000)] + [(i, "same") for i in range(5)], SCHEMA)
    n = exact_dedup.bucket_count(20005)
    bits = exact_dedup.repeated_bits(texts, "text", n)
    at, one, other = exact_dedup._probes(F.col("text"), n)
    maybe = (texts.withColumn("bucket", at).join(bits, "bucket")
             .where(exact_dedup._is_set(F.col("bits"), one) & exact_dedup._is_set(F.col("bits"), other)))
    assert maybe.where("text = 'same'").count() == 5
    assert maybe.count() < 20005 * 0.05


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, ""), (3, "a"), (3, "a"), (None, "b"), (None, "b"), (4, "x" * 3_000_000),
            (5, "x" * 3_000_000), (6, "A"), (7, "a ")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns(
        {c: F.lit("own") for c in ("kept", "_copy_bits", "_copy_row", "bucket", "bits", "place", "n")})
    got = exact_dedup.mark_copies(docs).collect()
    assert sum(r["kept"] for r in got) == 6
    assert {(r["doc_id"], r["keep_id"], r["group_size"]) for r in got} == {
        (1, 2, 3), (2, 2, 3), (None, 2, 3), (3, 3, 2), (None, None, 2), (4, 5, 2), (5, 5, 2), (6, 6, 1), (7, 7, 1)}
    assert {r["_copy_bits"] for r in got} == {"own"}
    kept = exact_dedup.without_copies(docs)
    assert kept.columns == docs.columns
    assert {r["kept"] for r in kept.collect()} == {"own"} and kept.count() == 6


def test_empty_table(spark):
    assert exact_dedup.mark_copies(spark.createDataFrame([], SCHEMA)).count() == 0

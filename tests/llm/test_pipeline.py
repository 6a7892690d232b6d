"""The stages against plain code, each on what its predecessor kept."""

import zlib

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from procwatch.llm import leaks, mixing
from procwatch.llm.token_files_query import tokenizer_path
from test_neardup import by_hand as classes_by_hand

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF)
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "tokens":
            assert docs.columns == before.columns
        kept[name] = (before, docs)
    before, after = kept["language"]
    assert after.count() >= 0.99 * before.count()
    before, after = kept["near copies"]
    classes = classes_by_hand([(r["doc_id"], r["text"]) for r in before.collect()])
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(set(classes.values()))
    before, after = kept["leaks"]
    matcher = leaks.Matcher([i for i in (leaks.make_item(r["item_id"], r["text"]) for r in spark.read.parquet(
        f"{SF}/benchmark.parquet").collect()) if i])
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(
        r["doc_id"] for r in before.collect() if not matcher.passages(r["text"]))
    before, after = kept["mixing"]
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(before).collect() if r["copies"]}
    assert {r["doc_id"]: r["count"] for r in after.groupBy("doc_id").count().collect()} == copies
    before, after = kept["tokens"]
    plain, start = Tokenizer.from_file(tokenizer_path()), 0
    for r, t in zip(before.orderBy("doc_id").collect(), after.orderBy("start").collect()):
        ids = plain.encode(r["text"], add_special_tokens=False).ids + [2]
        assert tuple(t) == (r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_odd_documents(spark, tmp_path):
    rows = [(1, None, None, None, 0), (2, "", "en", "a", 0), (None, "words without an id stand here", None, "a", 1),
            (3, "words without an id stand here", "en", "a", 1), (3, "words without an id stand here", "en", "a", 1),
            (4, "x " * 30_000, "en", None, 2)]
    given = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for docs in (given, given.where("doc_id > 9")):
        docs = docs.withColumn("lang_pred", F.lit("x")).withColumn("copies", F.lit(1))
        for name, stage in corpus_pipeline.STAGES:
            columns, docs = docs.columns, stage(spark, docs, SF)
            assert name == "tokens" or docs.columns == columns
            docs.write.mode("overwrite").parquet(f"{tmp_path}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]

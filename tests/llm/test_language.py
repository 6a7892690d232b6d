"""Language identification: held-out accuracy, the same logits as a plain loop, and odd rows."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from procwatch.llm import language
from procwatch.llm.language_query import op9_language

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    got = op9_language(spark, SF).collect()
    assert len(got) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)
    assert np.mean([r["rejected"] for r in got]) < 0.01


def test_labels_of_held_out_rows_are_not_used(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    spoiled = docs.withColumn("lang", F.when(language.is_held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang")))
    assert np.array_equal(language.fit(docs).table, language.fit(spoiled).table)


def _model():
    texts = ["the and of it was for", "der und die das nicht ein"] * 30
    return language.train(texts, ["en", "de"] * 30)


def test_logits_of_whole_texts():
    model = _model()
    texts = ["", "a", "the", "und " * 70_000, "the and " * 200_000, "é" * 10]
    data = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])])
    got = language.logits(model, np.concatenate(data), offsets)
    for d, row in zip(data, got):
        at, share = language._features(d)
        assert np.allclose(row, share.astype(np.float64) @ model.table[at].astype(np.float64) + model.offset, atol=1e-4)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "123 ?!"), (4, "the and of"), (4, "the and of"), (None, "der und die"), (5, "x " * 60_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("own")).withColumn("rejected", F.lit(7))
    got = language.predict(docs, _model()).collect()
    assert len(got) == len(rows)
    by = {(r["doc_id"], r["text"]): r for r in got}
    for key in [(1, None), (2, ""), (3, "123 ?!")]:
        assert (by[key]["lang_pred"], by[key]["score"], by[key]["rejected"]) == ("und", 0.0, True)
    assert by[(4, "the and of")]["lang_pred"] == "en" and by[(None, "der und die")]["lang_pred"] == "de"


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "some words", None), (3, None, "en")], "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert model is None
    got = {r["doc_id"]: (r["lang_pred"], r["rejected"]) for r in language.predict(docs, model).collect()}
    assert got == {1: ("und", False), 3: ("und", True)}
    empty = docs.where("doc_id > 9")
    assert language.predict(empty, _model()).count() == 0 and language.fit(empty) is None


def test_every_label_is_learned(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE_TOTAL", 130 * 500 * 30)  # 30 characters a row
    rows = [(i, f"{'abcdefghijklm'[i % 13] * 3}{'nopqrstuvw'[i // 13 % 10] * 3} " * 9, f"l{i % 130}") for i in range(1300)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == sorted({lang for *_, lang in rows})

"""Stages and operators on tables whose further columns are named like the operators' own."""

import random

from pyspark.sql import functions as F

from procwatch.llm import language, mixing, neardup

EXTRA = ("_dup_id", "_dup_digest", "_before", "_within", "_wfq_key", "_copy", "_has_letter", "size", "taken", "digest", "kept")


def _docs(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(f"w{rng.randrange(40)}" for _ in range(60)), "en", f"s{i % 3}") for i in range(30)]
    rows += [(100 + i, rows[i][1], None, "s0") for i in range(5)] + [(200, None, None, None), (201, "", "en", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def _with_extra(docs):
    return docs.withColumns({c: F.concat(F.lit(c), F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) for c in EXTRA})


def _same(plain, wide):
    """The rows are those of the table without the columns, and the columns keep their values."""
    assert wide.columns == [*plain.columns, *EXTRA]
    rows = wide.collect()
    assert all(r[c] == f"{c}:{r['doc_id']}" for r in rows for c in EXTRA)
    assert sorted(str(tuple(r[:len(plain.columns)])) for r in rows) == sorted(str(tuple(r)) for r in plain.collect())


def test_near_copies(spark):
    docs = _docs(spark)
    plain = neardup.without_near_copies(docs)
    assert plain.count() < docs.count()
    _same(plain, neardup.without_near_copies(_with_extra(docs)))


def test_mixing(spark):
    docs = _docs(spark)
    _same(mixing.mixed_documents(docs), mixing.mixed_documents(_with_extra(docs)))
    mixed = mixing.mix(_with_extra(docs))
    assert mixed.columns == [*docs.columns, *[c for c in EXTRA if c not in mixing.ADDED], *mixing.ADDED]


def test_language(spark):
    wide = _with_extra(_docs(spark))
    judged = language.predict(wide, language.fit(wide))
    assert {r["_has_letter"].split(":")[0] for r in judged.collect()} == {"_has_letter"}

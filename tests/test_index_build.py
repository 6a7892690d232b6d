"""The index is made in one go: chunks once, every part written once, few tokens held at a time."""

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from procwatch import fixed_values as fv
from procwatch.operators import index
from procwatch.session import file_system, session_dir


def _chunks(spark, n=60):
    text = F.concat_ws(" ", F.lit("Valve open"), F.col("id").cast("string"), F.lit("p_h-7 valve  x"))
    return spark.range(n).select(
        F.concat(F.lit("c"), "id").alias("chunk_id"), text.alias("text"), F.lit("ph").alias("param"),
        F.when(F.col("id") % 2 == 0, "sop").otherwise("oem").alias("source_type"))


def test_store_makes_chunks_once_and_entries_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def through(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    chunks = _chunks(spark)
    files, folder = file_system(spark, session_dir(spark))
    before = {f.getPath().getName() for f in files.listStatus(folder)}
    stored = index.Index.store(chunks.mapInArrow(through, chunks.schema), str(tmp_path))
    assert made.value == 60
    assert {f.getPath().getName() for f in files.listStatus(folder)} == before  # no second copy
    want = index.Index.of(chunks)
    for name in ("entries", "terms", "size", "kinds", "chunks"):
        got, other = getattr(stored, name), getattr(want, name)
        columns = sorted(c for c in other.columns if "terms" != c and c != "term_counts")
        assert sorted(map(tuple, got.select(columns).collect()), key=repr) == \
            sorted(map(tuple, other.select(columns).collect()), key=repr)


def test_large_batches_are_counted_in_pieces(monkeypatch):
    monkeypatch.setattr(index, "_BATCH_BYTES", 40)
    texts = ["valve open", "", None, "x" * 100, "valve valve p-7 p"] * 3
    batch = pa.RecordBatch.from_arrays(
        [pa.array([str(i) for i in range(15)]), pa.nulls(15, pa.string()), pa.nulls(15, pa.string()), pa.array(texts)],
        names=["chunk_id", "param", "source_type", "text"])
    found = list(index.count_batches(iter([batch]), 384))
    assert len(found) > 3
    rows = [r for b in found for r in b.to_pylist()]
    assert [r["chunk_id"] for r in rows] == [str(i) for i in range(15)]
    assert [r["n_words"] for r in rows] == [2, 0, 0, 1, 4] * 3
    assert dict(zip(rows[4]["terms"], rows[4]["term_counts"])) == {"valve": 2, "p-7": 1, "p": 1}
    assert sum(rows[4]["bucket_counts"]) == 5  # valve valve p 7 p


def test_arrow_splits_at_white_space():
    texts = pa.array([f"a{chr(c)}b" for c in range(1, 0x110000) if not 0xd800 <= c < 0xe000])
    assert pc.utf8_split_whitespace(texts).equals(pc.split_pattern_regex(texts, f"{fv.WHITE_SPACE}+"))


def test_term_counts_take_one_pass(spark, monkeypatch):
    from procwatch.plans import inputs, knowledge
    made = spark.sparkContext.accumulator(0)

    def through(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    chunks = _chunks(spark)
    monkeypatch.setattr(inputs, "document_chunks", lambda *_: chunks.mapInArrow(through, chunks.schema))
    got = {r["term"]: (r["df"], r["n_chunks"], r["avg_words"]) for r in knowledge.term_stats(spark, "").collect()}
    assert made.value == 60
    assert got["valve"][0] == got["x"][0] == 60 and got["7"][0] == 1
    assert len(got) == 4 + 60 and {v[1:] for v in got.values()} == {(60, 6.0)}
    monkeypatch.setattr(inputs, "document_chunks", lambda *_: chunks.limit(0))
    assert knowledge.term_stats(spark, "").count() == 0


def test_postings_and_vectors_are_made_alone(spark, monkeypatch):
    from procwatch.plans import inputs, knowledge
    chunks = _chunks(spark)
    entries = index.index_chunks(chunks)
    monkeypatch.setattr(inputs, "document_chunks", lambda *_: chunks)
    monkeypatch.setattr(index, "index_chunks", None)  # the whole entries are not needed

    def rows(df):
        return sorted(map(tuple, df.collect()))

    assert rows(knowledge.postings(spark, "")) == rows(index.postings(entries))
    assert rows(index.chunk_vectors(chunks)) == rows(index.vectors(entries))
    assert knowledge.hash_embeddings(spark, "").columns == ["chunk_id", "bucket", "n", "weight"]


def test_append_and_retract_cut_documents_once(spark, monkeypatch):
    from procwatch.plans import inputs, knowledge
    for query in (knowledge.index_append, knowledge.index_retract):
        made = spark.sparkContext.accumulator(0)

        def through(batches, made=made):
            for batch in batches:
                made.add(batch.num_rows)
                yield batch

        chunks = _chunks(spark).withColumn("source_type", F.when(F.substring("chunk_id", 2, 2) % 3 == 0, "deviation")
                                           .otherwise(F.col("source_type")))
        monkeypatch.setattr(inputs, "document_chunks", lambda *_: chunks.mapInArrow(through, chunks.schema))
        got = {r["term"]: (r["df"], r["n_chunks"]) for r in query(spark, "").collect()}
        assert made.value == 60, query.__name__
        assert got["valve"] == (60, 60) and len(got) == 64

"""Token files: codec, encoder, files, and odd rows."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from procwatch.llm import token_files
from procwatch.llm.token_files_query import tokenizer_path

ODD = ["", "a", " a", "a ", "  ", " a  b ", "a\n b", "x <|endoftext|> y", "it's  we'll  you  z", "a.b, c.d", "3.14 ,x",
       "...  !! a", "tab\t x", "日本 語 テ", "a\u0085 b", "\u200b x", "नमस्ते दुनिया", "e\u0301 , x.", "nul\0 l", "a" * 5000]


@given(st.lists(st.one_of(st.integers(0, 2**64 - 1), st.integers(0, 50_000), st.just(0)), max_size=700))
@settings(max_examples=60, deadline=None)
def test_codec(values):
    ids = np.array(values, np.uint64)
    words, firsts, escapes = token_files.encode(ids)
    assert np.array_equal(token_files.decode(words, escapes), ids)
    for group in range(len(firsts)):
        part = words[firsts[group]:firsts[group + 1] if group + 1 < len(firsts) else len(words)]
        assert np.array_equal(token_files.decode(part, escapes),
                              ids[group * token_files.GROUP:(group + 1) * token_files.GROUP])


@pytest.mark.parametrize("memory", [600_000, 5])
def test_encoder(memory, monkeypatch):
    monkeypatch.setattr(token_files, "MEMO_ENTRIES", memory)
    plain, encoder = Tokenizer.from_file(tokenizer_path()), token_files.Encoder(tokenizer_path())
    for _ in range(2):
        for texts in (ODD, [" ".join(ODD)], [], [""], ["Ein Wort, noch ein Wort. Une école."] * 3):
            ids, counts = encoder.encode(texts)
            want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
            assert ids.tolist() == [i for one in want for i in one]
            assert counts.tolist() == list(map(len, want))


@given(st.text(alphabet=" \n\t.,'a1é\u00a0-", max_size=30))
@settings(max_examples=150, deadline=None)
def test_pieces_do_not_change_ids(text):
    plain, encoder = _both()
    assert encoder.encode([text])[0].tolist() == plain.encode(text, add_special_tokens=False).ids


def _both(made=[]):
    if not made:
        made += [Tokenizer.from_file(tokenizer_path()), token_files.Encoder(tokenizer_path())]
    return made


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plain, start = Tokenizer.from_file(tokenizer_path()), 0
    got = {r["doc_id"]: r for r in token_files.token_table(docs.repartition(5), tokenizer_path()).collect()}
    for r in docs.orderBy("doc_id").collect():
        ids = plain.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        assert tuple(got[r["doc_id"]]) == (r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_odd_rows(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "null id"), (3, None), (3, "a "), (-5, "x " * 20000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit(1)).withColumn("block", F.lit(2))
    folder = token_files.write_tokens(docs, f"file://{tmp_path}/t", tokenizer_path())
    got = token_files.with_starts(token_files.read_tokens(spark, folder, ids=True)).orderBy("start").collect()
    plain = Tokenizer.from_file(tokenizer_path())
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    assert [r["doc_id"] for r in got] == [d for d, _ in want]
    start = 0
    for r, (_, text) in zip(got, want):
        assert r["ids"] == plain.encode(text or "", add_special_tokens=False).ids + [2]
        assert r["start"] == start
        start += r["n_tokens"]


def test_empty_table(spark):
    assert token_files.token_table(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path()).count() == 0


def test_files_of_bounded_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_BLOCKS", 2)
    monkeypatch.setattr(token_files, "BLOCK_IDS", 40)
    rows = [(i // 7, f"text {i} of {i % 5}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    folder = token_files.write_tokens(docs, f"file://{tmp_path}/t", tokenizer_path())
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == batch
    read = token_files.read_tokens(spark, folder, ids=True)
    assert read.select("file").distinct().count() > 12
    plain, start = Tokenizer.from_file(tokenizer_path()), 0
    for r, (doc, text) in zip(token_files.with_starts(read).orderBy("start").collect(), sorted(rows), strict=True):
        assert (r["doc_id"], r["start"]) == (doc, start)
        assert r["ids"] == plain.encode(text, add_special_tokens=False).ids + [2]
        start += r["n_tokens"]


def test_files_are_ordered_by_their_numbers(spark):
    names = ["part-00009-x-c000.txt", "part-00009-x-c999.txt", "part-00009-x-c1000.txt", "part-100000-x-c000.txt"]
    read = spark.createDataFrame([(f"f/part-7-y/{n}", 0, i, 0, 1, 0) for i, n in enumerate(names)],
                                 "file string, n long, doc_id long, file_start long, n_tokens long, ids_crc32 long")
    got = {r["doc_id"]: r["start"] for r in token_files.with_starts(read).collect()}
    assert got == {i: i for i in range(len(names))}

"""Chunks taken out of an index or changed: the same as an index built of what is left."""

import random

import pytest

from procwatch.operators import index, search

SCHEMA = "chunk_id string, param string, source_type string, text string"
WORDS = "pump valve filter temp rises falls check reset the of and seal coolant".split()


def _rows(seed, ids):
    rng = random.Random(seed)
    return [(f"c{i}", rng.choice(["ph", "temp", None]), rng.choice(["sop", "oem"]),
             " ".join(rng.choice(WORDS) for _ in range(rng.randrange(0, 30)))) for i in ids]


def _content(found):
    def rows(df, *columns):
        return sorted(map(repr, (tuple(r) for r in df.select(*columns).collect())))

    size = found.size.first()
    return (rows(found.chunks, "chunk_id", "text"), rows(found.entries, "chunk_id", "n_words", "norm"),
            rows(found.terms, "term", "df"), rows(found.kinds, "param", "source_type", "n"), size["n_chunks"],
            size["avg_words"] and round(size["avg_words"], 9))


@pytest.fixture(scope="module")
def made(spark):
    def frame(rows):
        return spark.createDataFrame(rows, SCHEMA)
    return frame


def test_add_change_delete_equals_rebuild(made, tmp_path, spark):
    old, more, changed = _rows(1, range(40)), _rows(2, range(40, 60)), _rows(3, range(10, 25))
    ids = made([(f"c{i}", None, None, None) for i in (0, 3, 12, 45, 59, 999)] + [(None, None, None, None)] * 2)
    got = index.Index.of(made(old)).append(made(more)).replace(made(changed)).retract(ids)
    left = {r[0]: r for r in old + more + changed}
    for gone in ("c0", "c3", "c12", "c45", "c59"):
        del left[gone]
    want = index.Index.of(made(list(left.values())))
    assert _content(got) == _content(want)

    got.write(str(tmp_path))  # what is stored holds no tombstones
    assert _content(index.Index.read(spark, str(tmp_path))) == _content(want)

    asked = spark.createDataFrame([("q", "pump seal coolant", None, None)],
                                  "query_id string, text string, param string, source_types array<string>")
    hits = [search.search(asked, one, 5).orderBy("rank").collect() for one in (got, want)]
    assert [h["chunk_id"] for h in hits[0]] == [h["chunk_id"] for h in hits[1]]
    assert [h["score"] for h in hits[0]] == pytest.approx([h["score"] for h in hits[1]])


def test_retracting_all_and_adding_again(made):
    rows = _rows(4, range(12))
    empty = index.Index.of(made(rows)).retract(made(rows))
    assert _content(empty)[:4] == ([], [], [], []) and empty.size.first()["n_chunks"] == 0
    assert _content(empty.append(made(rows))) == _content(index.Index.of(made(rows)))


def test_retracting_twice_or_nothing_changes_nothing(made):
    rows = _rows(5, range(12))
    full = index.Index.of(made(rows))
    assert _content(full.retract(made([]))) == _content(full)
    once = full.retract(made(rows[:3]))
    assert _content(once.retract(made(rows[:3]))) == _content(once)

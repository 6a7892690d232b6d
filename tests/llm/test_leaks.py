"""Decontamination against a plain edit distance, and on odd rows."""

import random

import pytest
from pyspark.sql import functions as F

from procwatch.llm import leaks

WORDS = [a + b for a in ("al", "be", "co", "du", "em") for b in ("ra", "nix", "to", "lume", "s")]


def nearest(item, text):
    """Smallest distance of the item to any passage of the text, by the plain recurrence."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(item):
            new.append(min(new[i] + 1, row[i + 1] + 1, row[i] + (p != c)))
        row, best = new, min(best, new[-1])
    return best


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng, text, n):
    out = list(text)
    for _ in range(n):
        at = rng.randrange(len(out))
        kind = rng.random()
        if kind < 0.4:
            out[at] = rng.choice("xyzq")
        elif kind < 0.7:
            del out[at]
        else:
            out.insert(at, rng.choice("xyzq"))
    return "".join(out)


def test_against_the_plain_distance(spark):
    rng = random.Random(5)
    items = [(i, sentence(rng, rng.randrange(6, 40)).capitalize() + ".") for i in range(12)]
    docs = []
    for d in range(120):
        body = sentence(rng, rng.randrange(0, 60))
        if d % 2:
            item = items[d % 12][1]
            body += "\n " + edited(rng, item, rng.randrange(0, 2 + len(item) // 12)) + "! " + sentence(rng, 20)
        docs.append((d, body))
    got = {(r["doc_id"], r["item_id"]): r for r in leaks.find_leaks(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string"), block_chars=300).collect()}
    for d, text in docs:
        for i, item in items:
            a, b = leaks.normal(item), leaks.normal(text)
            distance, budget = nearest(a, b), int(len(a) * leaks.ERROR_RATE)
            assert ((d, i) in got) == (distance <= budget), (d, i, distance, budget)
            if (d, i) in got:
                row = got[d, i]
                assert (row["distance"], row["budget"]) == (distance, budget)
                passage = " ".join(b.split(" ")[row["first_word"]:row["last_word"] + 1])
                assert nearest(a, passage) == distance


def test_clean_rows_stay(spark):
    rng = random.Random(6)
    item = sentence(rng, 20)
    docs = spark.createDataFrame(
        [(1, "x " + item.upper(), "a"), (2, sentence(rng, 30), "b"), (None, None, "c"), (2, "", "d"), (2, item[:40], "e")],
        "item_id long, text string, distance string")
    bench = spark.createDataFrame([(1, item), (2, "to be"), (3, None), (4, ""), (None, item)], "item_id long, text string")
    clean = leaks.without_leaks(docs, bench)
    assert clean.columns == docs.columns
    assert sorted(r["distance"] for r in clean.collect()) == ["b", "c", "d", "e"]
    found = leaks.find_leaks(docs.withColumn("doc_id", F.lit(7)), bench).collect()
    assert sorted((r["doc_id"], str(r["item_id"])) for r in found) == [(7, "1"), (7, "None")]


@pytest.mark.parametrize("docs,items", [([], [(1, "one two three four five six")]), ([(1, "one two three four five six")], [])])
def test_empty_tables(spark, docs, items):
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert leaks.find_leaks(d, b).count() == 0
    assert leaks.without_leaks(d, b).count() == len(docs)


def test_long_text_and_repeated_rows(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = spark.createDataFrame([(1, "word " * 100_000 + item + " word" * 1000)] * 3, "doc_id long, text string")
    got = leaks.find_leaks(docs, spark.createDataFrame([(9, item)] * 2, "item_id long, text string")).collect()
    assert [(r["doc_id"], r["item_id"], r["first_word"], r["last_word"]) for r in got] == [(1, 9, 100_000, 100_009)] * 3


def test_items_without_blanks(spark):
    items = [(1, "\u4e2d\u534e\u4eba\u6c11\u5171\u548c\u56fd\u7684\u9996\u90fd\u662f\u54ea\u4e00\u5ea7\u57ce\u5e02"),
             (2, "\u65e5\u672c\u3067\u4e00\u756a\u9ad8\u3044\u5c71\u306e\u540d\u524d\u3092\u7b54\u3048\u306a\u3055\u3044" * 4),
             (3, "\u0e1b\u0e23\u0e30\u0e40\u0e17\u0e28\u0e44\u0e17\u0e22\u0e21\u0e35\u0e01\u0e35\u0e48\u0e08\u0e31\u0e07\u0e2b\u0e27\u0e31\u0e14\u0e43\u0e19\u0e1b\u0e31\u0e08\u0e08\u0e38\u0e1a\u0e31\u0e19"),
             (4, "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"), (5, "\u4e2d\u56fd"), (6, "word"), (7, "\u0443\u043d\u0438\u0432\u0435\u0440\u0441\u0438\u0442\u0435\u0442")]
    changed = items[1][1][:30] + "\u8c37" + items[1][1][31:]
    docs = [(i, "\u524d" * 30 + text + "\u5f8c" * 30) for i, text in items]
    docs += [(8, "before " + changed + " after"), (9, "\u4e2d\u534e\u4eba\u6c11 word"), (10, None)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in leaks.find_leaks(d, b).collect()}
    assert set(got) == {(1, 1), (2, 2), (3, 3), (4, 4), (8, 2)}
    assert all((r["distance"] == 0) == (doc != 8) for (doc, _), r in got.items())
    assert {r["doc_id"] for r in leaks.without_leaks(d, b).collect()} == {5, 6, 7, 9, 10}

"""Ranked lexical search against a plain loop, the bounds of the trie, and odd rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from procwatch.llm import lexical

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"
TABLES = "/root/testdata/sf0.1"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def by_hand(docs, items, top=10):
    counted = [(doc, Counter(terms(text))) for doc, text in docs]
    counted = [(doc, c) for doc, c in counted if c]
    n_docs, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    found = []
    for item, text in items:
        scores = []
        for doc, c in counted:
            m = 25 + 75 * sum(c.values()) * n_docs // total
            score = sum(r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * ((10 ** 9 * c[t]) // (1000 * c[t] + 8 * m)) for t, r in Counter(terms(text)).items() if c[t])
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        found += [(item, i + 1, s[3], -s[0]) for i, s in enumerate(sorted(scores, key=lambda s: s[:3])[:top])]
    return sorted(found, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def invented(n, seed=5):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["É", "é", "ÀB", "àb", "λ", "12"]
    share = [1 / (i + 3) for i in range(len(vocabulary))]
    docs = []
    for i in range(n):
        text = " ".join(rng.choices(vocabulary, share, k=rng.choice([0, 3, 30, 120])))
        docs.append((i, text.upper() if i % 5 == 0 else text))
    docs += [(n + i, docs[7][1] + " tail w3") for i in range(n // 3)]  # a large group of copies
    items = [(i, " ".join(rng.choices(vocabulary, share, k=25)) if i % 3 else docs[i + 1][1]) for i in range(20)]
    return docs, items


def test_like_a_loop(spark, monkeypatch):
    monkeypatch.setattr(lexical, "SHARD_DOCS", 50)
    docs, items = invented(400)
    got = lexical.search(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS))
    assert found(got) == by_hand(docs, items)


def test_groups_of_items_and_small_shards(spark, monkeypatch):
    monkeypatch.setattr(lexical, "GROUP_CHARS", 900)
    monkeypatch.setattr(lexical, "SHARD_ENTRIES", 70)
    monkeypatch.setattr(lexical, "LEAF_DOCS", 2)
    monkeypatch.setattr(lexical, "_CELLS", 500)
    docs, items = invented(150, 9)
    got = lexical.search(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))
    assert found(got) == by_hand(docs, items)


def _trie(docs, items):
    found = lexical.Items([i for i, _ in items], [t for _, t in items])
    n_terms = len(found.vocabulary)
    hashes, bounds = lexical.terms_of(pa.array([t for _, t in docs]))
    row = np.repeat(np.arange(len(docs)), np.diff(bounds))
    at = np.minimum(np.searchsorted(found.vocabulary, hashes), n_terms - 1)
    known = found.vocabulary[at] == hashes
    keys, tf = np.unique(row[known] * n_terms + at[known], return_counts=True)
    df = np.bincount(keys % n_terms, minlength=n_terms)
    place = np.argsort(np.argsort(-df, kind="stable"), kind="stable")
    weights = np.floor(1000 * np.log((2 * len(docs) + 2) / (2 * df + 1))).astype(np.int64)
    n = np.diff(bounds)
    m = 25 + 75 * n * len(docs) // n.sum()
    starts = np.searchsorted(keys, np.arange(len(docs) + 1) * n_terms)
    trie = lexical.Trie([d for d, _ in docs], m, starts, keys % n_terms, tf, place)
    return trie, lexical.Searched(found, weights, 10)


def test_bounds_hold_and_ranges_share_paths():
    docs, items = invented(300)
    trie, state = _trie(docs, items)
    every = np.unique(state.item)
    stack = [(0, len(docs))]
    while stack:
        a, b = stack.pop()
        bound = trie.bounds(a, b, state, every)
        exact = np.max([trie.bounds(i, i + 1, state, every) for i in range(a, b)], axis=0)
        assert (bound >= exact).all()
        if b - a > lexical.LEAF_DOCS and not trie.alike(a, b):
            below = trie.children(a, b)
            assert below[0][0] == a and below[-1][1] == b and len(below) > 1
            stack += below


def test_most_scores_are_bounded_away():
    docs = pq.read_table(f"{TABLES}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    items = pq.read_table(f"{TABLES}/benchmark.parquet").to_pylist()
    trie, state = _trie([(r["doc_id"], r["text"] or "") for r in docs], [(r["item_id"], r["text"]) for r in items])
    trie.search(state)
    assert state.seen == len(docs) * len(items)
    assert state.scored < 0.3 * state.seen


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "--- ..."), (4, "alpha beta"), (4, "alpha beta"), (None, "alpha beta"),
            (5, "alpha " * 200_000), (6, "gamma"), (7, "ALPHA Beta"), (8, "Éa"), (9, "éa")]
    items = [(1, "alpha"), (1, "alpha"), (2, None), (3, ""), (None, "beta zeta"), (4, "nowhere"), (5, "éa " * 50_000),
             (6, "gamma")]
    table = spark.createDataFrame(docs, DOCS).withColumns({c: F.lit("x") for c in ("n", "terms", "item_id", "score")})
    got = lexical.search(table, spark.createDataFrame(items, ITEMS).withColumn("doc_id", F.lit("x")))
    assert found(got) == by_hand(docs, items)


def test_empty_tables(spark):
    none_, some = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a")], DOCS)
    items, no_items = spark.createDataFrame([(1, "a")], ITEMS), spark.createDataFrame([], ITEMS)
    assert lexical.search(none_, items).count() == 0
    assert lexical.search(some, no_items).count() == 0
    assert lexical.search(none_, no_items).count() == 0

"""Near-duplicates against brute force, and on odd rows."""

import collections
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from procwatch.llm import neardup
from procwatch.llm.components import components
from procwatch.llm.neardup_query import op1_near_duplicates

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def by_hand(rows):
    """Class of each row by all pairs; ids are unique."""
    words = {i: WORD.findall((t or "").lower()) for i, t in rows}
    sets = {i: collections.Counter(tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))) if w else {} for i, w in words.items()}
    n, df = len(sets), collections.Counter(s for one in sets.values() for s in one)
    cap = 1 + math.log(1 / neardup.CAP)
    idf = {s: min(1 + math.log((1 + n) / (1 + v)), cap) / cap for s, v in df.items()}
    total = {i: sum(v * idf[s] for s, v in one.items()) for i, one in sets.items()}
    cls = {i: i for i in sets}

    def root(x):
        while cls[x] != x:
            x = cls[x]
        return x
    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b]:
            shared = sum(min(v, sets[b][s]) * idf[s] for s, v in sets[a].items() if s in sets[b])
            if shared / (total[a] + total[b] - shared) >= 0.8 - 1e-9:
                cls[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in sets}


def family(rng, n, edits):
    """Copies of one text, some exact, some with up to `edits` words changed."""
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randrange(edits + 1)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def classes_of(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {r["doc_id"]: r["class_id"] for r in neardup.classes(docs).collect()}


def test_large_groups_against_all_pairs(spark):
    rng = random.Random(1)
    texts = family(rng, 150, 6) + family(rng, 40, 1) + [" ".join(f"u{rng.randrange(10**6)}" for _ in range(60)) for _ in range(60)]
    texts += ["common line of seven words stands here " + t for t in texts[150:170]] + ["a b c", "A, b; c", "a b"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    want = by_hand(rows)
    got = classes_of(spark, rows)
    wrong = sum(got[i] != want[i] for i in want)
    assert wrong <= 1, wrong  # bands miss one pair at the very threshold in thousands


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = by_hand([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = op1_near_duplicates(spark, "/root/testdata/sf0.001").collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == want
    assert sum(r["kept"] for r in got) == len(set(want.values()))
    sizes = collections.Counter(want.values())
    assert all(r["class_size"] == sizes[r["class_id"]] for r in got)


def test_odd_rows(spark):
    long = "one two three four five six seven " * 3
    rows = [(1, None), (2, None), (3, ""), (4, "!!"), (7, long), (7, long), (None, long), (8, long.upper()), (9, "x " * 60_000),
            (10, "x " * 60_000), (7, "another text of quite other words"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit(1)).withColumn("node", F.lit(2))
    got = neardup.classes(docs).collect()
    assert len(got) == len(rows)
    of = collections.defaultdict(set)
    for r in got:
        of[r["doc_id"]].add(r["class_id"])
    assert of[1] == {1} and of[3] == {3} and of[4] == {4} and of[8] == {7} and of[10] == of[9] == {9} and of[None] == {7, None}
    kept = neardup.without_near_copies(docs)
    assert kept.columns == docs.columns
    left = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    assert left == sorted([(1, None), (2, None), (3, ""), (4, "!!"), (7, long), (9, "x " * 60_000),
                           (7, "another text of quite other words"), (None, None)], key=str)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.classes(docs).count() == 0 and neardup.without_near_copies(docs).count() == 0


def test_document_frequencies(spark):
    texts = ["the same five words here and then text number %d of many words" % i for i in range(300)]
    weights = neardup.document_frequencies(spark.createDataFrame([(t,) for t in texts], "text string"))
    df = collections.Counter(s for t in texts for s in {tuple(t.split()[i:i + 5]) for i in range(len(t.split()) - 4)})
    frequent = [v for v in df.values() if v > neardup.CAP * 301 - 1]
    assert len(weights.heavy) == len(frequent)
    assert np.allclose(sorted(weights.idf), sorted(neardup.relative_idf(np.array(frequent), 300)))


@pytest.mark.parametrize("similarity", [0.3, 0.6, 0.9])
def test_draws_agree_with_the_weighted_similarity(similarity):
    rng = np.random.default_rng(2)
    n = 2000
    shared = rng.integers(0, 2**63, n, dtype=np.uint64)
    weight = rng.uniform(0.2, 4, n)
    own = int(n * (1 - similarity) / (2 * similarity) * 1.0)
    agree = []
    sampler = neardup.Sampler(400)
    sides = []
    for _ in range(2):
        extra = rng.integers(0, 2**63, own, dtype=np.uint64)
        keys, w = np.concatenate([shared, extra]), np.concatenate([weight * rng.choice([1.0, 1.3], n), rng.uniform(0.2, 4, own)])
        order = np.argsort(keys)
        sides.append((keys[order], w[order]))
    for keys, w in sides:
        agree.append(sampler.draws(np.zeros(len(keys), int), keys, w, 1)[0])
    exact = neardup.weighted_jaccard(sides[0][0], sides[0][1], sides[1][0], sides[1][1])
    assert abs((agree[0] == agree[1]).mean() - exact) < 0.09


def test_components(spark):
    rng = random.Random(8)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(500, 500)]
    cls = {x: x for pair in links for x in pair}

    def root(x):
        while cls[x] != x:
            x = cls[x]
        return x
    for a, b in links:
        cls[max(root(a), root(b))] = min(root(a), root(b))
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for x in cls if x in got}
    assert set(cls) - set(got) <= {a for a, b in links if a == b}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0

"""The conversation trie against a plain tree, over many shards and blocks, and on odd rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from procwatch.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def by_hand(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            half = [hashlib.md5(s.encode()).hexdigest() for s in (role, text)]
            own[conv].append(((turn is not None, turn or 0, hashlib.md5("".join(half).encode()).hexdigest()), (role, text)))
    own = {c: [said for _, said in sorted(v)] for c, v in own.items()}
    nodes, ends = defaultdict(list), defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        path = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            nodes[path[:d]].append(c)
        ends[path].append(c)
    children = defaultdict(list)
    for path in nodes:
        if path:
            children[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(nodes, key=len, reverse=True):
        last = len(path[-1][1].encode()) if path else 0
        saved[path] = (len(nodes[path]) - 1) * last + sum(saved[k] for k in children[path])
        leaves[path] = sum(leaves[k] for k in children[path]) or 1
    return sorted(((min(nodes[p]), len(p), min(nodes[p[:-1]]) if p else None, len(nodes[p]), len(children[p]), leaves[p],
                    saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
                   for p in nodes), key=str)


def found(df):
    return sorted((tuple(r) for r in df.select(*NAMES).collect()), key=str)


def invented(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        conv = i if i % 4 else i * 1_000_003
        for turn in range(rng.choice([1, 2, 5, 9, 14, 23])):
            said = "hello" if turn == 0 else f"{rng.choice('abö')}" * rng.choice([1, 2])
            rows.append((conv, turn * 3, "user" if turn % 2 == 0 else "assistant", said))
    return rows


@pytest.mark.parametrize("shard, block", [(640, 256), (7, 4), (1, 1), (50, 3)])
def test_like_a_tree(spark, monkeypatch, shard, block):
    monkeypatch.setattr(prefix_trie, "SHARD", shard)
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    rows = invented(90)
    random.Random(0).shuffle(rows)
    assert found(prefix_trie.build(spark.createDataFrame(rows, SCHEMA).repartition(5))) == by_hand(rows)


def test_equal_long_conversations(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SHARD", 16)
    rows = [(c, t, "user", f"turn {t}") for c in range(5, 60) for t in range(300)]
    rows += [(5, 300, "user", "é" * 100_000)]
    assert found(prefix_trie.build(spark.createDataFrame(rows, SCHEMA))) == by_hand(rows)


def test_odd_rows(spark):
    rows = [(None, 0, "user", "nobody"), (0, None, "user", "first"), (0, 1, None, None), (0, 1, None, None), (0, 0, "", ""),
            (3, 0, "user", "a"), (3, 0, "user", "b"), (4, 0, "user", "a"), (-7, 0, "user", "x"), (10 ** 15, 0, "u", "y")]
    table = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("no", "depth", "p", "k", "_idx", "shard")})
    # -7 - -7 % 5 is -5 in SQL, where the remainder has the sign of the number, and -10 in Python; neither is there
    assert found(prefix_trie.build(table)) == by_hand(rows)


def test_empty_table(spark):
    assert prefix_trie.build(spark.createDataFrame([], SCHEMA)).count() == 0
    assert prefix_trie.build(spark.createDataFrame([(None, 1, "user", "a")], SCHEMA)).count() == 0

"""Mixing against a plain loop, and on odd rows."""

import hashlib
import re

from pyspark.sql import functions as F

from procwatch.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def by_hand(rows):
    """Copies of each (doc_id, source) by the definition; ids are unique."""
    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows}
    sources = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[r[0]] for r in rows if r[2] == s) for s in sources}
    weight = {s: i % 3 + 1 for i, s in enumerate(sources)}
    target, open_ = {}, set(sources)
    while True:
        left = sum(total.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * total[s]}
        if not over:
            break
        target |= {s: 3 * total[s] for s in over}
        open_ -= over
    target |= share
    copies = []
    for s in sources:
        used = 0
        for r in sorted((r for r in rows if r[2] == s), key=lambda r: hashlib.md5(f"{r[0]}:7".encode()).hexdigest()):
            used += size[r[0]]
            if size[r[0]]:
                copies += [((e * total[s] + used) / target[s], s is None, s or "", used, r[0]) for e in range(3)]
    taken, spent = {r[0]: 0 for r in rows}, 0
    for *_, doc in sorted(copies):
        if spent + size[doc] > sum(total.values()):
            break
        spent += size[doc]
        taken[doc] += size[doc]
    return target, taken


def test_follows_the_definition(spark):
    rows = [(i, " ".join(["w"] * (i * 7 % 23)), None if i % 11 == 0 else f"s{i % 5 if i % 3 else 0}") for i in range(200)]
    target, taken = by_hand(rows)
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["doc_id"]: r["taken"] for r in got} == taken
    for r in got:
        assert abs(r["target"] - target[r["source"]]) < 1e-9 * max(1, r["target"])
        assert r["taken"] <= 3 * r["size"]


def test_sources_come_near_their_targets(spark):
    rows = [(i, "a b c", "big" if i % 3 else f"small{i % 7}") for i in range(600)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA))
    for r in got.groupBy("source", "target").agg(F.sum("taken").alias("taken")).collect():
        assert abs(r["taken"] - r["target"]) <= 3 * 3


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (None, "x y", "a"), (3, "x y", "a"), (3, "x y", "a"), (4, "z " * 20000, None)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("size", F.lit("own")).withColumn("taken", F.lit(1))
    got = mixing.mix(docs).collect()
    assert len(got) == 6
    assert {r["size"] for r in got if r["doc_id"] in (1, 2)} == {0}
    assert all(r["taken"] % max(r["size"], 1) == 0 for r in got)
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_empty_table(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    nothing = spark.createDataFrame([(1, None, "a"), (2, " ", None)], SCHEMA)
    assert [r["taken"] for r in mixing.mix(nothing).collect()] == [0, 0]


def test_rows_are_repeated_as_decided(spark):
    docs = spark.createDataFrame([(i, "a b", f"s{i % 2}") for i in range(50)], SCHEMA)
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect()}
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == {
        k: v for k, v in copies.items() if v}

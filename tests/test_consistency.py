"""Consistency proofs against mountain ranges built by hand."""

import hashlib

import pytest
from pyspark.sql import functions as F

from procwatch.operators import consistency


def _leaf(chain, i, version=0):
    return hashlib.sha256(f"{chain}/{i}/{version}".encode()).hexdigest()


def _frame(spark, sizes, changed=None):
    rows = [(c, 0, i, _leaf(c, i, int((c, i) in (changed or ())))) for c, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "chain string, level int, place long, hash string")


def _by_hand(chain, first, n):
    if n == 1:
        return _leaf(chain, first)
    half = n // 2
    return hashlib.sha256(("node:" + _by_hand(chain, first, half) + _by_hand(chain, first + half, half)).encode()).hexdigest()


SIZES = {"a": 1, "b": 2, "c": 7, "d": 8, "e": 21, "f": 64, None: 13}


@pytest.mark.parametrize("span", [2, 10])
def test_peaks_equal_those_by_hand(spark, span):
    kept = consistency.commitment(consistency.nodes(_frame(spark, SIZES), "chain", span), "chain")
    for row in kept.collect():
        n, at, want = SIZES[row["chain"]], 0, []
        for level in reversed(range(8)):
            if n >> level & 1:
                want.append((level, at >> level, _by_hand(row["chain"], at, 1 << level)))
                at += 1 << level
        assert row["n_segments"] == n and [tuple(p) for p in row["peaks"]] == want


def _check(spark, before, now, changed=()):
    old = consistency.commitment(consistency.nodes(_frame(spark, before), "chain", 3), "chain")
    later = consistency.nodes(_frame(spark, now, changed), "chain", 3)
    new = consistency.commitment(later, "chain")
    proofs = consistency.proof(later, old, new, "chain")
    return ({r["chain"]: r["consistent"] for r in consistency.check(old, new, proofs, "chain").collect()},
            {r["chain"]: len(r["siblings"]) for r in proofs.collect()})


def test_every_prefix_is_proven_in_logarithmic_size(spark):
    chains = {f"{n}-{m}": (n, m) for n in range(1, 18) for m in range(n, 35, 3)}
    said, sizes = _check(spark, {c: n for c, (n, _) in chains.items()}, {c: m for c, (_, m) in chains.items()})
    assert set(said) == set(chains) and all(said.values())
    assert max(sizes.values()) <= 2 * 6


def test_tampering_shows(spark):
    before = {"old": 11, "late": 11, "cut": 11, "gone": 4, "same": 11}
    now = {"old": 30, "late": 30, "cut": 10, "same": 11, "new": 3}
    said, _ = _check(spark, before, now, {("old", 6), ("late", 20)})
    # what came after the snapshot was never promised
    assert said == {"old": False, "late": True, "cut": False, "gone": False, "same": True, "new": True}


def test_any_changed_segment_of_the_snapshot_shows(spark):
    chains = {f"c{i}": i for i in range(13)}
    said, _ = _check(spark, dict.fromkeys(chains, 13), dict.fromkeys(chains, 22), {(c, i) for c, i in chains.items()})
    assert not any(said.values())


def test_forged_proofs_and_empty_logs(spark):
    assert not consistency.follows(2, [{"level": 1, "place": 0, "hash": "x"}], 4,
                                   [{"level": 2, "place": 0, "hash": "y"}], [])
    nothing = consistency.nodes(_frame(spark, {}), "chain")
    kept = consistency.commitment(nothing, "chain")
    assert kept.count() == 0
    assert consistency.check(kept, kept, consistency.proof(nothing, kept, kept, "chain"), "chain").count() == 0


def test_many_chains_cost_their_nodes_only(spark, monkeypatch):
    """no Python call for each chain; a chain that lacks a leaf lacks the node over it."""
    plans, real = [], consistency.materialize
    monkeypatch.setattr(consistency, "materialize", lambda df, label, *by: plans.append(
        df._jdf.queryExecution().toString()) or real(df, label, *by))
    leaves = spark.range(5_000).selectExpr("id AS chain", "explode(array(0L, 1L)) AS place").where(
        "NOT (chain % 1000 = 7 AND place = 0)").selectExpr(
        "chain", "0 AS level", "place", "sha2(concat(chain, '/', place), 256) AS hash")
    made = consistency.nodes(leaves, "chain")
    assert plans and not any("InPandas" in plan for plan in plans)
    above = made.where("level > 0")
    assert above.count() == 5_000 - 5
    one = above.where("chain = 5").first()
    halves = [hashlib.sha256(f"5/{i}".encode()).hexdigest() for i in (0, 1)]
    assert (one["level"], one["place"], one["hash"]) == (1, 0, hashlib.sha256(("node:" + "".join(halves)).encode()).hexdigest())


def test_chains_without_a_number(spark):
    rows = [(c, 0, i, _leaf(c, i)) for c in (float("nan"), None, 1.0) for i in range(5)]
    made = consistency.nodes(spark.createDataFrame(rows, "chain double, level int, place long, hash string"), "chain", 2)
    assert sorted((str(r["chain"]), r["n"]) for r in made.groupBy("chain").agg(F.count("hash").alias("n")).collect()) == [
        ("1.0", 8), ("None", 8), ("nan", 8)]

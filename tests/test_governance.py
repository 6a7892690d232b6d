"""Policy table, signatures, audit chain."""

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from procwatch.functions import policy
from procwatch.session import materialize
from procwatch.operators import audit, governance

# Cases of the policy that must come out as they do here.
CASES = [
    ("ph", "alarm", 0.40, ["agent.execute.ph"], "REQUIRE_ESIGN"),
    ("temp", "alarm", 0.50, ["agent.execute.temp"], "ALLOW"),
    ("temp", "trip", 0.50, ["agent.execute.temp"], "REQUIRE_ESIGN"),
    ("cond", "alarm", 0.91, ["agent.execute.cond"], "REQUIRE_ESIGN"),
    ("hum", "alarm", 0.80, ["agent.execute.hum"], "REQUIRE_ESIGN"),
    ("hum", "alarm", 0.79, ["agent.execute.hum"], "ALLOW"),
    ("temp", "alarm", 0.50, ["agent.execute.ph"], "DENY"),
]


@pytest.mark.parametrize("param,zone,p,roles,want", CASES)
def test_decision_table(spark, param, zone, p, roles, want):
    df = spark.createDataFrame([(param, zone, p, roles)],
                               "param string, zone string, p_breach double, roles array<string>")
    row = governance.decide(df).first()
    assert row["decision"] == want
    assert (row["reason"] == "RBAC denied: agent lacks the required execute role") == (want == "DENY")


def test_obligations_hold_even_when_denied(spark):
    df = spark.createDataFrame([("temp", "trip", 0.1, [])],
                               "param string, zone string, p_breach double, roles array<string>")
    row = governance.decide(df).first()
    assert row["decision"] == "DENY"
    assert row["obligations"] == ["log_worm", "qa_review_24h", "quarantine_review", "require_esign"]


def test_missing_inputs_fire_no_rule(spark):
    df = spark.createDataFrame([("temp", None, None, ["agent.execute.temp"]), ("temp", "trip", 0.9, None)],
                               "param string, zone string, p_breach double, roles array<string>")
    assert [r["decision"] for r in governance.decide(df.coalesce(1)).collect()] == ["ALLOW", "DENY"]


def test_role_subset(spark):
    df = spark.createDataFrame([(["a", "b"], ["a"]), (["a"], ["a", "c"])],
                               "roles array<string>, need array<string>")
    assert [r[0] for r in df.coalesce(1).select(policy.has_all_roles(F.col("need"))).collect()] == [True, False]


def _requests(spark, *rows):
    return spark.createDataFrame(
        [(e, s, "QA", r, dt.datetime(2024, 1, 1, 0, at), rej) for e, s, r, at, rej in rows],
        "event_id string, signer string, role string, reason string, signed_at timestamp, rejects boolean")


def test_signature_rules(spark):
    cards = spark.createDataFrame([("a", True), ("b", False), ("c", True), ("d", True)],
                                  "event_id string, requires_esign boolean")
    log, refused = governance.signature_log(_requests(
        spark, ("a", "X", "Approved", 0, False), ("a", " Valid Name ", "no", 1, False),
        ("a", " Valid Name ", " Approved within policy ", 2, False),
        ("a", "Later Name", "Approved again", 3, False),
        ("b", "Operator", "trace only", 0, False), ("c", "Q", "x", 0, True),
        ("zzz", "Valid Name", "Approved", 0, False)), cards)
    got = {r["event_id"]: r for r in log.collect()}
    assert set(got) == {"a", "b", "c"}
    assert got["a"]["signer"] == "Later Name" and got["a"]["how"] == "signed"
    assert got["b"]["how"] == "traceability" and got["b"]["committed"] is True
    assert (got["c"]["role"], got["c"]["committed"], got["c"]["how"]) == ("Rejected", False, "rejected")
    assert sorted((r["event_id"], r["refusal"]) for r in refused.collect()) == [
        ("a", "signer or reason too short"), ("a", "signer or reason too short"),
        ("zzz", "unknown event")]
    assert [r["event_id"] for r in governance.pending_signatures(cards, log).collect()] == ["d"]


@pytest.fixture(scope="module")
def log_rows(spark):
    rows = [(c, i, dt.datetime(2024, 1, 1, 0, 0, i % 60, 1000 * (i % 7)), "info", f"a{i % 3}",
             None if i % 4 == 0 else f"e{i}", f'{{"k": {i}}}')
            for c, n in (("hot", 250), ("cold", 3)) for i in range(n)]
    return spark.createDataFrame(rows, "chain string, id long, ts timestamp, level string, "
                                       "action string, event_id string, detail string").repartition(5)


def _loop(rows, segment_rows):
    out = {}
    for chain in {r["chain"] for r in rows}:
        part = sorted((r for r in rows if r["chain"] == chain), key=lambda r: r["id"])
        for i, r in enumerate(part):
            segment = i // segment_rows
            if i % segment_rows == 0:
                last = "GENESIS" if segment == 0 else f"GENESIS:{segment}"
            ts = r["ts"].strftime("%Y-%m-%d %H:%M:%S.%f").rstrip("0").rstrip(".") + "+00"
            text = last + ts + r["action"] + (r["event_id"] or "") + r["detail"]
            digest = hashlib.sha256(text.encode()).hexdigest()
            out[chain, r["id"]] = (last, digest)
            last = digest
    return out


@pytest.mark.parametrize("segment_rows", [1000, 40])
def test_chain_equals_loop(spark, log_rows, segment_rows):
    chained = audit.build_chain(log_rows, "chain", "id", segment_rows)
    got = {(r["chain"], r["id"]): (r["prev_hash"], r["row_hash"]) for r in chained.collect()}
    assert got == _loop(log_rows.collect(), segment_rows)
    clean = audit.verify_chain(chained, "chain", "id")
    assert {r["n_broken"] for r in clean.collect()} == {0}


def test_tampering_shows(spark, log_rows):
    chained = audit.build_chain(log_rows, "chain", "id", 40)
    changed = chained.withColumn("detail", F.when((F.col("chain") == "hot") & (F.col("id") == 77), "{}")
                                 .otherwise(F.col("detail")))
    got = {r["chain"]: r for r in audit.verify_chain(changed, "chain", "id").collect()}
    assert (got["hot"]["n_broken"], got["hot"]["first_broken"]) == (1, 77)
    assert got["cold"]["n_broken"] == 0
    cut = audit.verify_chain(chained.where("NOT (chain = 'hot' AND id = 10)"), "chain", "id")
    assert {r["chain"]: r["first_broken"] for r in cut.collect()}["hot"] == 11


def test_later_hashes_depend_on_earlier_rows(spark, log_rows):
    one = audit.build_chain(log_rows, "chain", "id")
    two = audit.build_chain(log_rows.withColumn("detail", F.when(F.col("id") == 0, "{}").otherwise(
        F.col("detail"))), "chain", "id")
    assert one.select("row_hash").intersect(two.select("row_hash")).count() == 0


def test_segments_are_anchored(spark, log_rows):
    chained = audit.build_chain(log_rows, "chain", "id", 40)
    anchors = audit.anchor_segments(chained, "chain", "id")
    assert anchors.where("chain = 'hot'").count() == 7
    tails = {(r["chain"], r["segment"]): r["row_hash"] for r in chained.orderBy("id").collect()}
    assert all(r["detail"].split(":")[1] == tails[r["chain"], r["of_segment"]] for r in anchors.collect())
    assert {r["n_broken"] for r in audit.verify_chain(anchors, "chain", "of_segment").collect()} == {0}


@pytest.mark.parametrize("kept,wrong,first", [
    ("true", 0, None), ("segment <> 2", 1, 2), ("id < 247", 1, 6), ("NOT (segment = 1 AND id >= 77)", 1, 1),
    ("chain = 'cold' OR id >= 240", 6, 0), ("chain = 'cold'", 7, 0)])
def test_deleted_rows_show_against_anchors(spark, log_rows, kept, wrong, first):
    chained = audit.build_chain(log_rows, "chain", "id", 40)
    anchors = audit.anchor_segments(chained, "chain", "id")
    got = {r["chain"]: r for r in audit.verify_chain(chained.where(kept), "chain", "id", anchors).collect()}
    assert (got["hot"]["n_wrong_segments"], got["hot"]["first_wrong_segment"]) == (wrong, first)
    assert got["cold"]["n_wrong_segments"] == 0
    forged = anchors.withColumn("detail", F.when(F.col("of_segment") == 3, "40:x").otherwise(F.col("detail")))
    assert {r["chain"]: r["n_wrong_segments"] for r in audit.verify_chain(
        chained, "chain", "id", forged).collect()}["hot"] == 1


@pytest.mark.parametrize("cuts", [[100], [40, 80], [1, 2, 3, 249], [0]])
def test_appending_equals_building_at_once(spark, log_rows, cuts):
    want = {(r["chain"], r["id"]): r["row_hash"] for r in audit.build_chain(log_rows, "chain", "id", 40).collect()}
    stored = None
    for low, high in zip([-1, *cuts], [*cuts, 10 ** 6]):
        part = log_rows.where((F.col("id") > low) & (F.col("id") <= high))
        heads = None if stored is None else audit.heads(stored, "chain", "id")
        new = materialize(audit.build_chain(part, "chain", "id", 40, heads), "log")
        stored = new if stored is None else stored.unionByName(new)
    assert {(r["chain"], r["id"]): r["row_hash"] for r in stored.collect()} == want


def test_policy_over_the_whole_grid(spark):
    """Every parameter, zone, probability and role against the rule in words."""
    params, zones = ["temp", "ph", "press", "cond", "hum"], ["control", "alarm", "trip"]
    rows = [(p, z, x, r, [f"agent.execute.{r}"] if r else ["rag.read"]) for p in params for z in zones
            for x in (0.0, 0.7999, 0.8, 1.0) for r in [*params, None]]
    events = spark.createDataFrame(rows, "param string, zone string, p_breach double, role string, roles array<string>")
    for r in governance.decide(events).collect():
        signature = r["param"] == "ph" or r["zone"] == "trip" or r["p_breach"] >= 0.8
        want = "DENY" if r["role"] != r["param"] else "REQUIRE_ESIGN" if signature else "ALLOW"
        assert r["decision"] == want, r


def test_an_event_goes_to_its_own_actor(spark):
    events = spark.createDataFrame([("e1", "ph", "a"), ("e2", "ph", "b"), ("e3", "temp", "a"), ("e4", "ph", None)],
                                   "event_id string, param string, actor string")
    roles = spark.createDataFrame([(f"x{i}", "agent.execute.ph") for i in range(50)] + [
        ("a", "agent.execute.ph"), ("a", "agent.execute.ph"), ("b", "rag.read")], "actor string, role string")
    assert [r["event_id"] for r in governance.route(events, roles).collect()] == ["e1"]

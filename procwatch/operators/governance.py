"""Routing, decisions, signatures and the escalation queue, many events at a time."""

from pyspark.sql import DataFrame, functions as F

from procwatch.functions import policy
from procwatch.operators import latest


def decide(events: DataFrame) -> DataFrame:
    """Add decision, reason and obligations to events that carry `roles`."""
    return events.withColumns({"decision": policy.decision(), "reason": policy.reason(),
                               "obligations": policy.obligations()})


def route(events: DataFrame, roles: DataFrame) -> DataFrame:
    """Events whose assigned `actor` may execute for their parameter; others are left out.

    `roles` has one row per (actor, role) and the role names the parameter: a semi-join
    on both, so an event stays one row however many actors hold the role.
    """
    agents = (roles.where(F.col("role").startswith("agent.execute."))
              .select("actor", F.substring_index("role", ".", -1).alias("param")))
    return events.join(agents, ["actor", "param"], "left_semi")


def attach_roles(requests: DataFrame, roles: DataFrame) -> DataFrame:
    """Add the role array of each request's `actor`; no roles gives an empty array."""
    sets = roles.groupBy("actor").agg(F.array_sort(F.collect_set("role")).alias("roles"))
    return (requests.join(sets, "actor", "left")
            .withColumn("roles", F.coalesce("roles", F.array().cast("array<string>"))))


def events_without_card(events: DataFrame, cards: DataFrame) -> DataFrame:
    return events.join(cards.select("event_id"), "event_id", "left_anti")


def card_with_signature(cards: DataFrame, signatures: DataFrame) -> DataFrame:
    return cards.join(signatures, "event_id", "left")


def pending_signatures(cards: DataFrame, signatures: DataFrame) -> DataFrame:
    """Cards that need a signature and have been neither signed nor rejected."""
    return cards.where("requires_esign").join(
        signatures.select("event_id"), "event_id", "left_anti")


def signature_log(requests: DataFrame, cards: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(signatures, refused requests) from requests
    (event_id, signer, role, reason, signed_at, rejects).

    A rejection is taken as given. A signature needs a signer and a reason, both
    trimmed. Requests for an unknown event are refused. The last accepted request of
    an event wins; `how` tells a signature the policy demanded from one kept for
    traceability.
    """
    known = requests.join(cards.select("event_id", "requires_esign"), "event_id", "left")
    ok = policy.signature_valid(F.col("signer"), F.col("reason"))
    judged = known.withColumn("refusal", F.when(F.col("requires_esign").isNull(), "unknown event")
                              .when(~F.col("rejects") & ~ok, "signer or reason too short"))
    accepted = judged.where(F.col("refusal").isNull())
    signed = accepted.select(
        "event_id",
        F.when(F.col("rejects"), F.col("signer")).otherwise(F.trim("signer")).alias("signer"),
        F.when(F.col("rejects"), "Rejected").otherwise(F.col("role")).alias("role"),
        F.when(F.col("rejects"), F.col("reason")).otherwise(F.trim("reason")).alias("reason"),
        "signed_at", (~F.col("rejects")).alias("committed"),
        F.when(F.col("rejects"), "rejected").when(F.col("requires_esign"), "signed")
        .otherwise("traceability").alias("how"))
    log = latest.last_by_key(signed, ["event_id"],
                             [F.desc("signed_at"), F.desc("signer"), F.desc("reason")])
    return log, judged.where(F.col("refusal").isNotNull()).select(*requests.columns, "refusal")


def governed_events(events: DataFrame, scores: DataFrame, decisions: DataFrame) -> DataFrame:
    """Events with their scores and policy decisions, all keyed by event_id."""
    return events.join(scores, "event_id").join(decisions, "event_id")

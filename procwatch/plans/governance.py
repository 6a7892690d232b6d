"""Registered queries over policy, signatures and the audit log."""

from pyspark.sql import functions as F

from procwatch.functions import policy
from procwatch.operators import audit, consistency, governance
from procwatch.plans import inputs, signals, sql
from procwatch.session import materialize

ACTORS = 5


def _roles(spark, sf_dir):
    """Five actors named after the first customers' remainder classes; each holds one
    parameter's role, but the fourth holds the role of the fifth."""
    agents = F.element_at(F.array(*[F.lit(p) for p in ("temp", "ph", "press", "hum", "hum")]),
                          (F.col("k") + 1).cast("int"))
    k = (inputs.table(spark, sf_dir, "customer")
         .select((F.col("c_custkey") % ACTORS).alias("k")).distinct())
    execute = k.select("k", F.concat(F.lit("agent.execute."), agents).alias("role"))
    read = k.select("k", F.lit("rag.read").alias("role"))
    return execute.unionByName(read).select(
        F.concat(F.lit("actor-"), F.col("k").cast("string")).alias("actor"), "role")


def _actor():
    """The agent asked to act: the one of the event's parameter."""
    spots = F.create_map(*[F.lit(x) for pair in zip(
        ("temp", "ph", "press", "cond", "hum"), range(ACTORS)) for x in pair])
    return F.concat(F.lit("actor-"), F.element_at(spots, F.col("param")).cast("string"))


def _requests(spark, sf_dir):
    events = signals.events(spark, sf_dir).withColumn("actor", _actor())
    return governance.attach_roles(events, _roles(spark, sf_dir))


def _decided(spark, sf_dir):
    return governance.decide(_requests(spark, sf_dir))


def policy_decision(spark, sf_dir):
    return _decided(spark, sf_dir).select("event_id", "decision")


def policy_reason(spark, sf_dir):
    return _decided(spark, sf_dir).select("event_id", "reason")


def policy_obligations(spark, sf_dir):
    return _decided(spark, sf_dir).select(
        "event_id", F.concat_ws(",", "obligations").alias("obligations"))


def rbac_route(spark, sf_dir):
    assigned = signals.events(spark, sf_dir).withColumn("actor", _actor())
    return governance.route(assigned, _roles(spark, sf_dir)).select("event_id", "actor")


def _cards(spark, sf_dir):
    """A card for every event that is not a mere control-zone warning."""
    return (signals.events(spark, sf_dir).where(F.col("zone_worst") != "control")
            .select("event_id", "param", "asset", "zone", "window_start",
                    policy.esign_required().alias("requires_esign"),
                    policy.card_reason().alias("esign_reason")))


def _sign_requests(spark, sf_dir):
    """One request per (event window, hour of day class), some of them faulty, and one
    per order for an event nobody knows."""
    events = signals.events(spark, sf_dir)
    slot = (F.floor(F.unix_timestamp("window_start") / 3600) % 7).cast("int")
    ours = events.withColumn("slot", slot).where("slot <> 0").select(
        "event_id",
        F.when(F.col("slot") == 1, " X ").otherwise(F.concat(F.lit(" Reviewer "), "batch_id"))
        .alias("signer"),
        F.lit("QA").alias("role"),
        F.when(F.col("slot") == 2, " no ").otherwise(F.lit(" Approved within policy "))
        .alias("reason"),
        F.col("window_start").alias("signed_at"), (F.col("slot") == 3).alias("rejects"))
    unknown = inputs.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("evt-none-"), F.col("o_orderkey").cast("string")).alias("event_id"),
        F.concat(F.lit("Clerk "), F.col("o_custkey").cast("string")).alias("signer"),
        F.lit("QA").alias("role"), F.col("o_orderpriority").alias("reason"),
        F.col("o_orderdate").cast("timestamp").alias("signed_at"), F.lit(False).alias("rejects"))
    return ours.unionByName(unknown)


def _signature_tables(spark, sf_dir):
    return governance.signature_log(_sign_requests(spark, sf_dir), _cards(spark, sf_dir))


def signature_validate(spark, sf_dir):
    ok = policy.signature_valid(F.col("signer"), F.col("reason"))
    return _sign_requests(spark, sf_dir).groupBy(ok.cast("int").alias("valid")).agg(
        F.count(F.lit(1)).alias("requests"))


def signature_known_event(spark, sf_dir):
    requests, cards = _sign_requests(spark, sf_dir), _cards(spark, sf_dir)
    return requests.join(cards.select("event_id"), "event_id", "left_semi").select(
        "event_id", F.trim("signer").alias("signer"))


def signature_log(spark, sf_dir):
    log, _ = _signature_tables(spark, sf_dir)
    return log.select("event_id", "signer", "role", "reason",
                      F.unix_timestamp("signed_at").alias("signed_at"),
                      F.col("committed").cast("int").alias("committed"), "how")


def signature_refusals(spark, sf_dir):
    _, refused = _signature_tables(spark, sf_dir)
    return refused.groupBy("refusal").agg(F.count(F.lit(1)).alias("requests"))


def events_without_card(spark, sf_dir):
    return governance.events_without_card(
        signals.events(spark, sf_dir), _cards(spark, sf_dir)).select("event_id", "zone_worst")


def card_with_signature(spark, sf_dir):
    log, _ = _signature_tables(spark, sf_dir)
    joined = governance.card_with_signature(
        _cards(spark, sf_dir), log.select("event_id", "signer", "committed"))
    return joined.select("event_id", "esign_reason", "signer",
                         F.col("committed").cast("int").alias("committed"))


def pending_signatures(spark, sf_dir):
    log, _ = _signature_tables(spark, sf_dir)
    return governance.pending_signatures(_cards(spark, sf_dir), log).select(
        "event_id", "esign_reason")


def governed_events(spark, sf_dir):
    events = signals.events(spark, sf_dir)
    scores = events.select("event_id", "p_breach", "top_driver")
    decisions = _decided(spark, sf_dir).select("event_id", "decision", "reason")
    return governance.governed_events(events.select("event_id", "param", "zone"),
                                      scores, decisions)


def _audit_rows(spark, sf_dir):
    return inputs.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("chain"), F.col("event_id").alias("id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_type") == "error", "warn").otherwise("info").alias("level"),
        F.col("event_type").alias("action"),
        F.concat(F.lit("evt-"), F.col("event_id").cast("string")).alias("event_id"),
        F.col("props").alias("detail"))


SEGMENT = 7  # small, so that the checked chains have many segments


def _chained(spark, sf_dir):
    return audit.build_chain(_audit_rows(spark, sf_dir), "chain", "id", SEGMENT)


def audit_chain(spark, sf_dir):
    return _chained(spark, sf_dir).select("chain", "id", "prev_hash", "row_hash")


def audit_append(spark, sf_dir):
    """The first half of the log stored, then continued by the rest: the same chains."""
    rows = _audit_rows(spark, sf_dir)
    middle = rows.agg(F.floor(F.avg("id"))).first()[0]
    stored = materialize(audit.build_chain(rows.where(F.col("id") <= middle), "chain", "id", SEGMENT), "log")
    later = audit.build_chain(rows.where(F.col("id") > middle), "chain", "id", SEGMENT,
                              audit.heads(stored, "chain", "id"))
    return stored.unionByName(later).select("chain", "id", "prev_hash", "row_hash")


def audit_deleted_segment(spark, sf_dir):
    """The second segment of every chain, and the last row of every third chain, deleted."""
    chained = materialize(_chained(spark, sf_dir), "log")
    anchors = audit.anchor_segments(chained, "chain", "id", SEGMENT)
    tails = chained.groupBy("chain").agg(F.max("id").alias("tail")).where("chain % 3 = 0")
    kept = (chained.where("segment <> 1").join(tails, "chain", "left")
            .where("tail IS NULL OR id <> tail").drop("tail"))
    return audit.verify_chain(kept, "chain", "id", anchors)


def _tampered(chained):
    """Every 97th row's detail changed after the fact."""
    return chained.withColumn("detail", F.when(F.col("id") % 97 == 0, F.lit("{}"))
                              .otherwise(F.col("detail")))


def audit_verify(spark, sf_dir):
    return audit.verify_chain(_tampered(_chained(spark, sf_dir)), "chain", "id")


def audit_append_only(spark, sf_dir):
    before = _chained(spark, sf_dir)
    now = before.withColumn("row_hash", F.when(F.col("id") % 89 == 0, F.sha2("row_hash", 256))
                            .otherwise(F.col("row_hash")))
    again = before.where(F.col("id") % 101 == 0)
    return audit.rewritten_rows(before, now.unionByName(again), ["chain", "id"])


def audit_consistency(spark, sf_dir):
    """The peaks of the log's first half against the whole log; every second chain was rewritten
    since, from its first row on, with hashes that are right."""
    rows = _audit_rows(spark, sf_dir)
    middle = rows.agg(F.floor(F.avg("id"))).first()[0]
    first = rows.groupBy("chain").agg(F.min("id").alias("_first"))
    forged = rows.join(first, "chain").withColumn("detail", F.when(
        (F.col("chain") % 2 == 1) & (F.col("id") == F.col("_first")), F.lit('{"forged": 1}'))
        .otherwise(F.col("detail"))).drop("_first")

    def grown(log):
        chained = audit.build_chain(log, "chain", "id", SEGMENT)
        return consistency.nodes(consistency.segment_leaves(chained, "chain", "id", SEGMENT), "chain")

    before = materialize(consistency.commitment(grown(rows.where(F.col("id") <= middle)), "chain"), "commitment")
    later = grown(forged)
    now = materialize(consistency.commitment(later, "chain"), "commitment")
    return consistency.check(before, now, consistency.proof(later, before, now, "chain"), "chain").withColumn(
        "consistent", F.col("consistent").cast("int"))


def audit_summary(spark, sf_dir):
    return audit.summary(_audit_rows(spark, sf_dir))


QUERIES = {f.__name__: f for f in (
    policy_decision, policy_reason, policy_obligations, rbac_route, signature_validate,
    signature_known_event, signature_log, signature_refusals, events_without_card,
    card_with_signature, pending_signatures, governed_events, audit_chain, audit_append,
    audit_verify, audit_deleted_segment, audit_append_only, audit_consistency, audit_summary)}

_DECIDE = """,
held AS (SELECT * FROM (VALUES ('temp', 'temp'), ('ph', 'ph'), ('press', 'press'),
                               ('cond', 'hum'), ('hum', 'hum')) t(param, role_param)),
d AS (SELECT ev.*, h.role_param = ev.param AS has_role,
             ev.param = 'ph' OR zone = 'trip' OR p_breach >= 0.80::DOUBLE AS esign
      FROM ev JOIN held h USING (param))
"""
_DECISION = "CASE WHEN NOT has_role THEN 'DENY' WHEN esign THEN 'REQUIRE_ESIGN' ELSE 'ALLOW' END"
_REASON = """CASE WHEN NOT has_role THEN 'RBAC denied: agent lacks the required execute role'
     WHEN param = 'ph' THEN 'SOP-PH-009: all pH setpoint changes require QA e-signature'
     WHEN zone = 'trip' THEN 'Trip-zone excursion — QA review obligation'
     WHEN p_breach >= 0.80::DOUBLE THEN 'High predicted breach probability (>= 0.80)'
     ELSE 'Micro-adjustment within policy' END"""
_CARDS = """,
cards AS (SELECT event_id, zone, window_start, param = 'ph' OR zone = 'trip' OR p_breach >= 0.80::DOUBLE AS requires_esign,
      CASE WHEN param = 'ph' THEN 'SOP-PH-009: all pH setpoint changes require QA e-signature'
           WHEN zone = 'trip' THEN 'Trip-zone excursion — QA review obligation'
           WHEN p_breach >= 0.80::DOUBLE THEN 'High predicted breach probability (>=0.80)'
           ELSE 'Micro-adjustment within policy — operator signature captured for traceability' END AS esign_reason
      FROM ev WHERE zone_worst <> 'control'),
req AS (SELECT event_id, CASE WHEN slot = 1 THEN 'X' ELSE 'Reviewer ' || batch_id END AS signer,
               CASE WHEN slot = 1 THEN ' X ' ELSE ' Reviewer ' || batch_id END AS raw_signer,
               CASE WHEN slot = 2 THEN 'no' ELSE 'Approved within policy' END AS reason,
               window_start AS signed_at, slot = 3 AS rejects
        FROM (SELECT *, (window_start // 3600) % 7 AS slot FROM ev) WHERE slot <> 0
        UNION ALL
        SELECT 'evt-none-' || o_orderkey, 'Clerk ' || o_custkey, 'Clerk ' || o_custkey,
               o_orderpriority, CAST(epoch(o_orderdate) AS BIGINT), false FROM orders),
sig AS (SELECT req.event_id, CASE WHEN rejects THEN raw_signer ELSE signer END AS signer,
               CASE WHEN rejects THEN 'Rejected' ELSE 'QA' END AS role,
               CASE WHEN rejects THEN ' Approved within policy ' ELSE reason END AS reason, signed_at,
               CASE WHEN rejects THEN 0 ELSE 1 END AS committed,
               CASE WHEN rejects THEN 'rejected' WHEN requires_esign THEN 'signed'
                    ELSE 'traceability' END AS how
        FROM req JOIN cards USING (event_id)
        WHERE rejects OR (length(signer) >= 3 AND length(reason) >= 4))
"""
_CHAIN = """
    WITH RECURSIVE r AS (
      SELECT user_id AS chain, event_id AS id,
             row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n,
             CAST(ts AS VARCHAR) || '+00' || event_type || 'evt-' || event_id || props AS text
      FROM events),
    m AS (SELECT *, CASE WHEN n < 7 THEN 'GENESIS' ELSE 'GENESIS:' || (n // 7) END AS mark FROM r),
    c AS (SELECT chain, id, n, mark AS prev_hash, sha256(mark || text) AS row_hash FROM m WHERE n % 7 = 0
          UNION ALL
          SELECT m.chain, m.id, m.n, c.row_hash, sha256(c.row_hash || m.text)
          FROM c JOIN m ON m.chain = c.chain AND m.n = c.n + 1 AND m.n % 7 <> 0)
    SELECT chain, id, prev_hash, row_hash FROM c"""
ORACLES = {
    "policy_decision": sql.with_events(_DECIDE + f"SELECT event_id, {_DECISION} AS decision FROM d"),
    "policy_reason": sql.with_events(_DECIDE + f"SELECT event_id, {_REASON} AS reason FROM d"),
    "policy_obligations": sql.with_events(_DECIDE + """
        SELECT event_id, 'log_worm' || CASE WHEN esign THEN ',qa_review_24h' ELSE '' END
            || CASE WHEN zone = 'trip' THEN ',quarantine_review' ELSE '' END
            || CASE WHEN esign THEN ',require_esign' ELSE '' END AS obligations FROM d"""),
    "rbac_route": sql.with_events("""
        , a AS (SELECT * FROM (VALUES ('actor-0', 'temp'), ('actor-1', 'ph'), ('actor-2', 'press'),
                                      ('actor-4', 'hum')) t(actor, param))
        SELECT event_id, actor FROM ev JOIN a USING (param)"""),
    "signature_validate": sql.with_events(_CARDS + """
        SELECT CASE WHEN length(signer) >= 3 AND length(reason) >= 4 THEN 1 ELSE 0 END AS valid,
               count(*) AS requests FROM req GROUP BY 1"""),
    "signature_known_event": sql.with_events(
        _CARDS + "SELECT event_id, signer FROM req WHERE event_id IN (SELECT event_id FROM cards)"),
    "signature_log": sql.with_events(_CARDS + "SELECT * FROM sig"),
    "signature_refusals": sql.with_events(_CARDS + """
        SELECT CASE WHEN c.event_id IS NULL THEN 'unknown event' ELSE 'signer or reason too short' END
               AS refusal, count(*) AS requests
        FROM req LEFT JOIN cards c USING (event_id)
        WHERE c.event_id IS NULL OR (NOT rejects AND (length(signer) < 3 OR length(reason) < 4))
        GROUP BY 1"""),
    "events_without_card": sql.with_events(
        _CARDS + "SELECT event_id, zone_worst FROM ev WHERE event_id NOT IN (SELECT event_id FROM cards)"),
    "card_with_signature": sql.with_events(
        _CARDS + "SELECT event_id, esign_reason, signer, committed FROM cards LEFT JOIN sig USING (event_id)"),
    "pending_signatures": sql.with_events(_CARDS + """
        SELECT event_id, esign_reason FROM cards
        WHERE requires_esign AND event_id NOT IN (SELECT event_id FROM sig)"""),
    "governed_events": sql.with_events(_DECIDE + f"""
        SELECT event_id, param, zone, p_breach, top_driver, {_DECISION} AS decision, {_REASON} AS reason
        FROM d"""),
    "audit_chain": _CHAIN,
    "audit_append": _CHAIN,
    "audit_deleted_segment": """
        WITH r AS (SELECT user_id AS chain, event_id AS id,
                          (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 7 AS segment,
                          row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS back FROM events),
        k AS (SELECT * FROM r WHERE segment <> 1 AND NOT (chain % 3 = 0 AND back = 1)),
        s AS (SELECT chain, segment, count(*) AS was FROM r GROUP BY ALL),
        n AS (SELECT chain, segment, count(*) AS is_ FROM k GROUP BY ALL),
        w AS (SELECT s.chain, s.segment, coalesce(is_, 0) <> was AS wrong
              FROM s LEFT JOIN n ON s.chain = n.chain AND s.segment = n.segment)
        SELECT w.chain, any_value(coalesce(c.n, 0)) AS n_rows, 0 AS n_broken, CAST(NULL AS BIGINT) AS first_broken,
               count(*) FILTER (wrong) AS n_wrong_segments, min(CASE WHEN wrong THEN segment END) AS first_wrong_segment
        FROM w LEFT JOIN (SELECT chain, count(*) AS n FROM k GROUP BY chain) c ON c.chain = w.chain
        GROUP BY w.chain""",
    "audit_verify": """
        SELECT user_id AS chain, count(*) AS n_rows,
               count(*) FILTER (event_id % 97 = 0 AND props <> '{}') AS n_broken,
               min(CASE WHEN event_id % 97 = 0 AND props <> '{}' THEN event_id END) AS first_broken
        FROM events GROUP BY user_id""",
    "audit_append_only": """
        SELECT user_id AS chain, event_id AS id, 'changed or missing' AS problem FROM events
        WHERE event_id % 89 = 0 AND event_id % 101 <> 0
        UNION ALL
        SELECT user_id, event_id, 'duplicate' FROM events WHERE event_id % 101 = 0""",
    "audit_consistency": """
        WITH r AS (SELECT user_id AS chain, event_id <= (SELECT floor(avg(event_id)) FROM events) AS early FROM events),
        n AS (SELECT chain, count(*) FILTER (early) // 7 AS n_before, count(*) // 7 AS n_now FROM r GROUP BY chain)
        SELECT chain, n_before, n_now, CASE WHEN chain % 2 = 1 AND n_before > 0 THEN 0 ELSE 1 END AS consistent
        FROM n WHERE n_now > 0""",
    "audit_summary": """
        SELECT CASE WHEN event_type = 'error' THEN 'warn' ELSE 'info' END AS level,
               event_type AS action, count(*) AS n_rows FROM events GROUP BY ALL""",
}

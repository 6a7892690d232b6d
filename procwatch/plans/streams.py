"""Registered queries that run a stream over files written from a given table, to its end."""

import time
import uuid
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from procwatch.functions import bands
from procwatch.operators import audit
from procwatch.plans import inputs, learning, signals, sql
from procwatch.plans.signals import CHECK_WINDOW, NUDGE
from procwatch.session import file_system, session_dir
from procwatch.sources import tables, telemetry
from procwatch.streaming import breaches, keyed

TO_THE_END = {"availableNow": True}
FILE_ROWS = 50_000  # of a file of readings that arrive


def _sent(spark, sf_dir):
    """A folder of JSON lines: one record per reading; every 13th is cut short."""
    folder = f"{session_dir(spark)}/stream-{uuid.uuid4().hex}"
    readings = inputs.telemetry_with_features(spark, sf_dir)
    text = F.to_json(F.struct("param", "asset", "value", "unit", "zone", "batch_id",
                              F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'+00:00'").alias("ts"), "features"))
    (readings.select(F.when(F.col("event_id") % 13 == 0, F.substring(text, 1, 25)).otherwise(text)
                     .alias("value")).write.text(f"{folder}/in"))
    return folder


def _run(spark, sf_dir):
    """The breach query over all files; windows are closed as far as the newest reading allows."""
    folder = _sent(spark, sf_dir)
    raw = telemetry.json_file_stream(spark, f"{folder}/in")
    breaches.start(telemetry.telemetry_stream(raw), bands.dimension(spark), f"{folder}/out", f"{folder}/check",
                   size=CHECK_WINDOW, trigger=TO_THE_END).awaitTermination()
    return folder


def stream_breach(spark, sf_dir):
    events = spark.read.parquet(f"{_run(spark, sf_dir)}/out/breach_events")
    return events.select("event_id", "param", "n_rows", "zone", F.round(F.col("v_avg") + F.lit(NUDGE), 3).alias("v_avg"))


def stream_audit(spark, sf_dir):
    """The chained audit rows of the stream, verified."""
    log = spark.read.parquet(f"{_run(spark, sf_dir)}/out/audit").drop(tables.BATCH)
    return audit.verify_chain(log, "chain", "ts").select(F.col("chain").alias("param"), "n_rows", "n_broken")


def stream_quarantine(spark, sf_dir):
    """What the stream sets aside, counted."""
    folder = _sent(spark, sf_dir)
    breaches.start_quarantine(telemetry.json_file_stream(spark, f"{folder}/in"), f"{folder}/bad",
                              f"{folder}/check", trigger=TO_THE_END).awaitTermination()
    return breaches.quarantined(spark, f"{folder}/bad")


def live_view(spark, sf_dir):
    """The latest readings of each parameter, kept file by file."""
    folder = _sent(spark, sf_dir)
    raw = telemetry.json_file_stream(spark, f"{folder}/in", files_per_batch=1)
    (telemetry.telemetry_stream(raw).writeStream.foreachBatch(breaches.live_view(f"{folder}/view"))
     .option("checkpointLocation", f"{folder}/check").trigger(**TO_THE_END).start().awaitTermination())
    view = breaches.read_live_view(spark, f"{folder}/view")
    return view.select("param", F.unix_millis("ts").alias("ts_ms"), F.round(F.col("value") + F.lit(NUDGE), 6).alias("value"))


def keyed_records(spark, sf_dir):
    """Readings as keyed records for a topic, read back: one key stays one parameter."""
    folder = f"{session_dir(spark)}/records-{uuid.uuid4().hex}"
    readings = inputs.telemetry(spark, sf_dir).select("param", "batch_id", "event_id")
    telemetry.to_keyed_json(readings).write.json(folder)
    back = spark.read.schema("key string, value string").json(folder)
    parsed = telemetry.parse_json(back, "value", readings.schema)
    return parsed.select("key", "param", "batch_id", "event_id")


def two_topics(spark, sf_dir):
    """Readings and breach events as records of two topics, consumed by one stream: what is kept of each."""
    folder = f"{session_dir(spark)}/topics-{uuid.uuid4().hex}"
    events = signals.events(spark, sf_dir).select(F.to_json(F.struct("event_id", "param", "v_avg")).alias("value"))
    spark.read.text(f"{_sent(spark, sf_dir)}/in").write.text(f"{folder}/in/topic=scada.telemetry")
    events.write.text(f"{folder}/in/topic=pdm.breaches")
    raw = spark.readStream.schema("value string, topic string").format("text").load(f"{folder}/in")
    (raw.writeStream.foreachBatch(breaches.consume(f"{folder}/out", bands.dimension(spark)))
     .option("checkpointLocation", f"{folder}/check").trigger(**TO_THE_END).start().awaitTermination())
    view = breaches.read_live_view(spark, f"{folder}/out/live")
    kept = spark.read.parquet(f"{folder}/out/events")
    bad = spark.read.parquet(f"{folder}/out/quarantine")
    log = spark.read.parquet(f"{folder}/out/audit")
    broken = audit.verify_chain(log, "chain", "ts").where("n_broken > 0")
    counts = [view.groupBy("param").agg(F.count(F.lit(1)).alias("n")).withColumn("of", F.lit("view")),
              kept.groupBy("param").agg(F.count(F.lit(1)).alias("n")).withColumn("of", F.lit("events")),
              bad.groupBy(F.col("of").alias("param")).agg(F.count(F.lit(1)).alias("n")).withColumn("of", F.lit("quarantine")),
              broken.agg(F.lit("all").alias("param"), F.count(F.lit(1)).alias("n")).withColumn("of", F.lit("broken"))]
    return reduce(DataFrame.unionByName, counts)


def _in_order(spark, rows, order, at=()):
    """`rows` as files of JSON lines that arrive in order of the columns `order`; their folder and fields.

    Ranges of the order are sorted and cut into files of at most `FILE_ROWS` rows, five files at least.
    A stream takes files by their time, a limited number at a time, so each gets a time of its own: no
    reading arrives before one that it follows, and a micro-batch is bounded, however many there are.
    Columns `at` are for the order only.
    """
    folder = f"{session_dir(spark)}/arriving-{uuid.uuid4().hex}"
    limit = max(1, min(FILE_ROWS, rows.count() // 5))
    (rows.repartitionByRange(*order).sortWithinPartitions(*order).drop(*at)
     .write.option("maxRecordsPerFile", limit).json(f"{folder}/in"))
    files, path = file_system(spark, f"{folder}/in")
    arriving = sorted((f.getPath() for f in files.globStatus(path.suffix("/part-*"))), key=lambda p: p.getName())
    start = int(time.time() * 1000) - 1000 * len(arriving)
    for i, one in enumerate(arriving):
        files.setTimes(one, start + 1000 * i, -1)
    return folder, rows.drop(*at).schema


def _closed(spark, folder):
    """Readings in the windows stored so far."""
    files, path = file_system(spark, f"{folder}/out/windows")
    if not files.exists(path) or not files.globStatus(path.suffix("/*/_SUCCESS")):
        return 0
    return spark.read.parquet(f"{folder}/out/windows").agg(F.sum("n_rows")).first()[0] or 0


def stream_idle(spark, sf_dir):
    """Windows of parameters one of which lags a day behind the others, which fall silent meanwhile.

    None of its readings is late, and the silent ones do not hold their last windows open.
    """
    readings = inputs.telemetry(spark, sf_dir).select("param", "ts", "value", "asset", "batch_id", "zone")
    lag = F.when(F.col("param") == "hum", 86_400_000_000).otherwise(0)
    folder, schema = _in_order(spark, readings.withColumn("at", F.unix_micros("ts") + lag), ["at"], ["at"])
    n_rows = readings.where("ts IS NOT NULL").count()
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).json(f"{folder}/in")
    query = keyed.start(arriving, bands.dimension(spark), f"{folder}/out", f"{folder}/check", size=CHECK_WINDOW,
                        trigger={"processingTime": "1 second"})
    try:
        until = time.monotonic() + 300
        while _closed(spark, folder) < n_rows:  # timers close what is still open
            if not query.isActive or time.monotonic() > until:
                raise RuntimeError(f"the stream ended early: {query.exception()}")
            time.sleep(1)
    finally:
        query.stop()
    windows = spark.read.parquet(f"{folder}/out/windows")
    return windows.select("param", F.unix_timestamp("window_start").alias("window_start"), "n_rows", "zone", "zone_worst",
                          *[F.round(F.col(c) + F.lit(NUDGE), 4).alias(c) for c in ("v_avg", "v_std", "v_delta")])


def stream_rolling(spark, sf_dir):
    """Trailing features of each reading, made as readings arrive."""
    readings = inputs.telemetry_with_features(spark, sf_dir).select(
        "param", F.unix_micros("ts").alias("ts"), "event_id", "value", F.element_at("features", "k").alias("k"))
    folder, schema = _in_order(spark, readings, ["ts", "event_id"])
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).json(f"{folder}/in")
    (keyed.online_rolling(arriving, ["ts", "event_id"], features=["k"]).writeStream.outputMode("append")
     .format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/check")
     .trigger(**TO_THE_END).start().awaitTermination())
    return spark.read.parquet(f"{folder}/out").select(
        "param", "event_id", *[F.round(F.col(c) + F.lit(NUDGE), 6).alias(c) for c in ("v_avg", "v_std", "v_delta", "k_mean")])


QUERIES = {f.__name__: f for f in (stream_idle, stream_rolling, keyed_records, two_topics, stream_breach, stream_audit, stream_quarantine, live_view)}

# The events of the windows that the newest reading closes, from the records that are whole.
_WHOLE = sql.EVENTS.replace("FROM telem GROUP BY", "FROM telem WHERE event_id % 13 <> 0 GROUP BY")
_CLOSED = _WHOLE + """,
closed AS (SELECT * FROM ev WHERE epoch_ms(w) + 3600000 <=
           (SELECT max(epoch_us(ts) // 1000) - 5000 FROM telem WHERE event_id % 13 <> 0))"""
ORACLES = {
    "stream_rolling": learning.ORACLES["rolling_features"],
    "stream_idle": sql.with_events("""
        SELECT param, window_start, n_rows, zone, zone_worst, round(v_avg + 1e-9::DOUBLE, 4) AS v_avg,
               round(v_std + 1e-9::DOUBLE, 4) AS v_std, round(v_delta + 1e-9::DOUBLE, 4) AS v_delta FROM scored"""),
    "keyed_records": sql.with_telemetry("""
        SELECT param AS key, param, CAST(user_id AS VARCHAR) AS batch_id, event_id FROM telem"""),
    "two_topics": sql.with_events("""
        SELECT 'view' AS of, param, least(240, count(*)) AS n FROM telem WHERE event_id % 13 <> 0 GROUP BY param
        UNION ALL SELECT 'events', param, count(*) FROM ev GROUP BY param
        UNION ALL SELECT 'quarantine', 'telemetry', count(*) FROM events WHERE event_id % 13 = 0
        UNION ALL SELECT 'broken', 'all', 0"""),
    "stream_breach": sql.with_ctes(_CLOSED, """
        SELECT event_id, param, n_rows, zone, round(v_avg + 1e-9::DOUBLE, 3) AS v_avg FROM closed"""),
    "stream_audit": sql.with_ctes(
        _CLOSED, "SELECT param, count(*) AS n_rows, 0 AS n_broken FROM closed GROUP BY param"),
    "stream_quarantine": "SELECT 'unreadable' AS problem, count(*) AS n_rows FROM events WHERE event_id % 13 = 0",
    "live_view": sql.with_telemetry("""
        SELECT param, epoch_us(ts) // 1000 AS ts_ms, round(v + 1e-9::DOUBLE, 6) AS value FROM telem
        WHERE event_id % 13 <> 0
        QUALIFY row_number() OVER (PARTITION BY param ORDER BY epoch_us(ts) // 1000 DESC, v DESC) <= 240"""),
}

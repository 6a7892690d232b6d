"""The continuous breach query, its sinks, the consumer of its topics, and the live view.

Streams use the operators of the batch queries. Everything a micro-batch writes is
a folder named by the batch number, so a batch that is replayed after a failure
replaces what it wrote before.
"""

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from procwatch import fixed_values as fv
from procwatch.operators import audit, breach, latest, models
from procwatch.sources import tables, telemetry

EVERY = {"processingTime": "5 seconds"}


def scored_windows(readings: DataFrame, dim: DataFrame, size: str = fv.WINDOW_SIZE) -> DataFrame:
    """Closed windows with their score. `readings` carries a watermark on `ts`."""
    return breach.score_windows(breach.window_aggregates(readings, size), dim)


def audit_rows(events: DataFrame) -> DataFrame:
    """One audit row per breach event; each parameter has a chain of its own."""
    return events.select(
        F.col("param").alias("chain"), F.col("window_end").alias("ts"), F.lit("warn").alias("level"),
        F.lit("breach.detected").alias("action"), "event_id",
        F.to_json(F.struct("event_id", "param", "p_breach")).alias("detail"))


def append_audit(rows: DataFrame, folder: str, number: int) -> None:
    """Chain a batch's audit rows onto the stored log and store them and the new chain ends."""
    spark = rows.sparkSession
    before = tables.read_generation(spark, f"{folder}/audit_heads", number)
    tables.append_batch(audit.build_chain(rows, "chain", "ts", stored=before), f"{folder}/audit", number)
    new = audit.heads(tables.read_batch(spark, f"{folder}/audit", number), "chain", "ts")
    if before is not None:
        both = new.unionByName(before)  # a row per chain, twice at most
        new = both.groupBy("chain").agg(
            F.sum("n_rows").alias("n_rows"), F.max_by("last_hash", "last_order").alias("last_hash"),
            F.max("last_order").alias("last_order"))
    tables.write_generation(new, f"{folder}/audit_heads", number)


def write_batch(folder: str, threshold: float = fv.BREACH_THRESHOLD,
                fitted: dict[str, PipelineModel] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: windows, events, windowed features and chained audit rows.

    The batch's windows are written first and all else is made from them, so the stream's
    state is read once, however many models score it. With `fitted` models the windows of
    their parameters are scored by them.
    """
    folder = folder.rstrip("/")

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        tables.append_batch(batch, f"{folder}/windows", number)
        windows = tables.read_batch(spark, f"{folder}/windows", number)
        if fitted:
            windows = models.rescore(windows, fitted)
        events = breach.emit_events(breach.breach_candidates(windows, threshold)).withColumn(
            "emitted_at", F.current_timestamp())
        tables.append_batch(events, f"{folder}/breach_events", number)
        tables.append_batch(
            windows.select("param", "window_start", F.round("v_avg", 4).alias("v_avg"),
                           F.round("v_std", 4).alias("v_std"),
                           F.round("v_delta", 4).alias("v_delta"), "zone",
                           F.round("p_raw", 4).alias("p_breach")),
            f"{folder}/features", number)
        append_audit(audit_rows(events), folder, number)

    return write


def start(readings: DataFrame, dim: DataFrame, folder: str, checkpoint: str,
          size: str = fv.WINDOW_SIZE, threshold: float = fv.BREACH_THRESHOLD,
          trigger: dict | None = None, fitted: dict[str, PipelineModel] | None = None
          ) -> StreamingQuery:
    """Start the breach query with its outputs below `folder`."""
    return (scored_windows(readings, dim, size).writeStream.outputMode("append")
            .foreachBatch(write_batch(folder, threshold, fitted))
            .option("checkpointLocation", checkpoint).trigger(**(trigger or EVERY)).start())


def start_json_sink(readings: DataFrame, dim: DataFrame, folder: str, checkpoint: str,
                    size: str = fv.WINDOW_SIZE, threshold: float = fv.BREACH_THRESHOLD,
                    trigger: dict | None = None) -> StreamingQuery:
    """Append breach events as JSON lines."""
    events = breach.emit_events(
        breach.breach_candidates(scored_windows(readings, dim, size), threshold))
    return (tables.to_json_lines(events).writeStream.outputMode("append").format("text")
            .option("checkpointLocation", checkpoint).option("path", folder)
            .trigger(**(trigger or EVERY)).start())


def start_quarantine(raw: DataFrame, folder: str, checkpoint: str, trigger: dict | None = None
                     ) -> StreamingQuery:
    """Store the records the breach query cannot use; count them with `quarantined`."""
    def write(batch: DataFrame, number: int) -> None:
        tables.append_batch(batch, folder, number)

    return (telemetry.quarantine_stream(raw).writeStream.foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(**(trigger or EVERY)).start())


def quarantined(spark: SparkSession, folder: str) -> DataFrame:
    """Records set aside so far, by problem."""
    return spark.read.parquet(folder).groupBy("problem").agg(F.count(F.lit(1)).alias("n_rows"))


def consume(folder: str, dim: DataFrame, telemetry_topic: str = "scada.telemetry",
            breach_topic: str = "pdm.breaches", n: int = latest.PER_PARAM
            ) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function for a stream of (topic, value) records of two topics.

    Telemetry goes to the live view, breach events, completed by the parameter's defaults, to
    a table by batch with chained audit rows, and what cannot be read to quarantine.
    """
    folder = folder.rstrip("/")
    view = live_view(f"{folder}/live", n)

    def route(batch: DataFrame, number: int) -> None:
        tables.append_batch(batch, f"{folder}/received", number)  # the source is read once
        rows = tables.read_batch(batch.sparkSession, f"{folder}/received", number)
        usable, rest = telemetry.split_usable(telemetry.parse_json(
            telemetry.by_topic(rows, telemetry_topic).select("value", F.col("value").alias("text")), "value"))
        view(usable.drop("text"), number)
        parsed = telemetry.event_from_json(
            telemetry.by_topic(rows, breach_topic).select("value", F.col("value").alias("text")), "value")
        known = F.col("event_id").isNotNull() & F.col("param").isNotNull()
        events = telemetry.fill_event_defaults(parsed.where(known).drop("text"), dim)
        tables.append_batch(events, f"{folder}/events", number)
        ordered = events.withColumn("window_end", F.coalesce(
            F.try_to_timestamp("window_start"), F.timestamp_seconds(F.lit(0))))
        append_audit(_in_order(audit_rows(ordered), number), folder, number)
        bad = (rest.select("text", F.lit("telemetry").alias("of"))
               .unionByName(parsed.where(~known).select("text", F.lit("breach").alias("of"))))
        tables.append_batch(bad, f"{folder}/quarantine", number)

    return route


def _in_order(rows: DataFrame, number: int) -> DataFrame:
    """Received events in no order of their own: later batches after earlier ones, then by id."""
    place = F.concat(F.lpad(F.lit(str(number)), 12, "0"), F.lit(":"), F.col("event_id"))
    return rows.dropDuplicates(["chain", "event_id"]).withColumn("ts", place)


def live_view(folder: str, n: int = latest.PER_PARAM) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps the latest `n` readings of each parameter.

    Each batch writes the view anew from the one before and its own rows, which are cut
    to `n` per parameter before the shuffle: the state is parameters x n rows, however
    busy a parameter is, and two generations of it are kept. Read it with `read_live_view`.
    """
    order = [F.desc("ts"), F.desc("value")]

    def write(batch: DataFrame, number: int) -> None:
        before = tables.read_generation(batch.sparkSession, folder, number)
        rows = batch if before is None else batch.unionByName(before)
        tables.write_generation(latest.latest_per_key(rows, ["param"], order, n), folder, number)

    return write


def read_live_view(spark: SparkSession, folder: str) -> DataFrame:
    """The view as of the last batch."""
    view = tables.read_generation(spark, folder)
    if view is None:
        raise ValueError(f"no view in {folder}")
    return view


def late_rows(query: StreamingQuery) -> int:
    """Rows dropped so far because the watermark had passed them."""
    return sum(op.get("numRowsDroppedByWatermark", 0)
               for progress in query.recentProgress for op in progress["stateOperators"])

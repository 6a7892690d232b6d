"""Telemetry: JSON parsing, Kafka and file sources."""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from procwatch import fixed_values as fv

TELEMETRY_SCHEMA = T.StructType([
    T.StructField("param", T.StringType()),
    T.StructField("asset", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("unit", T.StringType()),
    T.StructField("zone", T.StringType()),
    T.StructField("batch_id", T.StringType()),
    T.StructField("molecule", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("features", T.MapType(T.StringType(), T.DoubleType())),
])

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("param", T.StringType()),
    T.StructField("asset", T.StringType()),
    T.StructField("v_avg", T.DoubleType()),
    T.StructField("v_std", T.DoubleType()),
    T.StructField("v_delta", T.DoubleType()),
    T.StructField("zone", T.StringType()),
    T.StructField("p_breach", T.DoubleType()),
    T.StructField("top_driver", T.StringType()),
    T.StructField("batch_id", T.StringType()),
    T.StructField("window_start", T.StringType()),
])

# What an event that lacks a field is given.
EVENT_DEFAULTS = {"v_std": 0.0, "v_delta": 0.0, "zone": "alarm", "p_breach": 0.0,
                  "top_driver": "", "batch_id": "", "window_start": ""}


def parse_json(df: DataFrame, body: str, schema: T.StructType = TELEMETRY_SCHEMA) -> DataFrame:
    """Parse `body`, keeping the other columns. Unreadable text gives a null record
    and an unreadable field a null field; nothing raises."""
    rest = [c for c in df.columns if c != body]
    return df.select(*rest, F.from_json(F.col(body).cast("string"), schema,
                                        {"mode": "PERMISSIVE"}).alias("_r")).select(*rest, "_r.*")


def is_usable() -> Column:
    return F.col("param").isNotNull() & F.col("ts").isNotNull()


def split_usable(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records with parameter and event time, the rest for quarantine)."""
    return parsed.where(is_usable()), parsed.where(~is_usable())


def event_from_json(df: DataFrame, body: str) -> DataFrame:
    """Known fields only, defaults where a field is missing, unknown fields ignored."""
    parsed = parse_json(df, body, EVENT_SCHEMA)
    return parsed.withColumns({c: F.coalesce(F.col(c), F.lit(v))
                               for c, v in EVENT_DEFAULTS.items()})


def fill_event_defaults(events: DataFrame, dim: DataFrame) -> DataFrame:
    """Empty asset or driver are looked up from the parameter."""
    known = dim.select("param", F.col("asset").alias("_asset"),
                       F.element_at("features", 1).alias("_driver"))
    joined = events.join(F.broadcast(known), "param", "left")
    return joined.withColumns({
        "asset": F.coalesce(F.nullif(F.col("asset"), F.lit("")), F.col("_asset")),
        "top_driver": F.coalesce(F.nullif(F.col("top_driver"), F.lit("")), F.col("_driver")),
    }).select(*events.columns)


def features_long(telemetry: DataFrame, *keep: str) -> DataFrame:
    """One row per (reading, feature)."""
    return telemetry.select(*keep, F.explode("features").alias("feature", "feature_value"))


def kafka_stream(spark: SparkSession, servers: str, topics: str = "scada.telemetry",
                 starting: str = "latest", **options: str) -> DataFrame:
    """Raw records (topic, value) of one or more comma-separated topics.

    Needs the Kafka connector on the class path. The query's checkpoint takes the
    place of a consumer group.
    """
    reader = (spark.readStream.format("kafka")
              .option("kafka.bootstrap.servers", servers)
              .option("subscribe", topics)
              .option("startingOffsets", starting))
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.load().select("topic", F.col("value").cast("string").alias("value"))


def json_file_stream(spark: SparkSession, folder: str, files_per_batch: int | None = None
                     ) -> DataFrame:
    """The same records arriving as files of JSON lines."""
    reader = spark.readStream.format("text")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder)


def telemetry_stream(raw: DataFrame, delay: str = fv.WATERMARK,
                     groups: Sequence[Sequence[str]] | None = None) -> DataFrame:
    """Usable telemetry with its watermark, from a raw stream with a `value` column.

    One watermark for all parameters follows the newest reading of any of them, so a parameter
    that lags behind the others by more than `delay` loses rows. With `groups` of parameters
    each group has a watermark of its own, and Spark goes by the slowest (the `min` policy,
    its default): no group loses rows to another. The source is then read once per group, and a
    group that sends nothing, at first or after a restart, holds all windows open until it does;
    put a parameter that may fall silent into a group with another. Parameters of no group are
    dropped.
    """
    usable, _ = split_usable(parse_json(raw.select("value"), "value"))
    if not groups:
        return usable.withWatermark("ts", delay)
    return reduce(DataFrame.unionAll, [
        usable.where(F.col("param").isin(list(group))).withWatermark("ts", delay) for group in groups])


def quarantine_stream(raw: DataFrame) -> DataFrame:
    """The records `telemetry_stream` cannot use: their text and what is wrong."""
    parsed = parse_json(raw.select("value", F.col("value").alias("text")), "value")
    return parsed.where(~is_usable()).select(
        "text", F.when(F.col("param").isNull() & F.col("ts").isNull(), "unreadable")
        .when(F.col("param").isNull(), "no parameter").otherwise("no time").alias("problem"))


def by_topic(batch: DataFrame, topic: str) -> DataFrame:
    """The records of one topic out of a batch read from several."""
    return batch.where(F.col("topic") == topic).drop("topic")


def to_keyed_json(df: DataFrame, key: str = "param") -> DataFrame:
    """(key, value) rows for a Kafka sink: one key stays in one topic partition."""
    return df.select(F.col(key).cast("string").alias("key"),
                     F.to_json(F.struct(*df.columns)).alias("value"))

"""The test tables in the shapes the operators take."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from procwatch.functions import bands
from procwatch.operators import corpus

# Which event type stands for which parameter.
EVENT_TYPE_PARAM = {"click": "temp", "error": "ph", "purchase": "press",
                    "signup": "cond", "view": "hum"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# How many partitions costly work on a table that lies in few files is dealt over; unset, rows
# stay where they lie, as they should where a table has many files.
PARTITIONS = "spark.procwatch.inputPartitions"


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    n = df.sparkSession.conf.get(PARTITIONS, None)
    return df.repartition(int(n), *keys) if n else df


def _param_of_type():
    pairs = [F.lit(x) for pair in EVENT_TYPE_PARAM.items() for x in pair]
    return F.element_at(F.create_map(*pairs), F.col("event_type"))


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as readings: the value rescaled into the parameter's bands."""
    events = (table(spark, sf_dir, "events")
              .withColumn("param", _param_of_type())
              .withColumn("ts", F.col("ts").cast("timestamp")))
    joined = bands.with_bands(events, bands.dimension(spark), "asset", "unit")
    scaled = (bands.control_centre() + ((F.col("alarm_hi") - F.col("alarm_lo")) / F.lit(2.0))
              * ((F.col("value") - F.lit(35.0)) / F.lit(80.0)))
    placed = joined.withColumn("value", scaled)
    return placed.select(
        "event_id", "ts", "param", "asset", "unit", "value",
        bands.zone(F.col("value")).alias("zone"),
        F.col("user_id").cast("string").alias("batch_id"), "props")


def telemetry_with_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry plus its `features` map, read from `props`."""
    return telemetry(spark, sf_dir).withColumn(
        "features", F.from_json("props", "map<string,double>"))


# The parameters in the order in which remainders stand for them.
PARAM_ORDER = ["temp", "ph", "press", "cond", "hum"]
DOCUMENT_TYPES = ["sop", "oem", "deviation"]


def _pick(names: list[str], number):
    """names[number]; null beyond the end."""
    return F.get(F.array(*[F.lit(n) for n in names]), number.cast("int"))


def described_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` with a kind, a parameter and a path each, all from the id."""
    docs = dealt(table(spark, sf_dir, "documents"), "doc_id")
    kind = _pick(DOCUMENT_TYPES, F.col("doc_id") % 3)
    number = F.col("doc_id").cast("string")
    return docs.select(
        "doc_id", F.concat(kind, F.lit("/"), number, F.lit(".txt")).alias("path"), "text",
        kind.alias("source_type"), F.concat(F.lit("DOC-"), number).alias("source_id"),
        F.concat(F.lit("Document "), number).alias("title"),
        _pick(PARAM_ORDER, F.col("doc_id") % 6).alias("param"),
        F.lit(None).cast("string").alias("asset"),
        F.lit(None).cast("string").alias("effective_date"))


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.document_chunks(described_documents(spark, sf_dir).drop("doc_id"))


def capa_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`orders` in the columns of corrective-action records."""
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("CAPA-"), F.col("o_orderkey").cast("string")).alias("capa_id"),
        _pick(PARAM_ORDER, F.col("o_custkey") % 5).alias("parameter"),
        F.concat(F.lit("A-"), (F.col("o_custkey") % 7).cast("string")).alias("asset"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("opened"),
        F.concat(F.lit("Priority "), "o_orderpriority").alias("problem"),
        F.concat(F.lit("Order status "), "o_orderstatus").alias("root_cause"),
        F.concat(F.lit("Settled "), F.floor("o_totalprice").cast("string"))
        .alias("corrective_action"),
        F.when(F.col("o_orderkey") % 4 != 0, F.lit("Effective")).alias("effectiveness"),
        F.col("o_orderkey").alias("row"))


def maintenance_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`part` in the columns of work orders."""
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("WO-"), F.col("p_partkey").cast("string")).alias("wo_id"),
        F.concat(F.lit("A-"), (F.col("p_partkey") % 7).cast("string")).alias("asset"),
        F.col("p_name").alias("component"),
        _pick(PARAM_ORDER, F.col("p_partkey") % 5).alias("parameter"),
        F.col("p_type").alias("trigger"), F.col("p_brand").alias("action"),
        F.concat(F.lit("Size "), F.col("p_size").cast("string")).alias("findings"),
        F.col("p_size").alias("downtime_min"), F.col("p_partkey").alias("row"))


def batch_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`customer` in the columns of batch records."""
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("B-"), F.col("c_custkey").cast("string")).alias("batch_id"),
        F.col("c_mktsegment").alias("molecule"),
        F.concat(F.lit("Phase "), F.col("c_nationkey").cast("string")).alias("phase"),
        _pick(PARAM_ORDER, F.col("c_custkey") % 5).alias("parameter"),
        F.col("c_name").alias("setpoint"),
        F.floor("c_acctbal").cast("string").alias("observed_range"),
        F.lit("Released").alias("disposition"), F.col("c_custkey").alias("row"))


def record_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.union_corpus(
        corpus.record_chunks(capa_rows(spark, sf_dir), "capa", "capa/capa_records.csv", "row"),
        corpus.record_chunks(maintenance_rows(spark, sf_dir), "maintenance",
                             "capa/maintenance_log.csv", "row"),
        corpus.record_chunks(batch_rows(spark, sf_dir), "batch", "batch/batch_records.json", "row"))


QUERY_TYPES = [["sop"], ["oem", "deviation"], ["deviation"]]


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`benchmark` texts as queries, with filters that follow from the id."""
    types = F.get(F.array(*[F.array(*[F.lit(t) for t in ts]) for ts in QUERY_TYPES]),
                  (F.col("item_id") % 4).cast("int"))
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").cast("string").alias("query_id"), "text",
        _pick(PARAM_ORDER, F.col("item_id") % 6).alias("param"), types.alias("source_types"))

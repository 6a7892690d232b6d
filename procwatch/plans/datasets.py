"""Registered queries over sources, sinks and uploaded data sets.

Where a file format is read, the file is first written from a given table, into
the shared folder.
"""

import uuid
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from procwatch.functions import bands
from procwatch.operators import profile
from procwatch.plans import inputs, signals, sql
from procwatch.plans.signals import NUDGE
from procwatch.session import session_dir
from procwatch.sources import deltas, files, tables, telemetry


def _folder(spark, label):
    return f"{session_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _r(name, digits=6):
    return F.round(F.col(name) + F.lit(NUDGE), digits).alias(name)


# ---- telemetry text -------------------------------------------------------------

def _messages(spark, sf_dir):
    """Readings as JSON text; every 13th is cut short, every 17th has a bad value."""
    df = inputs.telemetry_with_features(spark, sf_dir)
    text = F.to_json(F.struct("param", "asset", "value", "unit", "zone", "batch_id",
                              F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'+00:00'").alias("ts"),
                              "features"))
    broken = F.substring(text, 1, 25)
    odd = F.regexp_replace(text, '"value":[^,]*', '"value":"high"')
    return df.select("event_id", F.when(F.col("event_id") % 13 == 0, broken)
                     .when(F.col("event_id") % 17 == 0, odd).otherwise(text).alias("body"))


def json_tolerant_parse(spark, sf_dir):
    usable, rest = telemetry.split_usable(telemetry.parse_json(_messages(spark, sf_dir), "body"))
    good = usable.groupBy("param").agg(F.count(F.lit(1)).alias("n_rows"),
                                       F.count("value").alias("n_values"))
    bad = rest.agg(F.lit("quarantine").alias("param"), F.count(F.lit(1)).alias("n_rows"),
                   F.count("value").alias("n_values"))
    return good.unionByName(bad)


def iso_timestamp_parse(spark, sf_dir):
    """All messages; those that are cut short have no time."""
    parsed = telemetry.parse_json(_messages(spark, sf_dir), "body")
    return parsed.select("event_id", F.unix_millis("ts").alias("ts_ms"))


def features_long(spark, sf_dir):
    return telemetry.features_long(inputs.telemetry_with_features(spark, sf_dir), "event_id")


def _event_json(spark, sf_dir):
    """Breach events as JSON that lacks some fields and has one nobody knows."""
    return signals.events(spark, sf_dir).select("event_id", F.to_json(F.struct(
        "event_id", "param", F.when(F.col("n_rows") % 2 == 0, F.col("asset")).alias("asset"), "v_avg",
        F.when(F.col("n_rows") % 3 == 0, F.col("top_driver")).alias("top_driver"),
        F.when(F.col("n_rows") > 3, F.col("zone")).alias("zone"), "p_breach",
        F.lit("x").alias("unknown_field"))).alias("body"))


def event_from_json(spark, sf_dir):
    df = telemetry.event_from_json(_event_json(spark, sf_dir).select("body"), "body")
    return df.select("event_id", "param", "asset", _r("v_avg", 4), "v_std", "zone", "top_driver",
                     "batch_id")


def event_defaults(spark, sf_dir):
    df = telemetry.event_from_json(_event_json(spark, sf_dir).select("body"), "body")
    return telemetry.fill_event_defaults(df, bands.dimension(spark)).select(
        "event_id", "asset", "top_driver")


def breach_json_sink(spark, sf_dir):
    """Breach events written as JSON lines and read back."""
    folder = _folder(spark, "breach-json")
    sent = signals.events(spark, sf_dir).withColumn(
        "window_start", F.unix_timestamp("window_start")).drop("window_end")
    tables.to_json_lines(sent).write.text(folder)
    back = files.jsonl_records(spark, folder, sent.schema)
    return back.select("event_id", "param", "window_start", "v_avg", "p_breach", "zone", "n_rows")


# ---- record files ---------------------------------------------------------------

_CAPA = ["capa_id", "parameter", "asset", "opened", "problem", "root_cause",
         "corrective_action", "effectiveness"]


def csv_records(spark, sf_dir):
    folder = _folder(spark, "capa-csv")
    inputs.capa_rows(spark, sf_dir).select(*_CAPA).write.option("header", True).csv(folder)
    return files.csv_records(spark, folder, _CAPA)


def json_records(spark, sf_dir):
    """Files that hold an array of up to 5,000 objects each, read as records."""
    folder = _folder(spark, "parts-json")
    rows = inputs.table(spark, sf_dir, "part").groupBy(F.floor(F.col("p_partkey") / 5000).alias("f"))
    arrays = rows.agg(F.to_json(F.collect_list(F.struct("p_partkey", "p_name", "p_size")))
                      .alias("value"))
    arrays.select("value", "f").write.partitionBy("f").text(folder)
    return files.json_records(spark, folder, "p_partkey long, p_name string, p_size int").select(
        "p_partkey", "p_name", "p_size")


def jsonl_records(spark, sf_dir):
    folder = _folder(spark, "parts-jsonl")
    inputs.table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size").write.json(folder)
    return files.jsonl_records(spark, folder, "p_partkey long, p_name string, p_size int")


def variant_records(spark, sf_dir):
    """Parts and orders, of different fields, and suppliers' lines cut short, read in one scan."""
    folder = _folder(spark, "mixed-jsonl")
    part = inputs.table(spark, sf_dir, "part").select(F.to_json(F.struct(
        F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), F.col("p_name").alias("label"),
        F.col("p_size").alias("number"), F.struct("p_type", "p_brand").alias("extra"))).alias("value"))
    order = inputs.table(spark, sf_dir, "orders").select(F.to_json(F.struct(
        F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("number"),
        F.array("o_custkey").alias("extra"))).alias("value"))
    cut = inputs.table(spark, sf_dir, "supplier").select(
        F.concat(F.lit('{"kind": "supplier", "id": '), F.col("s_suppkey").cast("string")).alias("value"))
    part.unionByName(order).unionByName(cut).write.text(folder)
    found = files.variant_records(spark, folder, {"kind": "string", "id": "long", "label": "string", "number": "int"})
    customer = F.try_variant_get("record", "$.extra[0]", "long")
    brand = F.try_variant_get("record", "$.extra.p_brand", "string")
    return found.select("kind", "id", "label", "number", "n_fields", customer.alias("customer"), brand.alias("brand"),
                        "bad_line")


TURNS_PER_FILE = 250


def text_corpus_scan(spark, sf_dir):
    """Turns of conversations written to text files of about 250 turns, and scanned recursively."""
    folder = _folder(spark, "texts")
    turns = inputs.table(spark, sf_dir, "conversations")
    n_files = max(1, -(-turns.count() // TURNS_PER_FILE))
    digest = F.substring(F.md5(F.concat_ws("-", "conv_id", "turn")), 1, 8)
    (turns.withColumn("f", F.conv(digest, 16, 10).cast("long") % n_files)
     .repartition("f").sortWithinPartitions("f", "conv_id", "turn").select("f", "text")
     .write.option("compression", "none").partitionBy("f").text(folder))
    docs = files.text_documents(spark, folder)
    return docs.select(F.regexp_extract("path", "f=([0-9]+)/", 1).cast("long").alias("f"),
                       F.md5(F.regexp_replace("text", "\n$", "")).alias("text_md5"))


def historian_scan(spark, sf_dir):
    """Readings stored by parameter; one parameter is read back."""
    folder = _folder(spark, "historian")
    inputs.telemetry(spark, sf_dir).select("event_id", "param", "value").write.partitionBy(
        "param").parquet(folder)
    return files.historian(spark, folder, "press").select("event_id", _r("value"))


# ---- keyed tables -----------------------------------------------------------------

def vector_upsert(spark, sf_dir):
    """Stored vectors with their payload, upserted four times: the highest version wins, whatever
    its label, and an older version that arrives late changes nothing."""
    folder = _folder(spark, "vectors")
    rows = inputs.table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", F.lit(1).alias("version"), "embedding")
    newer = rows.where(F.col("vec_id") % 3 == 0).withColumns(
        {"version": F.lit(3), "label": F.col("label") + 100})
    late = rows.where(F.col("vec_id") % 6 == 0).withColumns(
        {"version": F.lit(2), "label": F.col("label") + 200})
    for batch in (rows, newer, late, newer):
        deltas.upsert(batch, folder, ["vec_id"], [F.desc("version")], fanout=3)
    return deltas.read(spark, folder, ["vec_id"], [F.desc("version")]).select(
        "vec_id", "label", "version", F.size("embedding").alias("n"))


def vector_lookup(spark, sf_dir):
    """The largest id of each label, changed after all were stored, and looked up among the runs."""
    folder = _folder(spark, "vectors")
    rows = inputs.table(spark, sf_dir, "embeddings").select("vec_id", "label", F.lit(1).alias("version"), "embedding")
    last = rows.groupBy("label").agg(F.max("vec_id").alias("vec_id"))
    changed = rows.join(last, ["label", "vec_id"]).where("label % 2 = 0").withColumn("version", F.lit(2))
    for batch in (rows, changed):
        deltas.upsert(batch, folder, ["vec_id"], [F.desc("version")])
    return deltas.lookup(last.select("vec_id"), folder, ["vec_id"], [F.desc("version")]).select(
        "vec_id", "label", "version", F.size("embedding").alias("n"))


def upsert_sink(spark, sf_dir):
    """Breach events sent again and again, compacted, and sent once more: one row per event remains."""
    folder = _folder(spark, "events")
    events = signals.events(spark, sf_dir).select("event_id", "param", "p_breach")

    def send(number, param, p):
        tables.append_batch(events.where(F.col("param") == param).withColumn("p_breach", F.lit(p)),
                            folder, number)

    tables.append_batch(events, folder, 0)
    for p in (1.0, 0.5):
        send(1, "ph", p)
    send(2, "hum", 0.75)
    tables.compact(spark, folder, ["event_id"])
    send(2, "hum", 0.25)  # the last batch is replayed after the compaction
    return tables.latest_state(spark, folder, ["event_id"])


# ---- uploaded data sets -------------------------------------------------------------

# Per parameter: its value column, a column that stands for an input, the other parameter's
# column that the data set holds too.
DATASETS = {"temp": ("reactor_temperature_degc", "coolant_flow_rate_lpm", "ph"),
            "ph": ("ph", "acid_base_dose_rate_l", "humidity_pct"),
            "press": ("differential_pressure_kpa", "filter_dp_kpa", "ph"),
            "cond": ("conductivity_us_cm", "water_flow_rate_lpm", "ph"),
            "hum": ("humidity_pct", "hvac_fan_speed_rpm", "ph")}


def _dataset(spark, sf_dir, param):
    """A parameter's readings in the columns of an uploaded data set."""
    value, of_input, other = DATASETS[param]
    df = inputs.telemetry_with_features(spark, sf_dir).where(F.col("param") == param)
    return df.select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), "batch_id", "asset", "zone",
        F.col("event_id").alias("row"), F.col("value").alias(value),
        F.element_at("features", "k").alias(of_input),
        F.when(F.col("zone") != "control", F.col("value")).alias(other))


def _of_all(spark, sf_dir, build):
    """What `build` makes of each parameter's data set, in one table."""
    return reduce(DataFrame.unionByName, [
        build(_dataset(spark, sf_dir, p), p).withColumn("param", F.lit(p)) for p in DATASETS])


def identify_param(spark, sf_dir):
    """The parameter of each data set: by its value column, and by its rows where that is missing."""
    found = []
    for p, (value, _, _) in DATASETS.items():
        df = _dataset(spark, sf_dir, p)
        rows = df.drop(*[v for v, _, _ in DATASETS.values()]).withColumn("param", F.lit(p))
        found.append((p, profile.identify_param(df.drop(DATASETS[p][2])), profile.identify_param(rows), df.count()))
    return spark.createDataFrame(found, "param string, by_column string, by_rows string, rows long")


def dataset_profile(spark, sf_dir):
    return _of_all(spark, sf_dir, profile.dataset_profile)


def infer_types(spark, sf_dir):
    """Also columns whose first values look like dates and most do not, and the other way round."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return profile.infer_types(inputs.table(spark, sf_dir, "orders").withColumns({
        "o_day": day, "o_rarely": F.when(F.col("o_orderkey") % 40 < 10, day).otherwise("n/a"),
        "o_mostly": F.when(F.col("o_orderkey") % 40 >= 10, day).otherwise("n/a"),
        "o_sparse": F.when(F.col("o_orderkey") % 5 == 0, day)}))


def dataset_preview(spark, sf_dir):
    return _of_all(spark, sf_dir, lambda df, p: profile.preview(df, ["row"], 50).select(
        "row", "timestamp", "zone", F.col(DATASETS[p][1]).alias("input")))


def adapt_columns(spark, sf_dir):
    """The adapted inputs by their place in the parameter's list."""
    def build(df, p):
        adapted = profile.adapt_columns(df, p)
        return adapted.select(_r("value"), *[F.col(c).alias(f"input_{i}") for i, c in enumerate(
            c for c in adapted.columns if c not in ("value", "param"))])
    return _of_all(spark, sf_dir, build)


def dataset_promote(spark, sf_dir):
    """A staged data set becomes the saved one of its parameter and is no longer staged."""
    folder = _folder(spark, "uploads")

    def build(df, p):
        tables.stage_dataset(df, folder, p)
        saved = tables.promote_dataset(spark, folder, p)
        return saved.select("row", "zone", F.lit(int(tables.is_staged(spark, folder, p))).alias("still_staged"))
    return _of_all(spark, sf_dir, build)


def dataset_catalog(spark, sf_dir):
    """The catalog, written as JSON and read back."""
    folder = _folder(spark, "catalog")
    saved, pending = [], []
    for p in DATASETS:
        df = _dataset(spark, sf_dir, p)
        saved.append(profile.catalog_entry(df, p, "saved"))
        pending.append(profile.catalog_entry(df.where("zone <> 'control'"), p, "pending"))
    catalog = profile.all_datasets(saved, pending)
    tables.write_json(catalog, folder)
    return spark.read.schema(catalog.schema).json(folder).select(
        "param", "status", "rows", "dependent_variable",
        F.array_join("independent_variables", ",").alias("inputs"), "model")


QUERIES = {f.__name__: f for f in (
    json_tolerant_parse, iso_timestamp_parse, features_long, event_from_json, event_defaults,
    breach_json_sink, csv_records, json_records, jsonl_records, variant_records, text_corpus_scan, historian_scan,
    vector_upsert, vector_lookup, upsert_sink, identify_param, dataset_profile, infer_types, dataset_preview, adapt_columns,
    dataset_promote, dataset_catalog)}

# What the catalog says of the columns.
_SAID = {"timestamp": "Event time of the SCADA sample (ISO-8601 / wall-clock).",
         "batch_id": "Manufacturing batch or lot identifier associated with the reading.",
         "asset": "Equipment tag where the sensor reading was collected.",
         "zone": "Operating zone classification at sample time (control / alarm / trip).",
         "row": "Process / context variable: row.",
         "reactor_temperature_degc": "Dependent variable — bioreactor temperature in °C.",
         "ph": "Dependent variable — culture / media pH.",
         "differential_pressure_kpa": "Dependent variable — filter differential pressure in kPa.",
         "conductivity_us_cm": "Dependent variable — WFI conductivity in µS/cm.",
         "humidity_pct": "Dependent variable — cleanroom relative humidity in %."}
_MODEL = {"temp": "gbm", "ph": "random_forest", "press": "gbm", "cond": "svm", "hum": "ann"}
_DS = """,
ds AS (SELECT param, event_id AS row, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp, zone, v,
              CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM telem)
"""


def _profile_sql():
    rows = []
    for p, (value, of_input, other) in DATASETS.items():
        columns = [("timestamp", "datetime", "metadata"), ("batch_id", "string", "metadata"),
                   ("asset", "string", "metadata"), ("zone", "string", "metadata"),
                   ("row", "integer", "independent"), (value, "float", "dependent"),
                   (of_input, "float", "independent"), (other, "float", "other")]
        for name, kind, role in columns:
            said = _SAID.get(name, f"Process / context variable: {name.replace('_', ' ')}.")
            filled = {of_input: "nk", other: "nz"}.get(name, "n")
            rows.append(f"SELECT param, '{name}' AS name, '{kind}' AS type, '{role}' AS role, '{said}' AS description, "
                        f"{filled} AS non_null, n - {filled} AS nulls FROM c WHERE param = '{p}'")
    return " UNION ALL ".join(rows)


def _catalog_sql():
    entries = []
    for p, (value, of_input, other) in DATASETS.items():
        for status, rows in (("saved", "count(*)"), ("pending", "count(*) FILTER (zone <> 'control')")):
            entries.append(f"SELECT '{p}' AS param, '{status}' AS status, {rows} AS rows, '{value}' AS dependent_variable, "
                           f"'row,{of_input},{other}' AS inputs, '{_MODEL[p]}' AS model FROM ds WHERE param = '{p}'")
    return " UNION ALL ".join(entries)


ORACLES = {
    "json_tolerant_parse": sql.with_telemetry("""
        SELECT param, count(*) AS n_rows, count(*) FILTER (event_id % 17 <> 0) AS n_values FROM telem
        WHERE event_id % 13 <> 0 GROUP BY param
        UNION ALL SELECT 'quarantine', count(*), 0 FROM events WHERE event_id % 13 = 0"""),
    "iso_timestamp_parse": """
        SELECT event_id, CASE WHEN event_id % 13 <> 0 THEN epoch_us(ts) // 1000 END AS ts_ms FROM events""",
    "features_long": """
        SELECT event_id, 'k' AS feature, CAST(json_extract(props, '$.k') AS DOUBLE) AS feature_value
        FROM events WHERE json_extract(props, '$.k') IS NOT NULL""",
    "event_from_json": sql.with_events("""
        SELECT event_id, param, CASE WHEN n_rows % 2 = 0 THEN asset END AS asset,
               round(v_avg + 1e-9::DOUBLE, 4) AS v_avg,
               0::DOUBLE AS v_std, CASE WHEN n_rows > 3 THEN zone ELSE 'alarm' END AS zone,
               CASE WHEN n_rows % 3 = 0 THEN top_driver ELSE '' END AS top_driver, '' AS batch_id FROM ev"""),
    "event_defaults": sql.with_events("""
        SELECT event_id, asset, CASE WHEN param = 'cond' AND n_rows % 3 <> 0 THEN 'water_flow_rate'
               ELSE top_driver END AS top_driver FROM ev"""),
    "breach_json_sink": sql.with_events(
        "SELECT event_id, param, window_start, v_avg, p_breach, zone, n_rows FROM ev"),
    "csv_records": f"""
        SELECT 'CAPA-' || o_orderkey AS capa_id, {sql.PARAM_LIST}[CAST(o_custkey % 5 AS INT) + 1] AS parameter,
               'A-' || (o_custkey % 7) AS asset, strftime(o_orderdate, '%Y-%m-%d') AS opened,
               'Priority ' || o_orderpriority AS problem, 'Order status ' || o_orderstatus AS root_cause,
               'Settled ' || CAST(floor(o_totalprice) AS BIGINT) AS corrective_action,
               CASE WHEN o_orderkey % 4 <> 0 THEN 'Effective' END AS effectiveness FROM orders""",
    "json_records": "SELECT p_partkey, p_name, p_size FROM part",
    "jsonl_records": "SELECT p_partkey, p_name, p_size FROM part",
    "variant_records": """
        SELECT 'part' AS kind, p_partkey AS id, p_name AS label, CAST(p_size AS INT) AS number, 5 AS n_fields,
               CAST(NULL AS BIGINT) AS customer, p_brand AS brand, CAST(NULL AS VARCHAR) AS bad_line FROM part
        UNION ALL SELECT 'order', o_orderkey, NULL, NULL, 4, o_custkey, NULL, NULL FROM orders
        UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, '{"kind": "supplier", "id": ' || s_suppkey FROM supplier""",
    "text_corpus_scan": """
        WITH n AS (SELECT CAST(ceil(count(*) / 250::DOUBLE) AS BIGINT) AS n FROM conversations)
        SELECT ('0x' || substr(md5(conv_id || '-' || turn), 1, 8))::BIGINT % n AS f,
               md5(string_agg(text, chr(10) ORDER BY conv_id, turn)) AS text_md5
        FROM conversations, n GROUP BY 1""",
    "historian_scan": sql.with_telemetry(
        "SELECT event_id, round(v + 1e-9::DOUBLE, 6) AS value FROM telem WHERE param = 'press'"),
    "vector_upsert": """
        SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN label + 100 ELSE label END AS label,
               CASE WHEN vec_id % 3 = 0 THEN 3 ELSE 1 END AS version,
               CAST(len(embedding) AS INT) AS n FROM embeddings""",
    "vector_lookup": """
        SELECT max(vec_id) AS vec_id, label, CASE WHEN label % 2 = 0 THEN 2 ELSE 1 END AS version,
               arg_max(len(embedding), vec_id) AS n FROM embeddings GROUP BY label""",
    "upsert_sink": sql.with_events(
        "SELECT event_id, param, CASE param WHEN 'ph' THEN 0.5::DOUBLE WHEN 'hum' THEN 0.25::DOUBLE ELSE p_breach END AS p_breach FROM ev"),
    "identify_param": sql.with_telemetry("""
        SELECT param, param AS by_column, param AS by_rows, count(*) AS rows FROM telem GROUP BY param"""),
    "dataset_profile": sql.with_telemetry(_DS + """
        , c AS (SELECT param, count(*) AS n, count(k) AS nk, count(*) FILTER (zone <> 'control') AS nz
                FROM ds GROUP BY param) """ + _profile_sql()),
    "infer_types": """
        WITH t AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS d, o_orderkey AS k, o_orderstatus, o_orderpriority FROM orders),
        x AS (SELECT unnest([o_orderstatus, o_orderpriority, d, CASE WHEN k % 40 < 10 THEN d ELSE 'n/a' END,
                             CASE WHEN k % 40 >= 10 THEN d ELSE 'n/a' END, CASE WHEN k % 5 = 0 THEN d END]) AS v,
                     unnest(['o_orderstatus', 'o_orderpriority', 'o_day', 'o_rarely', 'o_mostly', 'o_sparse']) AS name FROM t)
        SELECT name, CASE WHEN avg(CASE WHEN regexp_matches(v, '^[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN 1 ELSE 0 END) > 0.6
                          THEN 'datetime' ELSE 'string' END AS type FROM x WHERE v IS NOT NULL GROUP BY name
        UNION ALL SELECT * FROM (VALUES ('o_orderkey', 'integer'), ('o_custkey', 'integer'),
            ('o_totalprice', 'float'), ('o_orderdate', 'datetime')) t(name, type)""",
    "dataset_preview": sql.with_telemetry(_DS + """
        SELECT param, row, timestamp, zone, k AS input FROM ds
        QUALIFY row_number() OVER (PARTITION BY param ORDER BY row) <= 50"""),
    "adapt_columns": sql.with_telemetry(_DS + """
        SELECT param, round(v + 1e-9::DOUBLE, 6) AS value, k AS input_0, 0::DOUBLE AS input_1,
               0::DOUBLE AS input_2, 0::DOUBLE AS input_3, 0::DOUBLE AS input_4 FROM ds"""),
    "dataset_promote": sql.with_telemetry(_DS + "SELECT param, row, zone, 0 AS still_staged FROM ds"),
    "dataset_catalog": sql.with_telemetry(_DS + _catalog_sql()),
}

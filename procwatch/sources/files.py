"""Record and text files."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from procwatch.functions.text import strip

TEXT_FILES = "*.{[mM][dD],[tT][xX][tT]}"


def csv_records(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """CSV with a header, every column a string."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return (spark.read.option("header", True).option("enforceSchema", False)
            .option("multiLine", True).schema(schema).csv(path))


def json_records(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON files that hold one object or an array of objects each."""
    return spark.read.option("multiLine", True).schema(schema).json(path)


def jsonl_records(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One JSON object per line."""
    return spark.read.schema(schema).json(path)


def variant_records(spark: SparkSession, path: str, fields: dict[str, str]) -> DataFrame:
    """Records of any shape, one JSON value per line, in one scan without a schema for all of them.

    `fields` names columns and the types they are read as, each from the top-level field of that
    name; null where a record lacks it or holds something else. `record` is the whole record as a
    variant, `n_fields` how many top-level fields it has (null unless it is an object), and
    `bad_line` the text of a line that is no JSON, whose other columns are null. Blank lines are
    left out.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.withColumn("record", F.try_parse_json("value"))
    named = [F.try_variant_get("record", f"$['{name}']", kind).alias(name) for name, kind in fields.items()]
    top = F.json_object_keys(F.to_json("record"))
    return parsed.select(*named, F.size(top).alias("n_fields"), "record",
                         F.when(F.col("record").isNull(), F.col("value")).alias("bad_line")).withColumn(
        "n_fields", F.when(F.col("n_fields") >= 0, F.col("n_fields")))


def variant_shapes(records: DataFrame, by: str, record: str = "record") -> DataFrame:
    """(by, shape, n): the merged type of the records of each group; combined where they lie."""
    return records.where(F.col(record).isNotNull()).groupBy(by).agg(
        F.schema_of_variant_agg(record).alias("shape"), F.count(F.lit(1)).alias("n"))


def text_documents(spark: SparkSession, root: str) -> DataFrame:
    """(path, text) of every .md and .txt file below `root`; blank files are left out.

    `path` is relative to `root`. Bytes that are not UTF-8 are dropped.
    """
    files = (spark.read.option("pathGlobFilter", TEXT_FILES)
             .text(root, wholetext=True, recursiveFileLookup=True)
             .select(F.col("_metadata.file_path").alias("uri"),
                     F.regexp_replace("value", "�", "").alias("text")))
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    inside = F.regexp_replace(F.url_decode("uri"), f"^.*?{_quoted(base)}/", "")
    return files.select(inside.alias("path"), "text").where(strip(F.col("text")) != "")


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() or c in "/_" else "\\" + c for c in text)


def historian(spark: SparkSession, path: str, param: str, schema: T.StructType | None = None
              ) -> DataFrame:
    """One parameter's readings from parquet, or from CSV (which needs `schema`).

    Stored by `param`, only that parameter's folder is read; otherwise the filter
    goes down to the parquet scan.
    """
    if path.endswith(".csv"):
        if schema is None:
            raise ValueError("a CSV needs its schema")
        return spark.read.option("header", True).schema(schema).csv(path).where(
            F.col("param") == param)
    return spark.read.parquet(path).where(F.col("param") == param)

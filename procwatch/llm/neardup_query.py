"""The query of the near-duplicates. Tests hold it against brute force; SQL cannot draw the samples."""

from pyspark.sql import DataFrame, SparkSession

from procwatch.llm import neardup
from procwatch.llm.inputs import table


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents")).select(
        "doc_id", "class_id", "class_size", "kept")


QUERIES = {"op1_near_duplicates": op1_near_duplicates}
ORACLES: dict[str, str] = {}

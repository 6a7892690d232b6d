"""The query of the decontamination. SQL has no approximate substrings; tests hold it against brute force."""

from pyspark.sql import DataFrame, SparkSession

from procwatch.llm import leaks
from procwatch.llm.inputs import table


def op7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op7_leaks": op7_leaks}
ORACLES: dict[str, str] = {}

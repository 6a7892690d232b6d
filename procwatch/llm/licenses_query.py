"""The query of the license scan. Its rules have no short form in SQL; tests hold it against Python."""

from pyspark.sql import DataFrame, SparkSession

from procwatch.llm import licenses
from procwatch.llm.inputs import table


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(table(spark, sf_dir, "documents"))


QUERIES = {"op3_license_scan": op3_license_scan}
ORACLES: dict[str, str] = {}

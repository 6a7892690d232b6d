"""The query of language identification. A trained model has no SQL; tests measure its accuracy."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from procwatch.llm import language
from procwatch.llm.inputs import table


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    predicted = language.predict(docs.select("doc_id", "text"), language.fit(docs))
    return predicted.select("doc_id", language.is_held_out(F.col("doc_id")).alias("held_out"),
                            "lang_pred", "score", "rejected")


QUERIES = {"op9_language": op9_language}
ORACLES: dict[str, str] = {}

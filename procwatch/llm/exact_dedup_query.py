"""The query of exact deduplication and its SQL."""

from pyspark.sql import DataFrame, SparkSession

from procwatch.llm import exact_dedup
from procwatch.llm.inputs import table


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_copies(table(spark, sf_dir, "documents"), carry=["doc_id"])


SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""

QUERIES = {"op11_exact_dedup": op11_exact_dedup}
ORACLES = {"op11_exact_dedup": SQL}

"""The query of the mixing operator and its SQL."""

from pyspark.sql import DataFrame, SparkSession

from procwatch.llm import mixing
from procwatch.llm.inputs import table


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "copies")


SQL = r"""
WITH d AS (SELECT doc_id, source,
                  md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':7') AS k,
                  CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
           FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS w FROM s),
l AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (
               ORDER BY 3 * source_size / w, source IS NULL, source
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
             / CAST(sum(w) OVER (ORDER BY 3 * source_size / w, source IS NULL, source
               ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM w),
t AS (SELECT source, source_size,
             least(CAST(3 * source_size AS DOUBLE), greatest(max(level) OVER (), 0.0) * w) AS target FROM l),
p AS (SELECT d.*, t.source_size, t.target,
             CAST(sum(size) OVER (PARTITION BY d.source ORDER BY k
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS upto
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT doc_id, size, source, k, e,
             CAST(e * source_size + upto AS DOUBLE) / target AS finish
      FROM p, (SELECT unnest([0, 1, 2]) AS e) WHERE size > 0),
o AS (SELECT doc_id, size, sum(size) OVER (ORDER BY finish, source IS NULL, source, k
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used FROM c),
n AS (SELECT doc_id, count(*) AS copies FROM o
      WHERE used <= (SELECT sum(size) FROM d) GROUP BY doc_id)
SELECT p.doc_id, p.size, p.source_size, p.target,
       CAST(coalesce(n.copies, 0) * p.size AS BIGINT) AS taken,
       CAST(coalesce(n.copies, 0) AS INTEGER) AS copies
FROM p LEFT JOIN n ON p.doc_id = n.doc_id
"""

QUERIES = {"op10_mixing": op10_mixing}
ORACLES = {"op10_mixing": SQL}

"""The query of the URL rules and its SQL."""

from pyspark.sql import DataFrame, SparkSession

from procwatch.llm import url_rules
from procwatch.llm.inputs import table

# The rules of the query.
RULES = [("com", "/", "allow"),
         ("example.com", "/en/", "block"),
         ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"),
         ("net", "/fr/", "block")]


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_rules.judge(table(spark, sf_dir, "pages"), rules)


SQL = r"""
WITH rules(host, path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
     ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
rest AS (SELECT page_id, row_number() OVER () AS r,
                CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS u
         FROM pages),
p AS (SELECT page_id, r, lower(regexp_extract(u, '^[^/?#]*')) AS host,
             regexp_extract(u, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
m AS (SELECT p.page_id, p.r, p.host, p.path, rules.host || rules.path AS rule, verdict,
             row_number() OVER (PARTITION BY p.r
                                ORDER BY length(rules.host || rules.path) DESC NULLS LAST) AS n
      FROM p LEFT JOIN rules ON (p.host = rules.host OR ends_with(p.host, '.' || rules.host))
                            AND starts_with(p.path, rules.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE n = 1
"""

QUERIES = {"op6_url_rules": op6_url_rules}
ORACLES = {"op6_url_rules": SQL}

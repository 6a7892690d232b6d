"""The query of the conversation trie and its SQL."""

from pyspark.sql import DataFrame, SparkSession

from procwatch.llm import prefix_trie
from procwatch.llm.inputs import table


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.build(table(spark, sf_dir, "conversations"))


SQL = """
WITH RECURSIVE ids AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL),
crc AS (  -- a bit at a time, over the bytes of the decimal number
    SELECT c, 0 AS i, CAST(4294967295 AS BIGINT) AS v FROM ids
    UNION ALL
    SELECT c, i + 1, xor((CASE WHEN i % 8 = 0 THEN xor(v, ascii(substr(CAST(c AS VARCHAR), i // 8 + 1, 1))) ELSE v END) >> 1,
                         ((CASE WHEN i % 8 = 0 THEN xor(v, ascii(substr(CAST(c AS VARCHAR), i // 8 + 1, 1))) ELSE v END) & 1)
                         * 3988292384)
    FROM crc WHERE i < 8 * length(CAST(c AS VARCHAR))),
h AS (SELECT c, c - c % 5 AS base, xor(v, 4294967295) % 9 AS h FROM crc WHERE i = 8 * length(CAST(c AS VARCHAR))),
o AS (SELECT conv_id AS c, md5(coalesce(role, '')) || md5(coalesce(text, '')) AS k, strlen(coalesce(text, '')) AS b,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(md5(coalesce(role, ''))
                                || md5(coalesce(text, '')))) - 1 AS p
      FROM conversations WHERE conv_id IS NOT NULL),
r AS (SELECT h.c, 0 AS part, p, k, b FROM h JOIN o ON o.c = h.base AND o.p < h.h
      UNION ALL SELECT h.c, 1, p, k, b FROM h JOIN o ON o.c = h.c AND o.p >= h.h),
t AS (SELECT c, row_number() OVER w AS depth, string_agg(k, ',') OVER w AS path, b FROM r
      WINDOW w AS (PARTITION BY c ORDER BY part, p)
      UNION ALL SELECT c, 0, '', 0 FROM ids),
e AS (SELECT *, max(depth) OVER (PARTITION BY c) AS n, lag(path) OVER (PARTITION BY c ORDER BY depth) AS up FROM t),
n AS (SELECT path, depth, up, min(c) AS conv_id, count(*) AS n_convs, any_value(b) AS b,
             sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (depth = n), '')) AS ends_sha256
      FROM e GROUP BY path, depth, up),
k AS (SELECT up, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY up),
l AS (SELECT n.path, sum((u.n_convs - 1) * u.b) AS saved, count(*) FILTER (kk.up IS NULL) AS n_leaves
      FROM n JOIN n AS u ON starts_with(u.path, n.path) AND u.depth >= n.depth LEFT JOIN k AS kk ON kk.up = u.path
      GROUP BY n.path)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n JOIN l USING (path) LEFT JOIN k ON k.up = n.path LEFT JOIN n AS p ON p.path = n.up
"""

QUERIES = {"op13_prefix_trie": op13_prefix_trie}
ORACLES = {"op13_prefix_trie": SQL}

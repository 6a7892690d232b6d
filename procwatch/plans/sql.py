"""Common table expressions shared by the checking SQL."""

# The bands, wordings and weights below repeat those of the operators, so that the
# SQL is a check of its own.
BANDS = """
b AS (SELECT et, param, asset, unit, driver, pname, CAST(cl AS DOUBLE) cl, CAST(ch AS DOUBLE) ch,
             CAST(al AS DOUBLE) al, CAST(ah AS DOUBLE) ah, CAST(tl AS DOUBLE) tl, CAST(th AS DOUBLE) th
      FROM (VALUES
  ('click', 'temp', 'BR-12', 'degC', 'coolant_flow_rate', 'Reactor Temperature', 36.5, 37.5, 36.0, 38.0, 35.5, 38.5),
  ('error', 'ph', 'BR-12', 'pH', 'acid_base_dose_rate', 'pH', 6.8, 7.2, 6.6, 7.4, 6.4, 7.6),
  ('purchase', 'press', 'FIL-07', 'kPa', 'filter_dp', 'Differential Pressure', 100.0, 110.0, 96.0, 114.0, 92.0, 118.0),
  ('signup', 'cond', 'WFI-02', 'uS/cm', 'feed_composition', 'Conductivity (WFI)', 700.0, 900.0, 640.0, 960.0, 600.0, 1000.0),
  ('view', 'hum', 'CR-A1', 'pct', 'hvac_fan_speed', 'Humidity (Cleanroom)', 40.0, 55.0, 36.0, 59.0, 32.0, 63.0))
      t(et, param, asset, unit, driver, pname, cl, ch, al, ah, tl, th))"""

TELEMETRY = BANDS + """,
m AS (SELECT e.event_id, e.ts, e.user_id, e.props, b.*,
             (cl + ch) / 2::DOUBLE + ((ah - al) / 2::DOUBLE) * ((e.value - 35::DOUBLE) / 80::DOUBLE) AS v
      FROM events e JOIN b ON e.event_type = b.et),
telem AS (SELECT *, CASE WHEN v < tl OR v > th THEN 'trip' WHEN v < al OR v > ah THEN 'alarm'
                    ELSE 'control' END AS zone FROM m)"""

EVENTS = TELEMETRY + """,
win AS (SELECT param, time_bucket(INTERVAL '1 hour', ts) AS w, max(asset) AS asset,
               max(CAST(user_id AS VARCHAR)) AS batch_id, max(driver) AS top_driver, max(cl) AS cl,
               max(ch) AS ch, max(al) AS al, max(ah) AS ah, max(tl) AS tl, max(th) AS th,
               max(pname) AS pname, max(unit) AS unit,
               avg(v) AS v_avg, min(v) AS v_min, max(v) AS v_max, stddev_pop(v) AS v_std,
               max(v) - min(v) AS v_delta, count(*) AS n_rows, max(zone) AS zone,
               CASE max(CASE zone WHEN 'trip' THEN 2 WHEN 'alarm' THEN 1 ELSE 0 END)
                    WHEN 2 THEN 'trip' WHEN 1 THEN 'alarm' ELSE 'control' END AS zone_worst
        FROM telem GROUP BY param, w),
scored AS (SELECT *, CAST(epoch(w) AS BIGINT) AS window_start,
      greatest(0::DOUBLE, least(1::DOUBLE,
        (abs(v_avg - (cl + ch) / 2::DOUBLE) / greatest((ah - al) / 2::DOUBLE, 1e-9::DOUBLE)
          - 0.30::DOUBLE) / 0.85::DOUBLE
        + least(coalesce(v_std, 0::DOUBLE) / greatest((ah - al) / 2::DOUBLE, 1e-9::DOUBLE),
                0.5::DOUBLE) * 0.35::DOUBLE)) AS p_raw
      FROM win),
ev AS (SELECT 'evt-' || param || '-' || window_start AS event_id, param, asset, batch_id,
              window_start, w, round(v_avg + 1e-9::DOUBLE, 4) AS v_avg, v_min, v_max,
              round(v_std + 1e-9::DOUBLE, 4) AS v_std, round(v_delta + 1e-9::DOUBLE, 4) AS v_delta,
              n_rows, zone, zone_worst, round(p_raw + 1e-9::DOUBLE, 4) AS p_breach, top_driver,
              cl, ch, pname, unit
       FROM scored WHERE p_raw > 0.30::DOUBLE OR zone <> 'control')"""


WS = "[\\t-\\r\\x{1c}-\\x{20}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


def words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{WS}+'), lambda w: w <> '')"


PARAM_LIST = "['temp', 'ph', 'press', 'cond', 'hum']"

DOCUMENT_SOURCE = f"""
    SELECT ['sop', 'oem', 'deviation'][CAST(doc_id % 3 AS INT) + 1] || '/' || doc_id || '.txt' AS path,
           ['sop', 'oem', 'deviation'][CAST(doc_id % 3 AS INT) + 1] AS source_type,
           {PARAM_LIST}[CAST(doc_id % 6 AS INT) + 1] AS param, 'DOC-' || doc_id AS source_id, text
    FROM documents"""


def chunks_of(source: str, name: str = "chunks") -> str:
    """Chunks of (path, source_type, param, source_id, text) rows that have no blank lines:
    such a text is one paragraph, and only the hard cut is at work."""
    return f"""
{name}_w AS (SELECT *, regexp_replace(text, '^{WS}+|{WS}+$', '', 'g') AS body, {words('text')} AS ws
         FROM ({source})),
{name}_c AS (SELECT *, unnest(CASE WHEN len(ws) * 2 <= 660 THEN [CAST(0 AS BIGINT)] ELSE range(0, len(ws), 180) END) AS i
           FROM {name}_w WHERE len(ws) > 0),
{name} AS (SELECT source_id, source_type, param, CAST(i // 180 AS BIGINT) AS chunk_no,
      substr(sha1(path || '::' || (i // 180)), 1, 16) AS chunk_id,
      CASE WHEN len(ws) * 2 <= 660 THEN body ELSE array_to_string(ws[i + 1:i + 220], ' ') END AS text
      FROM {name}_c)"""


CHUNKS = chunks_of(DOCUMENT_SOURCE)

BUCKET = ("(256 * (" + " + ".join(
    f"('0x' || substr(md5(t), {4 * i + 1}, 4))::BIGINT" for i in range(7))
    + ") + ('0x' || substr(md5(t), 29, 4))::BIGINT) % 384")

RECORDS = f"""
records AS (
  SELECT 'capa' AS source_type, 'CAPA-' || o_orderkey AS source_id, {PARAM_LIST}[CAST(o_custkey % 5 AS INT) + 1] AS param,
         'A-' || (o_custkey % 7) AS asset, strftime(o_orderdate, '%Y-%m-%d') AS effective_date,
         'CAPA record CAPA-' || o_orderkey || ' for ' || {PARAM_LIST}[CAST(o_custkey % 5 AS INT) + 1] || ' on asset A-'
           || (o_custkey % 7) || ', opened ' || strftime(o_orderdate, '%Y-%m-%d') || '. Problem: Priority '
           || o_orderpriority || ' Root cause: Order status ' || o_orderstatus || ' Corrective action taken: Settled '
           || CAST(floor(o_totalprice) AS BIGINT) || ' Effectiveness: '
           || CASE WHEN o_orderkey % 4 <> 0 THEN 'Effective' ELSE 'None' END
           || '. Recurrence after action: none recorded.' AS text,
         substr(sha1('capa/capa_records.csv::CAPA-' || o_orderkey || '::' || o_orderkey), 1, 16) AS chunk_id
  FROM orders
  UNION ALL
  SELECT 'maintenance', 'WO-' || p_partkey, {PARAM_LIST}[CAST(p_partkey % 5 AS INT) + 1], 'A-' || (p_partkey % 7), NULL,
         'Maintenance work order WO-' || p_partkey || ' on A-' || (p_partkey % 7) || ' (' || p_name
           || ') completed None. Trigger: ' || p_type || '. Action: ' || p_brand || '. Findings: Size ' || p_size
           || '. Downtime: ' || p_size || ' minutes. Technician note: -',
         substr(sha1('capa/maintenance_log.csv::WO-' || p_partkey || '::' || p_partkey), 1, 16)
  FROM part
  UNION ALL
  SELECT 'batch', 'B-' || c_custkey, {PARAM_LIST}[CAST(c_custkey % 5 AS INT) + 1], NULL, NULL,
         'Batch record B-' || c_custkey || ' for molecule ' || c_mktsegment || ', phase Phase ' || c_nationkey
           || '. Parameter ' || {PARAM_LIST}[CAST(c_custkey % 5 AS INT) + 1] || ' held ' || c_name
           || ' with observed range ' || CAST(floor(c_acctbal) AS BIGINT) || '. Deviations: none. Disposition: Released.',
         substr(sha1('batch/batch_records.json::B-' || c_custkey || '::' || c_custkey), 1, 16)
  FROM customer)"""

# Over chunks(chunk_id, source_type, param, text).
INDEX_OF = f""",
tok AS (SELECT chunk_id, source_type, param, {words('lower(text)')} AS ts FROM chunks),
post AS (SELECT chunk_id, t AS term, count(*) AS tf
         FROM (SELECT chunk_id, unnest(ts) AS t FROM tok) GROUP BY ALL),
size AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM tok),
stats AS (SELECT term, count(*) AS df FROM post GROUP BY term),
idf AS (SELECT term, df, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS idf FROM stats, size),
bk AS (SELECT chunk_id, {BUCKET} AS bucket, count(*) AS n
       FROM (SELECT chunk_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM chunks)
       GROUP BY ALL),
nrm AS (SELECT chunk_id, sqrt(sum(n * n)) AS norm FROM bk GROUP BY chunk_id)"""

INDEX = CHUNKS + INDEX_OF

QUERIES = f""",
q AS (SELECT CAST(item_id AS VARCHAR) AS query_id, text, {PARAM_LIST}[CAST(item_id % 6 AS INT) + 1] AS qparam,
             CASE item_id % 4 WHEN 0 THEN ['sop'] WHEN 1 THEN ['oem', 'deviation']
                              WHEN 2 THEN ['deviation'] END AS qtypes FROM benchmark)"""

# Over the index and q(query_id, text, qparam, qtypes).
SEARCH_OF = f""",
qpost AS (SELECT query_id, t AS term, count(*) AS qn
          FROM (SELECT query_id, unnest({words('lower(text)')}) AS t FROM q) GROUP BY ALL),
lexm AS (SELECT query_id, chunk_id, sum(qn * (CASE WHEN idf.idf < 0 THEN 0.25::DOUBLE * (SELECT avg(idf) FROM idf) ELSE idf.idf END)
              * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(tok.ts) / (SELECT avgdl FROM size)))) AS lex
         FROM qpost JOIN idf USING (term) JOIN post USING (term) JOIN tok USING (chunk_id)
         GROUP BY query_id, chunk_id),
qb AS (SELECT query_id, {BUCKET} AS bucket, count(*) AS qn
       FROM (SELECT query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM q) GROUP BY ALL),
qnrm AS (SELECT query_id, sqrt(sum(qn * qn)) AS qnorm FROM qb GROUP BY query_id),
densem AS (SELECT query_id, chunk_id, sum(qn * n) / (any_value(norm) * any_value(qnorm)) AS dense
           FROM qb JOIN bk USING (bucket) JOIN nrm USING (chunk_id) JOIN qnrm USING (query_id)
           GROUP BY query_id, chunk_id),
pairs AS (SELECT q.query_id, tok.chunk_id,
                 (qparam IS NULL OR param IS NULL OR param = qparam)
                 AND (qtypes IS NULL OR list_contains(qtypes, source_type)) AS fits FROM q, tok),
cand AS (SELECT p.query_id, p.chunk_id, coalesce(lex, 0) AS lex, coalesce(dense, 0) AS dense
         FROM (SELECT *, bool_or(fits) OVER (PARTITION BY query_id) AS any_fits FROM pairs) p
         LEFT JOIN lexm USING (query_id, chunk_id) LEFT JOIN densem USING (query_id, chunk_id)
         WHERE fits OR NOT any_fits),
normed AS (SELECT query_id, chunk_id, lex, dense,
      (dense - min(dense) OVER w) / CASE WHEN max(dense) OVER w = min(dense) OVER w THEN 1 ELSE max(dense) OVER w - min(dense) OVER w END AS d,
      (lex - min(lex) OVER w) / CASE WHEN max(lex) OVER w = min(lex) OVER w THEN 1 ELSE max(lex) OVER w - min(lex) OVER w END AS l
      FROM cand WINDOW w AS (PARTITION BY query_id)),
hyb AS (SELECT *, round(0.6::DOUBLE * d + 0.4::DOUBLE * l, 9) AS score FROM normed),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS rank FROM hyb)"""

SEARCH = INDEX + QUERIES + SEARCH_OF


def mmr(top_k: int, pool: int) -> str:
    """Picks of every query from its pool, over a search; needs WITH RECURSIVE."""
    return f""",
pool AS MATERIALIZED (SELECT query_id, rank, chunk_id, score, coalesce(norm, 1e-9::DOUBLE) AS norm
         FROM ranked LEFT JOIN nrm USING (chunk_id) WHERE rank < {pool}),
pool_bk AS MATERIALIZED (SELECT query_id, rank, bucket, n FROM pool JOIN bk USING (chunk_id)),
dots AS (SELECT x.query_id, x.rank AS i, y.rank AS j, sum(x.n * y.n) AS dot
         FROM pool_bk x JOIN pool_bk y USING (query_id, bucket) GROUP BY ALL),
sims AS (SELECT p.query_id, p.rank AS i, o.rank AS j, coalesce(dot, 0) / (p.norm * o.norm) AS s
         FROM pool p JOIN pool o USING (query_id)
         LEFT JOIN dots d ON d.query_id = p.query_id AND d.i = p.rank AND d.j = o.rank),
sim_rows AS (SELECT query_id, i, list(s ORDER BY j) AS r FROM sims GROUP BY query_id, i),
sim_mats AS MATERIALIZED (SELECT query_id, list(r ORDER BY i) AS m, count(*) AS n FROM sim_rows GROUP BY query_id),
walk AS (
  SELECT query_id, m, [CAST(0 AS BIGINT)] AS picked, range(1, n) AS rest FROM sim_mats
  UNION ALL
  SELECT query_id, m, list_append(picked, best), list_filter(rest, lambda x: x <> best)
  FROM (SELECT *, rest[list_position(gain, list_max(gain))] AS best
        FROM (SELECT *, list_transform(rest, lambda x, i: 0.72::DOUBLE * (1::DOUBLE - (i - 1)::DOUBLE / len(rest))
                - (1::DOUBLE - 0.72::DOUBLE) * list_max(list_transform(picked, lambda y: m[x + 1][y + 1]))) AS gain
              FROM walk WHERE len(picked) < {top_k} AND len(rest) > 0))),
ends AS (SELECT query_id, arg_max(picked, len(picked)) AS picked FROM walk GROUP BY query_id),
picks AS (SELECT query_id, unnest(picked) AS spot, generate_subscripts(picked, 1) - 1 AS pick FROM ends),
hits AS (SELECT picks.query_id, pick AS rank, chunk_id, score FROM picks
         JOIN pool ON pool.query_id = picks.query_id AND pool.rank = picks.spot)"""



def with_ctes(ctes: str, body: str) -> str:
    return _attach(ctes, body)


def _attach(ctes: str, body: str) -> str:
    return f"WITH RECURSIVE {ctes}\n{body.strip()}"


def with_bands(body: str) -> str:
    return _attach(BANDS, body)


def with_telemetry(body: str) -> str:
    """`body` may begin with a comma and further expressions."""
    return _attach(TELEMETRY, body)


def with_events(body: str) -> str:
    return _attach(EVENTS, body)

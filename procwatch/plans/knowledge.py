"""Registered queries over the corpus, the index and search."""

import hashlib
import uuid

from pyspark.sql import functions as F

from procwatch.functions import chunking, text as tx
from procwatch.operators import corpus, index, search, vector_cells
from procwatch.plans import inputs, sql
from procwatch.plans.signals import NUDGE
from procwatch.session import file_system, materialize, session_dir

POOL = search.pool_size(6)


def _r(name, digits=6):
    return F.round(F.col(name) + F.lit(NUDGE), digits).alias(name)


def _documents(spark, sf_dir):
    return inputs.dealt(inputs.table(spark, sf_dir, "documents"), "doc_id")


# ---- text ---------------------------------------------------------------------

def tokenize_ws(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", F.explode(tx.tokens_ws(F.col("text"))).alias(
        "token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def tokenize_alnum(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", F.explode(tx.tokens_alnum(F.col("text"))).alias(
        "token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def hash_bucket(spark, sf_dir):
    seen = tokenize_alnum(spark, sf_dir).select("token")
    return seen.select("token", tx.hash_bucket(F.col("token")).alias("bucket"))


def snippet(spark, sf_dir):
    return inputs.document_chunks(spark, sf_dir).select(
        "chunk_id", tx.snippet(F.col("text")).alias("snippet"))


# ---- corpus -------------------------------------------------------------------

def hard_split_chunks(spark, sf_dir):
    """Whole documents through the chunker; without blank lines only the hard cut acts."""
    return inputs.document_chunks(spark, sf_dir).select(
        "source_id", F.element_at("extra", "chunk").cast("long").alias("chunk_no"),
        F.md5("text").alias("text_md5"), F.size(tx.words(F.col("text"))).alias("n_words"))


def chunk_id(spark, sf_dir):
    return inputs.document_chunks(spark, sf_dir).select(
        "chunk_id", "source_id", F.element_at("extra", "chunk").cast("long").alias("chunk_no"))


def chunk_text(spark, sf_dir):
    """Lines as paragraphs, so that paragraphs are packed greedily."""
    docs = inputs.described_documents(spark, sf_dir).drop("doc_id")
    return corpus.document_chunks(docs, separator="\n").select(
        "chunk_id", "source_id", F.array_join(tx.words(F.col("text")), " ").alias("words")).select(
        "chunk_id", "source_id", F.md5("words").alias("words_md5"))


def infer_source_type(spark, sf_dir):
    """Kinds of paths built from table values: folder and file name vary independently."""
    folders = F.array(*[F.lit(x) for x in ("data/capa", "data/Batch", "x/oem/y", "misc")])
    names = F.array(*[F.lit(x) for x in ("SOP-", "maintenance_log", "notes", "deviation.sop.")])
    paths = inputs.table(spark, sf_dir, "part").select("p_partkey", F.concat(
        F.get(folders, (F.col("p_partkey") % 4).cast("int")), F.lit("/"),
        F.get(names, (F.col("p_size") % 4).cast("int")), "p_name", F.lit(".md")).alias("path"))
    return paths.select("p_partkey", chunking.infer_source_type(F.col("path")).alias("source_type"))


def verbalize_rows(spark, sf_dir):
    return inputs.record_chunks(spark, sf_dir).select(
        "chunk_id", "source_type", "source_id", "title", "text", "param", "asset", "effective_date")


def _corpus(spark, sf_dir):
    return corpus.union_corpus(inputs.document_chunks(spark, sf_dir),
                               inputs.record_chunks(spark, sf_dir))


def corpus_union(spark, sf_dir):
    return _corpus(spark, sf_dir).select(
        "chunk_id", "source_type", "source_id", "param", F.col("structured").cast("int")
        .alias("structured"))


def corpus_stats(spark, sf_dir):
    return corpus.corpus_stats(_corpus(spark, sf_dir))


def corpus_append(spark, sf_dir):
    """Appending all records to a corpus that already holds the work orders and batches."""
    records = inputs.record_chunks(spark, sf_dir)
    grown = corpus.append_chunks(records.where(F.col("source_type") != "capa"), records)
    return grown.select("chunk_id", "source_type")


def front_matter(spark, sf_dir):
    """Documents written with a front-matter block made of their columns, and read back."""
    written = inputs.table(spark, sf_dir, "documents").select("doc_id", F.concat(
        F.lit("---\nid: DOC-"), F.col("doc_id").cast("string"), F.lit(" r1\nnote\ntitle: \"On: "),
        "source", F.lit("\"\nlang: "), "lang", F.lit("\n lang : '"), "lang", F.lit("'\n---\n\n"),
        "text").alias("text"))
    meta = chunking.front_matter(F.col("text"))
    return written.select(
        "doc_id", F.element_at(meta, "id").alias("id"), F.element_at(meta, "title").alias("title"),
        F.element_at(meta, "lang").alias("lang"), F.size(meta).alias("n_keys"),
        F.md5(chunking.body(F.col("text"))).alias("body_md5"))


# ---- index --------------------------------------------------------------------

def postings(spark, sf_dir):
    return index.chunk_postings(inputs.document_chunks(spark, sf_dir))


def _term_table(terms, size):
    n_chunks = F.lit(size["n_chunks"])
    return terms.select(
        "term", "df", _r_of(index.idf(F.col("df"), n_chunks), "idf"),
        n_chunks.alias("n_chunks"), _r_of(F.lit(size["avg_words"]), "avg_words"))


def term_stats(spark, sf_dir):
    """Counted in one pass from the chunks as they are made; the counts are stored, as they give the size, too."""
    counted = materialize(index.counted_terms(inputs.document_chunks(spark, sf_dir)), "counted-terms")
    size = counted.where("term IS NULL").agg(
        F.coalesce(F.sum("df"), F.lit(0)).alias("n_chunks"), (F.sum("n_words") / F.sum("df")).alias("avg_words"))
    return _term_table(counted.where("term IS NOT NULL"), size.first())


def index_append(spark, sf_dir):
    """Half of the documents indexed, then all appended: only the other half is counted anew."""
    chunks = materialize(inputs.document_chunks(spark, sf_dir), "chunks")  # used twice, cut once
    half = index.Index.of(chunks.where(F.col("source_type") != "oem"))
    grown = half.append(chunks)
    return _term_table(grown.terms, grown.size.first())


def index_retract(spark, sf_dir):
    """All documents indexed, procedures in an outdated wording and deviations a second time under
    other ids; then the wording is replaced and the second ones are taken out again."""
    chunks = materialize(inputs.document_chunks(spark, sf_dir), "chunks")  # used four times, cut once
    outdated = F.when(F.col("source_type") == "sop", F.concat(F.lit("superseded wording "), "text")).otherwise(F.col("text"))
    twice = chunks.where(F.col("source_type") == "deviation").withColumn("chunk_id", F.concat(F.lit("copy:"), "chunk_id"))
    first = index.Index.of(chunks.withColumn("text", outdated).unionByName(twice))
    right = first.replace(chunks.where(F.col("source_type") == "sop")).retract(twice)
    return _term_table(right.terms, right.size.first())


def _r_of(column, name, digits=6):
    return F.round(column + F.lit(NUDGE), digits).alias(name)


def hash_embeddings(spark, sf_dir):
    return index.chunk_vectors(inputs.document_chunks(spark, sf_dir)).select("chunk_id", "bucket", "n", _r("weight"))


def index_roundtrip(spark, sf_dir):
    """The index written to the shared folder, read back, and counted per chunk."""
    folder = f"{session_dir(spark)}/index-{uuid.uuid4().hex}"
    back = index.Index.store(inputs.document_chunks(spark, sf_dir), folder)
    joined = back.chunks.select("chunk_id", "source_type").join(
        back.entries.select("chunk_id", "n_words", F.size("terms").alias("n_terms"),
                            F.size("buckets").alias("n_buckets")), "chunk_id")
    return joined


# ---- search -------------------------------------------------------------------

def stored_index(spark, sf_dir, name, chunks):
    """The index of a corpus, written to the session's folder when it is first asked for."""
    folder = f"{session_dir(spark)}/index/{hashlib.md5(sf_dir.encode()).hexdigest()}/{name}"
    files, done = file_system(spark, f"{folder}/kinds/_SUCCESS")  # written last
    if not files.exists(done):
        return index.Index.store(chunks(), folder)
    return index.Index.read(spark, folder)


def _search_index(spark, sf_dir):
    return stored_index(spark, sf_dir, "documents", lambda: inputs.document_chunks(spark, sf_dir))


def query_candidates(spark, sf_dir):
    return search.candidate_counts(inputs.search_queries(spark, sf_dir),
                                   index.kind_counts(inputs.document_chunks(spark, sf_dir)))


def candidate_filter(spark, sf_dir):
    """Candidates and score ranges per query, as the first reading of the index gives them."""
    found = search.candidate_ranges(inputs.search_queries(spark, sf_dir), _search_index(spark, sf_dir))
    falls_back = F.col("n_cand") == 0

    def of(name):
        return F.when(falls_back, F.col(f"{name}_all")).otherwise(F.col(f"{name}_cand"))

    return found.select(
        "query_id", F.when(falls_back, F.col("n_all")).otherwise(F.col("n_cand")).alias("n"),
        *[_r_of(of(n), n) for n in ("dense_min", "dense_max", "lexical_min", "lexical_max")])


def bm25_scores(spark, sf_dir):
    hits = search.plain_scores(inputs.search_queries(spark, sf_dir),
                               _search_index(spark, sf_dir), "lexical", POOL)
    return hits.where("lexical > 0").select("query_id", "rank", "chunk_id", _r("lexical"))


def dense_scores(spark, sf_dir):
    hits = search.plain_scores(inputs.search_queries(spark, sf_dir),
                               _search_index(spark, sf_dir), "dense", POOL)
    return hits.where("dense > 0").select("query_id", "rank", "chunk_id", _r("dense"))


def _hits(spark, sf_dir, **options):
    return search.search(inputs.search_queries(spark, sf_dir), _search_index(spark, sf_dir),
                         **options)


def hybrid_scores(spark, sf_dir):
    """The whole re-ranking pool of each query with both parts of the score."""
    return _hits(spark, sf_dir, top_k=POOL, mmr=False).select(
        "query_id", "rank", "chunk_id", _r("score"), _r("dense"), _r("lexical"))


def topk_hybrid(spark, sf_dir):
    return _hits(spark, sf_dir, mmr=False).select("query_id", "rank", "chunk_id", _r("score"))


def mmr_rerank(spark, sf_dir):
    return _hits(spark, sf_dir).select("query_id", "rank", "chunk_id", _r("score"))


def _label_means(stored):
    means = (stored.select("label", F.posexplode("embedding").alias("i", "x"))
             .groupBy("label", "i").agg(F.avg("x").alias("x"))
             .groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))),
                                               lambda e: F.round(e["x"], 9)).alias("mean")))
    return means.withColumnRenamed("mean", "embedding")


def knn_cosine(spark, sf_dir):
    """The five vectors nearest to the mean vector of each label."""
    stored = inputs.table(spark, sf_dir, "embeddings")
    return search.nearest(stored, _label_means(stored), "vec_id", "embedding", "label", 5).select(
        F.col("query_id").alias("label"), "vec_id", "rank", _r("cosine"))


def knn_cells(spark, sf_dir):
    """The same from vectors stored in cells."""
    stored = inputs.table(spark, sf_dir, "embeddings")
    index = vector_cells.build(stored, "vec_id", "embedding", f"{session_dir(spark)}/cells-{uuid.uuid4().hex}")
    return vector_cells.nearest(index, _label_means(stored), "label", "embedding", 5, "vec_id").select(
        F.col("query_id").alias("label"), "vec_id", "rank", _r("cosine"))


QUERIES = {f.__name__: f for f in (
    tokenize_ws, tokenize_alnum, hash_bucket, snippet, hard_split_chunks, chunk_id, chunk_text,
    infer_source_type, verbalize_rows, corpus_union, corpus_stats, corpus_append, front_matter,
    postings, term_stats, index_append, index_retract, hash_embeddings, index_roundtrip, query_candidates, candidate_filter,
    bm25_scores, dense_scores, hybrid_scores, topk_hybrid, mmr_rerank, knn_cosine, knn_cells)}

_SUFFIX = "round({0} + 1e-9::DOUBLE, 6) AS {1}"
ORACLES = {
    "tokenize_ws": f"""
        SELECT t AS token, count(*) AS n FROM (SELECT unnest({sql.words('lower(text)')}) AS t
        FROM documents) GROUP BY t""",
    "tokenize_alnum": """
        SELECT t AS token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t
        FROM documents) GROUP BY t""",
    "hash_bucket": f"""
        SELECT t AS token, CAST({sql.BUCKET} AS INT) AS bucket
        FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM documents)""",
    "snippet": sql.with_ctes(sql.CHUNKS, "SELECT chunk_id, left(text, 600) AS snippet FROM chunks"),
    "hard_split_chunks": sql.with_ctes(sql.CHUNKS, f"""
        SELECT source_id, chunk_no, md5(text) AS text_md5,
               len({sql.words('text')}) AS n_words FROM chunks"""),
    "chunk_id": sql.with_ctes(
        sql.CHUNKS, "SELECT chunk_id, source_id, chunk_no FROM chunks"),
    "chunk_text": f"""
        WITH RECURSIVE w AS (
          SELECT doc_id, {sql.words('text')} AS ws, list_filter(list_transform(string_split(text, chr(10)),
                 lambda x: len({sql.words('x')})), lambda n: n > 0) AS paras FROM documents),
        p AS (SELECT doc_id, unnest(paras) AS n, generate_subscripts(paras, 1) AS k FROM w),
        a AS (SELECT *, CAST(sum(n) OVER (PARTITION BY doc_id ORDER BY k) AS BIGINT) AS upto,
                     max(k) OVER (PARTITION BY doc_id) AS last FROM p),
        -- the open chunk holds words first..upto; a paragraph that does not fit closes it
        r AS (SELECT doc_id, k, CAST(0 AS BIGINT) AS first, upto, CAST(NULL AS BIGINT) AS from_, CAST(NULL AS BIGINT) AS to_
              FROM a WHERE k = 1
              UNION ALL
              SELECT a.doc_id, a.k,
                     CASE WHEN r.upto - r.first + a.n > 220 THEN greatest(r.first, r.upto - 40) ELSE r.first END, a.upto,
                     CASE WHEN r.upto - r.first + a.n > 220 THEN r.first END,
                     CASE WHEN r.upto - r.first + a.n > 220 THEN r.upto END
              FROM r JOIN a ON a.doc_id = r.doc_id AND a.k = r.k + 1),
        c AS (SELECT doc_id, from_, to_ FROM r WHERE to_ IS NOT NULL
              UNION ALL SELECT r.doc_id, r.first, r.upto FROM r JOIN a USING (doc_id, k) WHERE k = last),
        s AS (SELECT doc_id, from_, to_, unnest(CASE WHEN (to_ - from_) * 2 <= 660 THEN [CAST(0 AS BIGINT)]
                     ELSE range(0, to_ - from_, 180) END) AS i FROM c),
        n AS (SELECT doc_id, from_, CASE WHEN (to_ - from_) * 2 <= 660 THEN to_ ELSE least(to_, from_ + i + 220) END AS until,
                     i, row_number() OVER (PARTITION BY doc_id ORDER BY from_, to_, i) - 1 AS chunk_no FROM s)
        SELECT substr(sha1(['sop', 'oem', 'deviation'][CAST(doc_id % 3 AS INT) + 1] || '/' || doc_id || '.txt::' || chunk_no), 1, 16) AS chunk_id,
               'DOC-' || doc_id AS source_id, md5(array_to_string(ws[from_ + i + 1:until], ' ')) AS words_md5
        FROM n JOIN w USING (doc_id)""",
    "infer_source_type": """
        SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'sop' WHEN 1 THEN 'maintenance' WHEN 3 THEN 'deviation'
          ELSE CASE p_partkey % 4 WHEN 0 THEN 'capa' WHEN 1 THEN 'batch' WHEN 2 THEN 'oem'
                                  ELSE 'document' END END AS source_type FROM part""",
    "verbalize_rows": sql.with_ctes(sql.RECORDS, """
        SELECT chunk_id, source_type, source_id, upper(source_type) || ' ' || source_id AS title, text,
               param, asset, effective_date FROM records"""),
    "corpus_union": sql.with_ctes(sql.CHUNKS + "," + sql.RECORDS, """
        SELECT chunk_id, source_type, source_id, param, 0 AS structured FROM chunks
        UNION ALL SELECT chunk_id, source_type, source_id, param, 1 FROM records"""),
    "corpus_stats": sql.with_ctes(sql.CHUNKS + "," + sql.RECORDS, """
        , u AS (SELECT source_type, 0 AS s FROM chunks UNION ALL SELECT source_type, 1 FROM records)
        SELECT source_type, count(*) AS total, CAST(sum(s) AS BIGINT) AS structured,
               CAST(sum(1 - s) AS BIGINT) AS unstructured FROM u GROUP BY source_type
        UNION ALL SELECT 'all', count(*), CAST(sum(s) AS BIGINT), CAST(sum(1 - s) AS BIGINT) FROM u"""),
    "corpus_append": sql.with_ctes(sql.RECORDS, "SELECT chunk_id, source_type FROM records"),
    "front_matter": f"""
        SELECT doc_id, 'DOC-' || doc_id || ' r1' AS id, 'On: ' || source AS title, lang, 3 AS n_keys,
               md5(regexp_replace(text, '^{sql.WS}+|{sql.WS}+$', '', 'g')) AS body_md5 FROM documents""",
    "postings": sql.with_ctes(sql.INDEX, "SELECT chunk_id, term, tf FROM post"),
    **dict.fromkeys(("term_stats", "index_append", "index_retract"), sql.with_ctes(sql.INDEX, f"""
        SELECT term, df, {_SUFFIX.format('idf', 'idf')}, n AS n_chunks,
               {_SUFFIX.format('avgdl', 'avg_words')} FROM idf, size""")),
    "hash_embeddings": sql.with_ctes(sql.INDEX, f"""
        SELECT chunk_id, bucket, n, {_SUFFIX.format('n / norm', 'weight')} FROM bk JOIN nrm USING (chunk_id)"""),
    "index_roundtrip": sql.with_ctes(sql.INDEX, """
        SELECT chunk_id, source_type, len(ts) AS n_words, len(list_distinct(ts)) AS n_terms,
               coalesce(b.n_buckets, 0) AS n_buckets
        FROM tok LEFT JOIN (SELECT chunk_id, count(*) AS n_buckets FROM bk GROUP BY chunk_id) b USING (chunk_id)"""),
    "query_candidates": sql.with_ctes(sql.SEARCH, """
        SELECT query_id, count(*) FILTER (fits) AS n_candidates,
               CASE WHEN bool_or(fits) THEN 0 ELSE 1 END AS falls_back FROM pairs GROUP BY query_id"""),
    "candidate_filter": sql.with_ctes(sql.SEARCH, f"""
        SELECT query_id, count(*) AS n, {_SUFFIX.format('min(dense)', 'dense_min')},
               {_SUFFIX.format('max(dense)', 'dense_max')}, {_SUFFIX.format('min(lex)', 'lexical_min')},
               {_SUFFIX.format('max(lex)', 'lexical_max')} FROM cand GROUP BY query_id"""),
    "bm25_scores": sql.with_ctes(sql.SEARCH, f"""
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(lex, 9) DESC, chunk_id) - 1 AS rank,
               chunk_id, {_SUFFIX.format('lex', 'lexical')}
        FROM lexm JOIN pairs USING (query_id, chunk_id) WHERE fits QUALIFY rank < 24"""),
    "dense_scores": sql.with_ctes(sql.SEARCH, f"""
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(dense, 9) DESC, chunk_id) - 1 AS rank,
               chunk_id, {_SUFFIX.format('dense', 'dense')}
        FROM densem JOIN pairs USING (query_id, chunk_id) WHERE fits QUALIFY rank < 24"""),
    "hybrid_scores": sql.with_ctes(sql.SEARCH, f"""
        SELECT query_id, rank, chunk_id, {_SUFFIX.format('score', 'score')}, {_SUFFIX.format('d', 'dense')},
               {_SUFFIX.format('l', 'lexical')} FROM ranked WHERE rank < 24"""),
    "topk_hybrid": sql.with_ctes(sql.SEARCH, f"""
        SELECT query_id, rank, chunk_id, {_SUFFIX.format('score', 'score')} FROM ranked WHERE rank < 6"""),
    "mmr_rerank": sql.with_ctes(sql.SEARCH + sql.mmr(6, 24), f"""
        SELECT query_id, rank, chunk_id, {_SUFFIX.format('score', 'score')} FROM hits"""),
    "knn_cosine": """
        WITH u AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i
                   FROM embeddings),
        m AS (SELECT label AS l, i, round(avg(x), 9) AS y FROM u GROUP BY ALL),
        n AS (SELECT l, sqrt(sum(y * y)) AS ny FROM m GROUP BY l),
        v AS (SELECT vec_id, sqrt(sum(x * x)) AS nx FROM u GROUP BY vec_id),
        d AS (SELECT l AS label, vec_id, round(sum(x * y) / (any_value(nx) * any_value(ny)), 9) AS c
              FROM u JOIN m USING (i) JOIN n USING (l) JOIN v USING (vec_id) GROUP BY l, vec_id)
        SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY c DESC, vec_id) - 1 AS rank,
               round(c + 1e-9::DOUBLE, 6) AS cosine FROM d QUALIFY rank < 5""",
}
ORACLES["knn_cells"] = ORACLES["knn_cosine"]

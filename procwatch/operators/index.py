"""The search index: per chunk its term counts and its hashed vector."""

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from procwatch import fixed_values as fv
from procwatch.session import materialize

INDEX_SCHEMA = ("chunk_id string, param string, source_type string, n_words int, "
                "terms array<string>, term_counts array<int>, "
                "buckets array<int>, bucket_counts array<int>, norm double")
_BATCH_BYTES = 8 << 20  # of lower-case text that are tokens at a time
_HELD_TOKENS = 1 << 18  # whose buckets a task remembers
_TO_ALNUM = np.array([b if chr(b) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for b in range(256)], np.uint8)


def _count_per_row(rows: np.ndarray, codes: np.ndarray, n_codes: int, n_rows: int):
    """(distinct codes, their counts) of each row: flat arrays plus list offsets."""
    keys, counts = np.unique(rows * n_codes + codes, return_counts=True)
    per_row = np.bincount(keys // n_codes, minlength=n_rows) if len(keys) else np.zeros(n_rows, int)
    offsets = np.concatenate([[0], np.cumsum(per_row)]).astype(np.int32)
    return keys % n_codes, counts, offsets


def _alnum(texts: pa.Array) -> pa.Array:
    """The texts with a blank for every byte that is none of a-z and 0-9."""
    _, offsets, content = texts.buffers()
    mapped = _TO_ALNUM[np.frombuffer(content, np.uint8)] if content is not None else np.zeros(0, np.uint8)
    return pa.StringArray.from_buffers(len(texts), offsets, pa.py_buffer(mapped), offset=texts.offset)


def _tokens(split: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row of each token, code of each token, token of each code)."""
    flat, rows = pc.list_flatten(split), pc.list_parent_indices(split)
    whole = pc.not_equal(flat, "")
    encoded = flat.filter(whole).dictionary_encode()
    return (rows.filter(whole).to_numpy().astype(np.int64),
            encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary)


def _pieces(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Rows of at most some `_BATCH_BYTES` of text, and their texts, so that a task holds few tokens."""
    for batch in batches:
        texts = pc.fill_null(batch.column(text), "").cast(pa.string())
        upto = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
        edges = np.flatnonzero(np.diff(upto // _BATCH_BYTES, prepend=0)).tolist()
        for at, end in zip([0, *edges], [*edges, batch.num_rows]):
            if end > at:
                yield batch.slice(at, end - at), texts.slice(at, end - at)


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Tokens between white space; what Arrow splits at is `WHITE_SPACE`."""
    return _tokens(pc.utf8_split_whitespace(texts))


def _bucket(token: str, size: int) -> int:
    return int.from_bytes(hashlib.md5(token.encode()).digest()) % size


def _bucket_counts(texts: pa.Array, size: int, known: dict[str, int]):
    """Buckets of each row, their counts, list offsets, and the rows' norms; hashes no `known` token again."""
    rows, codes, tokens = _tokens(pc.ascii_split_whitespace(_alnum(texts)))
    if len(known) > _HELD_TOKENS:
        known.clear()
    bucket_of = np.array([known[t] if t in known else known.setdefault(t, _bucket(t, size))
                          for t in tokens.to_pylist()], dtype=np.int64)
    bucket, n, at = _count_per_row(rows, bucket_of[codes] if len(codes) else codes, size, len(texts))
    squares = np.bincount(np.repeat(np.arange(len(texts)), np.diff(at)),
                          weights=n.astype(float) ** 2, minlength=len(texts))
    return bucket, n, at, np.maximum(np.sqrt(squares), fv.MIN_NORM)


def count_batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Counts for batches of (chunk_id, param, source_type, lower-case text)."""
    def lists(values, offsets):
        items = values if isinstance(values, pa.Array) else pa.array(values.astype(np.int32))
        return pa.ListArray.from_arrays(pa.array(offsets), items)

    known: dict[str, int] = {}
    for batch, texts in _pieces(batches, 3):
        rows, codes, words = _words(texts)
        term, term_n, term_at = _count_per_row(rows, codes, max(len(words), 1), len(texts))
        bucket, bucket_n, bucket_at, norm = _bucket_counts(texts, size, known)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2),
             pa.array(np.bincount(rows, minlength=len(texts)).astype(np.int32)),
             lists(words.take(pa.array(term)), term_at), lists(term_n, term_at),
             lists(bucket, bucket_at), lists(bucket_n, bucket_at), pa.array(norm)],
            names=["chunk_id", "param", "source_type", "n_words", "terms", "term_counts",
                   "buckets", "bucket_counts", "norm"])


def index_chunks(chunks: DataFrame, size: int = fv.VECTOR_SIZE) -> DataFrame:
    """Term counts and hashed vector of each chunk, counted where the chunk lies: no shuffle."""
    texts = chunks.select("chunk_id", "param", "source_type", F.lower("text").alias("text"))
    return texts.mapInArrow(lambda batches: count_batches(batches, size), INDEX_SCHEMA)


def postings(index: DataFrame) -> DataFrame:
    """(chunk_id, term, tf), one row per distinct term of a chunk."""
    return index.select("chunk_id", F.explode(F.arrays_zip("terms", "term_counts")).alias("t")).select(
        "chunk_id", F.col("t.terms").alias("term"), F.col("t.term_counts").alias("tf"))


def vectors(index: DataFrame) -> DataFrame:
    """(chunk_id, bucket, n, weight), one row per occupied bucket; weights have unit length."""
    return index.select("chunk_id", "norm",
                        F.explode(F.arrays_zip("buckets", "bucket_counts")).alias("b")).select(
        "chunk_id", F.col("b.buckets").alias("bucket"), F.col("b.bucket_counts").alias("n"),
        (F.col("b.bucket_counts") / F.col("norm")).alias("weight"))


def _per_chunk(chunks: DataFrame, counts: Callable, columns: str) -> DataFrame:
    """One row per chunk and what `counts` finds in its lower-case text, without the other counts.

    `counts` takes texts and gives the row of each result and the results' columns.
    """
    names = [c.split()[0] for c in columns.split(", ")]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _pieces(batches, 1):
            rows, *found = counts(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *found], names=["chunk_id", *names])

    texts = chunks.select("chunk_id", F.lower("text").alias("text"))
    return texts.mapInArrow(task, f"chunk_id string, {columns}")


def chunk_postings(chunks: DataFrame) -> DataFrame:
    """`postings` of chunks that are not indexed: no vector is made."""
    def counts(texts: pa.Array) -> tuple:
        rows, codes, words = _words(texts)
        term, n, at = _count_per_row(rows, codes, max(len(words), 1), len(texts))
        return (np.repeat(np.arange(len(texts)), np.diff(at)), words.take(pa.array(term)), pa.array(n.astype(np.int32)))

    return _per_chunk(chunks, counts, "term string, tf int")


def chunk_vectors(chunks: DataFrame, size: int = fv.VECTOR_SIZE) -> DataFrame:
    """`vectors` of chunks that are not indexed: no term is counted."""
    def counts(texts: pa.Array) -> tuple:
        bucket, n, at, norm = _bucket_counts(texts, size, {})
        rows = np.repeat(np.arange(len(texts)), np.diff(at))
        return (rows, pa.array(bucket.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(n / norm[rows]))

    return _per_chunk(chunks, counts, "bucket int, n int, weight double")


def counted_terms(chunks: DataFrame) -> DataFrame:
    """(term, df, n_words) in one pass over the chunks, added up in tasks first. The row without a term
    has the number of chunks and that of their words; the others have no words."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _pieces(batches, 0):
            rows, codes, words = _words(texts)
            term, _, _ = _count_per_row(rows, codes, max(len(words), 1), len(texts))
            df = np.append(np.bincount(term, minlength=len(words)), len(texts))
            n_words = np.append(np.zeros(len(words), np.int64), len(rows))
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([words.cast(pa.string()), pa.nulls(1, pa.string())]), pa.array(df.astype(np.int64)),
                 pa.array(n_words)], names=["term", "df", "n_words"])

    return (chunks.select(F.lower("text").alias("text")).mapInArrow(task, "term string, df long, n_words long")
            .groupBy("term").agg(F.sum("df").alias("df"), F.sum("n_words").alias("n_words")))


def dense_vector(size: int = fv.VECTOR_SIZE) -> Column:
    """The unit vector of an index row as array<float>, for stores that want it dense."""
    filled = F.map_from_arrays("buckets", "bucket_counts")
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (
        F.coalesce(F.element_at(filled, i), F.lit(0)) / F.col("norm")).cast("float"))


def term_stats(index: DataFrame) -> DataFrame:
    """(term, df): the number of chunks that hold each term.

    The counts combine map-side, so a term found everywhere is no hot key.
    """
    return index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def corpus_size(index: DataFrame) -> DataFrame:
    """One row: number of chunks and their mean length in words."""
    return index.agg(F.count(F.lit(1)).alias("n_chunks"), F.avg("n_words").alias("avg_words"))


def kind_counts(chunks: DataFrame) -> DataFrame:
    """Chunks per parameter and source type."""
    return chunks.groupBy("param", "source_type").agg(F.count(F.lit(1)).alias("n"))


def idf(df: Column, n_chunks: Column) -> Column:
    return F.log(n_chunks - df + F.lit(0.5)) - F.log(df + F.lit(0.5))


_TABLES = ("chunks", "entries", "terms", "size", "kinds")


@dataclass(frozen=True)
class Index:
    """An index and the statistics searches need: one row for the corpus, one per term, one per
    parameter and source type. Entries are stored by source type, so that searches for some types
    read their files only."""

    chunks: DataFrame
    entries: DataFrame
    terms: DataFrame
    size: DataFrame
    kinds: DataFrame

    @classmethod
    def of(cls, chunks: DataFrame) -> "Index":
        """Index chunks. Counts are written once, as every search reads them again."""
        entries = materialize(index_chunks(chunks), "entries", "source_type")
        return cls(chunks, entries, materialize(term_stats(entries), "terms"),
                   materialize(corpus_size(entries), "size"), materialize(kind_counts(entries), "kinds"))

    @classmethod
    def store(cls, chunks: DataFrame, folder: str) -> "Index":
        """Index chunks in `folder`. They are written first and indexed as written, so that they are
        made once, and each part is written once, where it stays."""
        spark, path = chunks.sparkSession, folder.rstrip("/")
        chunks.write.mode("overwrite").parquet(f"{path}/chunks")
        written = spark.read.schema(chunks.schema).parquet(f"{path}/chunks")
        index_chunks(written).write.mode("overwrite").partitionBy("source_type").parquet(f"{path}/entries")
        entries = spark.read.schema(INDEX_SCHEMA).parquet(f"{path}/entries")
        for name, counts in (("terms", term_stats), ("size", corpus_size), ("kinds", kind_counts)):
            counts(entries).write.mode("overwrite").parquet(f"{path}/{name}")
        return cls.read(spark, folder)

    def append(self, chunks: DataFrame) -> "Index":
        """The index with the chunks it does not hold yet: only these are counted, and their
        counts are added to the stored ones."""
        new = materialize(chunks.join(self.entries.select("chunk_id"), "chunk_id", "left_anti"), "new-chunks")
        entries = materialize(index_chunks(new), "entries", "source_type")
        return Index(self.chunks.unionByName(new), self.entries.unionByName(entries), *self._counts_with(entries, 1))

    def retract(self, chunk_ids: DataFrame) -> "Index":
        """The index without the chunks named in `chunk_id`; ids that it does not hold change nothing.

        Only the chunks that go are looked at: their counts are taken off the stored ones, and
        terms and kinds that nothing is left of go too. Their ids are kept as tombstones that reads
        leave out, so no file of the index is rewritten; `write` stores what is left.
        """
        asked = chunk_ids.select("chunk_id").where(F.col("chunk_id").isNotNull()).distinct()
        gone = materialize(self.entries.join(asked, "chunk_id", "left_semi"), "retracted")
        tombstones = materialize(gone.select("chunk_id").distinct(), "tombstones")
        return Index(self.chunks.join(tombstones, "chunk_id", "left_anti").select(*self.chunks.columns),
                     self.entries.join(tombstones, "chunk_id", "left_anti").select(*self.entries.columns),
                     *self._counts_with(gone, -1))

    def replace(self, chunks: DataFrame) -> "Index":
        """The index with these chunks in place of those of the same ids; new ids are added."""
        return self.retract(chunks).append(chunks)

    def _counts_with(self, entries: DataFrame, sign: int) -> list[DataFrame]:
        """Terms, size and kinds after entries come (1) or go (-1): signed counts are added up."""
        def summed(old: DataFrame, more: DataFrame, keys: list[str], n: str) -> DataFrame:
            signed = more.withColumn(n, F.col(n) * F.lit(sign))
            return old.unionByName(signed).groupBy(*keys).agg(F.sum(n).alias(n)).where(F.col(n) > 0)

        words = F.col("n_chunks") * F.coalesce("avg_words", F.lit(0.0))
        change = corpus_size(entries).withColumn("n_chunks", F.col("n_chunks") * F.lit(sign))
        sums = self.size.unionByName(change).agg(F.sum("n_chunks").alias("n_chunks"), F.sum(words).alias("_words"))
        size = sums.select("n_chunks", F.when(
            F.col("n_chunks") > 0, F.round("_words") / F.col("n_chunks")).alias("avg_words"))
        return [materialize(summed(self.terms, term_stats(entries), ["term"], "df"), "terms"),
                materialize(size, "size"),
                materialize(summed(self.kinds, kind_counts(entries), ["param", "source_type"], "n"), "kinds")]

    def write(self, folder: str) -> None:
        """Store chunks, entries and statistics; searches then read instead of counting."""
        for name in _TABLES:
            writer = getattr(self, name).write.mode("overwrite")
            if name == "entries":
                writer = writer.partitionBy("source_type")
            writer.parquet(f"{folder.rstrip('/')}/{name}")

    @classmethod
    def read(cls, spark: SparkSession, folder: str) -> "Index":
        tables = {name: spark.read.parquet(f"{folder.rstrip('/')}/{name}") for name in _TABLES if name != "entries"}
        # the source type is a folder's name, so its kind is given
        tables["entries"] = spark.read.schema(INDEX_SCHEMA).parquet(f"{folder.rstrip('/')}/entries")
        return cls(**tables)

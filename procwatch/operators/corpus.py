"""Documents and records as one corpus of citable chunks."""

from pyspark.sql import Column, DataFrame, functions as F

from procwatch import fixed_values as fv
from procwatch.functions import chunking, text as tx
from procwatch.operators import ordering

COLUMNS = ["chunk_id", "text", "source_type", "source_id", "title", "param", "asset",
           "effective_date", "structured", "extra"]

# kind -> (template, id column)
RECORD_KINDS = {
    "capa": (fv.CAPA_TEMPLATE, "capa_id"),
    "maintenance": (fv.MAINTENANCE_TEMPLATE, "wo_id"),
    "batch": (fv.BATCH_TEMPLATE, "batch_id"),
}


def describe_documents(docs: DataFrame) -> DataFrame:
    """(path, text) rows with the metadata of their front matter or their path."""
    meta = chunking.front_matter(F.col("text"))
    name = F.substring_index("path", "/", -1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")

    def field(key: str) -> Column:
        return F.nullif(F.element_at("_meta", key), F.lit(""))

    return docs.withColumn("_meta", meta).select(
        "path", chunking.body(F.col("text")).alias("text"),
        F.coalesce(field("type"), chunking.infer_source_type(F.col("path"))).alias("source_type"),
        F.coalesce(field("id"), stem).alias("source_id"),
        F.coalesce(field("title"), F.replace(stem, F.lit("_"), F.lit(" "))).alias("title"),
        F.element_at("_meta", "param").alias("param"),
        F.element_at("_meta", "asset").alias("asset"),
        F.element_at("_meta", "effective").alias("effective_date"))


def document_chunks(docs: DataFrame, size: int = fv.CHUNK_WORDS, overlap: int = fv.CHUNK_OVERLAP,
                    separator: str = chunking.PARAGRAPH_BREAK) -> DataFrame:
    """Chunks of described documents; one document in, its chunks out, no shuffle."""
    split = chunking.chunk_text(F.col("text"), size, overlap, separator)
    cut = docs.select(*[c for c in docs.columns if c != "text"],
                      F.posexplode(split).alias("chunk_no", "text"))
    number = F.col("chunk_no").cast("string")
    return cut.select(
        tx.hashed_id(F.col("path"), number).alias("chunk_id"), "text", "source_type",
        "source_id", "title", "param", "asset", "effective_date",
        F.lit(False).alias("structured"),
        F.create_map(F.lit("path"), F.col("path"), F.lit("chunk"), number).alias("extra"))


def verbalize(rows: DataFrame, kind: str) -> Column:
    """The sentence of a record; a kind without a template gives its JSON."""
    if kind in RECORD_KINDS:
        return tx.fill_template(RECORD_KINDS[kind][0], rows.columns)
    return F.to_json(F.struct(*rows.columns))


def record_chunks(rows: DataFrame, kind: str, path: str, position: str | None = None) -> DataFrame:
    """One chunk per record.

    `position` names a column that is unique in the file. Without one, records
    that are alike in all columns are told apart by a copy number.
    """
    def text_column(*names: str) -> Column:
        found = [F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in rows.columns]
        return F.coalesce(*found, F.lit(None).cast("string"))

    records = rows.drop(position) if position else rows
    known = rows.select(
        verbalize(records, kind).alias("text"),
        (F.col(RECORD_KINDS[kind][1]).cast("string") if kind in RECORD_KINDS
         else F.lit(None).cast("string")).alias("_id"),
        text_column("parameter", "param").alias("param"), text_column("asset").alias("asset"),
        text_column("completed", "opened").alias("effective_date"),
        F.to_json(F.struct(*records.columns)).alias("_row"),
        *([F.col(position).cast("string").alias("_position")] if position else []))
    if not position:
        alike = known.withColumn("_alike", F.md5("_row"))
        known = ordering.number_copies(alike, ["_alike"], "_copy").withColumn(
            "_position", F.concat_ws("-", "_alike", F.col("_copy").cast("string")))
    stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    source_id = F.coalesce("_id", F.concat(F.lit(f"{stem}-"), F.col("_position"))
                           if kind not in RECORD_KINDS else F.lit("None"))
    return known.withColumn("source_id", source_id).select(
        tx.hashed_id(F.lit(path), F.col("source_id"), F.col("_position")).alias("chunk_id"),
        "text", F.lit(kind).alias("source_type"), "source_id",
        F.concat(F.lit(f"{kind.upper()} "), F.col("source_id")).alias("title"),
        "param", "asset", "effective_date", F.lit(True).alias("structured"),
        F.create_map(F.lit("row"), F.col("_row"), F.lit("path"),
                     F.lit(path.rsplit("/", 1)[-1])).alias("extra"))


def union_corpus(*parts: DataFrame) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def append_chunks(corpus: DataFrame, new: DataFrame) -> DataFrame:
    """The corpus with the chunks it does not hold yet; repeating it changes nothing."""
    return corpus.unionByName(new.join(corpus.select("chunk_id"), "chunk_id", "left_anti"))


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """Chunks per source type and family, with the grand total as type `all`.

    One pass: the totals are rolled up from the per-type counts.
    """
    return chunks.rollup("source_type").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("structured").alias("structured"),
        F.count_if(~F.col("structured")).alias("unstructured")).withColumn(
        "source_type", F.coalesce("source_type", F.lit("all")))

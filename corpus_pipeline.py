"""The corpus pipeline: five stages, from raw documents to files of token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next one's documents. All but the last keep the columns of documents.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession

from procwatch.llm import language, leaks, mixing, neardup, token_files
from procwatch.llm.inputs import table
from procwatch.llm.token_files_query import tokenizer_path
from procwatch.session import prepare, session_dir


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows; those that it rejects go.

    Rejected: texts without a letter, and those whose best language is less likely than the
    model's threshold. `lang` keeps the label that a document came with.
    """
    prepare(spark)
    judged = language.predict(docs, language.fit(docs))
    return judged.where("NOT rejected").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return neardup.without_near_copies(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no item of the benchmark leaks."""
    prepare(spark)
    return leaks.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, up to three times."""
    prepare(spark)
    return mixing.mixed_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files, as read back: per document its place, length and checksum."""
    prepare(spark)
    return token_files.token_table(docs, tokenizer_path())


STAGES = [("language", identify_language), ("near copies", drop_near_copies), ("leaks", drop_leaks),
          ("mixing", mix_sources), ("tokens", write_tokens)]

# A trained model, sampled bands and a tokenizer have no SQL; tests hold the stages against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; the result of the last one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{session_dir(spark)}/stage-{name.replace(' ', '-')}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

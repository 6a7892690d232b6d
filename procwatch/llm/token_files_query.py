"""The query of the token files. SQL has no tokenizer; tests hold it against a plain loop."""

from pyspark.sql import DataFrame, SparkSession

from procwatch.llm import token_files
from procwatch.llm.inputs import table


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_table(table(spark, sf_dir, "documents"), tokenizer_path())


QUERIES = {"op8_token_files": op8_token_files}
ORACLES: dict[str, str] = {}

"""Reading the test tables, and values that live as long as a Python worker."""

import sys
import types
from collections.abc import Callable, Hashable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def kept_in_worker(key: Hashable, make: Callable):
    """The value made for `key` by an earlier task of this Python worker, or a new one."""
    kept = sys.modules.setdefault("procwatch_worker", types.ModuleType("procwatch_worker"))
    if not hasattr(kept, "values"):
        kept.values = {}
    if key not in kept.values:
        kept.values[key] = make()
    return kept.values[key]


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with as many underscores before it as no column of `df` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def numbered_columns(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """`df` with its columns named by their place, so that no working column has the name of one,
    and the new name of each."""
    names = {c: f"_own{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names

"""Latest rows and keyed last-write-wins."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

PER_PARAM = 240
BREACHES = 200
AUDIT_ROWS = 1000


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
                   n: int = PER_PARAM) -> DataFrame:
    """The latest `n` rows of each key. `order` is newest first.

    Spark cuts each task's rows to `n` per key before the shuffle (window group
    limit), so a key with most of the rows costs tasks x n rows, no more.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).where(F.col("_rn") <= n).drop("_rn")


def latest_overall(df: DataFrame, order: Sequence[Column], n: int = BREACHES) -> DataFrame:
    """The latest `n` rows of all, newest first: a top-n, no total sort."""
    return df.orderBy(*order).limit(n)


def last_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Last write wins: one row per key."""
    return latest_per_key(df, keys, order, 1)

"""Scores of predictions and shares of importances."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from procwatch.operators import ordering
from procwatch.session import materialize


def _ratio(top: Column, bottom: Column) -> Column:
    """0 where the ratio is undefined."""
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top / F.when(bottom == 0, 1).otherwise(bottom))


def classification_metrics(df: DataFrame, label: str, score: str, by: Sequence[str],
                           threshold: float = 0.5) -> DataFrame:
    """Accuracy, precision and recall at `threshold` from one pass of counts."""
    said = F.when(F.col(score) >= threshold, 1).otherwise(0)
    counts = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(said == F.col(label), 1).otherwise(0)).alias("right"),
        F.sum(said).alias("said"),
        F.sum(F.col(label)).alias("actual"),
        F.sum(said * F.col(label)).alias("hits"))
    return counts.select(
        *by, "n", (F.col("right") / F.col("n")).alias("accuracy"),
        _ratio(F.col("hits"), F.col("said")).alias("precision"),
        _ratio(F.col("hits"), F.col("actual")).alias("recall"))


def roc_auc(df: DataFrame, label: str, score: str, by: Sequence[str]) -> DataFrame:
    """Area under the ROC curve per group; ties count half, null with a single class.

    Rows are first combined per distinct score, then one running count of the
    negatives below each score gives the rank sum.
    """
    per_score = materialize(df.groupBy(*by, score).agg(
        F.sum(F.col(label).cast("long")).alias("_pos"),
        F.sum(1 - F.col(label).cast("long")).alias("_neg")), "per-score")
    below = ordering.running_total(per_score, list(by), [score], "_neg", "_below")
    sums = below.groupBy(*by).agg(
        F.sum(F.col("_pos") * (F.col("_below") + F.col("_neg") / F.lit(2.0))).alias("_won"),
        F.sum("_pos").alias("_p"), F.sum("_neg").alias("_n"))
    pairs = (F.col("_p") * F.col("_n")).cast("double")
    return sums.select(*by, F.when(pairs > 0, F.col("_won") / F.when(pairs > 0, pairs).otherwise(1.0))
                       .alias("auc"))


def importance_shares(df: DataFrame, importance: str, by: Sequence[str], digits: int = 4,
                      nudge: float = 0.0) -> DataFrame:
    """Each importance as a share of its group's total (a total of 0 counts as 1).

    One row per feature, so a group is as wide as a feature list.
    """
    total = F.sum(importance).over(Window.partitionBy(*by))
    share = F.col(importance) / F.when(total == 0, F.lit(1.0)).otherwise(total)
    return df.withColumn("share", F.round(share + F.lit(nudge), digits))


def mean_absolute(df: DataFrame, feature: str, contribution: str, by: Sequence[str]) -> DataFrame:
    """Mean absolute contribution per feature, an importance."""
    return df.groupBy(*by, feature).agg(F.avg(F.abs(F.col(contribution))).alias("importance"))

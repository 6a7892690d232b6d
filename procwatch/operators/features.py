"""Rolling features, the forward-looking label, and the training set."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from procwatch import fixed_values as fv
from procwatch.functions import bands
from procwatch.operators import ordering
from procwatch.session import materialize


def _rolling(window: Window, value: str, features: Sequence[str], rows: int) -> dict[str, Column]:
    """Trailing aggregates over one frame; null until every column has `rows` values."""
    frame = window.rowsBetween(-(rows - 1), 0)
    full = F.lit(True)
    for c in (value, *features):
        full = full & (F.count(c).over(frame) == rows)
    columns = {
        "v_avg": F.avg(value).over(frame),
        "v_std": F.stddev_pop(value).over(frame),
        "v_delta": F.max(value).over(frame) - F.min(value).over(frame),
        "_full": full,
    }
    columns.update({f"{c}_mean": F.avg(c).over(frame) for c in features})
    return columns


def _label(window: Window, breach: str, horizon: int, incomplete: Column) -> dict[str, Column]:
    """Any breach in the next `horizon` rows; the tail without a full horizon is `incomplete`."""
    ahead = F.max(breach).over(window.rowsBetween(1, horizon))
    whole = F.count(F.lit(1)).over(window.rowsBetween(0, horizon - 1)) == horizon
    return {"label": F.when(whole, F.coalesce(ahead, F.lit(0))).otherwise(incomplete)}


def rolling_features(df: DataFrame, order: Sequence[str], value: str = "value",
                     features: Sequence[str] = (), rows: int = fv.ROLLING_ROWS,
                     key: str = "param", **limits: int) -> DataFrame:
    """Trailing mean, spread and range, and the mean of each feature (`<feature>_mean`).

    All columns share one window, so one sort. Rows without a full frame are dropped.
    `order` names columns that order the rows of a key completely.
    """
    out = ordering.framed(df, [key], order, rows - 1, 0,
                          lambda w: _rolling(w, value, features, rows), **limits)
    return out.where("_full").drop("_full")


def forward_label(df: DataFrame, dim: DataFrame, order: Sequence[str], value: str = "value",
                  horizon: int = fv.HORIZON_ROWS, drop_incomplete: bool = False,
                  **limits: int) -> DataFrame:
    """1 where the value leaves the control band within the next `horizon` rows.

    The last horizon - 1 rows of a parameter get 0 whatever follows, or are
    dropped with `drop_incomplete`.
    """
    marked = _mark(df, dim, value)
    out = ordering.framed(marked, ["param"], order, 0, horizon,
                          lambda w: _label(w, "_breach", horizon, _tail(drop_incomplete)), **limits)
    return out.where(F.col("label").isNotNull()).drop("_breach")


def training_set(df: DataFrame, dim: DataFrame, order: Sequence[str], value: str = "value",
                 features: Sequence[str] = (), rows: int = fv.ROLLING_ROWS,
                 horizon: int = fv.HORIZON_ROWS, drop_incomplete: bool = False,
                 **limits: int) -> DataFrame:
    """Rolling features and label from a single pass over the ordered rows."""
    marked = _mark(df, dim, value)
    out = ordering.framed(
        marked, ["param"], order, rows - 1, horizon,
        lambda w: {**_rolling(w, value, features, rows),
                   **_label(w, "_breach", horizon, _tail(drop_incomplete))}, **limits)
    return out.where(F.col("_full") & F.col("label").isNotNull()).drop("_breach", "_full")


def windowed_training_set(windows: DataFrame, dim: DataFrame, horizon: int = fv.HORIZON_ROWS,
                          **limits: int) -> DataFrame:
    """A training set from tumbling windows, the ones the stream scores, labelled
    by whether a later window's mean leaves the control band."""
    kept = windows.select("param", "window_start", "v_avg", "v_std", "v_delta")
    return forward_label(kept, dim, ["window_start"], "v_avg", horizon, **limits)


def _mark(df: DataFrame, dim: DataFrame, value: str) -> DataFrame:
    joined = bands.with_bands(df, dim)
    return joined.select(*df.columns, bands.breach_now(F.col(value)).cast("int").alias("_breach"))


def _tail(drop: bool) -> Column:
    return F.lit(None).cast("int") if drop else F.lit(0)


def key_hash(*key: str) -> Column:
    """15 hex digits of the MD5 of the key columns joined by ':'."""
    return F.substring(F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in key])), 1, 15)


def stratified_split(df: DataFrame, key: Sequence[str], strata: Sequence[str],
                     share: float = fv.TEST_SHARE, digits: int = 4) -> DataFrame:
    """Add `split`: in each stratum the `share` of rows with the smallest key hash is 'test'.

    The cut row of a stratum is found from counts per hash prefix (at most
    16**digits per stratum) and a ranking of the rows with the cut's prefix alone.
    The rows themselves are then compared with it where they lie: no shuffle of
    `df`, however large a stratum is. `key` must be unique within a stratum.
    """
    hashed = df.select(*strata, *key, key_hash(*key).alias("_h")).withColumn(
        "_p", F.substring("_h", 1, digits))
    counts = hashed.groupBy(*strata, "_p").agg(F.count(F.lit(1)).alias("_n"))
    stratum = Window.partitionBy(*strata)
    quota = F.floor(F.sum("_n").over(stratum) * F.lit(share) + F.lit(0.5))
    prefixes = (counts.withColumns({"_to": F.sum("_n").over(stratum.orderBy("_p")),
                                    "_quota": quota})
                .where((F.col("_to") >= F.col("_quota"))
                       & (F.col("_to") - F.col("_n") < F.col("_quota")))
                .select(*strata, "_p",
                        (F.col("_quota") - F.col("_to") + F.col("_n")).alias("_take")))
    # one row per stratum; written, so that Spark knows its size when it plans the joins
    near = hashed.join(materialize(prefixes, "cut-prefixes"), [*strata, "_p"])
    ranked = near.withColumn("_rank", F.row_number().over(stratum.orderBy("_h", *key)))
    cuts = ranked.where(F.col("_rank") == F.col("_take")).select(
        *strata, F.struct("_h", *key).alias("_cut"))
    placed = df.withColumn("_h", key_hash(*key)).join(
        materialize(cuts, "cuts"), [*strata], "left")
    test = F.coalesce(F.struct("_h", *key) <= F.col("_cut"), F.lit(False))
    return placed.withColumn("split", F.when(test, "test").otherwise("train")).select(
        *df.columns, "split")


def class_counts(df: DataFrame, label: str = "label", *by: str) -> DataFrame:
    """Rows, distinct classes and positive share per group."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct(label).alias("n_classes"),
        F.avg(label).alias("positive_rate"))

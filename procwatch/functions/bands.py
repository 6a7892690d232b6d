"""The parameter dimension and the expressions that need its bands."""

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from procwatch import fixed_values as fv

_DIMENSION_TYPES = pa.schema([
    *[(c, pa.string()) for c in ("param", "name", "short", "unit", "asset")],
    *[(f"{band}_{end}", pa.float64())
      for band in ("control", "alarm", "trip") for end in ("lo", "hi")],
    ("baseline", pa.float64()),
    ("features", pa.list_(pa.string())),
    *[(c, pa.string()) for c in ("primary_driver", "root_cause", "model", "value_column")],
])


def dimension(spark: SparkSession) -> DataFrame:
    """One row per monitored parameter: always five rows, so safe to broadcast."""
    rows = []
    for p in fv.PARAMETERS:
        row = {"param": p["id"]}
        for key, value in p.items():
            if key in ("control", "alarm", "trip"):
                row[f"{key}_lo"], row[f"{key}_hi"] = value
            elif key != "id":
                row[key] = value
        rows.append(row)
    return spark.createDataFrame(pa.Table.from_pylist(rows, schema=_DIMENSION_TYPES))


def with_bands(df: DataFrame, dim: DataFrame, *extra: str) -> DataFrame:
    """Left join on `param`; readings of an unknown parameter keep null bands."""
    bands = [f"{b}_{e}" for b in ("control", "alarm", "trip") for e in ("lo", "hi")]
    return df.join(F.broadcast(dim.select("param", *bands, *extra)), "param", "left")


def control_centre() -> Column:
    return (F.col("control_lo") + F.col("control_hi")) / F.lit(2.0)


def half_alarm() -> Column:
    return F.greatest((F.col("alarm_hi") - F.col("alarm_lo")) / F.lit(2.0),
                      F.lit(fv.MIN_HALF_WIDTH))


def _outside(value: Column, band: str) -> Column:
    return (value < F.col(f"{band}_lo")) | (value > F.col(f"{band}_hi"))


def _at_or_outside(value: Column, band: str) -> Column:
    return (value <= F.col(f"{band}_lo")) | (value >= F.col(f"{band}_hi"))


def zone(value: Column, inclusive: bool = False) -> Column:
    """Operating zone of one reading.

    Strict (default): a reading on a limit is still inside and the inner zone is
    `control`. Inclusive: a reading on a limit is outside and the inner zone is
    `normal`, as on the live display.
    """
    out, inner = (_at_or_outside, "normal") if inclusive else (_outside, "control")
    return (F.when(out(value, "trip"), "trip")
            .when(out(value, "alarm"), "alarm")
            .otherwise(inner))


def traffic_flag(zone_col: Column) -> Column:
    return F.when(zone_col == "trip", "RED").when(zone_col == "alarm", "AMBER").otherwise("GREEN")


def severity(zone_col: Column) -> Column:
    return F.when(zone_col == "trip", 2).when(zone_col == "alarm", 1).otherwise(0)


def zone_of_severity(level: Column) -> Column:
    return F.when(level == 2, "trip").when(level == 1, "alarm").otherwise("control")


def breach_now(value: Column) -> Column:
    """Reading outside the control band; a missing reading is no breach."""
    return F.coalesce(_outside(value, "control"), F.lit(False))


def breach_direction(value: Column) -> Column:
    return F.when(value > F.col("control_hi"), "above").otherwise("below")


def normalized_deviation(value: Column) -> Column:
    return (value - control_centre()) / half_alarm()


def pdm_score(v_avg: Column, v_std: Column) -> Column:
    """Breach score in [0, 1] from a window's mean and spread.

    Needs the band columns; an unknown parameter or a missing mean scores 0.
    """
    deviation = F.abs(v_avg - control_centre()) / half_alarm()
    volatility = F.least(F.coalesce(v_std, F.lit(0.0)) / half_alarm(), F.lit(fv.VOLATILITY_CAP))
    raw = ((deviation - F.lit(fv.SCORE_OFFSET)) / F.lit(fv.SCORE_SPAN)
           + volatility * F.lit(fv.VOLATILITY_WEIGHT))
    known = v_avg.isNotNull() & F.col("control_lo").isNotNull()
    return F.when(known, F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))).otherwise(F.lit(0.0))


def why_drivers(n: int = 3) -> Column:
    """The first `n` features of the parameter, given as the reason of a breach."""
    return F.slice(F.col("features"), 1, n)

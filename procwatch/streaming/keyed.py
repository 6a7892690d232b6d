"""Streams with state of their own per parameter: windows that do not wait for silent parameters,
and rolling features as readings arrive.

Spark keeps one watermark for a stream, so a parameter that lags behind another loses rows, or
one that falls silent holds all windows open. Here each parameter is a key with its own newest
reading and its own timer. The state is small (open windows, or the last few rows) and lies in
the query's checkpoint, so a query that is started again goes on where it stopped. For many keys
set spark.sql.streaming.stateStore.providerClass to Spark's RocksDB provider before the start.

The rows of a key in one micro-batch are handled by one task, in Arrow batches; their number is
bounded by the source's limit per trigger.
"""

import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from procwatch import fixed_values as fv
from procwatch.functions import bands
from procwatch.operators import breach
from procwatch.streaming.breaches import EVERY, write_batch

IDLE = "10 seconds"
_OPEN = ("param string, start long, n_rows long, v_avg double, v_min double, v_max double, v_std double, "
         "asset string, batch_id string, zone string, severity int")
_STATE = "content binary"


def micros(interval: str) -> int:
    """Microseconds of an interval such as '10 seconds'."""
    return int(pd.Timedelta(interval) / pd.Timedelta(microseconds=1))


def _largest(a: str | None, b: str | None) -> str | None:
    return max((x for x in (a, b) if x is not None), default=None)


class _Window:
    """Aggregates of one window, merged in any order."""

    def __init__(self, content: dict | None = None) -> None:
        self.rows = self.values = 0
        self.mean = self.square = 0.0
        self.low, self.high, self.severity = np.inf, -np.inf, None
        self.names: list[str | None] = [None] * 3
        vars(self).update(content or {})

    def add(self, part: pd.DataFrame) -> None:
        values = part["value"].dropna().to_numpy(float)
        self.rows += len(part)
        if len(values):
            mean, n = values.mean(), self.values + len(values)
            apart = mean - self.mean
            self.square += ((values - mean) ** 2).sum() + apart ** 2 * self.values * len(values) / n
            self.mean += apart * len(values) / n
            self.values = n
            self.low, self.high = min(self.low, values.min()), max(self.high, values.max())
        for i, column in enumerate(("asset", "batch_id", "zone")):
            self.names[i] = _largest(self.names[i], part[column].dropna().max() if part[column].notna().any() else None)
        worst = part["severity"].max()
        if worst == worst and worst is not None:
            self.severity = int(worst) if self.severity is None else max(self.severity, int(worst))

    def row(self, param: str, start: int) -> tuple:
        some = self.values > 0
        return (param, start, self.rows, self.mean if some else None, self.low if some else None,
                self.high if some else None, float(np.sqrt(self.square / self.values)) if some else None,
                *self.names, self.severity)


def windows_per_parameter(readings: DataFrame, size: str = fv.WINDOW_SIZE, delay: str = fv.WATERMARK,
                          idle: str = IDLE) -> DataFrame:
    """Tumbling windows as `breach.window_aggregates` gives them, closed by parameter.

    A window is closed when a reading of its parameter is `delay` past its end, or when its
    parameter has sent nothing for `idle` of processing time. Readings of closed windows are
    dropped. Readings without parameter or time take no part. Needs no watermark.
    """
    width, late = micros(size), micros(delay)
    wait = max(1, micros(idle) // 1000)
    columns = [c.split()[0] for c in _OPEN.split(", ")]

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stored, newest, closed = pickle.loads(bytes(state.get[0])) if state.exists else ({}, None, None)
        windows = {start: _Window(content) for start, content in stored.items()}
        if state.hasTimedOut:
            ready = sorted(windows)
        else:
            for frame in frames:
                newest = max(int(frame["at"].max()), newest if newest is not None else int(frame["at"].max()))
                for start, part in frame.groupby(frame["at"] // width * width):
                    if closed is None or start >= closed:
                        windows.setdefault(int(start), _Window()).add(part)
            ready = sorted(s for s in windows if s + width <= newest - late)
        if ready:
            closed = max(ready[-1] + width, closed or 0)
            yield pd.DataFrame([windows.pop(s).row(key[0], s) for s in ready], columns=columns)
        state.update((pickle.dumps(({start: vars(w) for start, w in windows.items()}, newest, closed)),))
        if windows:
            state.setTimeoutDuration(wait)

    rows = readings.where(F.col("param").isNotNull() & F.col("ts").isNotNull()).select(
        "param", F.unix_micros("ts").alias("at"), "value", "asset", "batch_id", "zone",
        bands.severity(F.col("zone")).alias("severity"))
    found = rows.groupBy("param").applyInPandasWithState(
        update, _OPEN, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
    return found.select(
        "param", F.timestamp_micros("start").alias("window_start"),
        F.timestamp_micros(F.col("start") + width).alias("window_end"), "asset", "batch_id", "v_avg", "v_min", "v_max",
        "v_std", (F.col("v_max") - F.col("v_min")).alias("v_delta"), "n_rows", "zone",
        bands.zone_of_severity(F.col("severity")).alias("zone_worst"))


def start(readings: DataFrame, dim: DataFrame, folder: str, checkpoint: str, size: str = fv.WINDOW_SIZE,
          delay: str = fv.WATERMARK, idle: str = IDLE, threshold: float = fv.BREACH_THRESHOLD,
          trigger: dict | None = None) -> StreamingQuery:
    """The breach query with its outputs below `folder`, its windows closed by parameter."""
    scored = breach.score_windows(windows_per_parameter(readings, size, delay, idle), dim)
    return (scored.writeStream.outputMode("append").foreachBatch(write_batch(folder, threshold))
            .option("checkpointLocation", checkpoint).trigger(**(trigger or EVERY)).start())


def online_rolling(readings: DataFrame, order: Sequence[str], value: str = "value", features: Sequence[str] = (),
                   rows: int = fv.ROLLING_ROWS, key: str = "param") -> DataFrame:
    """`features.rolling_features` of a stream: one row per reading, as soon as it arrives.

    The state of a key is its last `rows` - 1 readings. Readings of a micro-batch are put in
    order of `order`; one that does not come after all that were there before is dropped, and
    so is a reading without a key or a part of its order. Readings without a full frame of
    values give no row, as in the batch way.
    """
    columns, order = [value, *features], list(order)
    types = {f.name: f.dataType.simpleString() for f in readings.schema}
    results = ["v_avg", "v_std", "v_delta", *[f"{c}_mean" for c in features]]
    schema = ", ".join([f"{c} {types[c]}" for c in (key, *order)] + [f"{c} double" for c in results])

    def update(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tail, last = pickle.loads(bytes(state.get[0])) if state.exists else (np.zeros((0, len(columns))), None)
        new = pd.concat(list(frames)).sort_values(order, kind="stable").drop_duplicates(order)
        if last is not None:
            new = new[[tuple(r) > last for r in new[order].itertuples(index=False, name=None)]]
        if not len(new):
            return
        held = np.concatenate([tail, new[columns].to_numpy(float)])
        state.update((pickle.dumps((held[max(len(held) - rows + 1, 0):], tuple(new[order].iloc[-1]))),))
        if len(held) < rows:
            return
        frame = np.lib.stride_tricks.sliding_window_view(held, rows, axis=0)  # one frame per last row
        whole = ~np.isnan(frame).any(axis=(1, 2))
        out = new[order].iloc[len(new) - len(frame):].reset_index(drop=True)
        out.insert(0, key, name[0])
        main = frame[:, 0]
        out["v_avg"], out["v_std"], out["v_delta"] = main.mean(1), main.std(1), main.max(1) - main.min(1)
        for i, c in enumerate(features):
            out[f"{c}_mean"] = frame[:, i + 1].mean(1)
        yield out[whole]

    known = readings.select(key, *order, *[F.col(c).cast("double").alias(c) for c in columns]).dropna(subset=[key, *order])
    return known.groupBy(key).applyInPandasWithState(update, schema, _STATE, "append", GroupStateTimeout.NoTimeout)

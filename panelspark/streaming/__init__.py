"""Bars from ticks and trailing signals, in batch and in streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def bars(ticks: DataFrame, *, every: str = "1 hour", ts: str = "ts", key: str = "inst", value: str = "value", late: str | None = None) -> DataFrame:
    """(inst, ts, open, high, low, close, volume) per window.  For a stream give ``late``, how long rows may lag."""
    rows = ticks.withWatermark(ts, late) if late else ticks
    grouped = rows.groupBy(F.window(ts, every).alias("w"), F.col(key).alias("inst"))
    out = grouped.agg(
        F.min_by(value, ts).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, ts).alias("close"), F.sum(value).alias("volume")
    )
    return out.select("inst", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def trailing_stream(rows: DataFrame, signal, *, lookback: int, output: str = "signal") -> DataFrame:
    """A trailing signal over a stream of (inst, t, value), one row out per row in, dates in order per instrument.

    State is the last ``lookback`` values of an instrument; ``signal`` gets them with the new one, oldest first."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        new = pd.concat(list(frames)).sort_values("t")
        out = []
        for v in new["value"]:
            held = [*held[-lookback:], float(v) if v is not None else float("nan")] if lookback else [float(v)]
            out.append(signal(np.array(held)))
        state.update((held,))
        yield pd.DataFrame({"inst": key[0], "t": new["t"], output: out})

    kind = rows.schema["inst"].dataType.simpleString()
    grouped = rows.select("inst", F.col("t").cast("long").alias("t"), F.col("value").cast("double").alias("value")).groupBy("inst")
    return grouped.applyInPandasWithState(run, f"inst {kind}, t long, {output} double", "held array<double>", "append", GroupStateTimeout.NoTimeout)


def cross_section_stream(rows: DataFrame, signal, *, instruments: int, output: str = "signal") -> DataFrame:
    """A signal across the instruments of a date over a stream of (t, inst, value): a date's rows come out once it is complete,
    that is when ``instruments`` rows of it are there.

    State is what an open date has so far; ``signal`` gets all values of the date, NaN where missing.  A further row of a date
    that has come out is an error of the source and raises."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        inst, value = state.get if state.exists else ([], [])
        new = pd.concat(list(frames))
        if value and not inst:
            raise ValueError(f"date {key[0]} has more than {instruments} rows")
        inst, value = [*inst, *new["inst"]], [*value, *new["value"].astype(float)]
        if len(inst) > instruments:
            raise ValueError(f"date {key[0]} has more than {instruments} rows")
        if len(inst) == instruments:
            state.update(([], [0.0]))  # a mark that the date has come out
            yield pd.DataFrame({"t": key[0], "inst": inst, output: signal(np.array(value))})
        else:
            state.update((inst, value))

    kind = rows.schema["inst"].dataType.simpleString()
    grouped = rows.select(F.col("t").cast("long").alias("t"), "inst", F.col("value").cast("double").alias("value")).groupBy("t")
    return grouped.applyInPandasWithState(run, f"t long, inst {kind}, {output} double", f"inst array<{kind}>, value array<double>", "append", GroupStateTimeout.NoTimeout)

"""Structured Streaming: windows and open runs over events."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Count and sum by window and type; rows later than the watermark are left out."""
    out = events.withWatermark(ts, late).groupBy(F.window(ts, width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "1 hour", slide: str = "15 minutes", late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    out = events.withWatermark(ts, late).groupBy(F.window(ts, width, slide), "event_type").agg(F.avg("value").alias("mean"))
    return out.select(F.col("window.start").alias("start"), "event_type", "mean")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Spells of a user's events without a pause of `gap`."""
    out = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), "user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "total")


def once(events: DataFrame, key: str = "event_id", late: str = "1 hour", ts: str = "ts") -> DataFrame:
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def open_runs(days: DataFrame, threshold: float, least: int, late: int = 0) -> DataFrame:
    """Runs of days above a threshold as they close: cell, start, end, length.

    days: cell, t_idx, v.  A cell's days up to its newest less `late` are settled: they may come in any order
    before that, and are left out after it.  A run closes when a later day is settled.  The state of a cell is
    its open run and the hot days of the last `late`; cells are those of a grid, so states are not timed out.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, last, settled, waiting = state.get if state.exists else (-1, -1, None, [])
        part = pd.concat(list(frames))
        t, v = part["t_idx"].to_numpy("int64"), part["v"].to_numpy("float64", na_value=np.nan)
        newest = int(t.max()) - late if settled is None else max(settled, int(t.max()) - late)
        fresh = t[(v > threshold) & (t > (t.min() - 1 if settled is None else settled))]
        hot = np.unique(np.concatenate([np.asarray(waiting, "int64"), fresh]))
        now, waiting = hot[hot <= newest], hot[hot > newest]
        cuts = np.flatnonzero(np.diff(now) > 1) + 1
        runs = [(int(r[0]), int(r[-1])) for r in np.split(now, cuts) if len(r)]
        if start >= 0:
            runs = [(start, runs[0][1]), *runs[1:]] if runs and runs[0][0] == last + 1 else [(start, last), *runs]
        start, last = runs.pop() if runs and runs[-1][1] == newest else (-1, -1)
        state.update((start, last, newest, [int(x) for x in waiting]))
        out = [(key[0], a, b, b - a + 1) for a, b in runs if b - a + 1 >= least]
        yield pd.DataFrame(out, columns=["cell", "start", "end", "length"])

    kept = "start long, last long, settled long, waiting array<long>"
    return days.groupBy("cell").applyInPandasWithState(step, "cell long, start long, end long, length long", kept, "append", GroupStateTimeout.NoTimeout)

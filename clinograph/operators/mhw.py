"""Marine heatwaves: climatology and threshold by calendar slot, events, metrics."""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .extremes import join_gaps, runs

Keys = Sequence[str]

#: Slot of 29 February in years of 366 slots.
LEAP_SLOT = 59


def slots_of_record(t: np.ndarray, slot: np.ndarray, year: np.ndarray, v: np.ndarray, base: tuple[int, int], half: int, q: float, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slot, mean, q-quantile) over every value at most `half` steps from a base day of the slot; NaN is missing."""
    order = np.argsort(t)
    t, slot, year, v = t[order], slot[order], year[order], v[order]
    inside = (year >= base[0]) & (year <= base[1])
    centres = np.flatnonzero(inside & (slot != LEAP_SLOT))
    if not len(centres) or (~np.isnan(v[inside])).sum() < least * inside.sum():
        return np.zeros(0, np.int32), np.zeros(0), np.zeros(0)
    centres = centres[np.argsort(slot[centres], kind="stable")]
    wanted = t[centres][:, None] + np.arange(-half, half + 1)
    at = np.minimum(np.searchsorted(t, wanted), len(t) - 1)
    near = np.where(t[at] == wanted, v[at], np.nan)
    slots, first, count = np.unique(slot[centres], return_index=True, return_counts=True)
    table = np.full((len(slots), count.max(), 2 * half + 1), np.nan)
    row = np.repeat(np.arange(len(slots)), count)
    table[row, np.arange(len(centres)) - first[row]] = near
    values = np.sort(table.reshape(len(slots), -1), axis=1)  # missing ones come last
    there = (~np.isnan(values)).sum(1)
    slots, values, there = slots[there > 0], values[there > 0], there[there > 0]
    place = (there - 1) * q
    low = np.floor(place).astype(int)
    below, above = (values[np.arange(len(slots)), np.minimum(k, there - 1)] for k in (low, low + 1))
    mean, quantile = np.nansum(values, axis=1) / there, below + (place - low) * (above - below)
    beside = np.isin(slots, (LEAP_SLOT - 1, LEAP_SLOT + 1))
    if beside.sum() == 2:
        slots, mean, quantile = np.append(slots, LEAP_SLOT), np.append(mean, mean[beside].mean()), np.append(quantile, quantile[beside].mean())
    return slots.astype(np.int32), mean, quantile


def slot_climatology(days: DataFrame, keys: Keys, base: tuple[int, int], half: int = 5, q: float = 0.9, least: float = 0.5) -> DataFrame:
    """seas and thresh by slot, from every day at most `half` days of the whole record from a base day.

    days: keys, t_idx, slot, year, v on a complete axis.  29 February takes the mean of its
    neighbours.  A key needs `least` of its base days.  A key's days go through one exchange and are
    one group, decades of days at most; its windows are made in arrays, not as rows.
    """
    keys = list(keys)
    kinds = ", ".join(f"`{c}` {days.schema[c].dataType.simpleString()}" for c in keys)

    def of_key(table: pa.Table) -> pa.Table:
        t, slot, year, v = (pc.cast(table.column(c), kind).to_numpy() for c, kind in (("t_idx", pa.int64()), ("slot", pa.int64()), ("year", pa.int64()), ("v", pa.float64())))
        slots, seas, thresh = slots_of_record(t, slot, year, v, base, half, q, least)
        own = {c: pa.chunked_array([table.column(c).chunk(0).slice(0, 1)]).take(pa.array(np.zeros(len(slots), np.int64))) for c in keys}
        return pa.table(own | {"slot": slots, "seas": seas, "thresh": thresh})

    return days.select(*keys, "t_idx", "slot", "year", F.col("v").cast("double").alias("v")).groupBy(*keys).applyInArrow(of_key, f"{kinds}, slot int, seas double, thresh double")


def smooth_slots(clim: DataFrame, keys: Keys, columns: Sequence[str] = ("seas", "thresh"), width: int = 31, slots: int = 366) -> DataFrame:
    """Running mean over slots that goes round the year's end; needs every slot."""
    half = width // 2
    copies = clim.withColumn("turn", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn("place", F.col("slot") + F.col("turn") * slots)
    copies = copies.where(F.col("place").between(-half, slots - 1 + half))
    w = Window.partitionBy(*keys).orderBy("place").rowsBetween(-half, half)
    out = copies.select(*keys, "slot", "turn", *(F.when(F.count(c).over(w) == width, F.avg(c).over(w)).alias(c) for c in columns))
    return out.where("turn = 0").drop("turn")


def events(days: DataFrame, keys: Keys, least: int = 5, gap: int = 2) -> DataFrame:
    """start, end of events on days (keys, t_idx, v, seas, thresh): runs of `least` days first, then gaps joined."""
    spells = runs(days, keys, F.col("v") > F.col("thresh")).where(F.col("length") >= least)
    return join_gaps(spells, keys, gap)


def event_metrics(days: DataFrame, found: DataFrame, keys: Keys) -> DataFrame:
    """Duration, intensities, category, onset and decline of each event.

    A missing day counts as the climatology.  Rates reach half a day beyond the event, or to its
    edge where the record ends.
    """
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("t_idx")
    last = F.max("t_idx").over(Window.partitionBy(*keys))
    rel = F.coalesce(F.col("v") - F.col("seas"), F.lit(0.0))
    level = F.try_divide(F.col("v") - F.col("thresh"), F.col("thresh") - F.col("seas"))
    rows = days.withColumn("rel", rel).withColumn("level", level).withColumn("before", F.lag("rel").over(w)).withColumn("after", F.lead("rel").over(w)).withColumn("last", last)
    inside = found.withColumn("t_idx", F.explode(F.sequence("start", "end"))).join(rows, [*keys, "t_idx"])
    m = inside.groupBy(*keys, "event", "start", "end").agg(
        F.count(F.lit(1)).alias("duration"), F.max("rel").alias("intensity_max"), F.avg("rel").alias("intensity_mean"), F.stddev_pop("rel").alias("intensity_var"), F.sum("rel").alias("intensity_cumulative"),
        F.max("level").alias("level"), F.min_by("t_idx", F.struct((-F.col("rel")).alias("a"), F.col("t_idx").alias("b"))).alias("peak"),
        F.min_by("rel", "t_idx").alias("rel_s"), F.max_by("rel", "t_idx").alias("rel_e"), F.min_by("before", "t_idx").alias("before"), F.max_by("after", "t_idx").alias("after"), F.max("last").alias("last"))
    up, down, top = F.col("peak") - F.col("start"), F.col("end") - F.col("peak"), F.col("intensity_max")
    onset = F.when(F.col("start") > 0, (top - 0.5 * (F.col("rel_s") + F.col("before"))) / (up + 0.5)).otherwise((top - F.col("rel_s")) / F.greatest(up, F.lit(1)))
    decline = F.when(F.col("end") < F.col("last"), (top - 0.5 * (F.col("rel_e") + F.col("after"))) / (down + 0.5)).otherwise((top - F.col("rel_e")) / F.greatest(down, F.lit(1)))
    return m.withColumn("category", F.least(F.floor(1 + F.col("level")), F.lit(4)).cast("int")).withColumn("rate_onset", onset).withColumn("rate_decline", decline).drop("level", "peak", "rel_s", "rel_e", "before", "after", "last")


def cell_metrics(metrics: DataFrame, days: DataFrame, keys: Keys) -> DataFrame:
    """Frequency, means and maxima of event metrics and the share of heatwave days of each valid key.

    Without events the frequency, share and category are 0 and the means NULL.
    """
    keys = list(keys)
    valid = days.groupBy(*keys).agg(F.count_distinct("year").alias("years"), F.count(F.lit(1)).alias("n_days"), F.count("thresh").alias("ok")).where("ok > 0")
    m = metrics.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("duration").alias("duration_mean"), F.max("intensity_max").alias("intensity_max_max"), F.avg("intensity_mean").alias("intensity_mean_mean"), F.avg("intensity_cumulative").alias("intensity_cumulative_mean"), F.avg("rate_onset").alias("rate_onset_mean"), F.avg("rate_decline").alias("rate_decline_mean"), F.max("category").alias("category_max"), F.sum("duration").alias("hw_days"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return valid.join(m, keys, "left").select(*keys, (zero("n") / F.col("years")).alias("frequency"), "duration_mean", "intensity_max_max", "intensity_mean_mean", "intensity_cumulative_mean", "rate_onset_mean", "rate_decline_mean", zero("category_max").cast("int").alias("category_max"), (100.0 * zero("hw_days") / F.col("n_days")).alias("mhw_days_pct"))


def detect(days: DataFrame, keys: Keys, base: tuple[int, int], smooth: int = 31, half: int = 5) -> tuple[DataFrame, DataFrame]:
    """(events with metrics, days with seas and thresh) from days on a complete axis."""
    clim = slot_climatology(days, keys, base, half)
    clim = smooth_slots(clim, keys, width=smooth) if smooth > 1 else clim
    full = days.join(clim, [*keys, "slot"], "left")
    return event_metrics(full, events(full, keys), keys), full


def under_ice(days: DataFrame, reference: DataFrame, keys: Keys, least: float = -1.0) -> DataFrame:
    """Values only where the reference climatology is warmer than freezing water."""
    ref = reference.select(*keys, F.col("v").alias("ref"))
    return days.join(ref, list(keys), "left").withColumn("v", F.when(F.col("ref") > least, F.col("v"))).drop("ref")


def whole_columns(df: DataFrame, cell: str = "cell", v: str = "v") -> DataFrame:
    """Cells that have a value on every level of every member."""
    return df.groupBy(cell).agg(F.bool_and(F.col(v).isNotNull()).alias("whole")).where("whole").select(cell)


def mixed_layer(df: DataFrame, keys: Keys, v: str = "v") -> DataFrame:
    """Annual mean and deepest month of the monthly climatology of the mixed-layer depth."""
    by_month = df.groupBy(*keys, F.month("t").alias("month")).agg(F.avg(v).alias("m"))
    return by_month.groupBy(*keys).agg(F.avg("m").alias("mld_mean"), F.max("m").alias("mld_max"))

"""Runs, spells and indices of daily extremes.

Days carry (keys, d, t_idx, v); t_idx numbers days without gaps, whatever the calendar.
"""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Keys = Sequence[str]


def runs(df: DataFrame, keys: Keys, flag: Column, order: str = "t_idx") -> DataFrame:
    """start, end, length of every run of days on which the flag holds.

    Only flagged days are sorted; a run's number is its day less the day's rank.
    """
    days = df.where(flag).select(*keys, order)
    island = F.col(order) - F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    out = days.withColumn("island", island).groupBy(*keys, "island").agg(F.min(order).alias("start"), F.max(order).alias("end"))
    return out.drop("island").withColumn("length", F.col("end") - F.col("start") + 1)


def join_gaps(spells: DataFrame, keys: Keys, most: int) -> DataFrame:
    """Spells with at most `most` days between them become one."""
    w = Window.partitionBy(*keys).orderBy("start")
    fresh = F.coalesce((F.col("start") - F.lag("end").over(w) - 1 > most).cast("int"), F.lit(1))
    out = spells.withColumn("fresh", fresh).withColumn("event", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.groupBy(*keys, "event").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def spell_days(df: DataFrame, keys: Keys, flag: Column, least: int = 6) -> DataFrame:
    """Days in runs of at least `least` days; runs don't leave a key, so put the year among the keys."""
    counted = runs(df, keys, flag).where(F.col("length") >= least).groupBy(*keys).agg(F.sum("length").cast("long").alias("spell_days"))
    return df.select(*keys).distinct().join(counted, list(keys), "left").withColumn("spell_days", F.coalesce("spell_days", F.lit(0)).cast("long"))


def growing_season(df: DataFrame, keys: Keys, threshold: float, least: int, middle: int, length: int = 365, order: str = "t_idx") -> DataFrame:
    """Days from the first warm spell to the first cold spell that begins on or after it and `middle`.

    order counts days in the growing year from 0.  A cold run that began before that day counts from
    it on, if as many days are left.  0 without a warm spell; to the year's end without a cold one.
    """
    warm = runs(df, keys, F.col("v") > threshold, order).where(F.col("length") >= least).groupBy(*keys).agg(F.min("start").alias("s"))
    cold = runs(df, keys, F.col("v") < threshold, order).join(warm, list(keys))
    begin = F.greatest("start", "s", F.lit(middle))
    end = cold.where(F.col("end") - begin + 1 >= least).groupBy(*keys).agg(F.min(begin).alias("e"))
    out = df.select(*keys).distinct().join(warm, list(keys), "left").join(end, list(keys), "left")
    return out.select(*keys, F.when(F.col("s").isNull(), 0).otherwise(F.coalesce("e", F.lit(length)) - F.col("s")).cast("long").alias("gsl"))


def percentiles(df: DataFrame, by: Keys, points: Sequence[float], v: str = "v") -> DataFrame:
    """Exact percentiles with linear interpolation."""
    q = df.groupBy(*by).agg(F.percentile(v, F.array(*(F.lit(p) for p in points))).alias("q"))
    return q.select(*by, *(F.col("q")[i].alias(f"p{str(round(100 * p, 2)).rstrip('0').rstrip('.').replace('.', '_')}") for i, p in enumerate(points)))


def median_unbiased(values: Column, p: float) -> Column:
    """Hyndman and Fan's eighth quantile of an array."""
    x = F.array_sort(F.filter(values, lambda a: a.isNotNull()))
    n = F.size(x)
    at = F.greatest(F.lit(1.0), F.least(n.cast("double"), F.lit(p) * (n + 1.0 / 3) + 1.0 / 3))
    low = F.floor(at).cast("int")
    high = F.least(low + 1, n)
    return F.when(n > 0, F.element_at(x, low) + (at - low) * (F.element_at(x, high) - F.element_at(x, low)))


def window_quantiles(day: np.ndarray, v: np.ndarray, n_days: int, half: int, points: Sequence[float]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(day, quantiles) of the values within `half` days of each calendar day, by median_unbiased()'s rule; NaN is missing."""
    order = np.argsort(day, kind="stable")
    d, x = day[order] - 1, v[order]
    count = np.bincount(d, minlength=n_days)
    table = np.full((n_days, count.max()), np.nan)
    table[d, np.arange(len(d)) - (np.cumsum(count) - count)[d]] = x
    around = lambda a: [np.roll(a, k, axis=0) for k in range(-half, half + 1)]
    present = sum(around(count)) > 0
    values = np.sort(np.concatenate(around(table), axis=1)[present], axis=1)  # missing ones come last
    n = (~np.isnan(values)).sum(1)
    rows, out = np.arange(len(n)), []
    for p in points:
        at = np.maximum(1.0, np.minimum(n, p * (n + 1 / 3) + 1 / 3))
        low = np.floor(at).astype(int)
        below, above = values[rows, low - 1], values[rows, np.maximum(1, np.minimum(low + 1, n)) - 1]
        out.append(np.where(n > 0, below + (at - low) * (above - below), np.nan))
    return np.flatnonzero(present) + 1, out


def calendar_day_percentiles(df: DataFrame, keys: Keys, points: dict[str, float], day: str = "doy", n_days: int = 365, window: int = 5, v: str = "v") -> DataFrame:
    """Percentiles of each calendar day over a window that goes round the year's end.

    A key's values go through one exchange and are one group, decades of days at most; its windows are
    made in arrays, not as rows.  A day whose window holds only missing values gives NULL.
    """
    keys = list(keys)
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keys)

    def of_key(table: pa.Table) -> pa.Table:
        days, found = window_quantiles(table.column("day").to_numpy(), table.column("v").to_numpy(), n_days, window // 2, list(points.values()))
        own = {c: pa.chunked_array([table.column(c).chunk(0).slice(0, 1)]).take(pa.array(np.zeros(len(days), np.int64))) for c in keys}
        return pa.table(own | {day: days.astype(np.int32)} | {name: pa.array(x, from_pandas=True) for name, x in zip(points, found)})

    rows = df.select(*keys, F.col(day).cast("long").alias("day"), F.col(v).cast("double").alias("v"))
    return rows.groupBy(*keys).applyInArrow(of_key, f"{kinds}, `{day}` int, " + ", ".join(f"`{name}` double" for name in points))


def wet_percentiles(df: DataFrame, by: Keys, wet: float = 1.0, v: str = "v") -> DataFrame:
    """95th and 99th percentile of wet days, NULL where there are none."""
    return df.groupBy(*by).agg(F.percentile(F.when(F.col(v) >= wet, F.col(v)), F.array(F.lit(0.95), F.lit(0.99))).alias("q")).select(*by, F.col("q")[0].alias("p95"), F.col("q")[1].alias("p99"))


def threshold_days(df: DataFrame, by: Keys, tests: dict[str, Column]) -> DataFrame:
    """Days on which each test holds."""
    return df.groupBy(*by).agg(*(F.count_if(test).alias(name) for name, test in tests.items()))


def precip_indices(df: DataFrame, by: Keys, least: int = 350, wet: float = 1.0, heavy: float = 10.0, very_heavy: float = 20.0, v: str = "v") -> DataFrame:
    """Totals and counts of wet days, and R95p and R99p above thresholds p95 and p99 that rows carry.

    Everything is NULL with fewer than `least` days; a threshold that is missing gives NULL.
    """
    x = F.col(v)
    rows = lambda c: F.when(F.count(x) >= least, c)
    total = F.sum(F.when(x >= wet, x).otherwise(0.0))
    above = lambda p: F.when(F.max(p).isNotNull(), F.sum(F.when(x > F.col(p), x).otherwise(0.0)))
    return df.groupBy(*by).agg(rows(total).alias("prcptot"), rows(F.try_divide(total, F.count_if(x >= wet))).alias("sdii"), rows(F.max(x)).alias("rx1day"), rows(F.count_if(x >= wet)).alias("r1mm"), rows(F.count_if(x >= heavy)).alias("r10mm"), rows(F.count_if(x >= very_heavy)).alias("r20mm"), rows(above("p95")).alias("r95p"), rows(above("p99")).alias("r99p"))


def rolling_sum_max(df: DataFrame, keys: Keys, year: Column, width: int = 5, v: str = "v") -> DataFrame:
    """Largest sum over `width` days of each year; a window belongs to its last day and may begin the year before.

    The axis must be complete; a window with a missing day doesn't count.
    """
    w = Window.partitionBy(*keys).orderBy("t_idx").rowsBetween(1 - width, 0)
    sums = df.withColumn("s", F.when(F.count(v).over(w) == width, F.sum(v).over(w)))
    return sums.groupBy(*keys, year.alias("year")).agg(F.max("s").alias(f"rx{width}day"))


def temp_indices(df: DataFrame, by: Keys) -> DataFrame:
    """Extremes and percentages of days beyond thresholds tx10, tx90, tn10, tn90 that rows carry (tx, tn in C)."""
    both = F.col("tx").isNotNull() & F.col("tn").isNotNull()
    share = lambda test: F.try_divide(100.0 * F.count_if(test), F.count_if(both))
    c = F.col
    return df.groupBy(*by).agg(F.max("tx").alias("txx"), F.max("tn").alias("tnx"), F.min("tx").alias("txn"), F.min("tn").alias("tnn"), F.avg(c("tx") - c("tn")).alias("dtr"), share(c("tx") < c("tx10")).alias("tx10p"), share(c("tx") > c("tx90")).alias("tx90p"), share(c("tn") < c("tn10")).alias("tn10p"), share(c("tn") > c("tn90")).alias("tn90p"), F.count_if(c("tn") < 0).alias("fd"), F.count_if(c("tx") < 0).alias("id"), F.count_if(c("tn") > 20).alias("tr"))


def approx_exceedance(df: DataFrame, by: Keys, threshold: float, v: str = "v") -> DataFrame:
    """Days above a threshold, where a month counts whole if its mean lies above."""
    days = F.dayofmonth(F.last_day("t"))
    return df.groupBy(*by).agg(F.sum(F.when(F.col(v) > threshold, days).otherwise(0)).cast("long").alias("days"))


def summer_year(lat: str = "lat", d: str = "d") -> Column:
    """The year of a hemisphere's warm season (May to September, November to March of the next), else NULL."""
    m = F.month(d)
    north = F.when(m.between(5, 9), F.year(d))
    south = F.when(m >= 11, F.year(d) + 1).when(m <= 3, F.year(d))
    return F.when(F.col(lat) >= 0, north).otherwise(south)


def heatwaves(df: DataFrame, keys: Keys, year: str, threshold: str, least: int = 3, relative: bool = False, v: str = "v") -> DataFrame:
    """By year: number (hwn), days (hwf), longest (hwd), mean (hwm) and highest (hwa) value on heatwave days.

    Runs of at least `least` days above the row's threshold, inside a year.  Magnitudes count from
    the threshold if relative.  Without events the counts are 0 and the magnitudes NULL.
    """
    by = [*keys, year]
    spells = runs(df, by, F.col(v) > F.col(threshold)).where(F.col("length") >= least)
    days = spells.withColumn("t_idx", F.explode(F.sequence("start", "end"))).join(df, [*by, "t_idx"])
    size = F.col(v) - F.col(threshold) if relative else F.col(v)
    counts = spells.groupBy(*by).agg(F.count(F.lit(1)).alias("hwn"), F.sum("length").cast("long").alias("hwf"), F.max("length").cast("long").alias("hwd"))
    sizes = days.groupBy(*by).agg(F.avg(size).alias("hwm"), F.max(size).alias("hwa"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = df.select(*by).distinct().join(counts, by, "left").join(sizes, by, "left")
    return out.select(*by, zero("hwn"), zero("hwf"), zero("hwd"), "hwm", "hwa")


def season_blocks(df: DataFrame, d: str = "d") -> DataFrame:
    """Days with season and season year; the December before is in its winter without any carrying over."""
    from ..functions.columns import season, season_year

    return df.withColumn("season", season(F.month(d))).withColumn("season_year", season_year(d))


def top_values(df: DataFrame, by: Keys, k: int, v: str = "v") -> DataFrame:
    """The k largest values of each key, by rank."""
    w = Window.partitionBy(*by).orderBy(F.col(v).desc(), "t_idx")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

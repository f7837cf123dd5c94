"""Operators along time.  Fields are long: keys..., a date `t` (or an integer `year`) and a value `v`."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import season, season_year

Keys = Sequence[str]


def in_years(df: DataFrame, first: int, last: int, t: str = "t") -> DataFrame:
    """Rows from the first to the last year, both inclusive; the bounds reach the scan."""
    return df.where((F.col(t) >= F.make_date(F.lit(first), F.lit(1), F.lit(1))) & (F.col(t) < F.make_date(F.lit(last + 1), F.lit(1), F.lit(1))))


def climatology(df: DataFrame, keys: Keys, years: tuple[int, int] | None = None, v: str = "v") -> DataFrame:
    """Time mean of each key."""
    return (in_years(df, *years) if years else df).groupBy(*keys).agg(F.avg(v).alias(v))


def seasonal_climatology(df: DataFrame, keys: Keys, v: str = "v") -> DataFrame:
    """Mean of all steps of a season; December belongs to the calendar year it stands in."""
    return df.groupBy(*keys, season(F.month("t")).alias("season")).agg(F.avg(v).alias(v))


def monthly_climatology(df: DataFrame, keys: Keys, v: str = "v") -> DataFrame:
    return df.groupBy(*keys, F.month("t").alias("month")).agg(F.avg(v).alias(v))


def annual_mean(df: DataFrame, keys: Keys, v: str = "v") -> DataFrame:
    return df.groupBy(*keys, F.year("t").alias("year")).agg(F.avg(v).alias(v))


def season_year_mean(df: DataFrame, keys: Keys, v: str = "v") -> DataFrame:
    """Mean of each season and season year; December counts to the next year, incomplete winters stay."""
    return df.groupBy(*keys, season(F.month("t")).alias("season"), season_year("t").alias("year")).agg(F.avg(v).alias(v))


def season_of_climatology(df: DataFrame, keys: Keys, months: Sequence[int], v: str = "v") -> DataFrame:
    """Mean over some months of a monthly climatology."""
    return df.where(F.col("month").isin(*months)).groupBy(*keys).agg(F.avg(v).alias(v))


def anomaly(df: DataFrame, clim: DataFrame, keys: Keys, v: str = "v") -> DataFrame:
    """Departure from a given monthly climatology (keys, month, v)."""
    right = clim.select(*keys, "month", F.col(v).alias("normal"))
    return df.withColumn("month", F.month("t")).join(right, [*keys, "month"]).withColumn(v, F.col(v) - F.col("normal")).drop("normal", "month")


def deseason(df: DataFrame, keys: Keys, v: str = "v") -> DataFrame:
    """Departure from the field's own monthly means; one sort for each key and month."""
    return df.withColumn(v, F.col(v) - F.avg(v).over(Window.partitionBy(*keys, F.month("t"))))


def elapsed_years(keys: Keys, t: str = "t") -> Column:
    """Years of 365.25 days since the key's first step."""
    return F.datediff(F.col(t), F.min(t).over(Window.partitionBy(*keys))) / 365.25


def with_x(df: DataFrame, keys: Keys) -> DataFrame:
    return df.withColumn("x", F.col("year").cast("double") if "year" in df.columns else elapsed_years(keys))


def linear_trend(df: DataFrame, keys: Keys, v: str = "v") -> DataFrame:
    """Least-squares slope per year; NULL if a value is missing or there are fewer than two steps."""
    whole = (F.count(v) == F.count(F.lit(1))) & (F.count(F.lit(1)) >= 2)
    return with_x(df, keys).groupBy(*keys).agg(F.when(whole, F.regr_slope(v, "x")).alias("slope"))


def slope_skipping_missing(df: DataFrame, keys: Keys, v: str = "v") -> DataFrame:
    """Least-squares slope per year over the values that are there."""
    return with_x(df, keys).groupBy(*keys).agg(F.when(F.count(v) >= 2, F.regr_slope(v, "x")).alias("slope"))


def detrend(df: DataFrame, keys: Keys, v: str = "v") -> DataFrame:
    """Takes off slope times time only, so the level of the first step stays; NULLs poison a key."""
    w = Window.partitionBy(*keys)
    out = with_x(df, keys)
    slope = F.when(F.count(v).over(w) == F.count(F.lit(1)).over(w), F.regr_slope(v, "x").over(w))
    return out.withColumn(v, F.col(v) - slope * F.col("x")).drop("x")


def remove_fit(df: DataFrame, keys: Keys, v: str = "v") -> DataFrame:
    """Takes off the whole linear fit of the values that are there."""
    w = Window.partitionBy(*keys)
    fit = F.regr_intercept(v, "x").over(w) + F.regr_slope(v, "x").over(w) * F.col("x")
    return with_x(df, keys).withColumn(v, F.col(v) - fit).drop("x")


def variability(df: DataFrame, keys: Keys, v: str = "v") -> DataFrame:
    """Population standard deviation of the deseasoned, detrended series."""
    return detrend(deseason(df, keys, v), keys, v).groupBy(*keys).agg(F.stddev_pop(v).alias("std"))


def trend_test(df: DataFrame, keys: Keys, v: str = "v") -> DataFrame:
    """slope, its standard error, t and degrees of freedom of a least-squares line."""
    m = with_x(df, keys).where(F.col(v).isNotNull()).groupBy(*keys).agg(F.count(v).alias("n"), F.regr_slope(v, "x").alias("slope"), F.regr_sxx(v, "x").alias("sxx"), F.regr_syy(v, "x").alias("syy"), F.regr_sxy(v, "x").alias("sxy"))
    rest = F.greatest(F.lit(0.0), F.col("syy") - F.try_divide(F.col("sxy") * F.col("sxy"), F.col("sxx")))
    se = F.sqrt(F.try_divide(rest, (F.col("n") - 2) * F.col("sxx")))
    return m.where("n > 2").withColumn("se", se).select(*keys, "slope", "se", F.try_divide("slope", "se").alias("t"), (F.col("n") - 2).alias("df"))


def centred_mean(df: DataFrame, keys: Keys, width: int, least: int, order: str = "year", v: str = "v") -> DataFrame:
    """Running mean over width steps, width // 2 of them before; NULL with fewer than `least` values."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(width // 2), width - 1 - width // 2)
    return df.withColumn("smooth", F.when(F.count(v).over(w) >= least, F.avg(v).over(w)))


def warming_window(annual: DataFrame, keys: Keys, level: float, baseline: tuple[int, int], width: int = 30) -> DataFrame:
    """First width-year window whose mean lies `level` above the baseline: crossing, start and end year."""
    base = annual.where(F.col("year").between(*baseline)).groupBy(*keys).agg(F.avg("v").alias("base"))
    smooth = centred_mean(annual, keys, width, width).join(base, list(keys))
    hit = smooth.where(F.col("smooth") - F.col("base") >= level).groupBy(*keys).agg(F.min("year").alias("centre"))
    return hit.select(*keys, "centre", (F.col("centre") - width // 2).alias("start"), (F.col("centre") - width // 2 + width - 1).alias("end"))


def against_mean(df: DataFrame, keys: Keys, v: str = "v") -> DataFrame:
    """Departure from the key's mean over all steps."""
    return df.withColumn(v, F.col(v) - F.avg(v).over(Window.partitionBy(*keys)))


def against_first(df: DataFrame, keys: Keys, order: str = "t", v: str = "v") -> DataFrame:
    """Departure from the key's first step."""
    return df.withColumn(v, F.col(v) - F.first(v).over(Window.partitionBy(*keys).orderBy(order)))


def period_change(df: DataFrame, keys: Keys, reference: tuple[int, int], future: tuple[int, int], v: str = "v") -> DataFrame:
    """reference, future and their difference, from one pass over an annual field."""
    mean = lambda span: F.avg(F.when(F.col("year").between(*span), F.col(v)))
    return df.groupBy(*keys).agg(mean(reference).alias("reference"), mean(future).alias("future")).withColumn("change", F.col("future") - F.col("reference"))


def stitch(parts: Sequence[DataFrame], keys: Keys, t: str = "t") -> DataFrame:
    """Experiments one after the other; where they overlap, the earlier experiment's step counts."""
    whole = None
    for rank, part in enumerate(parts):
        part = part.withColumn("part_rank", F.lit(rank))
        whole = part if whole is None else whole.unionByName(part, allowMissingColumns=True)
    values = [c for c in whole.columns if c not in {*keys, t}]
    first = whole.groupBy(*keys, t).agg(F.min_by(F.struct(*values), "part_rank").alias("one"))
    return first.select(*keys, t, *(f"one.{c}" for c in values if c != "part_rank"))


def first_of_step(df: DataFrame, keys: Keys, order: str, t: str = "t") -> DataFrame:
    """One row for each key and step, the first by `order`."""
    values = [c for c in df.columns if c not in {*keys, t}]
    one = df.groupBy(*keys, t).agg(F.min_by(F.struct(*values), order).alias("one"))
    return one.select(*keys, t, *(f"one.{c}" for c in values))


def summary(df: DataFrame, keys: Keys, v: str = "v") -> DataFrame:
    """mean, trend per decade, first and last value of annual series."""
    there = F.col(v).isNotNull()
    return df.groupBy(*keys).agg(F.avg(v).alias("mean"), (F.regr_slope(v, F.col("year").cast("double")) * 10).alias("trend"), F.min_by(v, F.when(there, F.col("year"))).alias("first"), F.max_by(v, F.when(there, F.col("year"))).alias("last"))


def monthly_spread(df: DataFrame, keys: Keys, v: str = "v") -> DataFrame:
    """Standard deviation by calendar month, and the month where it peaks."""
    by_month = df.groupBy(*keys, F.month("t").alias("month")).agg(F.stddev_pop(v).alias("std"))
    return by_month.withColumn("peak_month", F.max_by("month", "std").over(Window.partitionBy(*keys)))


def extreme_months(df: DataFrame, keys: Keys, high: int = 3, low: int = 9, v: str = "v") -> DataFrame:
    """Each year's value of the month of the maximum and of the minimum, less their own means."""
    out = df.where(F.month("t").isin(high, low)).select(*keys, F.year("t").alias("year"), F.when(F.month("t") == high, "max").otherwise("min").alias("kind"), v)
    return out.withColumn("departure", F.col(v) - F.avg(v).over(Window.partitionBy(*keys, "kind")))


def coverage(df: DataFrame, keys: Keys, first: int, last: int, t: str = "t") -> DataFrame:
    """Keys whose years reach from the first to the last."""
    return df.groupBy(*keys).agg(F.min(F.year(t)).alias("from"), F.max(F.year(t)).alias("to")).where((F.col("from") <= first) & (F.col("to") >= last)).select(*keys)


def missing_months(df: DataFrame, keys: Keys, first: str, last: str) -> DataFrame:
    """Months of the span that a key has no step in."""
    axis = df.select(*keys).distinct().withColumn("month", F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("INTERVAL 1 MONTH"))))
    there = df.select(*keys, F.trunc("t", "MM").alias("month")).distinct()
    return axis.join(there, [*keys, "month"], "left_anti")


def shift_months(df: DataFrame, months: int, t: str = "t") -> DataFrame:
    """Stamps moved by whole months, for sources that stamp the end of a step."""
    return df.withColumn(t, F.add_months(t, months).cast("date"))


def centre_days(df: DataFrame, t: str = "ts") -> DataFrame:
    """Stamps at midnight (or one second before) moved to the noon of the day they end."""
    end = F.date_format(t, "HH:mm:ss")
    return df.withColumn(t, F.when(end == "00:00:00", F.col(t) - F.expr("INTERVAL 12 HOURS")).when(end == "23:59:59", F.date_trunc("DAY", t) + F.expr("INTERVAL 12 HOURS")).otherwise(F.col(t)))


def observed_climatology(field: DataFrame, obs: DataFrame, keys: Keys, first: int, last: int, t: str = "t", v: str = "v") -> DataFrame:
    """Mean over the years of the analysis that observations reach over: a model is held against what was seen.

    Without observations in the analysis there are no rows.
    """
    years = obs.where(F.col(v).isNotNull()).agg(F.greatest(F.min(F.year(t)), F.lit(first)).alias("from"), F.least(F.max(F.year(t)), F.lit(last)).alias("to"))
    return field.join(F.broadcast(years)).where(F.year(t).between(F.col("from"), F.col("to"))).groupBy(*keys).agg(F.avg(v).alias(v))  # one row

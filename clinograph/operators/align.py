"""Joins that bring fields and series together.  All are equi-joins on integer cells and dates."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Keys = Sequence[str]


def bias(field: DataFrame, reference: DataFrame, on: Keys, v: str = "v") -> DataFrame:
    """Field less reference where both have the cell."""
    return field.join(reference.select(*on, F.col(v).alias("ref")), list(on)).withColumn("bias", F.col(v) - F.col("ref"))


def common_steps(df: DataFrame, source: str = "source", t: str = "t", by: Keys = ()) -> DataFrame:
    """Steps that every source has, with the plain mean over sources; sources are counted for each key of `by`."""
    if by:
        sources = df.groupBy(*by).agg(F.count_distinct(source).alias("n_sources"))
        by_step = df.groupBy(*by, t).agg(F.count_distinct(source).alias("n"), F.avg("v").alias("v"))
        return by_step.join(sources, list(by)).where("n = n_sources").select(*by, t, "v")
    sources = df.select(F.count_distinct(source).alias("n_sources"))
    by_step = df.groupBy(t).agg(F.count_distinct(source).alias("n"), F.avg("v").alias("v"))
    return by_step.join(F.broadcast(sources), by_step.n == sources.n_sources).select(t, "v")  # one row


def any_steps(df: DataFrame, t: str = "t", by: Keys = ()) -> DataFrame:
    """Every step any source has, for each key of `by`: mean, least and most of what is there."""
    return df.groupBy(*by, t).agg(F.avg("v").alias("v"), F.min("v").alias("v_min"), F.max("v").alias("v_max"), F.count("v").alias("n"))


def on_full_axis(df: DataFrame, keys: Keys, d: str = "d", first: str | None = None, last: str | None = None, v: str = "v") -> DataFrame:
    """Every day of the axis for every key; missing days NULL; of repeated days the smallest value.

    t_idx counts days from the first.  Without bounds the axis is that of the whole table.
    """
    one = df.groupBy(*keys, d).agg(F.min(v).alias(v))
    bounds = df.select(F.min(d).alias("a"), F.max(d).alias("z")) if first is None else None
    cells = df.select(*keys).distinct()
    if bounds is None:
        cells = cells.withColumn("a", F.lit(first).cast("date")).withColumn("z", F.lit(last).cast("date"))
    else:
        cells = cells.join(F.broadcast(bounds))  # one row
    axis = cells.select(*keys, "a", F.explode(F.sequence("a", "z")).alias(d)).withColumn("t_idx", F.datediff(d, "a")).drop("a")
    return axis.join(one, [*keys, d], "left")


def complete_days(max_field: DataFrame, min_field: DataFrame, on: Keys) -> DataFrame:
    """Days that both fields have: tx and tn."""
    return max_field.select(*on, F.col("v").alias("tx")).join(min_field.select(*on, F.col("v").alias("tn")), list(on))


def with_threshold(df: DataFrame, thresholds: DataFrame, on: Keys) -> DataFrame:
    """Each day with the threshold of its calendar slot."""
    return df.join(thresholds, list(on), "left")


def by_offset(df: DataFrame, half: int, t_idx: str = "t_idx") -> DataFrame:
    """Each row once for every centre at most `half` steps away: a windowed join as an equi-join."""
    return df.withColumn("centre", F.explode(F.sequence(F.col(t_idx) - half, F.col(t_idx) + half)))


def with_area(field: DataFrame, area: DataFrame, computed: str, on: str = "cell") -> DataFrame:
    """A source's own cell areas, or the computed ones where it has none."""
    return field.join(area.select(on, F.col("area").alias("own_area")), on, "left").withColumn("area", F.coalesce("own_area", computed)).drop("own_area")


def first_of_both(north: DataFrame, south: DataFrame, on: Keys, v: str = "v") -> DataFrame:
    """The first field where it has a value, else the second."""
    a, b = north.select(*on, F.col(v).alias("a")), south.select(*on, F.col(v).alias("b"))
    return a.join(b, list(on), "full").select(*on, F.coalesce("a", "b").alias(v))


def available(df: DataFrame, wanted: DataFrame, on: Keys) -> DataFrame:
    return df.join(wanted, list(on), "left_semi")


def absent(wanted: DataFrame, df: DataFrame, on: Keys) -> DataFrame:
    return wanted.join(df, list(on), "left_anti")


def absolute_from_anomaly(anomaly: DataFrame, clim: DataFrame, keys: Keys, offset: float = 0.0) -> DataFrame:
    """Absolute values from anomalies and a twelve-month climatology."""
    right = clim.select(*keys, "month", F.col("v").alias("normal"))
    return anomaly.withColumn("month", F.month("t")).join(right, [*keys, "month"]).withColumn("v", F.col("v") + F.col("normal") + offset).drop("normal", "month")


def three_series(t2m: DataFrame, sw: DataFrame, lw: DataFrame) -> DataFrame:
    """Months all three have: temperature and net radiation, for a regression of one on the other."""
    out = t2m.select("t", F.col("v").alias("t2m")).join(sw.select("t", F.col("v").alias("sw")), "t").join(lw.select("t", F.col("v").alias("lw")), "t")
    return out.withColumn("net", F.col("sw") + F.col("lw"))


def common_cells(df: DataFrame, source: str = "source", cell: str = "cell") -> DataFrame:
    """Cells that every source covers."""
    n = df.select(F.count_distinct(source).alias("n_sources"))
    by_cell = df.where("v IS NOT NULL").groupBy(cell).agg(F.count_distinct(source).alias("n"))
    return by_cell.join(F.broadcast(n), by_cell.n == n.n_sources).select(cell)  # one row


def without_common_mean(df: DataFrame, weight: str = "area", source: str = "source", cell: str = "cell") -> DataFrame:
    """Each source less its weighted mean over the cells that every source covers."""
    inside = df.join(common_cells(df, source, cell).withColumn("common", F.lit(1)), cell, "left")
    w = Window.partitionBy(source)
    used = F.when(F.col("common").isNotNull(), F.col(weight))
    mean = F.try_divide(F.sum(F.col("v") * used).over(w), F.sum(F.when(F.col("v").isNotNull(), used)).over(w))
    return inside.withColumn("v", F.col("v") - mean).drop("common")

"""Operators across sources: members, families and benchmarks."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import variant_numbers
from .temporal import coverage

Keys = Sequence[str]


def mean_median(df: DataFrame, by: Keys, source: str = "source", v: str = "v", least: int = 2) -> DataFrame:
    """Mean and median over members where at least two have a value."""
    out = df.groupBy(*by).agg(F.avg(v).alias("ens_mean"), F.median(v).alias("ens_median"), F.count(v).alias("members"))
    return out.where(F.col("members") >= least)


def family_mean(df: DataFrame, by: Keys, family: str = "family", v: str = "v") -> DataFrame:
    return df.groupBy(family, *by).agg(F.avg(v).alias(v))


def family_spread(df: DataFrame, by: Keys, family: str = "family", bias: str = "bias") -> DataFrame:
    """Mean and spread of a family's bias, and whether the mean lies within two standard deviations."""
    out = df.groupBy(family, *by).agg(F.avg(bias).alias("mean_bias"), F.stddev_pop(bias).alias("spread"))
    return out.withColumn("within", F.abs("mean_bias") <= 2 * F.col("spread"))


def full_coverage_mean(df: DataFrame, by: Keys, first: int, last: int, source: str = "source", v: str = "v", one_per_model: str | None = None) -> DataFrame:
    """Mean over the sources whose years cover the span; members of a model first average to one, if asked."""
    rows = df.join(coverage(df, [source], first, last), source, "left_semi")
    if one_per_model:
        rows = rows.groupBy(one_per_model, *by).agg(F.avg(v).alias(v))
    return rows.groupBy(*by).agg(F.avg(v).alias(v))


def envelope(df: DataFrame, by: Keys, source: str = "source", v: str = "v", least: int = 2) -> DataFrame:
    out = df.groupBy(*by).agg(F.min(v).alias("v_min"), F.max(v).alias("v_max"), F.count_distinct(F.when(F.col(v).isNotNull(), F.col(source))).alias("n"))
    return out.where(F.col("n") >= least).drop("n")


def outside_envelope(obs: DataFrame, members: DataFrame, on: Keys, v: str = "v") -> DataFrame:
    """How far the observed value lies above the members' largest or below their smallest; 0 inside."""
    edge = members.groupBy(*on).agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
    o = F.col(v)
    out = obs.join(edge, list(on))
    return out.select(*on, F.when(o > F.col("hi"), o - F.col("hi")).when(o < F.col("lo"), o - F.col("lo")).otherwise(0.0).alias("outside"))


def select_member(members: DataFrame, model: str = "model", variant: str = "variant", preferred: str = "r1i1p1f1") -> DataFrame:
    """One variant a model: the preferred one, else the one of lowest numbers."""
    order = F.struct((F.col(variant) != preferred).alias("other"), *(n.alias(f"n{k}") for k, n in enumerate(variant_numbers(variant))), F.col(variant))
    return members.groupBy(model).agg(F.min_by(variant, order).alias(variant))


def newest_version(files: DataFrame, by: Keys, version: str = "version") -> DataFrame:
    """The newest version's file for each key and time span."""
    values = [c for c in files.columns if c not in by]
    return files.groupBy(*by).agg(F.max_by(F.struct(*values), version).alias("one")).select(*by, "one.*")


def av_shares(df: DataFrame, by: Keys, weight: str = "area", av: str = "av", edge: float = 0.005) -> DataFrame:
    """Weighted shares of cells that are better, worse or alike, share of positive ones, and the mean."""
    a, w = F.col(av), F.col(weight)
    total = F.sum(F.when(a.isNotNull(), w))
    share = lambda cond: F.try_divide(F.sum(F.when(cond, w).otherwise(0.0)), total)
    return df.groupBy(*by).agg(share(a > edge).alias("better"), share(a < -edge).alias("worse"), share((a >= -edge) & (a <= edge)).alias("alike"), share(a > 0).alias("positive"), F.try_divide(F.sum(a * w), total).alias("mean_av"))


def keep_set(rows: DataFrame, region: str = "region", member: str = "member", av: str = "av", least: int = 2) -> DataFrame:
    """Regions where at least `least` members have a positive value under any reference."""
    best = rows.groupBy(region, member).agg(F.max(av).alias("best"))
    return best.where("best > 0").groupBy(region).agg(F.count(F.lit(1)).alias("members")).where(F.col("members") >= least)


def modal_window(windows: DataFrame, by: Keys = ()) -> DataFrame:
    """The commonest (start, end); ties go to the earliest."""
    counted = windows.groupBy(*by, "start", "end").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(*by).agg(F.min_by(F.struct("start", "end", "n"), F.struct((-F.col("n")).alias("m"), F.col("start"), F.col("end"))).alias("one")).select(*by, "one.*")


def pool_levels(df: DataFrame, by: Keys, freq: str = "frequency", metrics: Keys = ()) -> DataFrame:
    """Levels of a layer pooled: means of event metrics weighted by frequency, and the mean frequency."""
    from ..functions.columns import wavg

    return df.groupBy(*by).agg(F.avg(freq).alias(freq), *(wavg(m, freq).alias(m) for m in metrics))


def benchmark_usage(events: DataFrame) -> DataFrame:
    """By benchmark and variable: members used, members left out, and the reasons."""
    used = F.col("used")
    return events.groupBy("benchmark", "variable").agg(F.sum(F.when(used, 1).otherwise(0)).cast("long").alias("n_used"), F.sum(F.when(used, 0).otherwise(1)).cast("long").alias("n_excluded"), F.array_join(F.array_sort(F.collect_set(F.when(~used, F.col("reason")))), ",").alias("reasons"))


def rank_members(df: DataFrame, by: Keys, score: str) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.col(score).desc(), "source")))


def verdicts(steps: DataFrame, by: Keys, first: int, last: int, least: int, t: str = "t") -> DataFrame:
    """Whether each member is used, and if not why: too few steps, a late start or an early end."""
    spans = steps.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(F.year(t)).alias("from"), F.max(F.year(t)).alias("to"))
    reason = F.when(F.col("n") < least, "too few steps").when(F.col("from") > first, "starts late").when(F.col("to") < last, "ends early").otherwise("used")
    return spans.select(*by, reason.alias("verdict"))


def same_members(scenario: DataFrame, historical: DataFrame, on: Keys) -> DataFrame:
    """The scenario's rows of members whose historical run is there."""
    return scenario.join(historical.select(*on).distinct(), list(on), "left_semi")


def mean_in_driver_window(runs: DataFrame, windows: DataFrame, by: Keys, driver: str = "driver", year: str = "year", v: str = "v") -> DataFrame:
    """Regional runs averaged over the window in which their driving model reaches a warming level.

    windows: driver, start, end; runs whose driver has none are left out.
    """
    return runs.join(windows, driver).where(F.col(year).between(F.col("start"), F.col("end"))).groupBy(*by).agg(F.avg(v).alias(v))


def within_budget(entries: DataFrame, by: Keys, order: Sequence[Column], size: str, budget: int) -> DataFrame:
    """The first entries of each group, in order, whose sizes together stay within a budget."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return entries.withColumn("used", F.sum(size).over(w)).where(F.col("used") <= budget)

"""Provenance and verification: what went in, what changed, what contradicts."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Keys = Sequence[str]


def fingerprint(df: DataFrame, path: str, content: str) -> DataFrame:
    """path, digest of its content."""
    return df.select(F.col(path).alias("path"), F.sha2(F.col(content).cast("binary"), 256).alias("digest"))


def drift(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """Paths that are changed, gone or new against what was recorded."""
    both = recorded.select("path", F.col("digest").alias("was")).join(current.select("path", F.col("digest").alias("now")), "path", "full")
    state = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "gone").when(F.col("was") != F.col("now"), "changed")
    return both.withColumn("state", state).where("state IS NOT NULL").select("path", "state")


def stale(analyses: DataFrame, figures: DataFrame) -> DataFrame:
    """Analyses whose figure is missing or has another digest."""
    out = analyses.join(figures.select("figure", F.col("digest").alias("now")), "figure", "left")
    return out.where("now IS NULL OR now <> digest").withColumn("state", F.when(F.col("now").isNull(), "missing").otherwise("changed")).drop("now")


def fallbacks(events: DataFrame, asked: str = "asked", used: str = "used") -> DataFrame:
    """Regridding events whose method wasn't the one asked for."""
    return events.where(F.col(asked) != F.col(used)).groupBy(asked, used).agg(F.count(F.lit(1)).alias("n"))


def coverage_contradictions(coverage: DataFrame, declared: DataFrame, key: str = "experiment") -> DataFrame:
    """Sources that start more than a year after what their experiment declares, or miss months."""
    out = coverage.join(declared, key)
    late = F.col("first_year") > F.col("declared_start") + 1
    return out.where(late | (F.col("missing") > 0)).withColumn("late", late)


def commits(events: DataFrame) -> DataFrame:
    """Runs by commit, and how many of them had changes."""
    return events.groupBy("commit").agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("dirty")).alias("dirty_runs"))


def completeness(df: DataFrame, keys: Keys, t: str = "t") -> DataFrame:
    """Steps a month: how many months, and the least and most steps of one."""
    by_month = df.groupBy(*keys, F.trunc(t, "MM").alias("month")).agg(F.count(F.lit(1)).alias("steps"))
    return by_month.groupBy(*keys).agg(F.count(F.lit(1)).alias("months"), F.min("month").alias("first"), F.max("month").alias("last"), F.min("steps").alias("least"), F.max("steps").alias("most"))


def figure_history(events: DataFrame, figure: str) -> DataFrame:
    """What is known of a figure, oldest first, each event as JSON."""
    return events.where(F.col("figure") == figure).orderBy("at").select("at", F.to_json(F.struct(*events.columns)).alias("event"))

"""Sources: catalogued tables, normalising readers and derivations.  Fields are read by Spark alone."""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import lon_0_360, missing_to_null, month_start
from ..operators.temporal import in_years, stitch


@dataclass
class Catalog:
    """Names of tables and the paths they stand at."""

    paths: Mapping[str, str]

    def load(self, spark: SparkSession, key: str) -> DataFrame:
        if key not in self.paths:
            raise KeyError(key)
        return spark.read.parquet(self.paths[key])

    @staticmethod
    def key(experiment: str, model: str, domain: str, member: str = "") -> str:
        return "_".join(x for x in (experiment, model, domain, member) if x)


@dataclass
class Catalogs:
    """The first catalog that knows a key answers."""

    parts: Sequence[Catalog] = field(default_factory=list)

    def load(self, spark: SparkSession, key: str) -> DataFrame:
        for part in self.parts:
            if key in part.paths:
                return part.load(spark, key)
        raise KeyError(key)


@dataclass(frozen=True)
class Variable:
    """How a dataset's values become ours: value * factor + offset, its names and fill bounds."""

    name: str
    column: str = "v"
    factor: float = 1.0
    offset: float = 0.0
    fill_below: float | None = None
    fill_above: float | None = None
    positive_up: bool = False


def normalise(raw: DataFrame, variable: Variable, source: str, t: str = "t", lon: str | None = None) -> DataFrame:
    """Raw columns as a field: fills and NaN to NULL, units and sign, month starts, longitudes 0 to 360."""
    v = missing_to_null(variable.column, variable.fill_below, variable.fill_above) * variable.factor + variable.offset
    out = raw.withColumn("v", -v if variable.positive_up else v).withColumn("source", F.lit(source)).withColumn("variable", F.lit(variable.name)).withColumn("t", month_start(F.col(t).cast("date")))
    return out.withColumn(lon, lon_0_360(lon)) if lon else out


def load_period(catalog: Catalog | Catalogs, spark: SparkSession, keys: Sequence[str], first: int, last: int, cells: Sequence[str] = ("cell",)) -> DataFrame:
    """Experiments of one run stitched and cut to whole years; keys the catalog lacks are passed over."""
    parts = []
    for key in keys:
        try:
            parts.append(in_years(catalog.load(spark, key), first, last))
        except KeyError:
            continue
    if not parts:
        raise KeyError(", ".join(keys))
    return stitch(parts, cells)


def composite(parts: Mapping[str, DataFrame]) -> DataFrame:
    """Backends' fields under their source names."""
    out = None
    for source, df in parts.items():
        df = df.withColumn("source", F.lit(source))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def daily_extremes(hourly: DataFrame, keys: Sequence[str], ts: str = "ts", v: str = "v") -> DataFrame:
    """Least and largest value of each UTC day."""
    return hourly.groupBy(*keys, F.to_date(ts).alias("d")).agg(F.min(v).alias("v_min"), F.max(v).alias("v_max"))


def daily_sums(steps: DataFrame, keys: Sequence[str], per_day: int = 8, ts: str = "ts", v: str = "v") -> DataFrame:
    """Sums of days that have all their steps; other days are left out."""
    return steps.groupBy(*keys, F.to_date(ts).alias("d")).agg(F.sum(v).alias("v"), F.count(v).alias("n")).where(F.col("n") == per_day).drop("n")


def to_monthly(daily: DataFrame, keys: Sequence[str], d: str = "d", v: str = "v") -> DataFrame:
    return daily.groupBy(*keys, F.trunc(d, "MM").alias("t")).agg(F.avg(v).alias(v))


def decimal_year(x: str) -> F.Column:
    """The month's first day of a decimal year."""
    year = F.floor(x)
    month = F.least(F.lit(12), F.greatest(F.lit(1), F.floor((F.col(x) - year) * 12) + 1))
    return F.make_date(year.cast("int"), month.cast("int"), F.lit(1))


def repair_times(df: DataFrame, keys: Sequence[str], i: str = "i", t: str = "t", step_days: int = 1) -> DataFrame:
    """Missing stamps rebuilt from the last good one before and the number of steps since."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(i).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col(t).isNotNull(), F.struct(i, t)), ignorenulls=True).over(w)
    return df.withColumn("last", last).withColumn(t, F.coalesce(F.col(t), F.date_add(F.col(f"last.{t}"), ((F.col(i) - F.col(f"last.{i}")) * step_days).cast("int")))).drop("last")


def members_in(df: DataFrame) -> DataFrame:
    """model and variant of stores named variable_model_experiment_variant."""
    parts = F.split("store", "_")
    return df.select(F.element_at(parts, 2).alias("model"), F.element_at(parts, 4).alias("variant")).where("variant IS NOT NULL").distinct()


def read_config(path: str) -> dict:
    """A YAML configuration; the sections models, periods, benchmarks and diagnostics become dimensions."""
    import yaml

    with open(path, encoding="utf-8") as file:
        return yaml.safe_load(file) or {}


def source_dimension(spark: SparkSession, config: dict) -> DataFrame:
    """source, role, family, member from a configuration."""
    rows = [(m["name"], "model", m.get("family") or m["name"].rsplit("-r", 1)[0], m.get("member", "")) for m in config.get("models", [])]
    rows += [(b["name"], "benchmark", b.get("family", b["name"]), b.get("member", "")) for b in config.get("benchmarks", [])]
    return spark.createDataFrame(rows, "source string, role string, family string, member string")

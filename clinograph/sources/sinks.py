"""Sinks: fields, summaries and settings-keyed checkpoints."""
from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_field(df: DataFrame, path: str, by: tuple[str, ...] = ("variable", "source")) -> None:
    """A field partitioned by variable and source, clustered by cell, so that a cell's steps lie together."""
    keys = [c for c in by if c in df.columns]
    df.repartition(*(F.col(c) for c in [*keys, "cell"])).sortWithinPartitions(*keys, "cell").write.mode("overwrite").partitionBy(*keys).parquet(path)


def write_attributes(spark: SparkSession, path: str, attributes: dict) -> None:
    """What a written field comes from, as a small table beside it: name and value, as text."""
    rows = [(str(k), v if isinstance(v, str) else json.dumps(v, sort_keys=True, default=str)) for k, v in sorted(attributes.items())]
    spark.createDataFrame(rows, "name string, value string").coalesce(1).write.mode("overwrite").json(f"{path.rstrip('/')}-attributes")


def export_nested(results: dict, path: str) -> list[str]:
    """Writes every DataFrame of nested results under the path that its keys make; gives the paths.

    Leaves that are no DataFrames are passed over; characters that a path can't hold become underscores.
    """
    done = []
    for key, value in results.items():
        place = f"{path.rstrip('/')}/" + re.sub(r"[^0-9A-Za-z_.=-]+", "_", str(key))
        if isinstance(value, dict):
            done += export_nested(value, place)
        elif isinstance(value, DataFrame):
            value.write.mode("overwrite").parquet(place)
            done.append(place)
    return done


def write_biases(df: DataFrame, path: str) -> None:
    """Bias maps of all periods, members and means as one table."""
    df.write.mode("overwrite").partitionBy("variable", "period").parquet(path)


def write_summary(df: DataFrame, path: str, kind: str = "csv") -> None:
    df.coalesce(1).write.mode("overwrite").format(kind).option("header", "true").save(path)  # summaries are small


def settings_key(settings: dict) -> str:
    return hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()[:16]


def checkpointed(spark: SparkSession, root: str, name: str, settings: dict, make) -> DataFrame:
    """The table made under these settings before, or make() written; a change of settings makes it anew."""
    path = f"{root}/{name}-{settings_key(settings)}"
    files = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if not files.getFileSystem(spark._jsc.hadoopConfiguration()).exists(files):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def build_store(df: DataFrame, path: str, keys: tuple[str, ...] = ("cell",), t: str = "t") -> None:
    """Sorted, without repeated steps, in even ranges of cells."""
    from ..operators.temporal import first_of_step

    first_of_step(df, keys, order=df.columns[-1], t=t).repartitionByRange(*keys).sortWithinPartitions(*keys, t).write.mode("overwrite").parquet(path)


def figure_data(df: DataFrame, figure: str, settings: dict) -> DataFrame:
    """The numbers behind a figure with the metadata that goes beside it."""
    return df.withColumn("figure", F.lit(figure)).withColumn("metadata", F.lit(json.dumps(settings, sort_keys=True, default=str)))

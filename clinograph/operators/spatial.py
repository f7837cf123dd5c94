"""Operators over cells.  Fields carry a cell number; a grid table gives lat, lon, area and land_frac."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import in_polygon, wavg

Keys = Sequence[str]


def on_grid(field: DataFrame, grid: DataFrame, cell: str = "cell") -> DataFrame:
    """The field with its grid's columns; Spark broadcasts a small grid by its own size check."""
    return field.join(grid, cell)


def area_mean(df: DataFrame, by: Keys, weight: str = "area", v: str = "v") -> DataFrame:
    """Weighted mean over cells; plain where weight is None (equal-area grids)."""
    return df.groupBy(*by).agg((wavg(v, weight) if weight else F.avg(v)).alias(v))


def coslat_mean(df: DataFrame, by: Keys, v: str = "v") -> DataFrame:
    return df.groupBy(*by).agg(wavg(v, F.cos(F.radians("lat"))).alias(v))


def region_cells(grid: DataFrame, regions: dict[str, list[tuple[float, float]]]) -> DataFrame:
    """region, cell: the cells whose centre lies in each polygon of (lon, lat) corners; built once a grid."""
    inside = [F.when(in_polygon("lat", "lon", corners), F.lit(name)) for name, corners in regions.items()]
    return grid.select("cell", F.explode(F.array_compact(F.array(*inside))).alias("region"))


def polar_cap(grid: DataFrame, name: str, south: float = -90.0, north: float = 90.0) -> DataFrame:
    return grid.where(F.col("lat").between(south, north)).select(F.lit(name).alias("region"), "cell")


def region_mean(df: DataFrame, bridge: DataFrame, by: Keys, weight: str = "area", v: str = "v") -> DataFrame:
    return df.join(bridge, "cell").groupBy("region", *by).agg(wavg(v, weight).alias(v))


def zonal_mean(df: DataFrame, by: Keys, width: float = 1.0, weight: str = "area", v: str = "v") -> DataFrame:
    """Weighted mean of half-open latitude bands; a cell at +90 falls outside; empty bands have no row."""
    bin_of = F.floor((F.col("lat") + 90.0) / width)
    return df.where(F.col("lat") < 90.0).groupBy(*by, ((bin_of + 0.5) * width - 90.0).alias("band")).agg(wavg(v, weight).alias(v))


def all_bands(zonal: DataFrame, spark, width: float) -> DataFrame:
    """Zonal means with a NULL row for each empty band."""
    bands = spark.range(int(180 / width)).select(((F.col("id") + 0.5) * width - 90.0).alias("band"))
    return bands.join(zonal, "band", "left")


def zonal_profile(df: DataFrame, axis: DataFrame, by: Keys, v: str = "v") -> DataFrame:
    """Plain longitude means on the field's own latitudes, linearly interpolated to the axis' `lat`."""
    rows = df.groupBy(*by, "lat").agg(F.avg(v).alias(v))
    steps = Window.partitionBy(*by).orderBy("lat")
    spans = rows.withColumn("lat2", F.lead("lat").over(steps)).withColumn("v2", F.lead(v).over(steps))
    spans = spans.groupBy(*by).agg(F.collect_list(F.struct("lat", v, "lat2", "v2")).alias("spans"))  # one entry a latitude
    pick = lambda s: (s["lat"] <= F.col("at")) & ((F.col("at") < s["lat2"]) | ((s["lat2"].isNull()) & (s["lat"] == F.col("at"))))
    out = spans.join(F.broadcast(axis.select(F.col("lat").alias("at"))))  # a latitude axis: thousands of rows at most
    out = out.withColumn("s", F.element_at(F.filter("spans", pick), 1)).where("s IS NOT NULL")
    value = F.when(F.col("s.lat") == F.col("at"), F.col(f"s.{v}")).otherwise(F.col(f"s.{v}") + (F.col("s.v2") - F.col(f"s.{v}")) * (F.col("at") - F.col("s.lat")) / (F.col("s.lat2") - F.col("s.lat")))
    return out.select(*by, F.col("at").alias("lat"), value.alias(v))


def box_index(df: DataFrame, box: Column, by: Keys, weight: str = "area", v: str = "v") -> DataFrame:
    return df.where(box).groupBy(*by).agg(wavg(v, weight).alias("index"))


def box_difference(df: DataFrame, first: Column, second: Column, by: Keys, weight: str = "area", v: str = "v") -> DataFrame:
    """Difference of two boxes' weighted means from one pass."""
    part = lambda box: wavg(F.when(box, F.col(v)), F.when(box, F.col(weight)))
    return df.where(first | second).groupBy(*by).agg((part(first) - part(second)).alias("index"))


def nearest_level(df: DataFrame, target: float, by: Keys, v: str = "v") -> DataFrame:
    """The value of the level next to the target; ties go to the smaller level."""
    return df.groupBy(*by).agg(F.min_by(v, F.struct(F.abs(F.col("level") - target), F.col("level"))).alias(v))


def equatorial_index(df: DataFrame, level: float, lat_most: float, by: Keys, weight: str = "area", v: str = "v") -> DataFrame:
    """Weighted mean round the equator on the level nearest the wanted one, as for the quasi-biennial oscillation."""
    around = df.where(F.abs(F.col("lat")) <= lat_most).groupBy(*by, "level").agg(wavg(v, weight).alias(v))
    return nearest_level(around, level, by, v).withColumnRenamed(v, "index")


def bias_statistics(df: DataFrame, by: Keys, weight: str = "area", b: str = "bias") -> DataFrame:
    """Weighted mean bias and root-mean-square error."""
    return df.groupBy(*by).agg(wavg(b, weight).alias("mean_bias"), F.sqrt(wavg(F.col(b) * F.col(b), weight)).alias("rmse"))


def taylor(df: DataFrame, by: Keys, m: str, o: str, weight: str = "area") -> DataFrame:
    """Weighted pattern correlation, ratio of standard deviations and centred difference, pairs complete."""
    w, x, y = F.col(weight), F.col(m), F.col(o)
    s = df.where(x.isNotNull() & y.isNotNull()).groupBy(*by).agg(F.sum(w).alias("w"), F.sum(w * x).alias("x"), F.sum(w * y).alias("y"), F.sum(w * x * x).alias("xx"), F.sum(w * y * y).alias("yy"), F.sum(w * x * y).alias("xy"))
    mean = lambda a: F.try_divide(F.col(a), F.col("w"))
    vx, vy, c = mean("xx") - mean("x") ** 2, mean("yy") - mean("y") ** 2, mean("xy") - mean("x") * mean("y")
    return s.select(*by, F.try_divide(c, F.sqrt(vx * vy)).alias("corr"), F.sqrt(F.try_divide(vx, vy)).alias("std_ratio"), F.sqrt(F.greatest(F.lit(0.0), vx + vy - 2 * c)).alias("crmse"))


def weighted_pdf(df: DataFrame, by: Keys, low: float, high: float, bins: int, weight: str = "area", v: str = "v", log: bool = True) -> DataFrame:
    """Weighted density by bin (logarithmic bins drop values <= 0); the last bin is closed on the right."""
    x = F.log10(F.when(F.col(v) > 0, F.col(v))) if log else F.col(v)
    import math

    a, z = (math.log10(low), math.log10(high)) if log else (low, high)
    step = (z - a) / bins
    k = F.when(F.col(v) == high, bins - 1).otherwise(F.floor((x - a) / step))
    counted = df.withColumn("bin", k.cast("int")).where(F.col("bin").between(0, bins - 1)).groupBy(*by, "bin").agg(F.sum(weight).alias("w"))
    edge = lambda i: F.pow(F.lit(10.0), F.lit(a) + i * step) if log else F.lit(a) + i * step
    total = F.sum("w").over(Window.partitionBy(*by))
    return counted.select(*by, "bin", F.try_divide(F.col("w"), total * (edge(F.col("bin") + 1) - edge(F.col("bin")))).alias("density"))


def ice_totals(df: DataFrame, by: Keys, threshold: float = 0.15) -> DataFrame:
    """Area, extent and volume by hemisphere from concentration, thickness and cell area."""
    side = F.when(F.col("lat") >= 0, "north").otherwise("south")
    c, a = F.col("conc"), F.col("area")
    return df.groupBy(*by, side.alias("hemisphere")).agg(F.sum(c * a).alias("ice_area"), F.sum(F.when(c >= threshold, a).otherwise(0.0)).alias("ice_extent"), F.sum(F.col("thick") * a).alias("ice_volume"))


def drop_implausible(df: DataFrame, source: str, v: str, most: float) -> DataFrame:
    """Without the sources that anywhere exceed a bound."""
    bad = df.groupBy(source).agg(F.max(v).alias("top")).where(F.col("top") > most).select(source)
    return df.join(bad, source, "left_anti")


def hovmoller(df: DataFrame, weight: str = "area", v: str = "v") -> DataFrame:
    """Weighted mean by step and level, and its departure from the level's first step."""
    out = df.groupBy("t", "level").agg(wavg(v, weight).alias("v"))
    return out.withColumn("anomaly", F.col("v") - F.first("v").over(Window.partitionBy("level").orderBy("t")))


def layer_means(df: DataFrame, layers: dict[str, tuple[float, float]], by: Keys, v: str = "v") -> DataFrame:
    """Volume-weighted means of depth layers; a level counts to the layer that its depth lies in."""
    name = F.lit(None).cast("string")
    for layer, (top, bottom) in layers.items():
        name = F.when((F.col("depth") >= top) & (F.col("depth") < bottom), layer).otherwise(name)
    volume = F.col("area") * F.col("thickness")
    return df.withColumn("layer", name).where("layer IS NOT NULL").groupBy(*by, "layer").agg(wavg(v, volume).alias(v))


def level_thickness(levels: DataFrame) -> DataFrame:
    """Thickness between the midpoints of neighbouring depths; the outer levels reach as far as their other half."""
    w = Window.orderBy("depth")  # a table of levels: hundreds of rows at most
    up, down = F.lag("depth").over(w), F.lead("depth").over(w)
    top = F.coalesce((up + F.col("depth")) / 2, F.lit(0.0))
    bottom = F.coalesce((down + F.col("depth")) / 2, F.col("depth") + (F.col("depth") - top))
    return levels.withColumn("thickness", bottom - top)


def class_shares(df: DataFrame, by: Keys, code: str = "code", weight: str = "area") -> DataFrame:
    """Share of the classified area of each class, in percent."""
    out = df.where(F.col(code) >= 1).groupBy(*by, code).agg(F.sum(weight).alias("w"))
    return out.select(*by, code, (F.try_divide(F.col("w"), F.sum("w").over(Window.partitionBy(*by))) * 100).alias("percent"))


def transitions(df: DataFrame, reference: str, future: str, weight: str = "area") -> DataFrame:
    """Percent of the area classified in both that goes from each class to each other."""
    out = df.where((F.col(reference) >= 1) & (F.col(future) >= 1)).groupBy(reference, future).agg(F.sum(weight).alias("w"))
    total = out.agg(F.sum("w").alias("total"))
    return out.join(F.broadcast(total)).select(reference, future, F.try_divide(100.0 * F.col("w"), F.col("total")).alias("percent"))  # one row


def agreement(df: DataFrame, by: Keys, first: str, second: str, weight: str = "area") -> DataFrame:
    """Percent of the area classified in both where both say the same."""
    both = (F.col(first) >= 1) & (F.col(second) >= 1)
    return df.where(both).groupBy(*by).agg((wavg((F.col(first) == F.col(second)).cast("double"), weight) * 100).alias("agree"))


def colour_range(df: DataFrame, by: Keys, v: str = "v") -> DataFrame:
    """2nd and 98th percentile, and the 98th of the size for symmetric scales."""
    return df.groupBy(*by).agg(F.percentile(v, 0.02).alias("low"), F.percentile(v, 0.98).alias("high"), F.percentile(F.abs(v), 0.98).alias("symmetric"))


def spread_of_values(df: DataFrame, by: Keys, v: str = "v") -> DataFrame:
    """Minimum, quartiles and maximum."""
    q = F.percentile(v, F.array(*(F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0))))
    return df.groupBy(*by).agg(q.alias("q")).select(*by, *(F.col("q")[i].alias(n) for i, n in enumerate(("lowest", "q25", "median", "q75", "highest"))))

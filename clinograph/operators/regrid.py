"""Regridding as sparse weights: a table of source cell, target cell and weight, built once and joined.

Weights are found by equi-joins on tiles or bins, never by comparing all cells with all.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import great_circle
from ..session import cut_lineage

Keys = Sequence[str]


def apply_weights(field: DataFrame, weights: DataFrame, by: Keys, strict: bool = False, v: str = "v") -> DataFrame:
    """Weighted mean of source cells for each target cell.

    Missing sources drop out with their weight, or make the target missing if strict.
    """
    rows = field.join(weights, field.cell == weights.src_cell)
    value = F.try_divide(F.sum(F.col(v) * F.col("w")), F.sum(F.when(F.col(v).isNotNull(), F.col("w"))))
    if strict:
        value = F.when(F.count(v) == F.count(F.lit(1)), value)
    return rows.groupBy(*by, F.col("dst_cell").alias("cell")).agg(value.alias(v))


def nearest_weights(source: DataFrame, target: DataFrame, radius_km: float) -> DataFrame:
    """The nearest source cell within a radius of each target cell; ties go to the smaller number.

    Cells fall in tiles as high as the radius; in each row of tiles, tiles are as wide as the radius
    at the row's latitude nearest a pole.  A source is sent to its own and all touching tiles.
    """
    height = max(radius_km / 111.19, 0.01)
    rows = int(180 / height) + 1
    row = F.least(F.floor((F.col("lat") + 90.0) / height), F.lit(rows)).cast("int")

    def tiles_in(r):  # tiles of a row, one where the parallel is too short
        far = F.least(F.lit(90.0), F.greatest(F.abs(r * height - 90.0), F.abs((r + 1) * height - 90.0)) + height)
        return F.greatest(F.lit(1), F.floor(360.0 * F.cos(F.radians(far)) / height)).cast("int")

    near = source.select(F.col("cell").alias("src_cell"), F.col("lat").alias("src_lat"), F.pmod("lon", F.lit(360.0)).alias("src_lon"), row.alias("r0"))
    near = near.withColumn("r", F.explode(F.sequence(F.col("r0") - 1, F.col("r0") + 1))).withColumn("n", tiles_in(F.col("r")))
    near = near.withColumn("c0", F.least(F.floor(F.col("src_lon") / 360.0 * F.col("n")), F.col("n") - 1).cast("int"))
    near = near.withColumn("c", F.explode(F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.pmod(F.col("c0") + k, F.col("n"))))))
    wanted = target.select(F.col("cell").alias("dst_cell"), "lat", F.pmod("lon", F.lit(360.0)).alias("lon"), row.alias("r")).withColumn("n", tiles_in(F.col("r")))
    wanted = wanted.withColumn("c", F.least(F.floor(F.col("lon") / 360.0 * F.col("n")), F.col("n") - 1).cast("int"))
    pairs = wanted.join(near, ["r", "c"]).withColumn("km", great_circle("lat", "lon", "src_lat", "src_lon")).where(F.col("km") <= radius_km)
    return pairs.groupBy("dst_cell").agg(F.min_by("src_cell", F.struct("km", "src_cell")).alias("src_cell")).withColumn("w", F.lit(1.0))


def axis_brackets(source: DataFrame, target: DataFrame, wrap: float | None = None) -> DataFrame:
    """dst, src, w: the two source points round each target point of one axis (i, x) and their weights.

    Beyond the ends the last point counts alone; with `wrap` the axis goes round.
    """
    s = source.select(F.col("i").alias("src"), F.col("x").alias("at"))
    if wrap:
        ends = source.agg(F.min_by("i", "x").alias("i0"), F.min("x").alias("x0"), F.max_by("i", "x").alias("i1"), F.max("x").alias("x1"))
        s = s.unionByName(ends.select(F.col("i0").alias("src"), (F.col("x0") + wrap).alias("at"))).unionByName(ends.select(F.col("i1").alias("src"), (F.col("x1") - wrap).alias("at")))
    w = Window.orderBy("at", "kind")  # one axis: thousands of points at most
    both = s.select("src", "at", F.lit(None).cast("long").alias("dst"), F.lit(0).alias("kind")).unionByName(target.select(F.lit(None).cast("long").alias("src"), F.col("x").alias("at"), F.col("i").cast("long").alias("dst"), F.lit(1).alias("kind")))
    point = F.when(F.col("kind") == 0, F.struct("src", "at"))
    both = both.withColumn("lo", F.last(point, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("hi", F.first(point, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    share = F.when(F.col("lo").isNull() | F.col("hi").isNull(), F.when(F.col("lo").isNull(), 1.0).otherwise(0.0)).otherwise((F.col("at") - F.col("lo.at")) / (F.col("hi.at") - F.col("lo.at")))
    found = both.where("kind = 1").select("dst", F.col("lo.src").alias("a"), F.col("hi.src").alias("b"), share.alias("s"))
    low = found.select("dst", F.col("a").alias("src"), (1 - F.col("s")).alias("w"))
    return low.unionByName(found.select("dst", F.col("b").alias("src"), F.col("s").alias("w"))).where("src IS NOT NULL AND w > 0")


def bilinear_weights(lat_src: DataFrame, lon_src: DataFrame, lat_dst: DataFrame, lon_dst: DataFrame, n_lon_src: int, n_lon_dst: int) -> DataFrame:
    """Four-point weights between rectilinear grids from axes (i, x); cells are i_lat * n_lon + i_lon.

    Longitudes go round; beyond the outermost parallels their values hold.
    """
    y = axis_brackets(lat_src, lat_dst).select(F.col("dst").alias("dy"), F.col("src").alias("sy"), F.col("w").alias("wy"))
    x = axis_brackets(lon_src, lon_dst, 360.0).select(F.col("dst").alias("dx"), F.col("src").alias("sx"), F.col("w").alias("wx"))
    both = y.join(F.broadcast(x))  # an axis: thousands of rows; a grid is the product of its axes
    return both.select((F.col("dy") * n_lon_dst + F.col("dx")).alias("dst_cell"), (F.col("sy") * n_lon_src + F.col("sx")).alias("src_cell"), (F.col("wy") * F.col("wx")).alias("w"))


def overlaps(source: DataFrame, target: DataFrame, width: float) -> DataFrame:
    """dst, src, lo, hi: overlapping intervals of two axes (i, a, z), found by bins of a width."""
    bins = lambda df: df.withColumn("bin", F.explode(F.sequence(F.floor(F.col("a") / width), F.greatest(F.floor(F.col("a") / width), F.ceil(F.col("z") / width) - 1))))
    s = bins(source.select(F.col("i").alias("src"), "a", "z")).withColumnsRenamed({"a": "sa", "z": "sz"})
    t = bins(target.select(F.col("i").alias("dst"), "a", "z"))
    both = s.join(t, "bin").select("dst", "src", F.greatest("a", "sa").alias("lo"), F.least("z", "sz").alias("hi"))
    return both.where("hi > lo").distinct()


def conservative_weights(lat_src: DataFrame, lon_src: DataFrame, lat_dst: DataFrame, lon_dst: DataFrame, n_lon_src: int, n_lon_dst: int, width: float) -> DataFrame:
    """Share of each target cell's area that a source cell covers, from cell edges (i, a, z) in degrees."""
    rad = lambda c: F.sin(F.radians(c))
    y = overlaps(lat_src, lat_dst, width).select(F.col("dst").alias("dy"), F.col("src").alias("sy"), (rad("hi") - rad("lo")).alias("h"))
    x = overlaps(lon_src, lon_dst, width).select(F.col("dst").alias("dx"), F.col("src").alias("sx"), (F.col("hi") - F.col("lo")).alias("b"))
    both = y.join(F.broadcast(x))  # an axis: thousands of rows
    rows = both.select((F.col("dy") * n_lon_dst + F.col("dx")).alias("dst_cell"), (F.col("sy") * n_lon_src + F.col("sx")).alias("src_cell"), (F.col("h") * F.col("b")).alias("area"))
    return rows.withColumn("w", F.col("area") / F.sum("area").over(Window.partitionBy("dst_cell"))).drop("area")


def box_average(df: DataFrame, by: Keys, size: float, v: str = "v") -> DataFrame:
    """Plain means of native points in boxes of `size` degrees."""
    n = int(round(360 / size))
    return df.groupBy(*by, F.floor((F.col("lat") + 90.0) / size).alias("iy"), F.pmod(F.floor(F.col("lon") / size), F.lit(n)).alias("ix")).agg(F.avg(v).alias(v))


def coarsen(df: DataFrame, by: Keys, factor: int, n_y: int, n_x: int, v: str = "v") -> DataFrame:
    """Means of factor x factor blocks; incomplete blocks at the far edges go."""
    inside = df.where((F.col("iy") < n_y // factor * factor) & (F.col("ix") < n_x // factor * factor))
    return inside.groupBy(*by, F.floor(F.col("iy") / factor).alias("by"), F.floor(F.col("ix") / factor).alias("bx")).agg(F.avg(v).alias(v))


def merge_points(points: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """cell, group: cells whose places coincide within a tolerance (radians) on the unit sphere.

    Cells whose places agree to twelve digits, such as a pole's, are one place.  Places fall in cubes; each is
    compared with those in touching cubes, and groups are the chains' components, by the smallest cell.
    """
    lat, lon = F.radians("lat"), F.radians("lon")
    places = {"x": F.cos(lat) * F.cos(lon), "y": F.cos(lat) * F.sin(lon), "z": F.sin(lat)}
    cells = points.select("cell", *(F.round(v, 12).alias(c) for c, v in places.items()))
    xyz = cells.groupBy("x", "y", "z").agg(F.min("cell").alias("cell"))
    cube = lambda c: F.floor(F.col(c) / tolerance)
    near = xyz.select(F.col("cell").alias("cell2"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("z").alias("z2"))
    firsts = cells.join(xyz.withColumnRenamed("cell", "first"), ["x", "y", "z"]).select("cell", "first")
    groups = xyz.select("cell", F.col("cell").alias("group"))
    for c in "xyz":
        xyz = xyz.withColumn(f"k{c}", cube(c))
        near = near.withColumn(f"k{c}", F.explode(F.sequence(F.floor(F.col(f"{c}2") / tolerance) - 1, F.floor(F.col(f"{c}2") / tolerance) + 1)))
    apart = F.sqrt(F.pow(F.col("x") - F.col("x2"), 2) + F.pow(F.col("y") - F.col("y2"), 2) + F.pow(F.col("z") - F.col("z2"), 2))
    links = xyz.join(near, ["kx", "ky", "kz"]).where((apart <= tolerance) & (F.col("cell2") != F.col("cell"))).select("cell", "cell2")
    links = cut_lineage(links)
    while True:  # a round takes the smallest group at hand, then that group's own: the reach doubles
        known = groups.select(F.col("cell").alias("cell2"), F.col("group").alias("g2"))
        step = links.join(known, "cell2").groupBy("cell").agg(F.min("g2").alias("g2"))
        after = groups.select("cell", F.col("group").alias("old")).join(step, "cell", "left").select("cell", "old", F.least("old", F.coalesce("g2", "old")).alias("near"))
        hop = after.select(F.col("cell").alias("near"), F.col("near").alias("group"))
        groups = cut_lineage(after.join(hop, "near").select("cell", "group", (F.col("group") < F.col("old")).alias("moved")))
        if groups.where("moved").isEmpty():
            return firsts.join(groups.select(F.col("cell").alias("first"), "group"), "first").select("cell", "group")


def group_values(field: DataFrame, groups: DataFrame, by: Keys, v: str = "v") -> DataFrame:
    """Mean of what is there over merged points."""
    return field.join(groups, "cell").groupBy(*by, F.col("group").alias("cell")).agg(F.avg(v).alias(v))


def fill_nearest(boxes: DataFrame, wanted: DataFrame, points: DataFrame, radius_km: float) -> DataFrame:
    """Boxes without a point take the nearest point within a radius."""
    empty = wanted.join(boxes.select("cell"), "cell", "left_anti")
    weights = nearest_weights(points, empty, radius_km)
    filled = weights.join(points.select(F.col("cell").alias("src_cell"), "v"), "src_cell").select(F.col("dst_cell").alias("cell"), "v")
    return boxes.select("cell", "v").unionByName(filled)

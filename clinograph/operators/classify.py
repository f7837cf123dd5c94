"""Climate classification and the physics of derived fields."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Keys = Sequence[str]

# The names of classes 1 to 14.
CLASSES = ("Ar", "Aw", "As", "BW", "BS", "Cs", "Cw", "Cf", "Do", "Dc", "Eo", "Ec", "Ft", "Fi")


def climate_class(df: DataFrame, keys: Keys, month: str = "month", t: str = "t_c", p: str = "p_cm", lat: str = "lat") -> DataFrame:
    """Class of each key from twelve monthly temperatures (C) and precipitation sums (cm).

    One aggregation makes all the statistics; the classes are tried in the order polar, boreal, dry,
    temperate, subtropical, tropical.  0 is unclassified; without temperature NULL.
    """
    T, P, m = F.col(t), F.col(p), F.col(month)
    half = (m >= 10) | (m <= 3)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    pick = lambda a, b: F.when(F.col("lat") >= 0, F.col(a)).otherwise(F.col(b))
    s = df.groupBy(*keys).agg(
        F.max(lat).alias("lat"), F.avg(T).alias("t_ann"), F.min(T).alias("t_cold"), F.max(T).alias("t_warm"), F.count_if(T >= 10).alias("mild"), zero(F.sum(P)).alias("p_ann"),
        zero(F.sum(F.when(half, P))).alias("p_oct"), zero(F.sum(F.when(~half, P))).alias("p_apr"), F.min(F.when(half, P)).alias("d_oct"), F.min(F.when(~half, P)).alias("d_apr"), F.count_if(P > 6).alias("wet"), F.count_if(P <= 6).alias("dry"))
    s = s.withColumns({"p_win": pick("p_oct", "p_apr"), "p_sum": pick("p_apr", "p_oct"), "d_win": pick("d_oct", "d_apr"), "d_sum": pick("d_apr", "d_oct")})
    share = F.when(F.col("p_ann") > 0, F.try_divide(100.0 * F.col("p_win"), F.col("p_ann"))).otherwise(0.0)
    s = s.withColumn("r", 2.3 * F.col("t_ann") - 0.64 * share + 41.0)
    c = F.col
    polar, boreal, arid = c("t_warm") <= 10, c("mild").between(1, 3), c("p_ann") < c("r")
    temperate, subtropical = c("mild").between(4, 7), (c("t_cold") <= 18) & (c("mild") >= 8)
    tropical = (c("t_cold") >= 18) & (c("p_ann") >= c("r"))
    tests: list[tuple[Column, int]] = [
        (polar & (c("t_warm") > 0), 13), (polar, 14), (boreal & (c("t_cold") > -10), 11), (boreal, 12), (arid & (c("p_ann") <= 0.5 * c("r")), 4), (arid, 5), (temperate & (c("t_cold") > 0), 9), (temperate, 10),
        (subtropical & (c("d_sum") <= 3) & (c("p_win") >= 3 * c("p_sum")) & (c("p_ann") <= 89), 6), (subtropical & (c("d_win") <= 3) & (c("p_sum") >= 10 * c("p_win")), 7), (subtropical, 8),
        (tropical & (c("wet") >= 10) & (c("dry") <= 2), 1), (tropical & (c("d_win") < 6) & (c("dry") > 2), 2), (tropical & (c("d_sum") <= 6), 3), (c("p_ann") == 0, 4)]
    code = F.when(c("t_ann").isNull(), None)
    for test, value in tests:
        code = code.when(test, value)
    return s.select(*keys, code.otherwise(0).cast("int").alias("code"))


def net_radiation(df: DataFrame, keys: Keys, variable: str = "variable", v: str = "v") -> DataFrame:
    """Budgets at the top and the surface, the cloud effect and what the atmosphere takes up.

    Fluxes count downward as positive; variables are rst, rlt, rss, rls, their clear-sky rstcs and
    rltcs, and the turbulent hfls and hfss.  The pivot names its columns, so no job looks for them.
    """
    wide = df.groupBy(*keys).pivot(variable, ["rst", "rlt", "rss", "rls", "rstcs", "rltcs", "hfls", "hfss"]).agg(F.first(v))
    c = F.col
    toa, surface = c("rst") + c("rlt"), c("rss") + c("rls") + F.coalesce("hfls", F.lit(0.0)) + F.coalesce("hfss", F.lit(0.0))
    return wide.select(*keys, toa.alias("toa_net"), surface.alias("sfc_net"), (toa - c("rstcs") - c("rltcs")).alias("cre"), (toa - surface).alias("atm"))


def derived(first: DataFrame, second: DataFrame, a: float, b: float, on: Keys, v: str = "v") -> DataFrame:
    """a times one field plus b times another."""
    return first.select(*on, F.col(v).alias("x")).join(second.select(*on, F.col(v).alias("y")), list(on)).select(*on, (a * F.col("x") + b * F.col("y")).alias(v))


def unit_scale(df: DataFrame, by: Keys, limit: float, factor: float, v: str = "v") -> DataFrame:
    """Values times a factor for the sources whose largest value passes a limit."""
    top = df.groupBy(*by).agg(F.max(v).alias("top"))
    return df.join(top, list(by)).withColumn(v, F.when(F.col("top") > limit, F.col(v) * factor).otherwise(F.col(v))).drop("top")


def ice_fraction(df: DataFrame, by: Keys, v: str = "v") -> DataFrame:
    """Percent made fractions, and fractions a little over one clipped."""
    top = df.groupBy(*by).agg(F.max(v).alias("top"))
    x = F.when(F.col("top") > 1.5, F.col(v) / 100).when(F.col("top") > 1.01, F.least(F.col(v), F.lit(1.0))).otherwise(F.col(v))
    return df.join(top, list(by)).withColumn(v, x).drop("top")


def thin_ice(v: str = "v", most: float = 50.0) -> Column:
    """Thicknesses in metres; what is beyond any ice is a fill value."""
    return F.when(F.col(v) <= most, F.col(v))


def check_range(df: DataFrame, by: Keys, low: float, high: float, v: str = "v") -> DataFrame:
    """Sources whose mean lies in a plausible range."""
    return df.groupBy(*by).agg(F.avg(v).alias("mean")).where(F.col("mean").between(low, high)).select(*by)


def common_land(own: DataFrame, others: Sequence[DataFrame], least: float, cell: str = "cell") -> DataFrame:
    """Cells whose land fraction, from the first source that knows it, reaches a threshold."""
    out = own.select(cell, F.col("land_frac").alias("f0"))
    for k, df in enumerate(others, 1):
        out = out.join(df.select(cell, F.col("land_frac").alias(f"f{k}")), cell, "full")
    return out.where(F.coalesce(*(f"f{k}" for k in range(len(others) + 1))) >= least).select(cell)

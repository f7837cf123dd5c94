"""Tests, spectra, decomposition and high-pass statistics."""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.distributions import f_two_sided, f_upper, t_two_sided
from .mhw import smooth_slots
from .temporal import centred_mean, remove_fit

Keys = Sequence[str]


@F.pandas_udf(DoubleType())
def t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(t_two_sided(t.to_numpy(float), df.to_numpy(float)))


@F.pandas_udf(DoubleType())
def f_p(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    return pd.Series(f_upper(f.to_numpy(float), df1.to_numpy(float), df2.to_numpy(float)))


@F.pandas_udf(DoubleType())
def f_p_two(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    return pd.Series(f_two_sided(f.to_numpy(float), df1.to_numpy(float), df2.to_numpy(float)))


def paired_t(df: DataFrame, by: Keys, a: str, b: str, weight: str | None = "area") -> DataFrame:
    """t and degrees of freedom of the mean difference over cells, weighted with Kish's sample size.

    NULL below three pairs; without variance 0, or infinite with the sign of the difference.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    rows = df.select(*by, (F.col(a) - F.col(b)).alias("d"), w.alias("w")).where("d IS NOT NULL AND w > 0")
    s = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("w")).alias("sww"), F.sum(F.col("w") * F.col("d")).alias("sd"), F.min("d").alias("lo"), F.max("d").alias("hi"))
    s = s.withColumn("mean", F.col("sd") / F.col("sw")).withColumn("v2", F.col("sww") / (F.col("sw") * F.col("sw")))
    dev = rows.join(s, list(by)).groupBy(*by).agg(F.sum(F.col("w") / F.col("sw") * F.pow(F.col("d") - F.col("mean"), 2)).alias("ss"))
    out = s.join(dev, list(by))
    t = F.when(F.col("n") < 3, None).when(F.col("lo") == F.col("hi"), F.when(F.col("lo") == 0, 0.0).otherwise(F.signum("lo") * float("inf"))).otherwise(F.try_divide(F.col("mean"), F.sqrt(F.try_divide(F.col("ss"), 1 - F.col("v2")) * F.col("v2"))))
    return out.select(*by, F.col("mean").alias("mean_diff"), t.alias("t"), (1 / F.col("v2") - 1).alias("df"))


def anova(df: DataFrame, source: str = "source", cell: str = "cell", v: str = "v") -> DataFrame:
    """F and its degrees of freedom between sources over the cells that all have."""
    from .align import common_cells

    rows = df.join(common_cells(df, source, cell), cell, "left_semi")
    g = rows.groupBy(source).agg(F.count(v).alias("n"), F.avg(v).alias("m"), F.var_pop(v).alias("var"))
    t = g.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"), F.sum(F.col("n") * F.col("var")).alias("within"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("nmm"))
    between = F.col("nmm") - F.col("n") * F.col("grand") * F.col("grand")
    df1, df2 = F.col("k") - 1, F.col("n") - F.col("k")
    return t.select(F.try_divide(F.try_divide(between, df1), F.try_divide(F.col("within"), df2)).alias("f"), df1.alias("df1"), df2.alias("df2"))


def variance_ratio(df: DataFrame, by: Keys, model: str, obs: str, weight: str = "area") -> DataFrame:
    """Ratio of weighted population variances over cells and its degrees of freedom."""
    w, m, o = F.col(weight), F.col(model), F.col(obs)
    rows = df.where(m.isNotNull() & o.isNotNull() & (w > 0))
    s = rows.groupBy(*by).agg(F.sum(w).alias("w"), F.sum(w * w).alias("ww"), (F.sum(w * m) / F.sum(w)).alias("mm"), (F.sum(w * o) / F.sum(w)).alias("mo"), F.count(F.lit(1)).alias("n"))
    out = rows.join(s.withColumnRenamed("w", "sw"), list(by)).groupBy(*by).agg((F.sum(w * F.pow(m - F.col("mm"), 2)) / F.max("sw")).alias("vm"), (F.sum(w * F.pow(o - F.col("mo"), 2)) / F.max("sw")).alias("vo"), (F.max(F.col("sw") * F.col("sw") / F.col("ww")) - 1).alias("df"), F.max("n").alias("n"))
    ratio = F.when(F.col("n") < 3, None).when(F.col("vo") == 0, F.when(F.col("vm") == 0, 1.0).otherwise(float("inf"))).otherwise(F.try_divide("vm", "vo"))
    return out.select(*by, ratio.alias("f"), "df")


def bootstrap_slope(df: DataFrame, keys: Keys, replicates: int = 10_000, seed: int = 0, v: str = "v") -> DataFrame:
    """2.5th and 97.5th percentile of slopes over years drawn with replacement.

    Draws are a hash of replicate and place, so they are the same wherever a task runs.  A key's
    years are one array, so a replicate is one row with its sums, and draws are never shuffled.
    """
    there = df.where(F.col(v).isNotNull())
    series = there.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("year").cast("double").alias("x"), F.col(v).cast("double").alias("y")))).alias("s"), F.avg(v).alias("mean"))
    n, first = F.size("s"), F.element_at("s", 1)["x"]
    drawn = F.transform(F.sequence(F.lit(0), n - 1), lambda place: F.element_at("s", F.pmod(F.xxhash64(F.lit(seed), "rep", place), n).cast("int") + 1))
    zero = F.struct(*(F.lit(0.0).alias(c) for c in ("x", "y", "xx", "xy")))

    def add(sums, one):
        x, y = one["x"] - first, one["y"] - F.col("mean")  # small numbers, for the differences of products below
        return F.struct((sums["x"] + x).alias("x"), (sums["y"] + y).alias("y"), (sums["xx"] + x * x).alias("xx"), (sums["xy"] + x * y).alias("xy"))

    slope = F.aggregate(drawn, zero, add, lambda a: F.try_divide(n * a["xy"] - a["x"] * a["y"], n * a["xx"] - a["x"] * a["x"]))
    slopes = series.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).select(*keys, slope.alias("slope"))
    return slopes.groupBy(*keys).agg(F.percentile("slope", 0.025).alias("low"), F.percentile("slope", 0.975).alias("high"))


def high_pass(days: DataFrame, keys: Keys, width: int = 365, smooth: int = 31) -> DataFrame:
    """mean, std of the series, of its anomaly from the smoothed slot climatology less its trend, and of
    that less its running mean (at least half of the window there)."""
    keys = list(keys)
    sums = days.groupBy(*keys, "slot").agg(F.sum("v").alias("s"), F.count("v").cast("double").alias("c"))
    clim = smooth_slots(sums, keys, ("s", "c"), smooth) if smooth > 1 else sums
    anomaly = days.join(clim, [*keys, "slot"], "left").withColumn("a", F.col("v") - F.try_divide("s", "c")).withColumn("year", F.col("t_idx"))
    flat = remove_fit(anomaly, keys, "a")
    slow = centred_mean(flat, keys, width, -(-width // 2), "t_idx", "a")
    return slow.groupBy(*keys).agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std_raw"), F.stddev_pop("a").alias("std_anom"), F.stddev_pop(F.col("a") - F.col("smooth")).alias("std_hp"))


def welch(values: np.ndarray, step: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """(period, power) of Hann-windowed, linearly detrended half-overlapping segments, longest first."""
    x = np.nan_to_num(np.asarray(values, float))
    if len(x) < 8:
        return np.zeros(0), np.zeros(0)
    size = min(len(x), max(8, len(x) // 4))
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    time = np.arange(size)
    total, count = 0.0, 0
    for start in range(0, len(x) - size + 1, size - size // 2):
        part = x[start : start + size]
        part = part - np.polyval(np.polyfit(time, part, 1), time)
        total, count = total + np.abs(np.fft.rfft(part * window)) ** 2, count + 1
    power = total / count * step / (window**2).sum()
    power[1 : None if size % 2 else -1] *= 2
    frequency = np.fft.rfftfreq(size, step)
    return 1 / frequency[1:], power[1:]


def spectrum(df: DataFrame, key: str, order: str = "t", v: str = "v") -> DataFrame:
    """key, period, power of each series; a series is one group, a few thousand steps."""
    kind = df.schema[key].dataType.simpleString()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        period, power = welch(group.sort_values(order)[v].to_numpy(float))
        return pd.DataFrame({key: group[key].iloc[0], "period": period, "power": power}, columns=[key, "period", "power"])

    return df.select(key, order, v).groupBy(key).applyInPandas(run, f"{key} {kind}, period double, power double")


#: Steps of the longest record that is decomposed: the steps x steps matrix must fit a task and the driver.
MOST_STEPS = 4_000


def gram(df: DataFrame, cell: str = "cell", t: str = "t", x: str = "x", weight: str | None = None) -> DataFrame:
    """Sum over cells of w^2 x_i x_j for each pair of steps that some cell has both of: few steps, many cells.

    Each cell's steps become one array; a task multiplies its cells as a matrix, and only its steps x steps
    sums are shuffled.  Null values take no part.  More than MOST_STEPS steps raise ValueError: take means first.
    """
    axis = [r[0] for r in df.where(F.col(t).isNotNull()).select(t).distinct().orderBy(t).limit(MOST_STEPS + 1).collect()]
    if len(axis) > MOST_STEPS:
        raise ValueError(f"more than {MOST_STEPS} steps")
    kind = df.schema[t].dataType.simpleString()
    spark, size = df.sparkSession, len(axis)
    steps = spark.createDataFrame(list(enumerate(axis)), f"place int, {t} {kind}")
    value = F.col(x).cast("double") * (F.col(weight).cast("double") if weight else F.lit(1.0))
    rows = df.select(cell, t, value.alias("x")).where("x IS NOT NULL").join(F.broadcast(steps), t)  # MOST_STEPS rows at most
    rows = rows.groupBy(cell).agg(F.collect_list("place").alias("places"), F.collect_list("x").alias("xs"))

    def products(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, both = np.zeros((size, size)), np.zeros((size, size), bool)
        for frame in frames:
            for first in range(0, len(frame), 256):
                part = frame.iloc[first : first + 256]
                values, there = np.zeros((len(part), size)), np.zeros((len(part), size), np.float32)
                for row, (places, xs) in enumerate(zip(part["places"], part["xs"])):
                    np.add.at(values[row], places, xs)
                    there[row, places] = 1
                total += values.T @ values
                both |= there.T @ there > 0
        for i in range(size):
            j = np.flatnonzero(both[i, i:]) + i
            if len(j):
                yield pd.DataFrame({"i": np.int32(i), "j": j.astype(np.int32), "g": total[i, j]})

    sums = rows.select("places", "xs").mapInPandas(products, "i int, j int, g double").groupBy("i", "j").agg(F.sum("g").alias("g"))
    named = lambda c: F.broadcast(steps.select(F.col("place").alias(c), F.col(t).alias(f"{c}_step")))
    return sums.join(named("i"), "i").join(named("j"), "j").select(F.col("i_step").alias("i"), F.col("j_step").alias("j"), "g")


def eof(df: DataFrame, modes: int = 3, cell: str = "cell", t: str = "t", v: str = "v", lat: str | None = "lat") -> tuple[DataFrame, DataFrame]:
    """(pcs: mode, t, pc, explained; patterns: mode, cell, pattern) by the steps' Gram matrix.

    Cells with a missing step are left out.  Only the steps x steps matrix reaches the driver; its
    eigenvectors go back as a small table.  PCs have population variance one, patterns the field's units.
    """
    spark = df.sparkSession
    steps = df.select(F.count_distinct(t).alias("steps"))
    whole = df.groupBy(cell).agg(F.count(v).alias("n")).join(F.broadcast(steps)).where("n = steps").select(cell)  # one row
    rows = df.join(whole, cell, "left_semi").withColumn("x", F.col(v) - F.avg(v).over(Window.partitionBy(cell)))
    rows = rows.withColumn("w", F.sqrt(F.cos(F.radians(lat))) if lat else F.lit(1.0))
    g = gram(rows, cell, t, "x", "w").toPandas()
    axis = sorted(set(g["i"]))
    place = {s: k for k, s in enumerate(axis)}
    matrix = np.zeros((len(axis), len(axis)))
    i, j = g["i"].map(place).to_numpy(int), g["j"].map(place).to_numpy(int)
    matrix[i, j] = matrix[j, i] = g["g"].to_numpy(float)
    values, vectors = np.linalg.eigh(matrix) if axis else (np.zeros(0), matrix)  # without a whole cell there is no mode
    order = np.argsort(values)[::-1][: min(modes, len(axis))]
    share = values / values.sum() if values.sum() else values
    scores = [(int(m + 1), axis[k], float(vectors[k, o] * np.sqrt(len(axis))), float(share[o])) for m, o in enumerate(order) for k in range(len(axis))]
    kind = df.schema[t].dataType.simpleString()
    pcs = spark.createDataFrame(scores, f"mode int, {t} {kind}, pc double, explained double")
    patterns = rows.join(F.broadcast(pcs), t).groupBy("mode", cell).agg(F.avg(F.col("x") * F.col("pc")).alias("pattern"))  # modes x steps rows
    return pcs, patterns


def fix_sign(pcs: DataFrame, patterns: DataFrame, grid: DataFrame, lat: float, lon: float, cell: str = "cell") -> tuple[DataFrame, DataFrame]:
    """Turns modes so that the pattern at the cell nearest a place is not positive."""
    from ..functions.columns import great_circle

    near = patterns.join(grid, cell).groupBy("mode").agg(F.min_by("pattern", F.struct(great_circle("lat", "lon", F.lit(lat), F.lit(lon)), F.col(cell))).alias("at"))
    sign = near.select("mode", F.when(F.col("at") > 0, -1.0).otherwise(1.0).alias("sign"))
    turn = lambda df, c: df.join(F.broadcast(sign), "mode").withColumn(c, F.col(c) * F.col("sign")).drop("sign")  # noqa: E731  a row a mode
    return turn(pcs, "pc"), turn(patterns, "pattern")


def regression_pattern(df: DataFrame, index: DataFrame, keys: Keys, t: str = "t", v: str = "v") -> DataFrame:
    """Covariance of the field with an index, for one standard deviation of the index."""
    rows = df.join(index.select(t, "index"), t)
    return rows.groupBy(*keys).agg(F.try_divide(F.covar_pop(v, "index"), F.stddev_pop("index")).alias("pattern"))

"""The diagnostics as named compositions of operators.

A diagnostic is a function of (inputs, settings) -> named DataFrames, where inputs is a mapping of
named fields.  They stay lazy: what is not asked for is not computed.  Fields are long tables with
source, cell, t (or d) and v; `grid` has cell, lat, lon, area and land_frac.
"""
from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import added_value, change, in_box, season
from ..operators import align, classify, ensemble, extremes, mhw, regrid, spatial, stats, temporal

Fields = Mapping[str, DataFrame]
REGISTRY: dict[str, Callable[..., dict[str, DataFrame]]] = {}


@dataclass(frozen=True)
class Settings:
    """Periods and thresholds of a run."""

    period: tuple[int, int] = (1990, 2014)
    reference: tuple[int, int] = (1995, 2014)
    future: tuple[int, int] = (2081, 2100)
    base: tuple[int, int] = (1983, 2012)
    land: float = 0.5
    band: float = 1.0
    level: float = 2.0
    min_days: int = 350
    extra: Mapping = field(default_factory=dict)


def register(name: str):
    def add(make):
        REGISTRY[name] = make
        return make

    return add


def run(name: str, fields: Fields, settings: Settings = Settings()) -> dict[str, DataFrame]:
    """The tables of a diagnostic; KeyError names what is unknown."""
    return REGISTRY[name](fields, settings)


def run_all(fields: Fields, settings: Settings = Settings()) -> dict[str, dict[str, DataFrame] | str]:
    """Every diagnostic; one whose inputs are missing says which, and the others go on."""
    out: dict[str, dict[str, DataFrame] | str] = {}
    for name, make in REGISTRY.items():
        try:
            out[name] = make(fields, settings)
        except KeyError as missing:
            out[name] = f"missing input {missing}"
    return out


def gridded(f: Fields, name: str) -> DataFrame:
    return f[name].join(f["grid"].select("cell", "lat", "lon", "area", "land_frac"), "cell")


def period_means(df: DataFrame) -> DataFrame:
    """Annual and seasonal climatologies in one pass."""
    rows = df.withColumn("season", season(F.month("t")))
    out = rows.groupingSets([["source", "cell", "season"], ["source", "cell"]], "source", "cell", "season").agg(F.avg("v").alias("v"), F.grouping("season").alias("whole"))
    return out.select("source", "cell", F.when(F.col("whole") == 1, "annual").otherwise(F.col("season")).alias("season"), "v")


def bias_tables(f: Fields, s: Settings, model: str = "model", obs: str = "obs") -> dict[str, DataFrame]:
    """Biases by period, their statistics, t-tests, ensemble and family means."""
    here = lambda name: period_means(temporal.in_years(f[name], *s.period))
    reference = here(obs).drop("source")
    bias = align.bias(here(model), reference, ["cell", "season"]).join(f["grid"].select("cell", "area"), "cell")
    out = {"bias": bias, "statistics": spatial.bias_statistics(bias, ["source", "season"]), "ttest": stats.paired_t(bias, ["source", "season"], "v", "ref"), "ensemble": ensemble.mean_median(bias, ["cell", "season"], v="bias")}
    if "families" in f:
        out["family"] = ensemble.family_mean(bias.join(f["families"], "source"), ["cell", "season"], v="bias")
    return out


@register("global_biases")
def global_biases(f, s):
    return bias_tables(f, s)


@register("global_trends")
def global_trends(f, s):
    annual = lambda name: temporal.annual_mean(temporal.in_years(f[name], *s.period), ["source", "cell"])
    trend = lambda name: temporal.linear_trend(annual(name), ["source", "cell"]).select("source", "cell", (F.col("slope") * 10).alias("v"))
    bias = align.bias(trend("model"), trend("obs").drop("source"), ["cell"]).join(f["grid"].select("cell", "area"), "cell")
    seasonal = temporal.season_year_mean(temporal.in_years(f["model"], *s.period), ["source", "cell"])
    return {"trend": trend("model"), "bias": bias, "statistics": spatial.bias_statistics(bias, ["source"]), "seasonal": temporal.linear_trend(seasonal, ["source", "cell", "season"])}


@register("timeseries")
def timeseries(f, s):
    mean = spatial.area_mean(gridded(f, "model"), ["source", "t"])
    return {"series": mean, "anomaly": temporal.against_mean(mean, ["source"]), "envelope": ensemble.envelope(mean, ["t"]), "common": align.common_steps(mean)}


@register("seasonal_cycle")
def seasonal_cycle(f, s):
    return {"cycle": temporal.monthly_climatology(spatial.area_mean(gridded(f, "model"), ["source", "t"]), ["source"])}


@register("climate_variability")
def climate_variability(f, s):
    std = lambda name: temporal.variability(temporal.in_years(f[name], *s.period), ["source", "cell"]).withColumnRenamed("std", "v")
    return {"std": std("model"), "bias": align.bias(std("model"), std("obs").drop("source"), ["cell"])}


@register("radiation_budget")
def radiation_budget(f, s):
    net = classify.net_radiation(f["radiation"], ["source", "cell", "t"]).join(f["grid"].select("cell", "area"), "cell")
    series = net.groupBy("source", "t").agg(*(F.try_divide(F.sum(F.col(c) * F.col("area")), F.sum(F.when(F.col(c).isNotNull(), F.col("area")))).alias(c) for c in ("toa_net", "sfc_net", "cre", "atm")))
    return {"budget": series.groupBy("source").agg(*(F.avg(c).alias(c) for c in ("toa_net", "sfc_net", "cre", "atm"))), "imbalance": series.select("source", F.year("t").alias("year"), "toa_net").groupBy("source", "year").agg(F.avg("toa_net").alias("v"))}


@register("sea_ice")
def sea_ice(f, s):
    rows = classify.ice_fraction(f["ice"], ["source"], "conc").withColumn("thick", F.when(F.col("thick") > 100, 0.0).otherwise(F.col("thick")))
    totals = spatial.ice_totals(rows.join(f["grid"].select("cell", "lat", "area"), "cell"), ["source", "t"])
    totals = spatial.drop_implausible(totals, "source", "ice_area", 1e14)
    march = f["ice"].where(F.month("t").isin(3, 9)).groupBy("source", "cell", F.month("t").alias("month")).agg(F.avg("conc").alias("v"))
    return {"series": totals, "cycle": temporal.monthly_climatology(totals, ["source", "hemisphere"], "ice_area"), "extremes": temporal.extreme_months(totals, ["source", "hemisphere"], v="ice_area"), "maps": march}


def surface(f: Fields, s: Settings, model: str, obs: str) -> dict[str, DataFrame]:
    out = bias_tables(f, s, model, obs)
    rows = gridded(f, model)
    out["series"] = spatial.coslat_mean(rows, ["source", "t"])
    out["cycle"] = temporal.monthly_climatology(out["series"], ["source"])
    out["zonal"] = spatial.zonal_mean(rows, ["source"], s.band)
    out["trend"] = temporal.linear_trend(temporal.annual_mean(f[model], ["source", "cell"]), ["source", "cell"])
    out["taylor"] = spatial.taylor(out["bias"], ["source", "season"], "v", "ref")
    return out


@register("ocean_sst")
def ocean_sst(f, s):
    return surface(f, s, "sst", "sst_obs")


@register("sst_hadisst")
def sst_hadisst(f, s):
    return surface(f, s, "sst", "sst_obs2")


@register("ocean_bias")
def ocean_bias(f, s):
    return bias_tables(f, s, "sst", "sst_obs")


@register("ocean_en4")
def ocean_en4(f, s):
    rows = f["ocean"].join(f["grid"].select("cell", "area"), "cell").join(F.broadcast(f["levels"]), "level")  # tens of levels
    layers = {"0-700": (0.0, 700.0), "700-2000": (700.0, 2000.0), "2000-bottom": (2000.0, 1e9)}
    return {"hovmoller": spatial.hovmoller(rows), "layers": spatial.layer_means(rows, layers, ["source", "t"])}


@register("temperature_berkeley")
def temperature_berkeley(f, s):
    land = classify.common_land(f["grid"], [], s.land)
    cut = {**f, "sst": f["model"].join(land, "cell", "left_semi"), "sst_obs": f["obs"].join(land, "cell", "left_semi")}
    return surface(cut, s, "sst", "sst_obs")


@register("precipitation_mswep")
def precipitation_mswep(f, s):
    out = surface(f, s, "precip", "precip_obs")
    out["relative"] = out["bias"].withColumn("percent", F.when(F.col("ref") > 0.1, F.try_divide(100.0 * F.col("bias"), F.col("ref"))))
    out["pdf"] = spatial.weighted_pdf(gridded(f, "precip"), ["source"], 1e-7, 1e-3, 50)
    return out


@register("added_value")
def added_value_maps(f, s):
    coarse = bias_tables(f, s, "coarse")["bias"].select("cell", "season", F.col("bias").alias("e1"))
    fine = bias_tables(f, s)["bias"].join(coarse, ["cell", "season"]).withColumn("av", added_value("e1", "bias"))
    out = {"av": fine, "shares": ensemble.av_shares(fine, ["source", "season"])}
    if "regions" in f:
        rows = fine.join(f["regions"], "cell")
        by_region = ensemble.av_shares(rows, ["region", "source", "season"])
        out |= {"regions": by_region, "keep": ensemble.keep_set(by_region.select("region", F.col("source").alias("member"), F.col("mean_av").alias("av")))}
    return out


# Boxes (south, north, west, east) of indices that are box means or differences.
BOXES = {"ENSO": ((-5.0, 5.0, 190.0, 240.0),), "IOD": ((-10.0, 10.0, 50.0, 70.0), (-10.0, 0.0, 90.0, 110.0)), "QBO": ((-5.0, 5.0, 0.0, 359.99),)}
# Boxes of modes by decomposition, and the place whose sign is fixed.
EOF_MODES = {"NAO": ((20.0, 80.0, 270.0, 40.0), (65.0, 340.0)), "SAM": ((-90.0, -20.0, 0.0, 359.99), (-65.0, 0.0)), "AO": ((20.0, 90.0, 0.0, 359.99), (90.0, 0.0)), "PDO": ((20.0, 70.0, 120.0, 260.0), (45.0, 200.0))}
#: Modes of the field less its global mean.
LESS_GLOBAL = {"PDO"}
#: Steps that a decomposition needs.
LEAST_STEPS = 12


@register("teleconnections")
def teleconnections(f, s):
    """For each of the seven modes its index, pattern, spectrum and monthly spread by source.

    The four modes by decomposition run jobs for each source; their index is in `index`, as the others'.
    Patterns are regressions of the field on the index; of decompositions the mode's own, in its box.
    """
    rows = gridded(f, "model")
    out: dict[str, DataFrame] = {}
    for name, boxes in BOXES.items():
        first, *more = (in_box("lat", "lon", *b) for b in boxes)
        index = spatial.box_difference(rows, first, more[0], ["source", "t"]) if more else spatial.box_index(rows, first, ["source", "t"])
        index = temporal.deseason(index, ["source"], "index")
        out |= mode_tables(name, index, regression_by_source(rows, index))
    sources = [r.source for r in f["model"].select("source").distinct().orderBy("source").collect()]  # tens
    for name in EOF_MODES:
        index = pattern = None
        for source in sources:
            pcs, patterns = mode(f, name, source)
            pcs = pcs.select(F.lit(source).alias("source"), "t", F.col("pc").alias("index"), "explained")
            patterns = patterns.select(F.lit(source).alias("source"), "cell", "pattern")
            index, pattern = (pcs, patterns) if index is None else (index.unionByName(pcs), pattern.unionByName(patterns))
        if index is not None:
            out |= mode_tables(name, index, pattern)
    return out


def regression_by_source(rows: DataFrame, index: DataFrame) -> DataFrame:
    """source, cell, pattern: each source's field on its own index."""
    both = F.struct("source", "t")
    field = rows.select("source", "cell", both.alias("at"), "v")
    return stats.regression_pattern(field, index.select(both.alias("at"), "index"), ["source", "cell"], t="at")


def mode_tables(name: str, index: DataFrame, pattern: DataFrame) -> dict[str, DataFrame]:
    return {name: index, f"{name}_pattern": pattern, f"{name}_spectrum": stats.spectrum(index, "source", v="index"), f"{name}_spread": temporal.monthly_spread(index, ["source"], "index")}


def mode(f: Fields, name: str, source: str, modes: int = 1) -> tuple[DataFrame, DataFrame]:
    """(series, pattern) of a mode by decomposition, its sign fixed; this one runs a job.

    Without enough steps or a whole cell in its box both are empty.
    """
    box, (lat, lon) = EOF_MODES[name]
    field = gridded(f, "model").where(F.col("source") == source)
    rows = field.where(in_box("lat", "lon", *box))
    if name in LESS_GLOBAL:
        everywhere = spatial.coslat_mean(field, ["t"]).withColumnRenamed("v", "everywhere")
        rows = rows.join(everywhere, "t").withColumn("v", F.col("v") - F.col("everywhere")).drop("everywhere")
    steps = rows.select(F.count_distinct("t").alias("steps")).where(F.col("steps") >= LEAST_STEPS)
    rows = rows.join(F.broadcast(steps)).drop("steps")  # one row
    pcs, patterns = stats.eof(temporal.deseason(rows, ["cell"]), modes)
    return stats.fix_sign(pcs, patterns, f["grid"].select("cell", "lat", "lon"), lat, lon)


def kt(f: Fields, first: int, last: int) -> DataFrame:
    clim = lambda name: temporal.monthly_climatology(temporal.in_years(f[name], first, last), ["source", "cell"])
    rows = clim("model").withColumnRenamed("v", "t_c").join(clim("precip").withColumnRenamed("v", "p_cm"), ["source", "cell", "month"]).join(f["grid"].select("cell", "lat"), "cell")
    return classify.climate_class(rows, ["source", "cell"])


@register("climate_classification")
def climate_classification(f, s):
    code = kt(f, *s.period).join(classify.common_land(f["grid"], [], s.land), "cell", "left_semi").join(f["grid"].select("cell", "area"), "cell")
    return {"code": code, "area": spatial.class_shares(code, ["source"])}


@register("climate_shifts")
def climate_shifts(f, s):
    annual = spatial.coslat_mean(gridded(f, "model").withColumn("year", F.year("t")), ["source", "year"])
    windows = temporal.warming_window(annual, ["source"], s.level, s.extra.get("baseline", s.reference))
    both = kt(f, *s.reference).withColumnRenamed("code", "reference").join(kt(f, *s.future).withColumnRenamed("code", "future"), ["source", "cell"]).join(f["grid"].select("cell", "area"), "cell")
    return {"windows": windows, "modal": ensemble.modal_window(windows), "transitions": spatial.transitions(both, "reference", "future")}


def land_days(f: Fields, s: Settings, name: str) -> DataFrame:
    return f[name].join(classify.common_land(f["grid"], [], s.land), "cell", "left_semi").withColumn("year", F.year("d"))


@register("tropical_nights")
def tropical_nights(f, s):
    nights = extremes.threshold_days(land_days(f, s, "tasmin"), ["source", "cell", "year"], {"v": F.col("v") > 20.0})
    rows = nights.join(f["grid"].select("cell", "lat", "area"), "cell")
    return {"nights": nights, "series": spatial.area_mean(rows, ["source", "year"]), "zonal": spatial.zonal_mean(rows, ["source"], s.band)}


@register("tropical_nights_change")
def tropical_nights_change(f, s):
    return {"change": temporal.period_change(tropical_nights(f, s)["nights"], ["source", "cell"], s.reference, s.future)}


@register("heatwave")
def heatwave(f, s):
    rows = land_days(f, s, "tasmax").join(f["grid"].select("cell", "lat"), "cell").withColumn("doy", F.dayofyear("d"))
    base = rows.where(F.col("year").between(*s.base)).groupBy("source", "cell", "doy").agg(F.percentile("v", 0.9).alias("thr"))
    rows = align.with_threshold(rows, base, ["source", "cell", "doy"]).withColumn("year", extremes.summer_year()).where("year IS NOT NULL")
    return {"indices": extremes.heatwaves(rows, ["source", "cell"], "year", "thr")}


@register("heatwave_change")
def heatwave_change(f, s):
    rows = land_days(f, s, "tasmax")
    base = rows.where(F.col("year").between(*s.reference)).groupBy("source", "cell").agg(F.percentile("v", 0.9).alias("thr"))
    indices = extremes.heatwaves(rows.join(base, ["source", "cell"]), ["source", "cell"], "year", "thr", relative=True)
    return {"indices": indices, "change": temporal.period_change(indices, ["source", "cell"], s.reference, s.future, "hwf")}


@register("heatwave_hotspots")
def heatwave_hotspots(f, s):
    widths = extremes.percentiles(land_days(f, s, "tasmax"), ["source", "cell", "year"], [0.875, 0.99]).withColumn("v", F.col("p99") - F.col("p87_5"))
    tested = temporal.trend_test(widths, ["source", "cell"]).withColumn("p", stats.t_p("t", F.col("df").cast("double")))
    spread = spatial.weighted_pdf(tested.join(f["grid"].select("cell", "area"), "cell"), ["source"], -0.2, 0.2, 40, v="slope", log=False)
    return {"widths": widths, "trend": tested, "pdf": spread, "bootstrap": stats.bootstrap_slope(widths.groupBy("source", "year").agg(F.avg("v").alias("v")), ["source"])}


@register("precip_extremes")
def precip_extremes(f, s):
    rows = land_days(f, s, "pr")
    base = extremes.wet_percentiles(rows.where(F.col("year").between(*s.base)), ["source", "cell"])
    indices = extremes.precip_indices(rows.join(base, ["source", "cell"]), ["source", "cell", "year"], s.min_days)
    five = extremes.rolling_sum_max(align.on_full_axis(rows, ["source", "cell"]), ["source", "cell"], F.year("d"))
    total = temporal.period_change(indices, ["source", "cell"], s.reference, s.future, "prcptot")
    return {"indices": indices, "rx5day": five, "change": total.withColumn("percent", change("future", "reference", 1.0))}


@register("temp_extremes_indices")
def temp_extremes_indices(f, s):
    from ..functions.columns import day_of_365

    days = align.complete_days(f["tasmax"], f["tasmin"], ["source", "cell", "d"]).withColumn("year", F.year("d")).withColumn("doy", day_of_365(F.month("d"), F.dayofmonth("d")))
    base = days.where(F.col("year").between(*s.base))
    low = extremes.calendar_day_percentiles(base, ["source", "cell"], {"tx10": 0.1, "tx90": 0.9}, v="tx")
    high = extremes.calendar_day_percentiles(base, ["source", "cell"], {"tn10": 0.1, "tn90": 0.9}, v="tn")
    full = align.with_threshold(align.with_threshold(days, low, ["source", "cell", "doy"]), high, ["source", "cell", "doy"])
    warm = full.withColumn("t_idx", F.dayofyear("d"))
    return {"indices": extremes.temp_indices(full, ["source", "cell", "year"]), "wsdi": extremes.spell_days(warm, ["source", "cell", "year"], F.col("tx") > F.col("tx90")), "csdi": extremes.spell_days(warm, ["source", "cell", "year"], F.col("tn") < F.col("tn10"))}


@register("temp_extremes_change")
def temp_extremes_change(f, s):
    annual = temporal.annual_mean(f["model"], ["source", "cell"])
    seasonal = temporal.season_year_mean(f["model"], ["source", "cell"])
    return {"annual": temporal.period_change(annual, ["source", "cell"], s.reference, s.future), "seasonal": temporal.period_change(seasonal, ["source", "cell", "season"], s.reference, s.future)}


def marine(f: Fields, s: Settings, keys: list[str], name: str) -> dict[str, DataFrame]:
    from ..functions.columns import calendar_slot

    days = align.on_full_axis(f[name], keys).withColumn("slot", calendar_slot(F.month("d"), F.dayofmonth("d"))).withColumn("year", F.year("d"))
    found, full = mhw.detect(days, keys, s.base)
    return {"events": found, "cells": mhw.cell_metrics(found, full, keys)}


@register("marine_heatwaves")
def marine_heatwaves(f, s):
    return marine(f, s, ["source", "cell"], "sst_daily")


@register("marine_heatwaves_subsurface")
def marine_heatwaves_subsurface(f, s):
    out = marine(f, s, ["source", "cell", "level"], "ocean_daily")
    pooled = ensemble.pool_levels(out["cells"], ["source", "cell"], metrics=["duration_mean", "intensity_mean_mean"])
    return out | {"layers": pooled, "columns": mhw.whole_columns(f["ocean_daily"])}


@register("ssh_variability")
def ssh_variability(f, s):
    from ..functions.columns import calendar_slot

    days = align.on_full_axis(f["ssh"], ["source", "cell"]).withColumn("slot", calendar_slot(F.month("d"), F.dayofmonth("d")))
    out = stats.high_pass(days, ["source", "cell"])
    means = out.select("source", "cell", F.col("mean").alias("v")).join(f["grid"].select("cell", "area"), "cell")
    return {"statistics": out, "relative": align.without_common_mean(means)}


def compare(f: Fields, s: Settings, names: list[str]) -> dict[str, DataFrame]:
    """Observations among each other: trends, area-weighted annual series and their summaries."""
    rows = None
    for name in names:
        rows = f[name] if rows is None else rows.unionByName(f[name], allowMissingColumns=True)
    annual = temporal.annual_mean(rows, ["source", "cell"])
    series = spatial.coslat_mean(annual.join(f["grid"].select("cell", "lat"), "cell"), ["source", "year"])
    return {"trend": temporal.linear_trend(annual, ["source", "cell"]), "series": series, "summary": temporal.summary(series, ["source"])}


@register("obs_comparison")
def obs_comparison(f, s):
    return compare(f, s, ["obs", "obs2"])


@register("precip_obs_comparison")
def precip_obs_comparison(f, s):
    return compare(f, s, ["precip_obs", "precip_obs2"])


@register("cloud_obs_comparison")
def cloud_obs_comparison(f, s):
    return compare(f, s, ["cloud_obs", "cloud_obs2"])


@register("temp_extremes_obs_comparison")
def temp_extremes_obs_comparison(f, s):
    days = extremes.approx_exceedance(f["obs"].withColumn("year", F.year("t")), ["source", "cell", "year"], s.extra.get("threshold", 20.0))
    return {"days": days} | compare(f, s, ["obs", "obs2"])


def to_grid(fields: Fields, name: str, weights: DataFrame) -> DataFrame:
    """A field on another grid; as the weights are linear, average over time before, not after."""
    return regrid.apply_weights(fields[name], weights, [c for c in fields[name].columns if c not in ("cell", "v")])

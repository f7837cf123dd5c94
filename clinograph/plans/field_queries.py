"""Queries on the monthly field and the grid: time means, trends, area means, classes, regridding."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import change, in_box, season
from ..operators import align, classify, ensemble, regrid, spatial, stats, temporal
from .catalog import long, query, rounded
from .panels import GRID, MONTHLY, T_TAILS, grid, monthly

M = "WITH " + MONTHLY
MG = M + ", " + GRID
S_CASE = "CASE WHEN month(t) IN (12, 1, 2) THEN 'DJF' WHEN month(t) IN (3, 4, 5) THEN 'MAM' WHEN month(t) IN (6, 7, 8) THEN 'JJA' ELSE 'SON' END"
X = "(date_diff('day', min(t) OVER (PARTITION BY cell), t) / 365.25::DOUBLE)"


@query(M + " SELECT cell, round(avg(v), 4) AS v FROM monthly WHERE year(t) BETWEEN 1996 AND 1999 GROUP BY cell")
def a01_climatology_period(spark, sf_dir):
    return rounded(temporal.climatology(monthly(spark, sf_dir), ["cell"], (1996, 1999)), v=4)


@query(M + f" SELECT cell, {S_CASE} AS season, round(avg(v), 4) AS v FROM monthly GROUP BY 1, 2")
def a02_seasonal_climatology(spark, sf_dir):
    return rounded(temporal.seasonal_climatology(monthly(spark, sf_dir), ["cell"]), v=4)


@query(M + " SELECT cell, CAST(month(t) AS BIGINT) AS month, round(avg(v), 4) AS v FROM monthly GROUP BY 1, 2")
def a03_monthly_climatology(spark, sf_dir):
    return rounded(temporal.monthly_climatology(monthly(spark, sf_dir), ["cell"]).withColumn("month", long("month")), v=4)


@query(M + " SELECT cell, CAST(year(t) AS BIGINT) AS year, round(avg(v), 4) AS v FROM monthly GROUP BY 1, 2")
def a04_annual_mean(spark, sf_dir):
    return rounded(temporal.annual_mean(monthly(spark, sf_dir), ["cell"]).withColumn("year", long("year")), v=4)


@query(M + f" SELECT cell, {S_CASE} AS season, CAST(year(t + INTERVAL 1 MONTH) AS BIGINT) AS year, round(avg(v), 4) AS v FROM monthly GROUP BY 1, 2, 3")
def a05_season_year_mean(spark, sf_dir):
    return rounded(temporal.season_year_mean(monthly(spark, sf_dir), ["cell"]).withColumn("year", long("year")), v=4)


@query(M + ", c AS (SELECT cell, month(t) AS m, avg(v) AS v FROM monthly GROUP BY 1, 2) SELECT cell, round(avg(v), 4) AS v FROM c WHERE m IN (12, 1, 2) GROUP BY 1")
def a06_season_of_climatology(spark, sf_dir):
    return rounded(temporal.season_of_climatology(temporal.monthly_climatology(monthly(spark, sf_dir), ["cell"]), ["cell"], (12, 1, 2)), v=4)


@query(M + ", c AS (SELECT cell, month(t) AS m, avg(v) AS n FROM monthly WHERE year(t) <= 1998 GROUP BY 1, 2) SELECT x.cell, t, round(v - n, 4) AS v FROM monthly x JOIN c ON x.cell = c.cell AND month(t) = m")
def j02_monthly_anomaly(spark, sf_dir):
    field = monthly(spark, sf_dir)
    base = temporal.monthly_climatology(temporal.in_years(field, 1990, 1998), ["cell"])
    return rounded(temporal.anomaly(field, base, ["cell"]), v=4)


@query(M + " SELECT cell, t, round(v - avg(v) OVER (PARTITION BY cell, month(t)), 4) AS v FROM monthly")
def w01_deseason(spark, sf_dir):
    return rounded(temporal.deseason(monthly(spark, sf_dir), ["cell"]), v=4)


@query(M + f", x AS (SELECT cell, v, {X} AS x FROM monthly) SELECT cell, round(regr_slope(v, x), 4) AS slope FROM x GROUP BY 1")
def w02_linear_trend(spark, sf_dir):
    return rounded(temporal.linear_trend(monthly(spark, sf_dir), ["cell"]), slope=4)


@query(M + f", x AS (SELECT cell, t, v, {X} AS x FROM monthly), s AS (SELECT cell, regr_slope(v, x) AS s FROM x GROUP BY 1) SELECT cell, t, round(v - s * x, 3) AS v FROM x JOIN s USING (cell)")
def w03_detrend(spark, sf_dir):
    return rounded(temporal.detrend(monthly(spark, sf_dir), ["cell"]), v=3)


@query(M + f", x AS (SELECT cell, t, v, {X} AS x FROM monthly), s AS (SELECT cell, regr_slope(v, x) AS s, regr_intercept(v, x) AS i FROM x GROUP BY 1) SELECT cell, t, round(v - i - s * x, 3) AS v FROM x JOIN s USING (cell)")
def w04_remove_fit(spark, sf_dir):
    return rounded(temporal.remove_fit(monthly(spark, sf_dir), ["cell"]), v=3)


@query(M + f", a AS (SELECT cell, v - avg(v) OVER (PARTITION BY cell, month(t)) AS v, {X} AS x FROM monthly), s AS (SELECT cell, regr_slope(v, x) AS s FROM a GROUP BY 1) SELECT cell, round(stddev_pop(v - s * x), 4) AS std FROM a JOIN s USING (cell) GROUP BY 1")
def w05_variability(spark, sf_dir):
    return rounded(temporal.variability(monthly(spark, sf_dir), ["cell"]), std=4)


YEARS = M + ", y AS (SELECT cell, CAST(year(t) AS DOUBLE) AS x, avg(v) AS v FROM monthly GROUP BY 1, 2)"


@query(YEARS + ", s AS (SELECT cell, count(*) AS n, regr_slope(v, x) AS b, regr_sxx(v, x) AS sxx, regr_syy(v, x) AS syy, regr_sxy(v, x) AS sxy FROM y GROUP BY 1) SELECT cell, round(b, 4) AS slope, round(sqrt(greatest(0, syy - sxy * sxy / sxx) / ((n - 2) * sxx)), 4) AS se, round(b / sqrt((syy - sxy * sxy / sxx) / ((n - 2) * sxx)), 4) AS t, CAST(n - 2 AS BIGINT) AS df FROM s")
def w06_trend_tstat(spark, sf_dir):
    return rounded(temporal.trend_test(temporal.annual_mean(monthly(spark, sf_dir), ["cell"]), ["cell"]), slope=4, se=4, t=4)


@query(YEARS + ", s AS (SELECT cell, count(*) AS n, regr_slope(v, x) AS b, regr_sxx(v, x) AS sxx, regr_syy(v, x) AS syy, regr_sxy(v, x) AS sxy FROM y GROUP BY 1), q AS (SELECT cell, b, sqrt((syy - sxy * sxy / sxx) / ((n - 2) * sxx)) AS se, n - 2 AS df FROM s) SELECT cell, round(b, 4) AS slope, round(se, 4) AS se, round(b / se, 4) AS t, CAST(df AS BIGINT) AS df, round(" + T_TAILS.format(t="b / se") + ", 6) AS p FROM q")
def w06_trend_pvalue(spark, sf_dir):
    tested = temporal.trend_test(temporal.annual_mean(monthly(spark, sf_dir), ["cell"]), ["cell"])
    return rounded(tested.withColumn("p", stats.t_p("t", F.col("df").cast("double"))), slope=4, se=4, t=4, p=6)


@query()
def w07_bootstrap_ci(spark, sf_dir):
    return rounded(stats.bootstrap_slope(temporal.annual_mean(monthly(spark, sf_dir), ["cell"]), ["cell"]), low=4, high=4)


@query(YEARS + ", w AS (SELECT cell, x, avg(v) OVER k AS s, count(*) OVER k AS n FROM y WINDOW k AS (PARTITION BY cell ORDER BY x ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)), b AS (SELECT cell, avg(v) AS b FROM y WHERE x BETWEEN 1995 AND 1996 GROUP BY 1), h AS (SELECT cell, min(x) AS c FROM w JOIN b USING (cell) WHERE n = 4 AND s - b >= 1000 GROUP BY 1) SELECT cell, CAST(c AS BIGINT) AS centre, CAST(c - 2 AS BIGINT) AS start, CAST(c + 1 AS BIGINT) AS \"end\" FROM h")
def w08_warming_window(spark, sf_dir):
    found = temporal.warming_window(temporal.annual_mean(monthly(spark, sf_dir), ["cell"]), ["cell"], 1000.0, (1995, 1996), 4)
    return found.select("cell", *(long(c).alias(c) for c in ("centre", "start", "end")))


@query(M + ", w AS (SELECT cell, t, CASE WHEN count(v) OVER k >= 6 THEN avg(v) OVER k END AS s FROM monthly WINDOW k AS (PARTITION BY cell ORDER BY t ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING)) SELECT cell, t, round(s, 4) AS smooth FROM w")
def w09_running_mean(spark, sf_dir):
    return rounded(temporal.centred_mean(monthly(spark, sf_dir), ["cell"], 12, 6, "t").drop("v"), smooth=4)


@query(M + " SELECT cell, t, round(v - avg(v) OVER (PARTITION BY cell), 4) AS v, round(v - first_value(v) OVER (PARTITION BY cell ORDER BY t), 4) AS f FROM monthly")
def w23_anomaly_of_series(spark, sf_dir):
    field = monthly(spark, sf_dir).withColumn("f", F.col("v"))
    return rounded(temporal.against_first(temporal.against_mean(field, ["cell"]), ["cell"], v="f"), v=4, f=4)


@query(YEARS + " SELECT cell, round(avg(v) FILTER (x BETWEEN 1995 AND 1997), 4) AS reference, round(avg(v) FILTER (x BETWEEN 1999 AND 2001), 4) AS future, round(avg(v) FILTER (x BETWEEN 1999 AND 2001) - avg(v) FILTER (x BETWEEN 1995 AND 1997), 4) AS change FROM y GROUP BY 1")
def w24_change_signal(spark, sf_dir):
    annual = temporal.annual_mean(monthly(spark, sf_dir), ["cell"])
    return rounded(temporal.period_change(annual, ["cell"], (1995, 1997), (1999, 2001)), reference=4, future=4, change=4)


@query(YEARS + ", c AS (SELECT cell, avg(v) FILTER (x BETWEEN 1995 AND 1997) AS r, avg(v) FILTER (x BETWEEN 1999 AND 2001) AS f FROM y GROUP BY 1) SELECT cell, round(CASE WHEN r >= 100 THEN 100 * (f - r) / r END, 4) AS percent FROM c")
def p21_percent_change(spark, sf_dir):
    out = temporal.period_change(temporal.annual_mean(monthly(spark, sf_dir), ["cell"]), ["cell"], (1995, 1997), (1999, 2001))
    return rounded(out.select("cell", change("future", "reference", 100.0).alias("percent")), percent=4)


@query(YEARS + " SELECT cell, round(avg(v), 4) AS mean, round(regr_slope(v, x) * 10, 3) AS trend, round(arg_min(v, x), 4) AS first, round(arg_max(v, x), 4) AS last FROM y GROUP BY 1")
def a40_series_summary(spark, sf_dir):
    return rounded(temporal.summary(temporal.annual_mean(monthly(spark, sf_dir), ["cell"]), ["cell"]), mean=4, trend=3, first=4, last=4)


@query(M + ", s AS (SELECT cell, CAST(month(t) AS BIGINT) AS month, stddev_pop(v) AS std FROM monthly GROUP BY 1, 2) SELECT cell, month, round(std, 4) AS std, CAST(arg_max(month, std) OVER (PARTITION BY cell) AS BIGINT) AS peak_month FROM s")
def a41_monthly_std(spark, sf_dir):
    out = temporal.monthly_spread(monthly(spark, sf_dir), ["cell"])
    return rounded(out.select("cell", long("month").alias("month"), "std", long("peak_month").alias("peak_month")), std=4)


@query(M + ", k AS (SELECT cell, CAST(year(t) AS BIGINT) AS year, CASE WHEN month(t) = 3 THEN 'max' ELSE 'min' END AS kind, v FROM monthly WHERE month(t) IN (3, 9)) SELECT cell, year, kind, round(v, 4) AS v, round(v - avg(v) OVER (PARTITION BY cell, kind), 4) AS departure FROM k")
def a42_extreme_months(spark, sf_dir):
    out = temporal.extreme_months(monthly(spark, sf_dir), ["cell"])
    return rounded(out.withColumn("year", long("year")), v=4, departure=4)


@query(M + " SELECT cell, round(avg(v) FILTER (month(t) = 3), 4) AS march, round(avg(v) FILTER (month(t) = 9), 4) AS september FROM monthly GROUP BY 1")
def a50_single_month_maps(spark, sf_dir):
    of = lambda m: F.avg(F.when(F.month("t") == m, F.col("v")))
    return rounded(monthly(spark, sf_dir).groupBy("cell").agg(of(3).alias("march"), of(9).alias("september")), march=4, september=4)


@query(M + " SELECT t, round(avg(v), 4) AS v FROM monthly GROUP BY 1")
def a07_equal_area_mean(spark, sf_dir):
    return rounded(spatial.area_mean(monthly(spark, sf_dir), ["t"], None), v=4)


@query(MG + " SELECT t, round(sum(v * area) / sum(area), 4) AS v FROM monthly JOIN grid USING (cell) GROUP BY 1")
def a08_area_weighted_mean(spark, sf_dir):
    return rounded(spatial.area_mean(spatial.on_grid(monthly(spark, sf_dir), grid(spark, sf_dir)), ["t"]), v=4)


@query(MG + " SELECT CAST(year(t) AS BIGINT) AS year, round(sum(v * cos(radians(lat))) / sum(cos(radians(lat))), 4) AS v FROM monthly JOIN grid USING (cell) GROUP BY 1")
def a09_coslat_mean(spark, sf_dir):
    rows = spatial.on_grid(monthly(spark, sf_dir), grid(spark, sf_dir)).withColumn("year", long(F.year("t")))
    return rounded(spatial.coslat_mean(rows, ["year"]), v=4)


@query(MG + " SELECT region, t, round(sum(v * area) / sum(area), 4) AS v FROM monthly JOIN grid USING (cell) GROUP BY 1, 2")
def a10_region_mean(spark, sf_dir):
    g = grid(spark, sf_dir)
    rows = monthly(spark, sf_dir).join(g.select("cell", "area"), "cell")
    return rounded(spatial.region_mean(rows, g.select("cell", "region"), ["t"]), v=4)


@query(MG + " SELECT CAST(month(t) AS BIGINT) AS month, (floor((lat + 90) / 30) + 0.5::DOUBLE) * 30 - 90 AS band, round(sum(v * area) / sum(area), 4) AS v FROM monthly JOIN grid USING (cell) WHERE lat < 90 GROUP BY 1, 2")
def a11_zonal_mean(spark, sf_dir):
    rows = spatial.on_grid(monthly(spark, sf_dir), grid(spark, sf_dir)).withColumn("month", long(F.month("t")))
    return rounded(spatial.zonal_mean(rows, ["month"], 30.0).withColumn("band", F.col("band").cast("double")), v=4)


@query(MG + ", r AS (SELECT lat, avg(v) AS v FROM monthly JOIN grid USING (cell) GROUP BY 1), s AS (SELECT lat, v, lead(lat) OVER (ORDER BY lat) AS lat2, lead(v) OVER (ORDER BY lat) AS v2 FROM r), a AS (SELECT CAST(unnest(range(-80, 81, 20)) AS DOUBLE) AS p) SELECT p AS lat, round(CASE WHEN s.lat = p THEN v ELSE v + (v2 - v) * (p - s.lat) / (lat2 - s.lat) END, 4) AS v FROM a JOIN s ON s.lat <= p AND p < lat2")
def a12_zonal_profile(spark, sf_dir):
    axis = spark.range(9).select((F.col("id") * 20 - 80).cast("double").alias("lat"))
    rows = spatial.on_grid(monthly(spark, sf_dir), grid(spark, sf_dir)).withColumn("one", F.lit(1))
    return rounded(spatial.zonal_profile(rows, axis, ["one"]).drop("one"), v=4)


BOX1, BOX2 = (-30.0, 30.0, 300.0, 100.0), (-80.0, -20.0, 0.0, 180.0)
B1, B2 = "(lat BETWEEN -30 AND 30 AND (lon >= 300 OR lon <= 100))", "(lat BETWEEN -80 AND -20 AND lon BETWEEN 0 AND 180)"
INDEX = f"idx AS (SELECT t, sum(v * area) FILTER {B1} / sum(area) FILTER {B1} - sum(v * area) FILTER {B2} / sum(area) FILTER {B2} AS i FROM monthly JOIN grid USING (cell) WHERE {B1} OR {B2} GROUP BY 1)"


def index_series(spark, sf_dir):
    rows = spatial.on_grid(monthly(spark, sf_dir), grid(spark, sf_dir))
    first, second = in_box("lat", "lon", *BOX1), in_box("lat", "lon", *BOX2)
    return spatial.box_difference(rows, first, second, ["t"])


@query(MG + ", " + INDEX + " SELECT t, round(i, 4) AS \"index\" FROM idx")
def a13_box_diff_index(spark, sf_dir):
    return rounded(index_series(spark, sf_dir), index=4)


@query(MG + ", " + INDEX + " SELECT cell, round(covar_pop(v, i) / stddev_pop(i), 4) AS pattern FROM monthly JOIN idx USING (t) GROUP BY 1")
def t07_regression_pattern(spark, sf_dir):
    return rounded(stats.regression_pattern(monthly(spark, sf_dir), index_series(spark, sf_dir), ["cell"]), pattern=4)


@query()
def t08_welch_spectrum(spark, sf_dir):
    return rounded(stats.spectrum(monthly(spark, sf_dir), "cell"), period=6, power=0)


@query()
def t04_eof_modes(spark, sf_dir):
    field = temporal.deseason(monthly(spark, sf_dir), ["cell"]).join(grid(spark, sf_dir).select("cell", "lat"), "cell")
    pcs, patterns = stats.eof(field, 3)
    pcs, _ = stats.fix_sign(pcs, patterns, grid(spark, sf_dir), 40.0, 300.0)
    return rounded(pcs, pc=6, explained=6)


@query(M + ", a AS (SELECT cell, t, v - avg(v) OVER (PARTITION BY cell) AS x FROM monthly) SELECT p.t AS i, q.t AS j, round(sum(p.x * q.x) / 1e6, 3) AS g FROM a p JOIN a q ON p.cell = q.cell AND p.t <= q.t GROUP BY 1, 2")
def t04_gram_matrix(spark, sf_dir):
    return rounded(stats.gram(temporal.against_mean(monthly(spark, sf_dir), ["cell"]), x="v").withColumn("g", F.col("g") / 1e6), g=3)


KT_IN = ", k AS (SELECT cell, lat, month(t) AS m, avg(v) / 10000 - 6 + 8 * cos((month(t) - 7) * 0.5235987755982988) - abs(lat) / 4 AS tc, (avg(v) - 120000) / 8000 + 6 + lat / 30 AS pc FROM monthly JOIN grid USING (cell) WHERE {years} GROUP BY 1, 2, 3)"
KT_CODE = """, k1 AS (SELECT cell, max(lat) AS lat, avg(tc) AS ta, min(tc) AS tcold, max(tc) AS twarm, count(*) FILTER (tc >= 10) AS mild, sum(pc) AS pa,
 coalesce(sum(pc) FILTER (m >= 10 OR m <= 3), 0) AS po, coalesce(sum(pc) FILTER (m BETWEEN 4 AND 9), 0) AS pap, min(pc) FILTER (m >= 10 OR m <= 3) AS d_o, min(pc) FILTER (m BETWEEN 4 AND 9) AS d_a, count(*) FILTER (pc > 6) AS wet, count(*) FILTER (pc <= 6) AS dry FROM k GROUP BY 1),
 k2 AS (SELECT *, CASE WHEN lat >= 0 THEN po ELSE pap END AS pw, CASE WHEN lat >= 0 THEN pap ELSE po END AS ps, CASE WHEN lat >= 0 THEN d_o ELSE d_a END AS dw, CASE WHEN lat >= 0 THEN d_a ELSE d_o END AS ds FROM k1),
 k3 AS (SELECT *, 2.3 * ta - 0.64 * (CASE WHEN pa > 0 THEN 100 * pw / pa ELSE 0 END) + 41 AS r FROM k2),
 kt AS (SELECT cell, CAST(CASE WHEN ta IS NULL THEN NULL WHEN twarm <= 10 AND twarm > 0 THEN 13 WHEN twarm <= 10 THEN 14 WHEN mild BETWEEN 1 AND 3 AND tcold > -10 THEN 11 WHEN mild BETWEEN 1 AND 3 THEN 12 WHEN pa < r AND pa <= 0.5 * r THEN 4 WHEN pa < r THEN 5
 WHEN mild BETWEEN 4 AND 7 AND tcold > 0 THEN 9 WHEN mild BETWEEN 4 AND 7 THEN 10 WHEN tcold <= 18 AND mild >= 8 AND ds <= 3 AND pw >= 3 * ps AND pa <= 89 THEN 6 WHEN tcold <= 18 AND mild >= 8 AND dw <= 3 AND ps >= 10 * pw THEN 7 WHEN tcold <= 18 AND mild >= 8 THEN 8
 WHEN tcold >= 18 AND pa >= r AND wet >= 10 AND dry <= 2 THEN 1 WHEN tcold >= 18 AND pa >= r AND dw < 6 AND dry > 2 THEN 2 WHEN tcold >= 18 AND pa >= r AND ds <= 6 THEN 3 WHEN pa = 0 THEN 4 ELSE 0 END AS INTEGER) AS code FROM k3)"""


def classes(spark, sf_dir, first, last):
    rows = temporal.in_years(monthly(spark, sf_dir), first, last).join(grid(spark, sf_dir).select("cell", "lat"), "cell")
    clim = rows.groupBy("cell", "lat", F.month("t").alias("month")).agg(F.avg("v").alias("v"))
    clim = clim.withColumn("t_c", F.col("v") / 10000 - 6 + 8 * F.cos((F.col("month") - 7) * 0.5235987755982988) - F.abs("lat") / 4).withColumn("p_cm", (F.col("v") - 120000) / 8000 + 6 + F.col("lat") / 30)
    return classify.climate_class(clim, ["cell"])


@query(MG + KT_IN.format(years="year(t) BETWEEN 1990 AND 2010") + KT_CODE + " SELECT cell, code FROM kt")
def p19_kt_classes(spark, sf_dir):
    return classes(spark, sf_dir, 1990, 2010)


@query(MG + KT_IN.format(years="year(t) BETWEEN 1990 AND 2010") + KT_CODE + ", w AS (SELECT code, sum(area) AS w FROM kt JOIN grid USING (cell) WHERE code >= 1 GROUP BY 1) SELECT code, round(w / sum(w) OVER () * 100, 4) AS percent FROM w")
def a28_area_by_class(spark, sf_dir):
    rows = classes(spark, sf_dir, 1990, 2010).join(grid(spark, sf_dir).select("cell", "area"), "cell").withColumn("one", F.lit(1))
    return rounded(spatial.class_shares(rows, ["one"]).drop("one"), percent=4)


def kt_of(name: str, years: str) -> str:
    body = (KT_IN.format(years=years) + KT_CODE).replace(" kt AS", f" {name} AS")
    for k in ("k3", "k2", "k1"):
        body = body.replace(f" {k} AS", f" {name}{k} AS").replace(f"FROM {k}", f"FROM {name}{k}")
    return body.replace(", k AS", f", {name}k AS").replace("FROM k ", f"FROM {name}k ")


@query(MG + kt_of("ka", "year(t) BETWEEN 1995 AND 1997") + kt_of("kb", "year(t) BETWEEN 1999 AND 2001") + ", w AS (SELECT ka.code AS reference, kb.code AS future, sum(area) AS w FROM ka JOIN kb USING (cell) JOIN grid USING (cell) WHERE ka.code >= 1 AND kb.code >= 1 GROUP BY 1, 2) SELECT reference, future, round(100 * w / sum(w) OVER (), 4) AS percent FROM w")
def a28_transition(spark, sf_dir):
    first, second = classes(spark, sf_dir, 1995, 1997), classes(spark, sf_dir, 1999, 2001)
    rows = first.withColumnRenamed("code", "reference").join(second.withColumnRenamed("code", "future"), "cell").join(grid(spark, sf_dir).select("cell", "area"), "cell")
    return rounded(spatial.transitions(rows, "reference", "future"), percent=4)


@query(MG + kt_of("ka", "year(t) BETWEEN 1995 AND 1997") + kt_of("kb", "year(t) BETWEEN 1999 AND 2001") + " SELECT region, round(100 * sum(area) FILTER (ka.code = kb.code) / sum(area), 4) AS agree FROM ka JOIN kb USING (cell) JOIN grid USING (cell) WHERE ka.code >= 1 AND kb.code >= 1 GROUP BY 1")
def a28_agreement(spark, sf_dir):
    first, second = classes(spark, sf_dir, 1995, 1997), classes(spark, sf_dir, 1999, 2001)
    rows = first.withColumnRenamed("code", "reference").join(second.withColumnRenamed("code", "future"), "cell").join(grid(spark, sf_dir).select("cell", "area", "region"), "cell")
    return rounded(spatial.agreement(rows, ["region"], "reference", "future").fillna(0.0, ["agree"]), agree=4)


@query(MG + ", b AS (SELECT region, floor((log10(v) - 3::DOUBLE) / 0.25::DOUBLE) AS k, sum(area) AS w FROM monthly JOIN grid USING (cell) WHERE v > 0 GROUP BY 1, 2) SELECT region, CAST(k AS INTEGER) AS bin, round(w / (sum(w) OVER (PARTITION BY region) * (pow(10, 3 + (k + 1) * 0.25::DOUBLE) - pow(10, 3 + k * 0.25::DOUBLE))) * 1e6, 6) AS density FROM b WHERE k BETWEEN 0 AND 11")
def a27_weighted_pdf(spark, sf_dir):
    rows = spatial.on_grid(monthly(spark, sf_dir), grid(spark, sf_dir))
    return rounded(spatial.weighted_pdf(rows, ["region"], 1e3, 1e6, 12).withColumn("density", F.col("density") * 1e6), density=6)


@query(MG + ", c AS (SELECT cell, avg(v) AS v FROM monthly GROUP BY 1) SELECT floor((lat + 90) / 30)::BIGINT AS iy, floor(lon / 30)::BIGINT AS ix, round(avg(v), 4) AS v FROM c JOIN grid USING (cell) GROUP BY 1, 2")
def j14_box_average(spark, sf_dir):
    rows = spatial.on_grid(temporal.climatology(monthly(spark, sf_dir), ["cell"]), grid(spark, sf_dir))
    out = regrid.box_average(rows, [], 30.0)
    return rounded(out.select(long("iy").alias("iy"), long("ix").alias("ix"), "v"), v=4)


@query(M + ", c AS (SELECT cell // 5 AS iy, cell % 5 AS ix, avg(v) AS v FROM monthly GROUP BY cell) SELECT CAST(iy // 2 AS BIGINT) AS \"by\", CAST(ix // 2 AS BIGINT) AS bx, round(avg(v), 4) AS v FROM c WHERE iy < 4 AND ix < 4 GROUP BY 1, 2")
def j15_coarsen(spark, sf_dir):
    rows = temporal.climatology(monthly(spark, sf_dir), ["cell"]).select(F.floor(F.col("cell") / 5).alias("iy"), (F.col("cell") % 5).alias("ix"), "v")
    return rounded(regrid.coarsen(rows, [], 2, 5, 5), v=4)


NEAR = "2 * 6371.0::DOUBLE * asin(least(1, sqrt(pow(sin(radians(s.lat - d.lat) / 2), 2) + cos(radians(d.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - d.lon) / 2), 2))))"
TARGET = "dst AS (SELECT CAST(i AS BIGINT) AS cell, -75::DOUBLE + 30 * (i // 8) AS lat, 45::DOUBLE * (i % 8) AS lon FROM range(48) r(i))"


def target_grid(spark):
    i = F.col("id")
    return spark.range(48).select(i.alias("cell"), (F.lit(-75.0) + 30 * F.floor(i / 8)).cast("double").alias("lat"), (45.0 * (i % 8)).cast("double").alias("lon"))


@query(MG + f", {TARGET}, near AS (SELECT d.cell, s.cell AS src, {NEAR} AS km FROM dst d JOIN grid s ON true), best AS (SELECT cell, arg_min(src, km) AS src FROM near WHERE km <= 2500 GROUP BY 1), c AS (SELECT cell, avg(v) AS v FROM monthly GROUP BY 1) SELECT best.cell, round(v, 4) AS v FROM best JOIN c ON src = c.cell")
def j09_nearest_regrid(spark, sf_dir):
    weights = regrid.nearest_weights(grid(spark, sf_dir).select("cell", "lat", "lon"), target_grid(spark), 2500.0)
    return rounded(regrid.apply_weights(temporal.climatology(monthly(spark, sf_dir), ["cell"]), weights, []), v=4)


def axis(spark, n, first, step):
    return spark.range(n).select(F.col("id").alias("i"), (F.lit(first) + F.col("id") * step).cast("double").alias("x"))


@query(M + """, c AS (SELECT cell // 5 AS iy, cell % 5 AS ix, avg(v) AS v FROM monthly GROUP BY cell), d AS (SELECT y, x, -60::DOUBLE + 40 * y AS lat, 30::DOUBLE + 60 * x AS lon FROM range(4) a(y), range(6) b(x)),
 p AS (SELECT *, least(4, greatest(0, (lat + 72) / 36)) AS fy, (lon - 36) / 72 AS fx FROM d), q AS (SELECT *, least(3, floor(fy))::BIGINT AS y0, floor(fx)::BIGINT AS x0 FROM p)
 SELECT CAST(y * 6 + x AS BIGINT) AS cell, round((1 - (fy - y0)) * ((1 - (fx - x0)) * c00.v + (fx - x0) * c01.v) + (fy - y0) * ((1 - (fx - x0)) * c10.v + (fx - x0) * c11.v), 4) AS v FROM q
 JOIN c c00 ON c00.iy = y0 AND c00.ix = (x0 + 5) % 5 JOIN c c01 ON c01.iy = y0 AND c01.ix = (x0 + 6) % 5 JOIN c c10 ON c10.iy = y0 + 1 AND c10.ix = (x0 + 5) % 5 JOIN c c11 ON c11.iy = y0 + 1 AND c11.ix = (x0 + 6) % 5""")
def j10_bilinear(spark, sf_dir):
    weights = regrid.bilinear_weights(axis(spark, 5, -72.0, 36.0), axis(spark, 5, 36.0, 72.0), axis(spark, 4, -60.0, 40.0), axis(spark, 6, 30.0, 60.0), 5, 6)
    return rounded(regrid.apply_weights(temporal.climatology(monthly(spark, sf_dir), ["cell"]), weights, [], strict=True), v=4)


def edges(spark, n, first, step):
    return spark.range(n).select(F.col("id").alias("i"), (F.lit(first) + F.col("id") * step).cast("double").alias("a"), (F.lit(first) + (F.col("id") + 1) * step).cast("double").alias("z"))


@query(M + """, c AS (SELECT cell, avg(v) AS v FROM monthly GROUP BY 1), y AS (SELECT d.i AS dy, s.i AS sy, sin(radians(least(-90 + 36 * (s.i + 1), -90 + 45 * (d.i + 1)))) - sin(radians(greatest(-90 + 36 * s.i, -90 + 45 * d.i))) AS h FROM range(5) s(i), range(4) d(i) WHERE least(-90 + 36 * (s.i + 1), -90 + 45 * (d.i + 1)) > greatest(-90 + 36 * s.i, -90 + 45 * d.i)),
 x AS (SELECT d.i AS dx, s.i AS sx, least(72 * (s.i + 1), 60 * (d.i + 1)) - greatest(72 * s.i, 60 * d.i) AS b FROM range(5) s(i), range(6) d(i) WHERE least(72 * (s.i + 1), 60 * (d.i + 1)) > greatest(72 * s.i, 60 * d.i))
 SELECT CAST(dy * 6 + dx AS BIGINT) AS cell, round(sum(v * h * b) / sum(h * b), 4) AS v FROM y, x JOIN c ON cell = sy * 5 + sx GROUP BY 1""")
def j11_conservative(spark, sf_dir):
    weights = regrid.conservative_weights(edges(spark, 5, -90.0, 36.0), edges(spark, 5, 0.0, 72.0), edges(spark, 4, -90.0, 45.0), edges(spark, 6, 0.0, 60.0), 5, 6, 36.0)
    return rounded(regrid.apply_weights(temporal.climatology(monthly(spark, sf_dir), ["cell"]), weights, []), v=4)


@query(MG + ", p AS (SELECT cell, CAST(cell - cell % 5 AS BIGINT) AS g FROM grid), c AS (SELECT cell, avg(v) AS v FROM monthly GROUP BY 1) SELECT g AS cell, round(avg(v), 4) AS v FROM c JOIN p USING (cell) GROUP BY 1")
def j13_merged_points(spark, sf_dir):
    points = grid(spark, sf_dir).select("cell", (F.floor(F.col("cell") / 5) * 10).cast("double").alias("lat"), F.lit(20.0).alias("lon"))
    groups = regrid.merge_points(points)
    return rounded(regrid.group_values(temporal.climatology(monthly(spark, sf_dir), ["cell"]), groups, []), v=4)


@query(MG + " SELECT cell, region, round(CASE WHEN land_frac >= 0.5 THEN avg(v) END, 4) AS v FROM monthly JOIN grid USING (cell) GROUP BY cell, region, land_frac")
def p13_land_mask(spark, sf_dir):
    g = grid(spark, sf_dir)
    land = classify.common_land(g, [], 0.5).withColumn("land", F.lit(True))
    rows = temporal.climatology(monthly(spark, sf_dir), ["cell"]).join(g.select("cell", "region"), "cell").join(land, "cell", "left")
    return rounded(rows.select("cell", "region", F.when(F.col("land"), F.col("v")).alias("v")), v=4)


@query("WITH " + GRID + " SELECT cell, CASE WHEN lat > -50 AND lat < 40 AND lon > 100 AND lon < 250 THEN 'mid' WHEN lat >= 60 THEN 'cap' END AS region FROM grid WHERE (lat > -50 AND lat < 40 AND lon > 100 AND lon < 250) OR lat >= 60")
def p11_region_cells(spark, sf_dir):
    g = grid(spark, sf_dir)
    inside = spatial.region_cells(g, {"mid": [(100.0, -50.0), (250.0, -50.0), (250.0, 40.0), (100.0, 40.0)]})
    return inside.unionByName(spatial.polar_cap(g, "cap", 60.0))


@query(M + f" SELECT cell, t, {S_CASE} AS season, CAST(year(t + INTERVAL 1 MONTH) AS BIGINT) AS season_year, CAST(date_part('day', last_day(t)) AS BIGINT) AS days, round(v / (date_part('day', last_day(t)) * 86400), 8) AS flux FROM monthly")
def p08_calendar(spark, sf_dir):
    from ..functions.columns import monthly_total_to_flux, season_year

    rows = monthly(spark, sf_dir)
    return rounded(rows.select("cell", "t", season(F.month("t")).alias("season"), long(season_year("t")).alias("season_year"), long(F.dayofmonth(F.last_day("t"))).alias("days"), monthly_total_to_flux("v", "t").alias("flux")), flux=8)


@query(M + ", s AS (SELECT unnest(generate_series(DATE '1995-01-01', DATE '2002-12-01', INTERVAL 1 MONTH))::DATE AS month) SELECT a.cell, a.month FROM (SELECT c.cell, s.month FROM (SELECT DISTINCT cell FROM monthly) c, s) a LEFT JOIN monthly m ON m.cell = a.cell AND m.t = a.month WHERE m.v IS NULL")
def a45_missing_months(spark, sf_dir):
    return temporal.missing_months(monthly(spark, sf_dir), ["cell"], "1995-01-01", "2002-12-01")


@query(M + " SELECT x.cell, x.t, round(x.v + n.v - 100000, 4) AS v FROM monthly x JOIN (SELECT cell, month(t) AS m, avg(v) AS v FROM monthly GROUP BY 1, 2) n ON x.cell = n.cell AND month(x.t) = n.m")
def s17_absolute_from_anomaly(spark, sf_dir):
    field = monthly(spark, sf_dir)
    return rounded(align.absolute_from_anomaly(field, temporal.monthly_climatology(field, ["cell"]), ["cell"], -100000.0), v=4)


@query(M + ", e AS (SELECT 'all' AS one, cell, v FROM (SELECT cell, avg(v) AS v FROM monthly GROUP BY 1)) SELECT round(quantile_cont(v, 0.02), 4) AS low, round(quantile_cont(v, 0.98), 4) AS high, round(quantile_cont(abs(v), 0.98), 4) AS symmetric FROM e")
def a44_colour_range(spark, sf_dir):
    rows = temporal.climatology(monthly(spark, sf_dir), ["cell"])
    return rounded(spatial.colour_range(rows.withColumn("one", F.lit(1)), ["one"]).drop("one"), low=4, high=4, symmetric=4)


@query(MG + " SELECT region, round(min(v), 4) AS lowest, round(quantile_cont(v, 0.25), 4) AS q25, round(quantile_cont(v, 0.5), 4) AS median, round(quantile_cont(v, 0.75), 4) AS q75, round(max(v), 4) AS highest FROM monthly JOIN grid USING (cell) GROUP BY 1")
def a51_distribution(spark, sf_dir):
    rows = spatial.on_grid(monthly(spark, sf_dir), grid(spark, sf_dir))
    return rounded(spatial.spread_of_values(rows, ["region"]), lowest=4, q25=4, median=4, q75=4, highest=4)


@query(YEARS + ", w AS (SELECT cell, CAST(min(x) AS BIGINT) + cell % 3 AS s FROM y GROUP BY 1) SELECT s AS start, s + 2 AS \"end\", count(*) AS n FROM w GROUP BY 1, 2 QUALIFY row_number() OVER (ORDER BY count(*) DESC, s) = 1")
def a47_modal_window(spark, sf_dir):
    annual = temporal.annual_mean(monthly(spark, sf_dir), ["cell"])
    windows = annual.groupBy("cell").agg((F.min("year") + F.col("cell") % 3).alias("start")).select(long("start").alias("start"), long(F.col("start") + 2).alias("end"))
    return ensemble.modal_window(windows)

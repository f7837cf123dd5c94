"""Queries on the daily fields: complete axes, runs, extremes, heatwaves, marine heatwaves."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import calendar_slot, day_of_365
from ..operators import align, extremes, mhw, spatial, stats, temporal
from ..sources import readers
from .catalog import long, query, rounded
from .panels import DAYS, DENSE, GRID, LINES, SPARSE, days, dense, grid, lines, sparse

D = "WITH " + DAYS()
N = "WITH " + DAYS("s_nationkey")
SLOT = "CAST([0, 31, 60, 91, 121, 152, 182, 213, 244, 274, 305, 335][month(d)] + day(d) - 1 AS INTEGER)"
DOY = "CAST([0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334][month(d)] + CASE WHEN month(d) = 2 THEN least(day(d), 28) ELSE day(d) END AS INTEGER)"


def runs_sql(name: str, source: str, keys: str, flag: str) -> str:
    return f"{name} AS (SELECT {keys}, min(t_idx) AS s, max(t_idx) AS e, count(*) AS n FROM (SELECT {keys}, t_idx, t_idx - row_number() OVER (PARTITION BY {keys} ORDER BY t_idx) AS isl FROM {source} WHERE {flag}) GROUP BY {keys}, isl)"


def slotted(rows):
    return rows.withColumn("slot", calendar_slot(F.month("d"), F.dayofmonth("d"))).withColumn("year", F.year("d"))


@query("WITH " + SPARSE + ", span AS (SELECT min(d) AS a, max(d) AS z FROM sparse), axis AS (SELECT cell, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(z AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS d, a FROM (SELECT DISTINCT cell FROM sparse), span) SELECT cell, d, CAST(date_diff('day', a, d) AS INTEGER) AS t_idx, v FROM axis LEFT JOIN sparse USING (cell, d)")
def j06_complete_axis(spark, sf_dir):
    return align.on_full_axis(sparse(spark, sf_dir), ["cell"])


@query(D + " SELECT cell, CAST(year(d) AS BIGINT) AS year, round(quantile_cont(v, 0.875), 4) AS p87_5, round(quantile_cont(v, 0.99), 4) AS p99 FROM days GROUP BY 1, 2")
def a20_percentiles_cell_year(spark, sf_dir):
    out = extremes.percentiles(days(spark, sf_dir).withColumn("year", long(F.year("d"))), ["cell", "year"], [0.875, 0.99])
    return rounded(out, p87_5=4, p99=4)


@query(D + ", w AS (SELECT cell, CAST(year(d) AS DOUBLE) AS x, quantile_cont(v, 0.99) - quantile_cont(v, 0.875) AS v FROM days GROUP BY 1, 2) SELECT cell, round(regr_slope(v, x), 7) AS slope FROM w GROUP BY 1")
def p24_tail_width_trend(spark, sf_dir):
    widths = extremes.percentiles(days(spark, sf_dir).withColumn("year", F.year("d")), ["cell", "year"], [0.875, 0.99])
    return rounded(temporal.linear_trend(widths.withColumn("v", F.col("p99") - F.col("p87_5")), ["cell"]), slope=7)


@query(D + f", k AS (SELECT cell, CAST((({DOY} - 1 + o + 365) % 365) + 1 AS INTEGER) AS doy, v FROM days, (SELECT unnest([-2, -1, 0, 1, 2]) AS o) WHERE year(d) BETWEEN 1995 AND 2000), l AS (SELECT cell, doy, list_sort(list(v) FILTER (WHERE v IS NOT NULL)) AS x FROM k GROUP BY 1, 2), p AS (SELECT *, len(x) AS n, greatest(1, least(len(x), 0.1::DOUBLE * (len(x) + 1 / 3::DOUBLE) + 1 / 3::DOUBLE)) AS a, greatest(1, least(len(x), 0.9::DOUBLE * (len(x) + 1 / 3::DOUBLE) + 1 / 3::DOUBLE)) AS b FROM l) SELECT cell, doy, round(x[floor(a)::INT] + (a - floor(a)) * (x[least(floor(a)::INT + 1, n)] - x[floor(a)::INT]), 4) AS p10, round(x[floor(b)::INT] + (b - floor(b)) * (x[least(floor(b)::INT + 1, n)] - x[floor(b)::INT]), 4) AS p90 FROM p")
def a21_type8_slot_percentile(spark, sf_dir):
    rows = days(spark, sf_dir).where(F.year("d").between(1995, 2000)).withColumn("doy", day_of_365(F.month("d"), F.dayofmonth("d")))
    return rounded(extremes.calendar_day_percentiles(rows, ["cell"], {"p10": 0.1, "p90": 0.9}), p10=4, p90=4)


@query(D + " SELECT cell, round(quantile_cont(v / 10, 0.95) FILTER (WHERE v / 10 >= 1), 4) AS p95, round(quantile_cont(v / 10, 0.99) FILTER (WHERE v / 10 >= 1), 4) AS p99 FROM days GROUP BY 1")
def a22_wet_percentiles(spark, sf_dir):
    return rounded(extremes.wet_percentiles(days(spark, sf_dir).withColumn("v", F.col("v") / 10), ["cell"]), p95=4, p99=4)


@query(D + " SELECT cell, CAST(year(d) AS BIGINT) AS year, count(*) FILTER (WHERE v >= 100) AS high, count(*) FILTER (WHERE v < 50) AS low, count(*) FILTER (WHERE v > 200) AS very_high FROM days GROUP BY 1, 2")
def a23_threshold_days(spark, sf_dir):
    v = F.col("v")
    return extremes.threshold_days(days(spark, sf_dir).withColumn("year", long(F.year("d"))), ["cell", "year"], {"high": v >= 100, "low": v < 50, "very_high": v > 200})


@query(D + """, p AS (SELECT cell, d, v / 10 AS v FROM days), q AS (SELECT cell, quantile_cont(v, 0.95) FILTER (WHERE v >= 1) AS p95, quantile_cont(v, 0.99) FILTER (WHERE v >= 1) AS p99 FROM p WHERE year(d) BETWEEN 1995 AND 1998 GROUP BY 1)
 SELECT cell, CAST(year(d) AS BIGINT) AS year, CASE WHEN count(v) >= 300 THEN round(coalesce(sum(v) FILTER (WHERE v >= 1), 0), 4) END AS prcptot, CASE WHEN count(v) >= 300 THEN round(sum(v) FILTER (WHERE v >= 1) / count(*) FILTER (WHERE v >= 1), 4) END AS sdii, CASE WHEN count(v) >= 300 THEN round(max(v), 4) END AS rx1day,
 CASE WHEN count(v) >= 300 THEN count(*) FILTER (WHERE v >= 1) END AS r1mm, CASE WHEN count(v) >= 300 THEN count(*) FILTER (WHERE v >= 10) END AS r10mm, CASE WHEN count(v) >= 300 THEN count(*) FILTER (WHERE v >= 20) END AS r20mm,
 CASE WHEN count(v) >= 300 THEN round(coalesce(sum(v) FILTER (WHERE v > p95), 0), 4) END AS r95p, CASE WHEN count(v) >= 300 THEN round(coalesce(sum(v) FILTER (WHERE v > p99), 0), 4) END AS r99p FROM p JOIN q USING (cell) GROUP BY 1, 2""")
def a24_precip_indices(spark, sf_dir):
    rows = days(spark, sf_dir).withColumn("v", F.col("v") / 10).withColumn("year", long(F.year("d")))
    base = extremes.wet_percentiles(rows.where(F.col("year").between(1995, 1998)), ["cell"])
    return rounded(extremes.precip_indices(rows.join(base, "cell"), ["cell", "year"], 300), prcptot=4, sdii=4, rx1day=4, r95p=4, r99p=4)


@query(D + ", w AS (SELECT cell, year(d) AS y, CASE WHEN count(v) OVER k = 5 THEN sum(v) OVER k END AS s FROM days WINDOW k AS (PARTITION BY cell ORDER BY t_idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) SELECT cell, CAST(y AS BIGINT) AS year, max(s) AS rx5day FROM w GROUP BY 1, 2")
def w13_rx5day(spark, sf_dir):
    return extremes.rolling_sum_max(days(spark, sf_dir), ["cell"], long(F.year("d")))


TXTN = LINES() + f", x AS (SELECT cell, d, max(l_quantity) AS tx, min(l_quantity) - 5 AS tn, {DOY} AS doy FROM lines GROUP BY 1, 2)"


def tx_tn(spark, sf_dir):
    rows = lines(spark, sf_dir).groupBy("cell", "d").agg(F.max("l_quantity").alias("v"), F.min("l_quantity").alias("n"))
    both = align.complete_days(rows.select("cell", "d", "v"), rows.select("cell", "d", (F.col("n") - 5).alias("v")), ["cell", "d"])
    return both.withColumn("doy", day_of_365(F.month("d"), F.dayofmonth("d"))).withColumn("year", long(F.year("d")))


@query("WITH " + TXTN + """, b AS (SELECT cell, doy, quantile_cont(tx, 0.1) AS tx10, quantile_cont(tx, 0.9) AS tx90, quantile_cont(tn, 0.1) AS tn10, quantile_cont(tn, 0.9) AS tn90 FROM x WHERE year(d) BETWEEN 1995 AND 1999 GROUP BY 1, 2)
 SELECT cell, CAST(year(d) AS BIGINT) AS year, max(tx) AS txx, max(tn) AS tnx, min(tx) AS txn, min(tn) AS tnn, round(avg(tx - tn), 4) AS dtr, round(100.0::DOUBLE * count(*) FILTER (WHERE tx < tx10) / count(*), 4) AS tx10p, round(100.0::DOUBLE * count(*) FILTER (WHERE tx > tx90) / count(*), 4) AS tx90p, round(100.0::DOUBLE * count(*) FILTER (WHERE tn < tn10) / count(*), 4) AS tn10p, round(100.0::DOUBLE * count(*) FILTER (WHERE tn > tn90) / count(*), 4) AS tn90p,
 count(*) FILTER (WHERE tn < 0) AS fd, count(*) FILTER (WHERE tx < 0) AS id, count(*) FILTER (WHERE tn > 20) AS tr FROM x LEFT JOIN b USING (cell, doy) GROUP BY 1, 2""")
def a25_temp_indices(spark, sf_dir):
    rows = tx_tn(spark, sf_dir)
    q = F.array(F.lit(0.1), F.lit(0.9))
    base = rows.where(F.col("year").between(1995, 1999)).groupBy("cell", "doy").agg(F.percentile("tx", q).alias("x"), F.percentile("tn", q).alias("n"))
    base = base.select("cell", "doy", F.col("x")[0].alias("tx10"), F.col("x")[1].alias("tx90"), F.col("n")[0].alias("tn10"), F.col("n")[1].alias("tn90"))
    out = extremes.temp_indices(align.with_threshold(rows, base, ["cell", "doy"]), ["cell", "year"])
    return rounded(out, dtr=4, tx10p=4, tx90p=4, tn10p=4, tn90p=4)


@query("WITH orders_m AS (SELECT CAST(c_nationkey AS BIGINT) AS cell, CAST(date_trunc('month', o_orderdate) AS DATE) AS t, avg(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) SELECT cell, CAST(year(t) AS BIGINT) AS year, CAST(sum(CASE WHEN v > 120000 THEN date_part('day', last_day(t)) ELSE 0 END) AS BIGINT) AS days FROM orders_m GROUP BY 1, 2")
def a26_approx_exceedance(spark, sf_dir):
    from .panels import monthly

    return extremes.approx_exceedance(monthly(spark, sf_dir).withColumn("year", long(F.year("t"))), ["cell", "year"], 120000.0)


@query(D + ", m AS (SELECT cell, avg(v) AS m FROM days GROUP BY 1), f AS (SELECT days.*, m FROM days JOIN m USING (cell)), " + runs_sql("r", "f", "cell", "v > m") + " SELECT cell, s AS start, e AS \"end\", CAST(n AS INTEGER) AS length FROM r")
def w14_runs(spark, sf_dir):
    rows = days(spark, sf_dir)
    mean = temporal.climatology(rows, ["cell"]).withColumnRenamed("v", "m")
    out = extremes.runs(rows.join(mean, "cell"), ["cell"], F.col("v") > F.col("m"))
    return out.withColumn("length", F.col("length").cast("int"))


@query(D + ", y AS (SELECT cell, CAST(year(d) AS BIGINT) AS year, t_idx, v FROM days), " + runs_sql("r", "y", "cell, year", "v > 100") + " SELECT k.cell, k.year, CAST(coalesce(sum(n) FILTER (WHERE n >= 3), 0) AS BIGINT) AS spell_days FROM (SELECT DISTINCT cell, year FROM y) k LEFT JOIN r USING (cell, year) GROUP BY 1, 2")
def w15_spell_days(spark, sf_dir):
    rows = days(spark, sf_dir).withColumn("year", long(F.year("d")))
    return extremes.spell_days(rows, ["cell", "year"], F.col("v") > 100, 3)


@query(D + ", y AS (SELECT cell, CAST(year(d) AS BIGINT) AS year, CAST(dayofyear(d) - 1 AS INTEGER) AS t_idx, v FROM days), " + runs_sql("w", "y", "cell, year", "v > 90") + ", " + runs_sql("c", "y", "cell, year", "v < 90") + """, s AS (SELECT cell, year, min(s) AS s FROM w WHERE n >= 2 GROUP BY 1, 2), e AS (SELECT c.cell, c.year, min(greatest(c.s, s.s, 181)) AS e FROM c JOIN s USING (cell, year) WHERE c.e - greatest(c.s, s.s, 181) + 1 >= 2 GROUP BY 1, 2)
 SELECT k.cell, k.year, CAST(CASE WHEN s.s IS NULL THEN 0 ELSE coalesce(e.e, 365) - s.s END AS BIGINT) AS gsl FROM (SELECT DISTINCT cell, year FROM y) k LEFT JOIN s USING (cell, year) LEFT JOIN e USING (cell, year)""")
def w16_gsl(spark, sf_dir):
    rows = days(spark, sf_dir).select("cell", long(F.year("d")).alias("year"), (F.dayofyear("d") - 1).alias("t_idx"), "v")
    return extremes.growing_season(rows, ["cell", "year"], 90.0, 2, 181)


HW = ", " + runs_sql("r", "f", "cell, year", "v > thr") + """, g AS (SELECT * FROM r WHERE n >= 2), q AS (SELECT f.cell, f.year, {size} AS x FROM g JOIN f ON f.cell = g.cell AND f.year = g.year AND f.t_idx BETWEEN g.s AND g.e),
 a AS (SELECT cell, year, count(*) AS hwn, sum(n) AS hwf, max(n) AS hwd FROM g GROUP BY 1, 2), b AS (SELECT cell, year, avg(x) AS hwm, max(x) AS hwa FROM q GROUP BY 1, 2)
 SELECT k.cell, k.year, CAST(coalesce(hwn, 0) AS BIGINT) AS hwn, CAST(coalesce(hwf, 0) AS BIGINT) AS hwf, CAST(coalesce(hwd, 0) AS BIGINT) AS hwd, round(hwm, 4) AS hwm, round(hwa, 4) AS hwa FROM (SELECT DISTINCT cell, year FROM f) k LEFT JOIN a USING (cell, year) LEFT JOIN b USING (cell, year)"""


@query("WITH " + DAYS("s_nationkey") + ", " + GRID + f", p AS (SELECT days.*, dayofyear(d) AS doy, CASE WHEN lat >= 0 THEN CASE WHEN month(d) BETWEEN 5 AND 9 THEN year(d) END WHEN month(d) >= 11 THEN year(d) + 1 WHEN month(d) <= 3 THEN year(d) END AS year FROM days JOIN grid USING (cell)), t AS (SELECT cell, doy, quantile_cont(v, 0.5) AS thr FROM p GROUP BY 1, 2), f AS (SELECT p.cell, CAST(p.year AS BIGINT) AS year, t_idx, v, thr FROM p JOIN t USING (cell, doy) WHERE p.year IS NOT NULL)" + HW.format(size="v"))
def w20_heatwave_v1(spark, sf_dir):
    rows = days(spark, sf_dir, "s_nationkey").join(grid(spark, sf_dir).select("cell", "lat"), "cell").withColumn("doy", F.dayofyear("d"))
    threshold = rows.groupBy("cell", "doy").agg(F.percentile("v", 0.5).alias("thr"))
    rows = align.with_threshold(rows.withColumn("year", long(extremes.summer_year())).where("year IS NOT NULL"), threshold, ["cell", "doy"])
    return rounded(extremes.heatwaves(rows, ["cell"], "year", "thr", 2), hwm=4, hwa=4)


@query(D + ", t AS (SELECT cell, quantile_cont(v, 0.9) AS thr FROM days WHERE year(d) BETWEEN 1995 AND 1998 GROUP BY 1), f AS (SELECT cell, CAST(year(d) AS BIGINT) AS year, t_idx, v, thr FROM days JOIN t USING (cell))" + HW.format(size="v - thr"))
def w21_heatwave_v2(spark, sf_dir):
    rows = days(spark, sf_dir).withColumn("year", long(F.year("d")))
    threshold = rows.where(F.col("year").between(1995, 1998)).groupBy("cell").agg(F.percentile("v", 0.9).alias("thr"))
    return rounded(extremes.heatwaves(rows.join(threshold, "cell"), ["cell"], "year", "thr", 2, relative=True), hwm=4, hwa=4)


@query(D + ", s AS (SELECT cell, CASE WHEN month(d) IN (12, 1, 2) THEN 'DJF' WHEN month(d) IN (3, 4, 5) THEN 'MAM' WHEN month(d) IN (6, 7, 8) THEN 'JJA' ELSE 'SON' END AS season, CAST(year(d + INTERVAL 1 MONTH) AS BIGINT) AS season_year, v FROM days) SELECT cell, season, season_year, CASE WHEN count(v) >= 80 THEN max(v) END AS rx1day, CASE WHEN count(v) >= 80 THEN sum(v) END AS total FROM s GROUP BY 1, 2, 3")
def w22_season_blocks(spark, sf_dir):
    rows = extremes.season_blocks(days(spark, sf_dir)).withColumn("season_year", long("season_year"))
    enough = F.count("v") >= 80
    return rows.groupBy("cell", "season", "season_year").agg(F.when(enough, F.max("v")).alias("rx1day"), F.when(enough, F.sum("v")).alias("total"))


SEAS = f""", sl AS (SELECT cell, t_idx, {SLOT} AS slot, year(d) AS year, v FROM days), cen AS (SELECT cell, t_idx, slot FROM sl WHERE year BETWEEN 1995 AND 2000 AND slot <> 59),
 cl0 AS (SELECT cen.cell, cen.slot, avg(v) AS seas, quantile_cont(v, 0.9) AS thresh FROM cen JOIN sl ON sl.cell = cen.cell AND sl.t_idx BETWEEN cen.t_idx - 5 AND cen.t_idx + 5 WHERE v IS NOT NULL GROUP BY 1, 2),
 cl1 AS (SELECT * FROM cl0 UNION ALL SELECT cell, 59, avg(seas), avg(thresh) FROM cl0 WHERE slot IN (58, 60) GROUP BY 1 HAVING count(*) = 2),
 ok AS (SELECT cell FROM sl WHERE year BETWEEN 1995 AND 2000 GROUP BY 1 HAVING count(v) >= 0.5 * count(*)), cl AS (SELECT cl1.* FROM cl1 JOIN ok USING (cell)),
 sm AS (SELECT a.cell, a.slot, avg(b.seas) AS seas, avg(b.thresh) AS thresh FROM cl a JOIN cl b ON a.cell = b.cell AND ((b.slot - a.slot + 366 + 15) % 366) <= 30 GROUP BY 1, 2)"""


@query(D + SEAS + " SELECT cell, CAST(slot AS INTEGER) AS slot, round(seas, 4) AS seas, round(thresh, 4) AS thresh FROM cl")
def w11_mhw_climatology(spark, sf_dir):
    return rounded(mhw.slot_climatology(slotted(days(spark, sf_dir)), ["cell"], (1995, 2000)), seas=4, thresh=4)


@query(D + SEAS + " SELECT cell, CAST(slot AS INTEGER) AS slot, round(seas, 4) AS seas FROM cl0")
def j19_slot_window(spark, sf_dir):
    record = slotted(days(spark, sf_dir))
    centres = record.where(F.col("year").between(1995, 2000) & (F.col("slot") != mhw.LEAP_SLOT)).select("cell", F.col("t_idx").alias("centre"), "slot")
    near = align.by_offset(record.select("cell", "t_idx", "v").where("v IS NOT NULL"), 5)
    return rounded(near.join(centres, ["cell", "centre"]).groupBy("cell", "slot").agg(F.avg("v").alias("seas")), seas=4)


@query(D + SEAS + " SELECT cell, CAST(slot AS INTEGER) AS slot, round(seas, 4) AS seas, round(thresh, 4) AS thresh FROM sm")
def w10_slot_smooth(spark, sf_dir):
    clim = mhw.slot_climatology(slotted(days(spark, sf_dir)), ["cell"], (1995, 2000))
    return rounded(mhw.smooth_slots(clim, ["cell"]), seas=4, thresh=4)


EVENTS = SEAS + ", fu AS (SELECT sl.cell, t_idx, year, v, seas, thresh, coalesce(v - seas, 0) AS rel, (v - thresh) / nullif(thresh - seas, 0) AS lev FROM sl LEFT JOIN sm USING (cell, slot)), " + runs_sql("r0", "fu", "cell", "v > thresh") + """, r1 AS (SELECT cell, s, e, coalesce(CASE WHEN s - lag(e) OVER (PARTITION BY cell ORDER BY s) - 1 > 2 THEN 1 ELSE 0 END, 1) AS fresh, lag(e) OVER (PARTITION BY cell ORDER BY s) AS pe FROM r0 WHERE n >= 2),
 r2 AS (SELECT cell, s, e, sum(CASE WHEN pe IS NULL OR s - pe - 1 > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY cell ORDER BY s) AS ev FROM r1), ev AS (SELECT cell, ev, min(s) AS s, max(e) AS e FROM r2 GROUP BY 1, 2),
 wi AS (SELECT *, lag(rel) OVER (PARTITION BY cell ORDER BY t_idx) AS pr, lead(rel) OVER (PARTITION BY cell ORDER BY t_idx) AS nx, max(t_idx) OVER (PARTITION BY cell) AS la FROM fu),
 m0 AS (SELECT ev.cell, ev.ev, ev.s, ev.e, count(*) AS dur, max(rel) AS imax, avg(rel) AS imean, stddev_pop(rel) AS ivar, sum(rel) AS icum, max(lev) AS lev, max(la) AS la, arg_min(rel, t_idx) AS rs, arg_max(rel, t_idx) AS re, max(pr) FILTER (WHERE t_idx = ev.s) AS pr, max(nx) FILTER (WHERE t_idx = ev.e) AS nx FROM ev JOIN wi ON wi.cell = ev.cell AND wi.t_idx BETWEEN ev.s AND ev.e GROUP BY 1, 2, 3, 4),
 pk AS (SELECT m0.cell, m0.ev, min(t_idx) AS pk FROM m0 JOIN wi ON wi.cell = m0.cell AND wi.t_idx BETWEEN m0.s AND m0.e AND wi.rel = m0.imax GROUP BY 1, 2),
 me AS (SELECT cell, s, e, dur, imax, imean, ivar, icum, least(floor(1 + lev), 4) AS cat, CASE WHEN s > 0 THEN (imax - 0.5::DOUBLE * (rs + pr)) / (pk - s + 0.5::DOUBLE) ELSE (imax - rs) / greatest(pk - s, 1) END AS onset, CASE WHEN e < la THEN (imax - 0.5::DOUBLE * (re + nx)) / (e - pk + 0.5::DOUBLE) ELSE (imax - re) / greatest(e - pk, 1) END AS decl FROM m0 JOIN pk USING (cell, ev))"""


def marine(spark, sf_dir):
    full = slotted(days(spark, sf_dir))
    clim = mhw.smooth_slots(mhw.slot_climatology(full, ["cell"], (1995, 2000)), ["cell"])
    full = full.join(clim, ["cell", "slot"], "left")
    return mhw.event_metrics(full, mhw.events(full, ["cell"], least=2), ["cell"]), full


@query(D + EVENTS + " SELECT cell, s AS start, e AS \"end\", dur AS duration, round(imax, 4) AS intensity_max, round(imean, 4) AS intensity_mean, round(ivar, 4) AS intensity_var, round(icum, 4) AS intensity_cumulative, CAST(cat AS INTEGER) AS category, round(onset, 4) AS rate_onset, round(decl, 4) AS rate_decline FROM me")
def w19_mhw_events(spark, sf_dir):
    found = marine(spark, sf_dir)[0].drop("event")
    return rounded(found, intensity_max=4, intensity_mean=4, intensity_var=4, intensity_cumulative=4, rate_onset=4, rate_decline=4)


@query(D + EVENTS + """, va AS (SELECT cell, count(DISTINCT year) AS ny, count(*) AS nd FROM fu GROUP BY 1 HAVING count(thresh) > 0), ag AS (SELECT cell, count(*) AS n, avg(dur) AS a, max(imax) AS b, avg(imean) AS c, avg(icum) AS d, avg(onset) AS f, avg(decl) AS g, max(cat) AS h, sum(dur) AS hd FROM me GROUP BY 1)
 SELECT cell, round(coalesce(n, 0) / ny, 4) AS frequency, round(a, 4) AS duration_mean, round(b, 4) AS intensity_max_max, round(c, 4) AS intensity_mean_mean, round(d, 4) AS intensity_cumulative_mean, round(f, 4) AS rate_onset_mean, round(g, 4) AS rate_decline_mean, CAST(coalesce(h, 0) AS INTEGER) AS category_max, round(100.0::DOUBLE * coalesce(hd, 0) / nd, 4) AS mhw_days_pct FROM va LEFT JOIN ag USING (cell)""")
def a37_mhw_cell_metrics(spark, sf_dir):
    found, full = marine(spark, sf_dir)
    out = mhw.cell_metrics(found, full, ["cell"])
    return rounded(out, **{c: 4 for c in out.columns if c not in ("cell", "category_max")})


@query(D + f""", sl AS (SELECT cell, t_idx, {SLOT} AS slot, v FROM days), s0 AS (SELECT cell, slot, sum(v) AS s, count(v) AS c FROM sl GROUP BY 1, 2), a AS (SELECT sl.cell, t_idx, v, v - s / nullif(c, 0) AS a FROM sl JOIN s0 USING (cell, slot)), f AS (SELECT cell, regr_slope(a, t_idx) AS b, regr_intercept(a, t_idx) AS i FROM a GROUP BY 1),
 z AS (SELECT cell, t_idx, v, a - (i + b * t_idx) AS a FROM a JOIN f USING (cell)), h AS (SELECT *, CASE WHEN count(a) OVER k >= 46 THEN avg(a) OVER k END AS sm FROM z WINDOW k AS (PARTITION BY cell ORDER BY t_idx ROWS BETWEEN 45 PRECEDING AND 45 FOLLOWING)) SELECT cell, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS std_raw, round(stddev_pop(a), 4) AS std_anom, round(stddev_pop(a - sm), 4) AS std_hp FROM h GROUP BY 1""")
def w12_ssh_stats(spark, sf_dir):
    return rounded(stats.high_pass(slotted(days(spark, sf_dir)), ["cell"], 91, 1), mean=4, std_raw=4, std_anom=4, std_hp=4)


@query("WITH " + LINES() + ", m AS (SELECT CAST(date_trunc('month', d) AS DATE) AS t, l_linenumber AS level, sum(l_quantity * (1 + l_tax)) / sum(1 + l_tax) AS v FROM lines GROUP BY 1, 2) SELECT t, level, round(v, 4) AS v, round(v - first_value(v) OVER (PARTITION BY level ORDER BY t), 4) AS anomaly FROM m")
def a34_hovmoller(spark, sf_dir):
    rows = lines(spark, sf_dir).select(F.trunc("d", "MM").alias("t"), F.col("l_linenumber").alias("level"), F.col("l_quantity").alias("v"), (1 + F.col("l_tax")).alias("area"))
    return rounded(spatial.hovmoller(rows), v=4, anomaly=4)


@query("WITH " + LINES() + ", x AS (SELECT CAST(year(d) AS BIGINT) AS year, CASE WHEN l_linenumber < 3 THEN 'upper' WHEN l_linenumber < 6 THEN 'middle' ELSE 'lower' END AS layer, l_quantity AS v, (1 + l_tax) * l_linenumber AS w FROM lines) SELECT year, layer, round(sum(v * w) / sum(w), 4) AS v FROM x GROUP BY 1, 2")
def a35_layer_means(spark, sf_dir):
    rows = lines(spark, sf_dir).select(long(F.year("d")).alias("year"), F.col("l_linenumber").alias("depth"), F.col("l_linenumber").cast("double").alias("thickness"), F.col("l_quantity").alias("v"), (1 + F.col("l_tax")).alias("area"))
    return rounded(spatial.layer_means(rows, {"upper": (0, 3), "middle": (3, 6), "lower": (6, 99)}, ["year"]), v=4)


@query("WITH l AS (SELECT DISTINCT CAST(l_linenumber * l_linenumber AS DOUBLE) AS depth FROM lineitem), e AS (SELECT depth, coalesce((lag(depth) OVER (ORDER BY depth) + depth) / 2, 0) AS top, (lead(depth) OVER (ORDER BY depth) + depth) / 2 AS bot FROM l) SELECT depth, coalesce(bot, depth + depth - top) - top AS thickness FROM e")
def a36_level_thickness(spark, sf_dir):
    from .panels import table

    levels = table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") * F.col("l_linenumber")).cast("double").alias("depth")).distinct()
    return spatial.level_thickness(levels)


@query("WITH " + LINES() + ", x AS (SELECT cell, l_linenumber AS level, CAST(count(*) AS DOUBLE) AS f, avg(l_quantity) AS m FROM lines GROUP BY 1, 2) SELECT cell, round(avg(f), 4) AS frequency, round(sum(m * f) / sum(f), 4) AS m FROM x GROUP BY 1")
def a38_pool_levels(spark, sf_dir):
    from ..operators.ensemble import pool_levels

    rows = lines(spark, sf_dir).groupBy("cell", "l_linenumber").agg(F.count(F.lit(1)).cast("double").alias("frequency"), F.avg("l_quantity").alias("m"))
    return rounded(pool_levels(rows, ["cell"], metrics=["m"]), frequency=4, m=4)


@query("WITH " + LINES() + ", x AS (SELECT cell, month(d) AS k, avg(l_quantity) AS m FROM lines GROUP BY 1, 2) SELECT cell, round(avg(m), 4) AS mld_mean, round(max(m), 4) AS mld_max FROM x GROUP BY 1")
def a39_mixed_layer(spark, sf_dir):
    return rounded(mhw.mixed_layer(lines(spark, sf_dir).select("cell", F.col("d").alias("t"), F.col("l_quantity").alias("v")), ["cell"]), mld_mean=4, mld_max=4)


@query("WITH " + LINES("s_nationkey") + ", " + GRID + ", x AS (SELECT lines.cell, CAST(year(d) AS BIGINT) AS year, avg(l_discount * 5) AS conc, avg(l_tax) AS thick FROM lines GROUP BY 1, 2) SELECT year, CASE WHEN lat >= 0 THEN 'north' ELSE 'south' END AS hemisphere, round(sum(conc * area), 6) AS ice_area, round(sum(CASE WHEN conc >= 0.25 THEN area ELSE 0 END), 6) AS ice_extent, round(sum(thick * area), 6) AS ice_volume FROM x JOIN grid USING (cell) GROUP BY 1, 2")
def a33_ice_area_extent(spark, sf_dir):
    rows = lines(spark, sf_dir, "s_nationkey").groupBy("cell", long(F.year("d")).alias("year")).agg(F.avg(F.col("l_discount") * 5).alias("conc"), F.avg("l_tax").alias("thick"))
    out = spatial.ice_totals(rows.join(grid(spark, sf_dir), "cell"), ["year"], 0.25)
    return rounded(out, ice_area=6, ice_extent=6, ice_volume=6)


@query("WITH " + LINES() + ", x AS (SELECT cell, CAST(date_trunc('month', d) AS DATE) AS t, avg(l_quantity) AS rst, -avg(l_discount) * 100 AS rlt, avg(l_tax) * 500 AS rss, -avg(l_linenumber) AS rls FROM lines GROUP BY 1, 2) SELECT cell, t, round(rst + rlt, 4) AS toa_net, round(rss + rls, 4) AS sfc_net, round(rst + rlt - rst * 1.1::DOUBLE - rlt * 0.9::DOUBLE, 4) AS cre, round(rst + rlt - rss - rls, 4) AS atm FROM x")
def p23_radiation_budget(spark, sf_dir):
    from ..operators.classify import net_radiation

    m = lines(spark, sf_dir).groupBy("cell", F.trunc("d", "MM").alias("t")).agg(F.avg("l_quantity").alias("rst"), (-F.avg("l_discount") * 100).alias("rlt"), (F.avg("l_tax") * 500).alias("rss"), (-F.avg("l_linenumber")).alias("rls"))
    m = m.withColumn("rstcs", F.col("rst") * 1.1).withColumn("rltcs", F.col("rlt") * 0.9)
    return rounded(net_radiation(m.unpivot(["cell", "t"], ["rst", "rlt", "rss", "rls", "rstcs", "rltcs"], "variable", "v"), ["cell", "t"]), toa_net=4, sfc_net=4, cre=4, atm=4)


@query("WITH e AS (SELECT event_type, CAST(ts AS DATE) AS d, min(value) AS v_min, max(value) AS v_max FROM events GROUP BY 1, 2) SELECT * FROM e")
def s22_daily_extremes(spark, sf_dir):
    from .panels import table

    return readers.daily_extremes(table(spark, sf_dir, "events"), ["event_type"], v="value")


@query("WITH h AS (SELECT event_type, CAST(ts AS DATE) AS d, hour(ts) // 3 AS k, sum(value) AS v FROM events GROUP BY 1, 2, 3) SELECT event_type, d, round(sum(v), 4) AS v FROM h GROUP BY 1, 2 HAVING count(*) = 8")
def s22_daily_sums(spark, sf_dir):
    from .panels import table

    steps = table(spark, sf_dir, "events").groupBy("event_type", F.window(F.col("ts").cast("timestamp"), "3 hours")["start"].alias("ts")).agg(F.sum("value").alias("v"))
    return rounded(readers.daily_sums(steps, ["event_type"]), v=4)


@query("WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS f FROM events), s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k")
def x_session_spells(spark, sf_dir):
    from ..streaming.spells import sessions
    from .panels import table

    out = sessions(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "12 hours")
    return rounded(out.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", "total"), total=4)


@query(D + ", k AS (SELECT cell, year(d) AS y, v, t_idx FROM days WHERE v IS NOT NULL) SELECT cell, CAST(y AS BIGINT) AS year, CAST(row_number() OVER (PARTITION BY cell, y ORDER BY v DESC, t_idx) AS INTEGER) AS rank, v FROM k QUALIFY row_number() OVER (PARTITION BY cell, y ORDER BY v DESC, t_idx) <= 5")
def o02_top_values(spark, sf_dir):
    rows = days(spark, sf_dir).where("v IS NOT NULL").withColumn("year", long(F.year("d")))
    return extremes.top_values(rows, ["cell", "year"], 5).select("cell", "year", "rank", "v")

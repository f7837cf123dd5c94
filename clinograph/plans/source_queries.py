"""Queries on sources, units, masks and levels."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import convert, missing_to_null, month_start, monthly_total_to_flux, signed_flux
from ..operators import classify, ensemble, mhw, regrid, spatial, temporal
from ..sources import readers
from ..streaming import spells
from .catalog import long, query, rounded
from .field_queries import NEAR
from .panels import DAYS, GRID, LINES, MEMBERS, MONTHLY, SPARSE, days, grid, lines, members, monthly, sparse, table


@query("SELECT r_regionkey, r_name FROM region")
def s01_catalog_scan(spark, sf_dir):
    return readers.Catalog({"regions": f"{sf_dir}/region.parquet"}).load(spark, "regions").select("r_regionkey", "r_name")


@query("SELECT n_nationkey, n_name FROM nation")
def s02_catalog_search(spark, sf_dir):
    both = readers.Catalogs([readers.Catalog({"regions": f"{sf_dir}/region.parquet"}), readers.Catalog({"regions": "nowhere", "nations": f"{sf_dir}/nation.parquet"})])
    return both.load(spark, "nations").select("n_nationkey", "n_name")


@query("WITH " + DAYS() + " SELECT cell, t_idx, d AS t FROM days")
def s04_time_repair(spark, sf_dir):
    broken = days(spark, sf_dir).select("cell", F.col("t_idx").alias("i"), F.when(~(F.col("t_idx") % 7).isin(1, 2, 3), F.col("d")).alias("t"))
    return readers.repair_times(broken, ["cell"]).select("cell", F.col("i").alias("t_idx"), "t")


@query("SELECT o_custkey AS member, CASE WHEN count(*) < 8 THEN 'too few steps' WHEN min(year(o_orderdate)) > 1995 THEN 'starts late' WHEN max(year(o_orderdate)) < 2001 THEN 'ends early' ELSE 'used' END AS verdict FROM orders GROUP BY 1")
def s10_member_verdicts(spark, sf_dir):
    steps = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("member"), F.col("o_orderdate").alias("t"))
    return ensemble.verdicts(steps, ["member"], 1995, 2001, 8)


@query("SELECT DISTINCT p_brand AS model, 'r' || p_size || 'i1p1f1' AS variant FROM part")
def s11_members_of_stores(spark, sf_dir):
    stores = table(spark, sf_dir, "part").select(F.concat(F.lit("tas_"), "p_brand", F.lit("_historical_r"), F.col("p_size").cast("string"), F.lit("i1p1f1")).alias("store"))
    return readers.members_in(stores)


@query("SELECT event_id, 'obs' AS source, 'flux' AS variable, CAST(date_trunc('month', ts) AS DATE) AS t, round(CASE WHEN value < 400 THEN -(value * 2 + 1) END, 4) AS v FROM events")
def s15_normalised_obs(spark, sf_dir):
    flux = readers.Variable("flux", "value", 2.0, 1.0, fill_above=400.0, positive_up=True)
    out = readers.normalise(table(spark, sf_dir, "events"), flux, "obs", "ts")
    return rounded(out.select("event_id", "source", "variable", "t", "v"), v=4)


@query("SELECT event_id, make_date(1990 + (event_id % 1200) // 12, (event_id % 1200) % 12 + 1, 1) AS t FROM events")
def s16_decimal_years(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", (F.lit(1990.0) + (F.col("event_id") % 1200 + 0.5) / 12).alias("x"))
    return rows.select("event_id", readers.decimal_year("x").alias("t"))


@query("WITH " + MEMBERS + ", a AS (SELECT * FROM members WHERE family = 'F'), b AS (SELECT * FROM members WHERE family = 'O') SELECT a.source, a.cell, a.t, round(0.5::DOUBLE * a.v + 2.0::DOUBLE * b.v, 4) AS v FROM a JOIN b USING (source, cell, t)")
def s18_derived_field(spark, sf_dir):
    rows = members(spark, sf_dir)
    return rounded(classify.derived(rows.where("family = 'F'"), rows.where("family = 'O'"), 0.5, 2.0, ["source", "cell", "t"]), v=4)


@query("SELECT p_partkey FROM part a WHERE p_partkey % 2 = 0 AND EXISTS (SELECT 1 FROM part b WHERE b.p_partkey % 2 = 1 AND b.p_brand = a.p_brand AND b.p_size = a.p_size)")
def s23_same_members(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    return ensemble.same_members(parts.where("p_partkey % 2 = 0"), parts.where("p_partkey % 2 = 1"), ["p_brand", "p_size"]).select("p_partkey")


@query("WITH " + MEMBERS + " SELECT source || '/' || family AS source, cell, t, round(v, 4) AS v FROM members WHERE family IN ('F', 'O')")
def u01_composite(spark, sf_dir):
    rows = members(spark, sf_dir)
    parts = {f: rows.where(F.col("family") == f).select(F.col("source").alias("priority"), "cell", "t", "v") for f in ("F", "O")}
    out = readers.composite(parts)
    return rounded(out.select(F.concat_ws("/", "priority", "source").alias("source"), "cell", "t", "v"), v=4)


@query("SELECT o_orderkey, round(o_totalprice - 273.15::DOUBLE, 4) AS celsius, round(o_totalprice + 273.15::DOUBLE, 4) AS kelvin, round(o_totalprice / 86400.0::DOUBLE, 12) AS flux, round(o_totalprice * 100.0::DOUBLE, 4) AS pascal, round(o_totalprice / 100.0::DOUBLE, 6) AS fraction, round(o_totalprice / (day(last_day(o_orderdate)) * 86400.0::DOUBLE), 12) AS from_monthly FROM orders")
def p01_units(spark, sf_dir):
    x = "o_totalprice"
    ways = {"celsius": ("K", "degC"), "kelvin": ("degC", "K"), "flux": ("mm day-1", "kg m-2 s-1"), "pascal": ("hPa", "Pa"), "fraction": ("%", "1")}
    out = table(spark, sf_dir, "orders").select("o_orderkey", *(convert(x, *way).alias(name) for name, way in ways.items()), monthly_total_to_flux(x, "o_orderdate").alias("from_monthly"))
    return rounded(out, celsius=4, kelvin=4, flux=12, pascal=4, fraction=6, from_monthly=12)


@query("SELECT event_id, round(-value, 4) AS from_up, round(value, 4) AS from_down FROM events")
def p02_flux_sign(spark, sf_dir):
    out = table(spark, sf_dir, "events").select("event_id", signed_flux("value", True).alias("from_up"), signed_flux("value", False).alias("from_down"))
    return rounded(out, from_up=4, from_down=4)


@query("SELECT o_orderkey, round(CASE WHEN max(o_totalprice) OVER (PARTITION BY o_custkey) > 400000 THEN o_totalprice * 0.001::DOUBLE ELSE o_totalprice END, 7) AS v FROM orders")
def p03_unit_by_size(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("v"))
    return rounded(classify.unit_scale(rows, ["o_custkey"], 400000.0, 0.001).select("o_orderkey", "v"), v=7)


@query("WITH x AS (SELECT l_suppkey AS cell, l_discount * CASE l_suppkey % 3 WHEN 0 THEN 100.0::DOUBLE WHEN 1 THEN 10.2::DOUBLE ELSE 1.0::DOUBLE END AS v FROM lineitem), t AS (SELECT cell, max(v) AS top FROM x GROUP BY 1) SELECT cell, round(avg(CASE WHEN top > 1.5::DOUBLE THEN v / 100 WHEN top > 1.01::DOUBLE THEN least(v, 1.0::DOUBLE) ELSE v END), 4) AS v FROM x JOIN t USING (cell) GROUP BY 1")
def p03_ice_fraction(spark, sf_dir):
    scale = F.when(F.col("l_suppkey") % 3 == 0, 100.0).when(F.col("l_suppkey") % 3 == 1, 10.2).otherwise(1.0)
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("cell"), (F.col("l_discount") * scale).alias("v"))
    return rounded(classify.ice_fraction(rows, ["cell"]).groupBy("cell").agg(F.avg("v").alias("v")), v=4)


@query("SELECT p_partkey, CASE WHEN p_size <= 40 THEN CAST(p_size AS DOUBLE) END AS v FROM part")
def p03_ice_thickness(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("v"))
    return rows.select("p_partkey", classify.thin_ice("v", 40.0).alias("v"))


@query("SELECT l_suppkey AS cell FROM lineitem GROUP BY 1 HAVING avg(l_quantity) BETWEEN 25 AND 26")
def p04_plausible_sources(spark, sf_dir):
    return classify.check_range(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("cell"), F.col("l_quantity").alias("v")), ["cell"], 25.0, 26.0)


@query("SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS t, count(*) AS n FROM lineitem GROUP BY 1")
def p07_month_starts(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(month_start(F.col("l_shipdate").cast("date")).alias("t")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH " + MONTHLY + ", c AS (SELECT cell, avg(v) AS ref FROM monthly GROUP BY 1), m AS (SELECT avg(ref) AS middle FROM c) SELECT cell, t, round(CASE WHEN ref - middle > 0 THEN v END, 6) AS v FROM monthly JOIN c USING (cell), m")
def p14_ice_mask(spark, sf_dir):
    field = monthly(spark, sf_dir)
    clim = temporal.climatology(field, ["cell"])
    middle = clim.agg(F.avg("v").alias("middle"))
    reference = clim.join(F.broadcast(middle)).select("cell", (F.col("v") - F.col("middle")).alias("v"))  # one row
    return rounded(mhw.under_ice(field, reference, ["cell"], 0.0).select("cell", "t", "v"), v=6)


@query("WITH x AS (SELECT l_suppkey AS cell, l_linenumber AS level, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2) SELECT cell FROM x GROUP BY 1 HAVING bool_and(v > 22)")
def p15_whole_columns(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("cell"), "l_linenumber").agg(F.avg("l_quantity").alias("v"))
    return mhw.whole_columns(rows.withColumn("v", F.when(F.col("v") > 22, F.col("v"))))


LEVELS = "x AS (SELECT l_suppkey AS cell, l_linenumber * 100 AS level, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2)"


def levels(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("cell"), (F.col("l_linenumber") * 100).alias("level")).agg(F.avg("l_quantity").alias("v"))


@query("WITH " + LEVELS + " SELECT cell, round(v, 4) AS v FROM (SELECT cell, v, row_number() OVER (PARTITION BY cell ORDER BY level) AS r FROM x) WHERE r = 1")
def p16_surface(spark, sf_dir):
    return rounded(levels(spark, sf_dir).groupBy("cell").agg(F.min_by("v", "level").alias("v")), v=4)


@query("WITH " + LEVELS + " SELECT cell, round(v, 4) AS v FROM (SELECT cell, v, row_number() OVER (PARTITION BY cell ORDER BY abs(level - 250), level) AS r FROM x) WHERE r = 1")
def p17_nearest_level(spark, sf_dir):
    return rounded(spatial.nearest_level(levels(spark, sf_dir), 250.0, ["cell"]), v=4)


@query("SELECT o_custkey AS cell FROM orders GROUP BY 1 HAVING min(year(o_orderdate)) <= 1995 AND max(year(o_orderdate)) >= 2001")
def p25_coverage(spark, sf_dir):
    return temporal.coverage(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("cell"), F.col("o_orderdate").alias("t")), ["cell"], 1995, 2001)


@query("SELECT event_id, CASE WHEN event_id % 11 = 0 OR event_id % 13 = 0 OR event_id % 17 = 0 OR event_id % 19 = 0 THEN NULL ELSE round(value, 4) END AS v FROM events")
def p27_fill_values(spark, sf_dir):
    k, bad = F.col("event_id"), {11: float("nan"), 13: 1e20, 17: -999.0, 19: float("inf")}
    raw = F.col("value")
    for divisor, fill in bad.items():
        raw = F.when(k % divisor == 0, F.lit(fill)).otherwise(raw)
    return rounded(table(spark, sf_dir, "events").select("event_id", missing_to_null(raw, -900.0, 1e19).alias("v")), v=4)


@query("WITH " + MONTHLY + ", " + SPARSE + ", y AS (SELECT greatest(min(year(d)), 1996) AS a, least(max(year(d)), 1999) AS z FROM sparse WHERE d BETWEEN DATE '1997-03-01' AND DATE '2000-05-31') SELECT cell, round(avg(v), 4) AS v FROM monthly, y WHERE year(t) BETWEEN a AND z GROUP BY 1")
def p28_observed_climatology(spark, sf_dir):
    obs = sparse(spark, sf_dir).where("d BETWEEN DATE '1997-03-01' AND DATE '2000-05-31'").withColumnRenamed("d", "t")
    return rounded(temporal.observed_climatology(monthly(spark, sf_dir), obs, ["cell"], 1996, 1999), v=4)


@query("WITH x AS (SELECT l_suppkey AS source, l_linenumber AS level, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2) SELECT source, CAST(level AS INTEGER) AS level, round(v, 4) AS v FROM x WHERE source NOT IN (SELECT source FROM x WHERE v > 2600)")
def p29_plausible_members(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("source"), F.col("l_linenumber").alias("level")).agg(F.sum("l_quantity").alias("v"))
    return rounded(spatial.drop_implausible(rows, "source", "v", 2600.0), v=4)


@query(f"WITH {MONTHLY}, {GRID}, c AS (SELECT cell, avg(v) AS v FROM monthly GROUP BY 1), near AS (SELECT d.cell, s.cell AS src, {NEAR} AS km FROM grid d JOIN grid s ON d.cell % 2 = 1 AND s.cell % 2 = 0), best AS (SELECT cell, arg_min(src, km) AS src FROM near WHERE km <= 3000 GROUP BY 1) SELECT cell, round(v, 4) AS v FROM c WHERE cell % 2 = 0 UNION ALL SELECT best.cell, round(v, 4) FROM best JOIN c ON c.cell = src")
def j14_fill_nearest(spark, sf_dir):
    places = grid(spark, sf_dir).select("cell", "lat", "lon")
    points = places.where("cell % 2 = 0").join(temporal.climatology(monthly(spark, sf_dir), ["cell"]), "cell")
    return rounded(regrid.fill_nearest(points.select("cell", "v"), places, points, 3000.0), v=4)


@query("WITH " + MEMBERS + " SELECT family, source AS driver, round(avg(v), 4) AS v FROM members WHERE year(t) BETWEEN 1995 + length(source) % 3 AND 1997 + length(source) % 3 GROUP BY 1, 2")
def j18_driver_window(spark, sf_dir):
    runs = members(spark, sf_dir).select("family", F.col("source").alias("driver"), F.year("t").alias("year"), "v")
    start = F.lit(1995) + F.length("driver") % 3
    windows = runs.select("driver").distinct().select("driver", start.alias("start"), (start + 2).alias("end"))
    return rounded(ensemble.mean_in_driver_window(runs, windows, ["family", "driver"]), v=4)


@query("WITH " + LINES("s_nationkey") + ", " + GRID + ", x AS (SELECT CAST(date_trunc('month', d) AS DATE) AS t, l_linenumber * 10 AS level, sum(l_quantity * area) / sum(area) AS v FROM lines JOIN grid USING (cell) WHERE abs(lat) <= 30 GROUP BY 1, 2) SELECT t, round(v, 4) AS \"index\" FROM (SELECT t, v, row_number() OVER (PARTITION BY t ORDER BY abs(level - 38), level) AS r FROM x) WHERE r = 1")
def a14_equatorial_index(spark, sf_dir):
    rows = lines(spark, sf_dir, "s_nationkey").select("cell", F.trunc("d", "MM").alias("t"), (F.col("l_linenumber") * 10).alias("level"), F.col("l_quantity").alias("v"))
    return rounded(spatial.equatorial_index(spatial.on_grid(rows, grid(spark, sf_dir)), 38.0, 30.0, ["t"]), index=4)


BOXES = "sum(CASE WHEN lat > 0 THEN v * area END) / sum(CASE WHEN lat > 0 THEN area END) - sum(CASE WHEN lat <= 0 THEN v * area END) / sum(CASE WHEN lat <= 0 THEN area END)"


@query(f"WITH {MEMBERS}, {GRID}, a AS (SELECT source, family, cell, t, v - avg(v) OVER (PARTITION BY source, family, cell, month(t)) AS v FROM members) SELECT source, family, t, round({BOXES}, 3) AS \"index\" FROM a JOIN grid USING (cell) GROUP BY 1, 2, 3")
def t10_member_indices(spark, sf_dir):
    anomaly = temporal.deseason(members(spark, sf_dir), ["source", "family", "cell"])
    rows = spatial.on_grid(anomaly, grid(spark, sf_dir))
    return rounded(spatial.box_difference(rows, F.col("lat") > 0, F.col("lat") <= 0, ["source", "family", "t"]), index=3)


@query("SELECT p_partkey FROM (SELECT p_partkey, sum(length(p_name)) OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey ROWS UNBOUNDED PRECEDING) AS used FROM part) WHERE used <= 200")
def o04_detail_budget(spark, sf_dir):
    entries = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice", F.length("p_name").alias("size"))
    return ensemble.within_budget(entries, ["p_brand"], [F.col("p_retailprice").desc(), F.col("p_partkey")], "size", 200).select("p_partkey")


@query("SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def x_tumbling_windows(spark, sf_dir):
    out = spells.tumbling(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return rounded(out, total=4).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT start, event_type, round(avg(value), 4) AS mean FROM (SELECT event_type, value, CAST(time_bucket(INTERVAL 15 MINUTE, ts) - k * INTERVAL 15 MINUTE AS TIMESTAMP) AS start FROM events, range(4) r(k)) GROUP BY 1, 2")
def x_sliding_windows(spark, sf_dir):
    out = spells.sliding(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return rounded(out, mean=4).withColumn("start", F.col("start").cast("timestamp_ntz"))

"""Queries across sources: biases, ensembles, families, envelopes, added value, tests."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import added_value, relative_bias
from ..operators import align, ensemble, spatial, stats, temporal
from .catalog import long, query, rounded
from .panels import CLIM, GRID, MEMBERS, MONTHLY, T_TAILS, grid, members, monthly, source_clim

C = "WITH " + CLIM
SRC = C + ", src AS (SELECT source, cell, avg(v) AS v FROM members GROUP BY 1, 2)"
#: The source that others are held against.
OBS = "1-URGENT"
PAIRS = SRC + ", " + GRID + f", p AS (SELECT s.source, s.cell, s.v, o.v AS ref, s.v - o.v AS bias, lat, area, region FROM src s JOIN src o ON s.cell = o.cell AND o.source = '{OBS}' JOIN grid ON grid.cell = s.cell WHERE s.source <> '{OBS}')"
SEASON = "CASE WHEN month(t) IN (12, 1, 2) THEN 'DJF' WHEN month(t) IN (3, 4, 5) THEN 'MAM' WHEN month(t) IN (6, 7, 8) THEN 'JJA' ELSE 'SON' END"


def by_source(spark, sf_dir):
    return members(spark, sf_dir).groupBy("source", "cell").agg(F.avg("v").alias("v"))


def biases(spark, sf_dir):
    """Each source's climatology against the reference source's, with the grid."""
    clim = by_source(spark, sf_dir)
    reference = clim.where(F.col("source") == OBS).drop("source")
    return align.bias(clim.where(F.col("source") != OBS), reference, ["cell"]).join(grid(spark, sf_dir).select("cell", "lat", "area", "region"), "cell")


@query("WITH " + MEMBERS + ", " + GRID + f", c AS (SELECT source, cell, {SEASON} AS season, avg(v) AS v FROM members WHERE year(t) BETWEEN 1995 AND 2000 GROUP BY 1, 2, 3 UNION ALL SELECT source, cell, 'annual', avg(v) FROM members WHERE year(t) BETWEEN 1995 AND 2000 GROUP BY 1, 2), b AS (SELECT s.source, s.season, s.v - o.v AS bias, area FROM c s JOIN c o ON s.cell = o.cell AND s.season = o.season AND o.source = '{OBS}' JOIN grid ON grid.cell = s.cell WHERE s.source <> '{OBS}') SELECT source, season, round(sum(bias * area) / sum(area), 4) AS mean_bias, round(sqrt(sum(bias * bias * area) / sum(area)), 4) AS rmse FROM b GROUP BY 1, 2")
def j01_bias_rmse(spark, sf_dir):
    """Annual and seasonal climatologies in one pass by grouping sets, biases, weighted statistics."""
    from ..functions.columns import season

    rows = temporal.in_years(members(spark, sf_dir), 1995, 2000).withColumn("season", season(F.month("t")))
    clim = rows.groupingSets([["source", "cell", "season"], ["source", "cell"]], "source", "cell", "season").agg(F.avg("v").alias("v"), F.grouping("season").alias("whole"))
    clim = clim.select("source", "cell", F.when(F.col("whole") == 1, "annual").otherwise(F.col("season")).alias("season"), "v")
    reference = clim.where(F.col("source") == OBS).drop("source")
    field = align.bias(clim.where(F.col("source") != OBS), reference, ["cell", "season"]).join(grid(spark, sf_dir).select("cell", "area"), "cell")
    return rounded(spatial.bias_statistics(field, ["source", "season"]), mean_bias=4, rmse=4)


@query(SRC + " SELECT cell, round(avg(v), 4) AS ens_mean, round(median(v), 4) AS ens_median, count(v) AS members FROM src GROUP BY 1 HAVING count(v) >= 2")
def a15_ensemble_mean_median(spark, sf_dir):
    return rounded(ensemble.mean_median(by_source(spark, sf_dir), ["cell"]), ens_mean=4, ens_median=4)


@query(C + " SELECT family, cell, round(avg(v), 4) AS v FROM clim GROUP BY 1, 2")
def a16_family_mean(spark, sf_dir):
    return rounded(ensemble.family_mean(source_clim(spark, sf_dir), ["cell"]), v=4)


@query("WITH " + MEMBERS + ", k AS (SELECT source, family FROM members GROUP BY 1, 2 HAVING min(year(t)) <= 1995 AND max(year(t)) >= 2001), c AS (SELECT source, family, cell, avg(v) AS v FROM members JOIN k USING (source, family) GROUP BY 1, 2, 3), m AS (SELECT source, cell, avg(v) AS v FROM c GROUP BY 1, 2) SELECT cell, round(avg(v), 4) AS v FROM m GROUP BY 1")
def a17_mmm_full_coverage(spark, sf_dir):
    rows = members(spark, sf_dir).withColumn("member", F.concat_ws("/", "source", "family"))
    whole = rows.join(temporal.coverage(rows, ["member"], 1995, 2001), "member", "left_semi").groupBy("source", "family", "cell").agg(F.avg("v").alias("v"))
    return rounded(whole.groupBy("source", "cell").agg(F.avg("v").alias("v")).groupBy("cell").agg(F.avg("v").alias("v")), v=4)


@query("WITH " + MEMBERS + ", s AS (SELECT source, t, avg(v) AS v FROM members GROUP BY 1, 2) SELECT t, round(min(v), 4) AS v_min, round(max(v), 4) AS v_max FROM s GROUP BY 1 HAVING count(DISTINCT source) >= 2")
def a18_envelope(spark, sf_dir):
    rows = members(spark, sf_dir).groupBy("source", "t").agg(F.avg("v").alias("v"))
    return rounded(ensemble.envelope(rows, ["t"]), v_min=4, v_max=4)


@query("WITH " + MEMBERS + ", x AS (SELECT family AS source, cell, t, avg(v) AS v FROM members GROUP BY 1, 2, 3), n AS (SELECT cell, count(DISTINCT source) AS n FROM x GROUP BY 1), s AS (SELECT cell, t, avg(v) AS v, count(DISTINCT source) AS k FROM x GROUP BY 1, 2) SELECT s.cell, t, round(v, 4) AS v FROM s JOIN n ON s.cell = n.cell AND k = n.n")
def j03_inner_align(spark, sf_dir):
    """The steps that all sources of a cell have, for every cell."""
    rows = members(spark, sf_dir).groupBy(F.col("family").alias("source"), "cell", "t").agg(F.avg("v").alias("v"))
    return rounded(align.common_steps(rows, by=["cell"]), v=4)


@query("WITH " + MEMBERS + ", x AS (SELECT source, cell, t, avg(v) AS v FROM members GROUP BY 1, 2, 3) SELECT cell, t, round(avg(v), 4) AS v, round(min(v), 4) AS v_min, round(max(v), 4) AS v_max, count(v) AS n FROM x GROUP BY 1, 2")
def j04_outer_align(spark, sf_dir):
    """The steps that any source of a cell has, for every cell."""
    rows = members(spark, sf_dir).groupBy("source", "cell", "t").agg(F.avg("v").alias("v"))
    return rounded(align.any_steps(rows, by=["cell"]), v=4, v_min=4, v_max=4)


@query("WITH " + MEMBERS + ", s AS (SELECT source, t, avg(v) AS v FROM members GROUP BY 1, 2) SELECT a.t, round(a.v, 4) AS t2m, round(b.v, 4) AS sw, round(c.v, 4) AS lw, round(b.v + c.v, 4) AS net FROM s a JOIN s b USING (t) JOIN s c USING (t) WHERE a.source = '1-URGENT' AND b.source = '2-HIGH' AND c.source = '3-MEDIUM'")
def j05_three_way_align(spark, sf_dir):
    rows = members(spark, sf_dir).groupBy("source", "t").agg(F.avg("v").alias("v"))
    of = lambda name: rows.where(F.col("source") == name)
    return rounded(align.three_series(of("1-URGENT"), of("2-HIGH"), of("3-MEDIUM")), t2m=4, sw=4, lw=4, net=4)


@query("WITH " + MONTHLY + ", a AS (SELECT cell, t, v, 0 AS k FROM monthly WHERE t <= DATE '1998-12-01' UNION ALL SELECT cell, t, v + 1000000, 1 FROM monthly WHERE t >= DATE '1998-06-01') SELECT cell, t, round(arg_min(v, k), 4) AS v FROM a GROUP BY 1, 2")
def u02_stitch_dedupe(spark, sf_dir):
    field = monthly(spark, sf_dir)
    first = field.where("t <= DATE '1998-12-01'")
    second = field.where("t >= DATE '1998-06-01'").withColumn("v", F.col("v") + 1000000)
    return rounded(temporal.stitch([first, second], ["cell"]), v=4)


@query(C + f", f AS (SELECT c.family, c.cell, c.v - o.v AS b FROM clim c JOIN (SELECT cell, avg(v) AS v FROM members WHERE source = '{OBS}' GROUP BY 1) o USING (cell)) SELECT family, cell, round(avg(b), 4) AS mean_bias, round(stddev_pop(b), 4) AS spread, abs(avg(b)) <= 2 * stddev_pop(b) AS within FROM f GROUP BY 1, 2")
def a43_family_spread(spark, sf_dir):
    reference = members(spark, sf_dir).where(F.col("source") == OBS).groupBy("cell").agg(F.avg("v").alias("v"))
    return rounded(ensemble.family_spread(align.bias(source_clim(spark, sf_dir), reference, ["cell"]), ["cell"]), mean_bias=4, spread=4)


@query(SRC + f", e AS (SELECT cell, min(v) AS lo, max(v) AS hi FROM src WHERE source <> '{OBS}' GROUP BY 1) SELECT cell, round(CASE WHEN v > hi THEN v - hi WHEN v < lo THEN v - lo ELSE 0 END, 4) AS outside FROM src JOIN e USING (cell) WHERE source = '{OBS}'")
def a48_outside_envelope(spark, sf_dir):
    clim = by_source(spark, sf_dir)
    return rounded(ensemble.outside_envelope(clim.where(F.col("source") == OBS), clim.where(F.col("source") != OBS), ["cell"]), outside=4)


@query(SRC + ", " + GRID + ", k AS (SELECT cell FROM src GROUP BY 1 HAVING count(DISTINCT source) = (SELECT count(DISTINCT source) FROM src)), m AS (SELECT source, sum(v * area) / sum(area) AS m FROM src JOIN grid USING (cell) JOIN k USING (cell) GROUP BY 1) SELECT source, cell, round(v - m, 4) AS v FROM src JOIN m USING (source)")
def a49_without_common_mean(spark, sf_dir):
    rows = by_source(spark, sf_dir).join(grid(spark, sf_dir).select("cell", "area"), "cell")
    return rounded(align.without_common_mean(rows).select("source", "cell", "v"), v=4)


AV = PAIRS + ", av AS (SELECT a.source, a.cell, a.area, a.region, CASE WHEN greatest(a.bias * a.bias, b.bias * b.bias) = 0 THEN 0 ELSE (b.bias * b.bias - a.bias * a.bias) / greatest(a.bias * a.bias, b.bias * b.bias) END AS av FROM p a JOIN p b ON a.cell = b.cell AND b.source = '5-LOW' WHERE a.source <> '5-LOW')"


def values(spark, sf_dir):
    b = biases(spark, sf_dir)
    coarse = b.where("source = '5-LOW'").select("cell", F.col("bias").alias("e1"))
    return b.where("source <> '5-LOW'").join(coarse, "cell").withColumn("av", added_value("e1", "bias"))


@query(AV + " SELECT source, cell, round(av, 6) AS av FROM av")
def p20_added_value(spark, sf_dir):
    return rounded(values(spark, sf_dir).select("source", "cell", "av"), av=6)


@query(AV + " SELECT source, round(coalesce(sum(area) FILTER (WHERE av > 0.005), 0) / sum(area), 6) AS better, round(coalesce(sum(area) FILTER (WHERE av < -0.005), 0) / sum(area), 6) AS worse, round(coalesce(sum(area) FILTER (WHERE av BETWEEN -0.005 AND 0.005), 0) / sum(area), 6) AS alike, round(coalesce(sum(area) FILTER (WHERE av > 0), 0) / sum(area), 6) AS positive, round(sum(av * area) / sum(area), 6) AS mean_av FROM av GROUP BY 1")
def a29_av_categories(spark, sf_dir):
    return rounded(ensemble.av_shares(values(spark, sf_dir), ["source"]), better=6, worse=6, alike=6, positive=6, mean_av=6)


@query(AV + ", r AS (SELECT region, source, sum(av * area) / sum(area) AS av FROM av GROUP BY 1, 2) SELECT region, count(*) AS members FROM r WHERE av > 0 GROUP BY 1 HAVING count(*) >= 2")
def a30_keep_set(spark, sf_dir):
    rows = ensemble.av_shares(values(spark, sf_dir), ["region", "source"]).select("region", F.col("source").alias("member"), F.col("mean_av").alias("av"))
    return ensemble.keep_set(rows)


@query(PAIRS + ", s AS (SELECT source, sum(area) AS w, sum(area * v) / sum(area) AS x, sum(area * ref) / sum(area) AS y, sum(area * v * v) / sum(area) AS xx, sum(area * ref * ref) / sum(area) AS yy, sum(area * v * ref) / sum(area) AS xy FROM p GROUP BY 1) SELECT source, round((xy - x * y) / sqrt((xx - x * x) * (yy - y * y)), 6) AS corr, round(sqrt((xx - x * x) / (yy - y * y)), 6) AS std_ratio, round(sqrt(greatest(0, xx - x * x + yy - y * y - 2 * (xy - x * y))), 2) AS crmse FROM s")
def a31_taylor(spark, sf_dir):
    return rounded(spatial.taylor(biases(spark, sf_dir), ["source"], "v", "ref"), corr=6, std_ratio=6, crmse=2)


@query(PAIRS + ", s AS (SELECT source, sum(area) AS sw, sum(area * area) / (sum(area) * sum(area)) AS v2, sum(area * bias) / sum(area) AS m FROM p GROUP BY 1), q AS (SELECT source, sum(area / sw * (bias - m) * (bias - m)) AS ss FROM p JOIN s USING (source) GROUP BY 1) SELECT source, round(m, 4) AS mean_diff, round(m / sqrt(ss / (1 - v2) * v2), 6) AS t, round(1 / v2 - 1, 6) AS df FROM s JOIN q USING (source)")
def t01_weighted_ttest(spark, sf_dir):
    return rounded(stats.paired_t(biases(spark, sf_dir), ["source"], "v", "ref"), mean_diff=4, t=6, df=6)


@query(SRC + ", k AS (SELECT cell FROM src GROUP BY 1 HAVING count(DISTINCT source) = (SELECT count(DISTINCT source) FROM src)), x AS (SELECT * FROM src JOIN k USING (cell)), g AS (SELECT source, count(*) AS n, avg(v) AS m, var_pop(v) AS s FROM x GROUP BY 1), a AS (SELECT sum(n) AS n, count(*) AS k, sum(n * m) / sum(n) AS gm, sum(n * s) AS w FROM g), b AS (SELECT sum(g.n * (m - gm) * (m - gm)) AS b FROM g, a) SELECT round((b / (k - 1)) / (w / (n - k)), 6) AS f, CAST(k - 1 AS BIGINT) AS df1, CAST(n - k AS BIGINT) AS df2 FROM a, b")
def t02_anova_f(spark, sf_dir):
    out = stats.anova(by_source(spark, sf_dir))
    return rounded(out.withColumns({"df1": long("df1"), "df2": long("df2")}), f=6)


@query(PAIRS + ", s AS (SELECT source, sum(area) AS w, sum(area) * sum(area) / sum(area * area) - 1 AS df, sum(area * v) / sum(area) AS mm, sum(area * ref) / sum(area) AS mo FROM p GROUP BY 1), q AS (SELECT source, sum(area * (v - mm) * (v - mm)) AS vm, sum(area * (ref - mo) * (ref - mo)) AS vo, max(df) AS df FROM p JOIN s USING (source) GROUP BY 1) SELECT source, round(vm / vo, 6) AS f, round(df, 6) AS df FROM q")
def t03_variance_ratio(spark, sf_dir):
    return rounded(stats.variance_ratio(biases(spark, sf_dir), ["source"], "v", "ref"), f=6, df=6)


@query(PAIRS + ", s AS (SELECT source, sum(area) AS sw, sum(area * area) / (sum(area) * sum(area)) AS v2, sum(area * bias) / sum(area) AS m FROM p GROUP BY 1), q AS (SELECT source, sum(area / sw * (bias - m) * (bias - m)) AS ss FROM p JOIN s USING (source) GROUP BY 1), x AS (SELECT source, m, m / sqrt(ss / (1 - v2) * v2) AS t, 1 / v2 - 1 AS df FROM s JOIN q USING (source)) SELECT source, round(m, 4) AS mean_diff, round(t, 6) AS t, round(df, 6) AS df, round(" + T_TAILS.format(t="t") + ", 6) AS p FROM x")
def t01_ttest_pvalue(spark, sf_dir):
    out = stats.paired_t(biases(spark, sf_dir), ["source"], "v", "ref")
    return rounded(out.withColumn("p", stats.t_p("t", "df")), mean_diff=4, t=6, df=6, p=6)


@query(PAIRS + " SELECT source, cell, round(CASE WHEN ref > 100000 THEN 100 * bias / ref END, 4) AS percent FROM p")
def p22_relative_bias(spark, sf_dir):
    return rounded(biases(spark, sf_dir).select("source", "cell", relative_bias("bias", "ref", 100000.0).alias("percent")), percent=4)


@query(SRC + " SELECT n.cell, round(coalesce(a.v, b.v), 4) AS v FROM (SELECT DISTINCT cell FROM src) n LEFT JOIN (SELECT cell, v FROM src WHERE source = '1-URGENT' AND cell % 2 = 0) a USING (cell) LEFT JOIN (SELECT cell, v FROM src WHERE source = '2-HIGH') b USING (cell)")
def j21_first_of_both(spark, sf_dir):
    clim = by_source(spark, sf_dir)
    return rounded(align.first_of_both(clim.where("source = '1-URGENT' AND cell % 2 = 0"), clim.where("source = '2-HIGH'"), ["cell"]), v=4)


@query(SRC + ", " + GRID + " SELECT src.source, src.cell, round(v, 4) AS v, round(CASE WHEN src.cell % 4 = 0 THEN 2 * area ELSE area END, 6) AS area FROM src JOIN grid USING (cell)")
def j20_align_area(spark, sf_dir):
    g = grid(spark, sf_dir)
    own = g.where("cell % 4 = 0").select("cell", (F.col("area") * 2).alias("area"))
    rows = by_source(spark, sf_dir).join(g.select("cell", F.col("area").alias("computed")), "cell")
    return rounded(align.with_area(rows, own, "computed").select("source", "cell", "v", "area"), v=4, area=6)


@query("WITH m AS (SELECT o_orderpriority AS model, 'r' || (o_orderkey % 13 + 1) || 'i1p1f' || (o_orderkey % 2 + 1) AS variant FROM orders GROUP BY 1, 2) SELECT model, arg_min(variant, (CASE WHEN variant = 'r5i1p1f1' THEN 0 ELSE 1 END) * 1000000 + CAST(regexp_extract(variant, 'r(\\d+)i', 1) AS INTEGER) * 100 + CAST(regexp_extract(variant, 'f(\\d+)$', 1) AS INTEGER)) AS variant FROM m GROUP BY 1")
def s12_member_selection(spark, sf_dir):
    from .panels import table

    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("model"), F.concat(F.lit("r"), F.col("o_orderkey") % 13 + 1, F.lit("i1p1f"), F.col("o_orderkey") % 2 + 1).alias("variant")).distinct()
    return ensemble.select_member(rows, preferred="r5i1p1f1")


@query("SELECT o_custkey, CAST(year(o_orderdate) AS BIGINT) AS year, max(o_orderkey) AS version, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1, 2")
def u03_newest_version(spark, sf_dir):
    from .panels import table

    rows = table(spark, sf_dir, "orders").select("o_custkey", long(F.year("o_orderdate")).alias("year"), F.col("o_orderkey").alias("version"), "o_totalprice")
    return ensemble.newest_version(rows, ["o_custkey", "year"])

"""Operators on small fields with known results."""
import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from clinograph.functions import columns as C
from clinograph.functions import distributions
from clinograph.operators import align, classify, ensemble, extremes, mhw, provenance, regrid, spatial, stats, temporal
from clinograph.plans import diagnostics


def days_of(spark, series, first=dt.date(2000, 1, 1)):
    rows = [(cell, first + dt.timedelta(i), i, v) for cell, values in series.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "cell long, d date, t_idx int, v double")


def test_calendar_slots(spark):
    rows = spark.createDataFrame([(1, 1), (2, 28), (3, 1), (12, 30)], "m int, d int")
    slots = lambda kind: [r[0] for r in rows.select(C.calendar_slot("m", "d", kind)).collect()]
    assert slots("standard") == [0, 58, 60, 364] and slots("noleap") == [0, 58, 59, 363] and slots("360_day") == [0, 57, 60, 359]
    leap = spark.createDataFrame([(2, 29), (2, 28), (3, 1)], "m int, d int").select(C.day_of_365("m", "d")).collect()
    assert [r[0] for r in leap] == [59, 59, 60]


def test_missing_values_never_reach_an_aggregate(spark):
    rows = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (-9999.0,), (9.97e36,), (None,)], "v double")
    assert [r[0] for r in rows.select(C.missing_to_null("v", -1e3, 1e30)).collect()] == [1.0, None, None, None, None, None]
    w = spark.createDataFrame([(1.0, 1.0), (None, 5.0), (4.0, 2.0)], "v double, w double")
    assert w.agg(C.wavg("v", "w")).first()[0] == 3.0
    assert w.where("v IS NULL").agg(C.wavg("v", "w")).first()[0] is None


@pytest.mark.parametrize("values, want", [([1, 1, 1, 1, 1, 10, 10, 0, 0, 0, 0, 30], 30), ([5, 5, 5, 5, 5, None, 6, 6, 6, 7, 7], 32)])
def test_rolling_sum(spark, values, want):
    rows = days_of(spark, {1: [None if v is None else float(v) for v in values]})
    assert extremes.rolling_sum_max(rows, ["cell"], F.year("d")).first()["rx5day"] == want


def test_rolling_window_reaches_back_over_the_year(spark):
    rows = days_of(spark, {1: [20.0] * 4 + [20.0] + [0.0] * 5}, dt.date(1999, 12, 28))
    got = {r.year: r.rx5day for r in extremes.rolling_sum_max(rows, ["cell"], F.year("d")).collect()}
    assert got == {1999: None, 2000: 100.0}


def test_precipitation_counts_and_valid_days(spark):
    rows = days_of(spark, {1: [0.0, 0.99, 1.0, 9.99, 10.0, 19.9, 20.0, 50.0], 2: [None] * 8}).withColumn("p95", F.lit(10.0)).withColumn("p99", F.lit(None).cast("double"))
    got = {r.cell: r for r in extremes.precip_indices(rows, ["cell"], 8).collect()}
    assert (got[1].r1mm, got[1].r10mm, got[1].r20mm, got[1].r99p) == (6, 4, 2, None)
    assert math.isclose(got[1].r95p, 19.9 + 20 + 50) and got[2].prcptot is None


def test_type_eight_quantile(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=41)
    rows = spark.createDataFrame([([float(v) for v in x] + [None],), ([],)], "x array<double>")
    for p in (0.1, 0.5, 0.9, 0.999):
        got = [r[0] for r in rows.select(extremes.median_unbiased(F.col("x"), p)).collect()]
        assert math.isclose(got[0], np.quantile(x, p, method="median_unbiased"), rel_tol=1e-12) and got[1] is None


def test_marine_heatwave_gap_case(spark):
    hot = [0.0] * 1400
    for first, n in ((100, 6), (108, 6), (118, 3)):
        hot[first : first + n] = [5.0] * n
    rows = days_of(spark, {1: hot}).withColumn("seas", F.lit(1.0)).withColumn("thresh", F.lit(2.0)).withColumn("year", F.year("d"))
    found = mhw.events(rows, ["cell"])
    assert [(r.start, r.end) for r in found.collect()] == [(100, 113)]
    m = mhw.event_metrics(rows, found, ["cell"]).first()
    assert (m.duration, m.intensity_max, m.category) == (14, 4.0, 4)
    assert math.isclose(m.intensity_mean, (12 * 4 - 2) / 14) and math.isclose(m.rate_onset, (4 - 0.5 * (4 - 1)) / 0.5)
    none = mhw.cell_metrics(mhw.event_metrics(rows, found.where("false"), ["cell"]), rows, ["cell"]).first()
    assert (none.frequency, none.category_max, none.duration_mean) == (0.0, 0, None)


def brute_climatology(v, slots, base, half, q):
    out = {}
    for slot in set(slots[base]) - {59}:
        at = np.flatnonzero((slots == slot) & base)
        window = np.concatenate([v[max(0, a - half) : a + half + 1] for a in at])
        out[slot] = (np.nanmean(window), np.nanquantile(window, q))
    return out


def test_slot_climatology_equals_brute_force(spark):
    rng = np.random.default_rng(89)
    first = dt.date(2000, 1, 1)
    dates = [first + dt.timedelta(i) for i in range(1500)]
    v = 15 + 5 * np.sin(2 * np.pi * np.arange(1500) / 365.25) + rng.normal(0, 0.4, 1500)
    v[rng.random(1500) < 0.01] = np.nan
    rows = days_of(spark, {1: [None if np.isnan(x) else float(x) for x in v]}).withColumn("slot", C.calendar_slot(F.month("d"), F.dayofmonth("d"))).withColumn("year", F.year("d"))
    got = {r.slot: r for r in mhw.slot_climatology(rows, ["cell"], (2001, 2003)).collect()}
    before = np.cumsum([0, 31, 29, 31, 30, 31, 30, 31, 31, 30, 31, 30])
    slots = np.array([before[d.month - 1] + d.day - 1 for d in dates])
    want = brute_climatology(v, slots, np.array([2001 <= d.year <= 2003 for d in dates]), 5, 0.9)
    assert len(got) == 366
    for slot, (mean, high) in want.items():
        assert math.isclose(got[slot].seas, mean, rel_tol=1e-9) and math.isclose(got[slot].thresh, high, rel_tol=1e-9)
    assert math.isclose(got[59].seas, (got[58].seas + got[60].seas) / 2)
    smooth = {r.slot: r.seas for r in mhw.smooth_slots(spark.createDataFrame([(1, r.slot, r.seas, r.thresh) for r in got.values()], "cell long, slot int, seas double, thresh double"), ["cell"]).collect()}
    assert math.isclose(smooth[0], np.mean([got[s % 366].seas for s in range(-15, 16)]))


def test_growing_season_clips_runs(spark):
    v = [0.0] * 20 + [10.0] * 100 + [0.0] * 30 + [10.0] * 30 + [0.0] * 185
    rows = days_of(spark, {1: v, 2: [0.0] * 365, 3: [10.0] * 365}).withColumn("year", F.lit(2000))
    got = {r.cell: r.gsl for r in extremes.growing_season(rows, ["cell", "year"], 5.0, 6, 140).collect()}
    assert got == {1: 140 - 20, 2: 0, 3: 365}


def test_spells_and_heatwaves_without_events(spark):
    rows = days_of(spark, {1: [1.0] * 30, 2: [9.0] * 30}).withColumn("year", F.lit(2000)).withColumn("thr", F.lit(5.0))
    got = {r.cell: r for r in extremes.heatwaves(rows, ["cell"], "year", "thr").collect()}
    assert (got[1].hwn, got[1].hwm) == (0, None) and (got[2].hwn, got[2].hwf, got[2].hwa) == (1, 30, 9.0)
    assert {r.cell: r.spell_days for r in extremes.spell_days(rows, ["cell"], F.col("v") > 5).collect()} == {1: 0, 2: 30}


# one cell of each class: monthly temperature, monthly precipitation (cm), latitude
KT_CASES = [([-30] * 12, [3] * 12, 80, "Fi"), ([-10] * 10 + [5, 5], [3] * 12, 75, "Ft"), ([-20] * 9 + [12] * 3, [5] * 12, 60, "Ec"), ([-5] * 9 + [12] * 3, [5] * 12, 60, "Eo"), ([25] * 12, [0] * 12, 20, "BW"), ([25] * 12, [5] * 12, 20, "BS"), ([27] * 12, [20] * 12, 0, "Ar"), ([5] * 6 + [15] * 6, [10] * 12, 50, "Do"), ([-5] * 6 + [15] * 6, [10] * 12, 50, "Dc"), ([12] * 12, [12] * 12, 35, "Cf")]


def test_climate_classes(spark):
    rows = [(k, m + 1, float(t[m]), float(p[m]), float(lat)) for k, (t, p, lat, _) in enumerate(KT_CASES) for m in range(12)]
    rows += [(90, m, 25.0, None, 10.0) for m in range(1, 13)] + [(91, m, None, 5.0, 10.0) for m in range(1, 13)]
    got = {r.cell: r.code for r in classify.climate_class(spark.createDataFrame(rows, "cell long, month int, t_c double, p_cm double, lat double"), ["cell"]).collect()}
    assert [classify.CLASSES[got[k] - 1] for k in range(len(KT_CASES))] == [c for *_, c in KT_CASES]
    assert classify.CLASSES[got[90] - 1] == "BW" and got[91] is None


def test_p_values():
    assert math.isclose(distributions.t_two_sided(np.array([2.228138852]), np.array([10.0]))[0], 0.05, rel_tol=1e-6)
    assert math.isclose(distributions.f_upper(np.array([3.0]), np.array([2.0]), np.array([9.0]))[0], 0.1004, abs_tol=2e-4)
    assert distributions.t_two_sided(np.array([0.0, np.inf]), np.array([5.0, 5.0])).tolist() == [1.0, 0.0]
    assert math.isclose(distributions.f_two_sided(np.array([1.0]), np.array([7.0]), np.array([7.0]))[0], 1.0)


def test_t_test_edges(spark):
    rows = [("same", 1.0, 1.0), ("same", 2.0, 2.0), ("same", 3.0, 3.0), ("up", 2.0, 1.0), ("up", 3.0, 2.0), ("up", 4.0, 3.0), ("few", 1.0, 2.0)]
    got = {r.k: r.t for r in stats.paired_t(spark.createDataFrame(rows, "k string, a double, b double").withColumn("area", F.lit(1.0)), ["k"], "a", "b").collect()}
    assert got == {"same": 0.0, "up": float("inf"), "few": None}


def test_trend_poisons_and_skips(spark):
    rows = [(1, 2000 + i, 2.0 * i) for i in range(5)] + [(2, 2000 + i, None if i == 2 else 2.0 * i) for i in range(5)]
    df = spark.createDataFrame(rows, "cell long, year int, v double")
    assert {r.cell: r.slope for r in temporal.linear_trend(df, ["cell"]).collect()} == {1: 2.0, 2: None}
    assert all(math.isclose(r.slope, 2.0, rel_tol=1e-9) for r in temporal.slope_skipping_missing(df, ["cell"]).collect())


def test_warming_window(spark):
    rows = [(1, y, (y - 1900) * 0.02 if y > 1900 else 0.0) for y in range(1850, 2101)] + [(2, y, 0.5) for y in range(1850, 2101)]
    got = temporal.warming_window(spark.createDataFrame(rows, "cell long, year int, v double"), ["cell"], 2.0, (1850, 1900)).collect()
    assert len(got) == 1 and got[0].start == got[0].centre - 15 and got[0].end == got[0].start + 29 and 1984 <= got[0].start <= 1987


def test_spectrum_finds_the_period():
    x = np.sin(2 * np.pi * np.arange(480) / 24)
    period, power = stats.welch(x)
    assert period[power.argmax()] == 24 and (np.diff(period) < 0).all() and len(stats.welch(x[:5])[0]) == 0


def test_eof_finds_the_dipole(spark):
    rng = np.random.default_rng(42)
    lat = np.arange(-80, 81, 20.0)
    series = np.sin(2 * np.pi * np.arange(60) / 24)
    rows = [(i, t, float(series[t] * np.sin(np.radians(lat[i])) + 0.05 * rng.normal()), float(lat[i])) for i in range(9) for t in range(60)]
    pcs, patterns = stats.eof(spark.createDataFrame(rows, "cell long, t int, v double, lat double"), 2)
    grid = spark.createDataFrame([(i, float(lat[i]), 0.0) for i in range(9)], "cell long, lat double, lon double")
    pcs, patterns = stats.fix_sign(pcs, patterns, grid, 80.0, 0.0)
    first = pcs.where("mode = 1").orderBy("t").toPandas()
    assert first["explained"][0] > 0.9 and math.isclose(first["pc"].std(ddof=0), 1.0, rel_tol=1e-6)
    assert abs(np.corrcoef(first["pc"], series)[0, 1]) > 0.99 and patterns.where("mode = 1 AND cell = 8").first()["pattern"] < 0


def test_nearest_weights_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    place = lambda n: [(int(i), float(np.degrees(np.arcsin(rng.uniform(-1, 1)))), float(rng.uniform(0, 360))) for i in range(n)]
    source, target = place(300), place(150) + [(900, 89.9, 10.0), (901, -89.99, 200.0), (902, 0.0, 359.99)]
    schema = "cell long, lat double, lon double"
    got = {r.dst_cell: r.src_cell for r in regrid.nearest_weights(spark.createDataFrame(source, schema), spark.createDataFrame(target, schema), 800.0).collect()}

    def km(a, b):
        la, lo, lb, lp = map(math.radians, (a[1], a[2], b[1], b[2]))
        return 2 * 6371 * math.asin(min(1, math.sqrt(math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lp - lo) / 2) ** 2)))

    want = {t[0]: min(source, key=lambda s: km(s, t))[0] for t in target if min(km(s, t) for s in source) <= 800}
    assert got == want


def test_conservative_weights_keep_the_area_mean(spark):
    edges = lambda n, a, step: spark.createDataFrame([(i, a + i * step, a + (i + 1) * step) for i in range(n)], "i long, a double, z double")
    weights = regrid.conservative_weights(edges(9, -90.0, 20.0), edges(18, 0.0, 20.0), edges(4, -90.0, 45.0), edges(5, 0.0, 72.0), 18, 5, 20.0).toPandas()
    v = np.random.default_rng(1).normal(size=9 * 18)
    out = (weights.w * v[weights.src_cell]).groupby(weights.dst_cell).sum()
    area = lambda n, step: np.diff(np.sin(np.radians(np.arange(-90, 90.1, step))))
    assert len(out) == 20 and np.allclose(weights.groupby("dst_cell").w.sum(), 1)
    assert math.isclose((out.to_numpy().reshape(4, 5) * area(4, 45)[:, None]).sum() / 5, (v.reshape(9, 18) * area(9, 20)[:, None]).sum() / 18, rel_tol=1e-9)


def test_poles_are_merged(spark):
    rows = [(i, 90.0, 30.0 * i) for i in range(12)] + [(20, 0.0, 0.0), (21, 0.0, 360.0), (22, 0.0, 180.0)]
    got = {r.cell: r.group for r in regrid.merge_points(spark.createDataFrame(rows, "cell long, lat double, lon double")).collect()}
    assert got == {**dict.fromkeys(range(12), 0), 20: 20, 21: 20, 22: 22}


def test_chains_of_points_are_one_group_whatever_their_order(spark):
    rng = np.random.default_rng(9)
    rows = [(5, 0.0, 10.0), (3, 0.0, 10.0 + 5e-5), (2, 0.0, 10.0 - 5e-5), (4, 0.0, 10.0 + 1e-4), (9, 0.0, 11.0)]
    rows += [(100 + k, 50.0, 20.0 + 5e-5 * int(i)) for k, i in enumerate(rng.permutation(40))] + [(200, 50.0, 20.0 + 5e-5 * 41)]
    got = {r.cell: r.group for r in regrid.merge_points(spark.createDataFrame(rows, "cell long, lat double, lon double")).collect()}
    unit = np.array([(math.cos(math.radians(a)) * math.cos(math.radians(b)), math.cos(math.radians(a)) * math.sin(math.radians(b)), math.sin(math.radians(a))) for _, a, b in rows])
    near = np.linalg.norm(unit[:, None] - unit[None], axis=2) <= 1e-6
    for _ in rows:
        near = near @ near
    assert got == {c: min(rows[j][0] for j in np.flatnonzero(near[i])) for i, (c, _, _) in enumerate(rows)} and got[5] == got[4] == 2


def test_gram_leaves_out_what_is_missing_and_refuses_long_records(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(c, t, float(rng.normal()), 1.0 + c % 3) for c in range(600) for t in range(7) if (c + t) % 4 and not (t == 6 and c != 11) and not (c == 11 and t == 0)]
    got = {(r.i, r.j): r.g for r in stats.gram(spark.createDataFrame([*rows, (1, 3, None, 1.0)], "cell long, t int, x double, w double"), weight="w").collect()}
    want = {}
    for c in range(600):
        own = [(t, x * w) for k, t, x, w in rows if k == c]
        for i, a in own:
            for j, b in own:
                if i <= j:
                    want[i, j] = want.get((i, j), 0.0) + a * b
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9, abs_tol=1e-9) for k in want)
    monkeypatch.setattr(stats, "MOST_STEPS", 6)
    with pytest.raises(ValueError):
        stats.gram(spark.createDataFrame(rows, "cell long, t int, x double, w double"))


def test_boxes_and_polygons(spark):
    rows = spark.createDataFrame([(1, 0.0, 350.0), (2, 0.0, 10.0), (3, 0.0, 180.0), (4, 50.0, -5.0)], "cell long, lat double, lon double")
    assert [r.cell for r in rows.where(C.in_box("lat", "lon", -5, 5, 340, 20)).orderBy("cell").collect()] == [1, 2]
    quad = [(-20.0, -10.0), (20.0, -10.0), (20.0, 60.0), (-20.0, 60.0)]
    assert [r.cell for r in spatial.region_cells(rows, {"q": quad}).orderBy("cell").collect()] == [1, 2, 4]


def test_zonal_mean_leaves_the_pole_out(spark):
    rows = spark.createDataFrame([(89.9, 1.0, 2.0), (90.0, 1.0, 50.0), (-90.0, 1.0, 3.0)], "lat double, area double, v double").withColumn("k", F.lit(1))
    got = {r.band: r.v for r in spatial.zonal_mean(rows, ["k"]).collect()}
    assert {float(b): v for b, v in got.items()} == {89.5: 2.0, -89.5: 3.0}
    assert spatial.all_bands(spatial.zonal_mean(rows, ["k"]).withColumn("band", F.col("band").cast("double")), spark, 1.0).count() == 180


def test_full_axis_and_duplicates(spark):
    rows = spark.createDataFrame([(1, dt.date(2000, 1, 1), 5.0), (1, dt.date(2000, 1, 1), 4.0), (2, dt.date(2000, 1, 3), 1.0)], "cell long, d date, v double")
    got = {(r.cell, r.t_idx): r.v for r in align.on_full_axis(rows, ["cell"]).collect()}
    assert got == {(1, 0): 4.0, (1, 1): None, (1, 2): None, (2, 0): None, (2, 1): None, (2, 2): 1.0}


def test_every_cell_is_aligned_by_its_own_sources(spark):
    rows = spark.createDataFrame([("a", 1, 1, 2.0), ("b", 1, 1, 4.0), ("a", 1, 2, 5.0), ("a", 2, 1, 7.0), ("a", 2, 2, 8.0)], "source string, cell long, t int, v double")
    assert {(r.cell, r.t): r.v for r in align.common_steps(rows, by=["cell"]).collect()} == {(1, 1): 3.0, (2, 1): 7.0, (2, 2): 8.0}
    assert {(r.cell, r.t): (r.v_min, r.n) for r in align.any_steps(rows, by=["cell"]).collect()} == {(1, 1): (2.0, 2), (1, 2): (5.0, 1), (2, 1): (7.0, 1), (2, 2): (8.0, 1)}


def test_registered_alignments_cover_all_cells(spark, data_dir):
    from clinograph.plans import catalog, panels

    cells = lambda rows: {r.cell for r in rows.select("cell").distinct().collect()}
    field = panels.members(spark, data_dir)
    whole = field.select("cell", "t", F.col("family").alias("source")).distinct().toPandas()
    families = whole.groupby("cell").source.nunique()
    common = {cell for (cell, _), n in whole.groupby(["cell", "t"]).source.nunique().items() if n == families[cell]}
    assert len(common) > 1 and cells(catalog.QUERIES["j03_inner_align"](spark, data_dir)) == common
    assert cells(catalog.QUERIES["j04_outer_align"](spark, data_dir)) == cells(field)


def test_bootstrap_draws_ten_thousand_times(spark, data_dir):
    from clinograph.plans import catalog, field_queries

    rng = np.random.default_rng(7)
    values = {(k, 1990 + i): float(0.3 * k * i + rng.normal()) for k in (1, 2) for i in range(9 + k)}
    rows = spark.createDataFrame([(k, y, v) for (k, y), v in values.items()] + [(2, 2040, None), (3, 1990, 1.0)], "cell long, year int, v double")
    got = {r.cell: (r.low, r.high) for r in stats.bootstrap_slope(rows, ["cell"]).collect()}
    assert got[3] == (None, None)
    for k in (1, 2):
        n = 9 + k
        draws = spark.range(10_000).select(F.col("id").cast("int").alias("rep"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("place"))
        draws = draws.select("rep", "place", F.pmod(F.xxhash64(F.lit(0), "rep", "place"), F.lit(n)).alias("i")).toPandas().sort_values(["rep", "place"]).i.to_numpy().reshape(-1, n)
        x, y = draws.astype(float), np.array([values[k, 1990 + i] for i in range(n)])[draws]
        dx, dy = x - x.mean(1, keepdims=True), y - y.mean(1, keepdims=True)
        want = np.nanpercentile((dx * dy).sum(1) / (dx * dx).sum(1), [2.5, 97.5])
        assert np.allclose(got[k], want, rtol=1e-9)
    annual = temporal.annual_mean(field_queries.monthly(spark, data_dir), ["cell"])
    table = lambda df: {r.cell: (r.low, r.high) for r in catalog.rounded(df, low=4, high=4).collect()}
    assert table(catalog.QUERIES["w07_bootstrap_ci"](spark, data_dir)) == table(stats.bootstrap_slope(annual, ["cell"], 10_000))


def test_members_and_windows(spark):
    rows = spark.createDataFrame([("A", "r10i1p1f1"), ("A", "r2i1p1f1"), ("B", "r1i1p1f1"), ("B", "r0i1p1f1")], "model string, variant string")
    assert {r.model: r.variant for r in ensemble.select_member(rows).collect()} == {"A": "r2i1p1f1", "B": "r1i1p1f1"}
    windows = spark.createDataFrame([(2000, 2029), (2000, 2029), (1990, 2019)], "start int, end int")
    assert ensemble.modal_window(windows).first()["start"] == 2000


def test_added_value_signs(spark):
    rows = spark.createDataFrame([(2.0, 1.0), (1.0, 2.0), (0.0, 0.0), (None, 1.0)], "a double, b double")
    assert [r[0] for r in rows.select(C.added_value("a", "b")).collect()] == [0.75, -0.75, 0.0, None]


def test_drift(spark):
    frame = lambda rows: spark.createDataFrame(rows, "path string, digest string")
    got = {r.path: r.state for r in provenance.drift(frame([("a", "1"), ("b", "1"), ("c", "1")]), frame([("a", "1"), ("b", "2"), ("d", "1")])).collect()}
    assert got == {"b": "changed", "c": "gone", "d": "new"}


def test_replies_and_secrets(spark):
    rows = spark.createDataFrame([('x ```json\n{"a": [1,],}\n``` y',), ("no braces",)], "x string")
    assert [r[0] for r in rows.select(F.get_json_object(C.json_of_reply("x"), "$.a[0]")).collect()] == ["1", None]
    assert spark.createDataFrame([("api_key=abc token: def",)], "x string").select(C.redact("x")).first()[0] == "api_key=*** token: ***"


def monthly_field(spark, sources, years=range(1990, 2000), cells=6):
    rows = [(s, c, dt.date(y, m, 1), 280.0 + 10 * math.sin(2 * math.pi * m / 12) + 0.1 * (y - 1990) + c + k) for k, s in enumerate(sources) for c in range(cells) for y in years for m in range(1, 13)]
    return spark.createDataFrame(rows, "source string, cell long, t date, v double")


def test_diagnostics_run_on_a_small_world(spark):
    grid = spark.createDataFrame([(c, -75.0 + 30 * c, 60.0 * c, 1.0, (c % 2) * 1.0) for c in range(6)], "cell long, lat double, lon double, area double, land_frac double")
    fields = {"grid": grid, "model": monthly_field(spark, ["m1", "m2"]), "obs": monthly_field(spark, ["o1"]), "coarse": monthly_field(spark, ["g"])}
    settings = diagnostics.Settings(period=(1990, 1999), reference=(1990, 1994), future=(1995, 1999))
    out = diagnostics.run_all(fields, settings)
    assert len(out) >= 31 and out["sea_ice"] == "missing input 'ice'"
    bias = out["global_biases"]
    got = {(r.source, r.season): (r.mean_bias, r.rmse) for r in bias["statistics"].collect()}
    assert math.isclose(got["m2", "annual"][0], 1.0, abs_tol=1e-9) and math.isclose(got["m1", "DJF"][1], 0.0, abs_tol=1e-9) and len(got) == 10
    assert all(math.isclose(r.v, 1.0, rel_tol=1e-9) for r in out["global_trends"]["trend"].collect())
    assert out["seasonal_cycle"]["cycle"].count() == 24 and out["timeseries"]["envelope"].count() == 120
    assert {round(r.change, 9) for r in out["temp_extremes_change"]["annual"].collect()} == {0.5}
    assert out["added_value"]["shares"].count() == 10


def test_teleconnections_give_seven_modes_whole(spark):
    rng = np.random.default_rng(17)
    places = [(lat, lon) for lat in (-75.0, -45.0, 0.0, 45.0, 75.0) for lon in (0.0, 60.0, 100.0, 200.0, 220.0, 300.0)]
    grid = spark.createDataFrame([(c, lat, lon, math.cos(math.radians(lat)), 0.0) for c, (lat, lon) in enumerate(places)], "cell long, lat double, lon double, area double, land_frac double")
    steps = [dt.date(y, m, 1) for y in range(1990, 1995) for m in range(1, 13)]
    waves = {k: rng.normal(size=(2, len(steps))) for k in ("m1", "m2")}
    values = {k: np.array([[3 * w[0, t] * math.sin(math.radians(lat)) + w[1, t] * math.cos(math.radians(lon)) + 0.1 * rng.normal() for t in range(len(steps))] for lat, lon in places]) for k, w in waves.items()}
    rows = [(k, c, steps[t], float(v[c, t])) for k, v in values.items() for c in range(len(places)) for t in range(len(steps))]
    out = diagnostics.run("teleconnections", {"grid": grid, "model": spark.createDataFrame(rows, "source string, cell long, t date, v double")})
    names = ("ENSO", "IOD", "QBO", "NAO", "SAM", "AO", "PDO")
    assert set(out) == {n + part for n in names for part in ("", "_pattern", "_spectrum", "_spread")}

    lat, lon = np.array(places).T
    month = np.array([t.month for t in steps])
    away = lambda x: x - np.stack([x[:, month == m].mean(1) for m in month], axis=1)
    w = np.cos(np.radians(lat))
    boxes = {"NAO": (lat >= 20) & (lat <= 80) & ((lon >= 270) | (lon <= 40)), "SAM": lat <= -20, "AO": lat >= 20, "PDO": (lat >= 20) & (lat <= 70) & (lon >= 120) & (lon <= 260)}
    signs = {"NAO": (65.0, 340.0), "SAM": (-65.0, 0.0), "AO": (90.0, 0.0), "PDO": (45.0, 200.0)}
    assert all(out[n].count() == 2 * len(steps) for n in names)
    for name, inside in boxes.items():
        got, patterns = out[name].toPandas(), out[f"{name}_pattern"].toPandas()
        for k in ("m1", "m2"):
            v = values[k][inside] - ((w @ values[k]) / w.sum() if name == "PDO" else 0)
            x = away(v)
            root = np.sqrt(w[inside])[:, None]
            pc = np.linalg.svd(root * x, full_matrices=False)[2][0] * math.sqrt(len(steps))
            pattern = x @ pc / len(steps)
            a, b = (np.radians(q) for q in signs[name])
            la, lo = np.radians(lat[inside]), np.radians(lon[inside])
            near = np.argmax(np.sin(la) * math.sin(a) + np.cos(la) * math.cos(a) * np.cos(lo - b) - 1e-9 * np.arange(len(la)))
            turn = -1.0 if pattern[near] > 0 else 1.0
            own = got[got.source == k].sort_values("t")
            assert np.allclose(own["index"], turn * pc, atol=1e-6), name
            assert np.allclose(patterns[patterns.source == k].sort_values("cell").pattern, turn * pattern, atol=1e-6)
    enso = out["ENSO"].where("source = 'm2'").orderBy("t").toPandas()["index"].to_numpy(float)
    want = [np.cov(r, enso, bias=True)[0, 1] / enso.std() for r in values["m2"]]
    got = out["ENSO_pattern"].where("source = 'm2'").orderBy("cell").toPandas().pattern
    assert np.allclose(got, want) and len(want) == len(places)
    for n in ("IOD", "PDO"):
        series = out[n].where("source = 'm1'").orderBy("t").toPandas()["index"].to_numpy(float)
        period, power = stats.welch(series)
        spectrum = out[f"{n}_spectrum"].where("source = 'm1'").toPandas().sort_values("period", ascending=False)
        assert np.allclose(spectrum.period, period) and np.allclose(spectrum.power, power)
        spread = {r.month: (r.std, r.peak_month) for r in out[f"{n}_spread"].where("source = 'm1'").collect()}
        std = {m: series[month == m].std() for m in range(1, 13)}
        assert len(spread) == 12 and all(math.isclose(spread[m][0], std[m], rel_tol=1e-9) and spread[m][1] == max(std, key=std.get) for m in std)


def test_plans_push_filters_and_prune_columns(spark, data_dir):
    from clinograph.plans import panels

    plan = temporal.in_years(spark.read.parquet(f"{data_dir}/lineitem.parquet").select("l_suppkey", F.col("l_shipdate").cast("date").alias("t"), "l_quantity"), 1996, 1997).groupBy("l_suppkey").agg(F.avg("l_quantity"))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate)" in plan or "l_shipdate" in plan.split("ReadSchema")[1]
    assert "l_extendedprice" not in plan
    assert "l_tax" not in panels.dense(spark, data_dir)._jdf.queryExecution().executedPlan().toString()

"""Readers, sinks, the command line, and streams."""
import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from clinograph import cli
from clinograph.sources import readers, sinks
from clinograph.streaming import spells


def field(spark, rows):
    return spark.createDataFrame(rows, "cell long, t date, v double")


def test_catalogs_answer_in_order_and_stitch(spark, tmp_path):
    for name, rows in {"hist_a_mon": [(1, dt.date(2000, 1, 1), 1.0), (1, dt.date(2001, 1, 1), 2.0)], "ssp_a_mon": [(1, dt.date(2001, 1, 1), 9.0), (1, dt.date(2002, 1, 1), 3.0)]}.items():
        field(spark, rows).write.parquet(str(tmp_path / name))
    first = readers.Catalog({"hist_a_mon": str(tmp_path / "hist_a_mon")})
    second = readers.Catalog({"hist_a_mon": "nowhere", "ssp_a_mon": str(tmp_path / "ssp_a_mon")})
    both = readers.Catalogs([first, second])
    got = readers.load_period(both, spark, ["hist_a_mon", "ssp_a_mon", "absent"], 2000, 2002).orderBy("t").collect()
    assert [r.v for r in got] == [1.0, 2.0, 3.0]
    with pytest.raises(KeyError):
        both.load(spark, "absent")
    assert readers.Catalog.key("hist", "a", "mon") == "hist_a_mon"


def test_normalise(spark):
    raw = spark.createDataFrame([(1, dt.datetime(2000, 1, 16, 12), 273.15, -10.0), (1, dt.datetime(2000, 2, 15), 1e20, 10.0), (1, dt.datetime(2000, 3, 15), float("nan"), 370.0)], "cell long, t timestamp_ntz, tas double, lon double")
    got = readers.normalise(raw, readers.Variable("tas", "tas", offset=-273.15, fill_above=1e19), "obs", lon="lon").orderBy("t").collect()
    assert [(r.t, r.v, r.lon) for r in got] == [(dt.date(2000, 1, 1), 0.0, 350.0), (dt.date(2000, 2, 1), None, 10.0), (dt.date(2000, 3, 1), None, 10.0)]


def test_derived_days(spark):
    steps = spark.createDataFrame([(1, dt.datetime(2000, 1, 1, 3 * h), 1.0) for h in range(8)] + [(1, dt.datetime(2000, 1, 2, 0), 5.0)], "cell long, ts timestamp_ntz, v double")
    assert [(r.d, r.v) for r in readers.daily_sums(steps, ["cell"]).collect()] == [(dt.date(2000, 1, 1), 8.0)]
    assert readers.daily_extremes(steps, ["cell"]).count() == 2


def test_times(spark):
    rows = spark.createDataFrame([(1, 0, dt.date(2000, 1, 1)), (1, 1, None), (1, 2, dt.date(2000, 1, 3)), (1, 3, None)], "cell long, i int, t date")
    assert [r.t.day for r in readers.repair_times(rows, ["cell"]).orderBy("i").collect()] == [1, 2, 3, 4]
    assert [r[0] for r in spark.createDataFrame([(1850.04,), (1850.96,)], "y double").select(readers.decimal_year("y")).collect()] == [dt.date(1850, 1, 1), dt.date(1850, 12, 1)]


def test_checkpoints_follow_settings(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for settings in ({"a": 1}, {"a": 1}, {"a": 2}):
        assert sinks.checkpointed(spark, str(tmp_path), "x", settings, make).count() == 3
    assert len(made) == 2


def test_field_sink(spark, tmp_path):
    df = spark.createDataFrame([("tas", "m", 1, 1.0), ("pr", "m", 2, 2.0)], "variable string, source string, cell long, v double")
    sinks.write_field(df, str(tmp_path / "f"))
    plan = spark.read.parquet(str(tmp_path / "f")).where("variable = 'tas'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(variable" in plan
    sinks.write_summary(df, str(tmp_path / "s"))
    assert spark.read.option("header", True).csv(str(tmp_path / "s")).count() == 2


def test_command_line(spark, tmp_path):
    grid = spark.createDataFrame([(c, 10.0 * c, 0.0, 1.0, 1.0) for c in range(3)], "cell long, lat double, lon double, area double, land_frac double")
    model = spark.createDataFrame([("m", c, dt.date(2000, m, 1), float(m)) for c in range(3) for m in range(1, 13)], "source string, cell long, t date, v double")
    grid.write.parquet(str(tmp_path / "grid"))
    model.write.parquet(str(tmp_path / "model"))
    (tmp_path / "c.yaml").write_text(json.dumps({"fields": {"grid": str(tmp_path / "grid"), "model": str(tmp_path / "model")}, "output": str(tmp_path / "out"), "settings": {"period": [2000, 2000]}}))
    cli.main(["--config", str(tmp_path / "c.yaml"), "--diagnostics", "seasonal_cycle"])
    assert spark.read.parquet(str(tmp_path / "out" / "seasonal_cycle" / "cycle")).count() == 12


def stream(spark, path, rows, schema):
    for k, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{path}/b{k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def drain(spark, df, name, mode="append"):
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name).collect()


EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double"


def events_of(minutes, user=1):
    return [(m, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m), user, "a", 1.0) for m in minutes]


def test_sessions_close_after_a_pause(spark, tmp_path):
    df = stream(spark, str(tmp_path), [events_of([0, 10, 20]), events_of([100, 110]), events_of([5000])], EVENTS)
    got = drain(spark, spells.sessions(df), "sessions_out")
    assert sorted(r.n for r in got) == [2, 3]


def test_windows_and_late_rows(spark, tmp_path):
    df = stream(spark, str(tmp_path), [events_of([0, 30, 70]), events_of([400]), events_of([10]), events_of([900])], EVENTS)
    got = {r.start: r.n for r in drain(spark, spells.tumbling(df), "tumbling_out")}
    assert got[dt.datetime(2024, 1, 1, 0)] == 2 and got[dt.datetime(2024, 1, 1, 1)] == 1


def test_open_runs_go_on_over_batches(spark, tmp_path):
    schema = "cell long, t_idx long, v double"
    v = [9.0, 9.0, 9.0, 9.0, 0.0, 9.0, 9.0, 0.0]
    df = stream(spark, str(tmp_path), [[(1, i, v[i])] for i in range(8)], schema)
    got = drain(spark, spells.open_runs(df, 5.0, 3), "runs_out")
    assert [(r.start, r.end, r.length) for r in got] == [(0, 3, 4)]


def test_open_runs_wait_for_late_days(spark, tmp_path):
    hot = {1: [0, 1, 2, 4, 5, 6, 7, 11, 12, 13], 2: [3, 4, 5]}
    days = [(c, i, 9.0 if i in hot[c] else None) for c in hot for i in range(20)]
    order = sorted(days, key=lambda d: d[1] + (d[1] * 7 % 3))  # at most two days behind the newest
    batches = [order[k : k + 5] for k in range(0, len(order), 5)]
    df = stream(spark, str(tmp_path), batches, "cell long, t_idx long, v double")
    got = drain(spark, spells.open_runs(df, 5.0, 3, late=4), "late_runs_out")
    assert sorted((r.cell, r.start, r.end, r.length) for r in got) == [(1, 0, 2, 3), (1, 4, 7, 4), (1, 11, 13, 3), (2, 3, 5, 3)]


def test_units_both_ways(spark):
    from clinograph.functions.columns import UNITS, convert

    df = spark.createDataFrame([(3.5,)], "x double")
    for unit, to in UNITS:
        there = df.select(convert("x", unit, to).alias("x"))
        assert there.select(convert("x", to, unit)).first()[0] == pytest.approx(3.5)
    assert df.select(convert("x", "K", "K")).first()[0] == 3.5
    with pytest.raises(ValueError):
        convert("x", "K", "Pa")


def test_nested_results_and_attributes(spark, tmp_path):
    one, two = field(spark, [(1, dt.date(2000, 1, 1), 1.0)]), field(spark, [(2, dt.date(2000, 1, 1), 2.0)])
    paths = sinks.export_nested({"bias": {"DJF mean": one, "note": "text"}, "trend": two}, str(tmp_path / "out"))
    assert [spark.read.parquet(p).first().cell for p in paths] == [1, 2] and paths[0].endswith("/bias/DJF_mean")
    sinks.write_attributes(spark, str(tmp_path / "tas"), {"source": "model", "years": [1995, 2001]})
    assert {r.name: r.value for r in spark.read.json(str(tmp_path / "tas-attributes")).collect()} == {"source": "model", "years": "[1995, 2001]"}


def test_windows_of_a_record_without_gaps_are_not_assumed():
    import numpy as np

    from clinograph.operators.mhw import slots_of_record

    rng = np.random.default_rng(2)
    t = np.sort(rng.choice(2200, 1500, replace=False))
    slot, year, v = t % 366, 2000 + t // 366, np.where(rng.random(1500) < 0.2, np.nan, rng.normal(size=1500))
    slots, mean, quantile = slots_of_record(t, slot, year, v, (2001, 2004), 5, 0.9, 0.5)
    for s, m, q in zip(slots, mean, quantile):
        if s == 59:
            continue
        near = [x for c in t[(slot == s) & (year >= 2001) & (year <= 2004)] for x in v[np.abs(t - c) <= 5] if not np.isnan(x)]
        assert m == pytest.approx(np.mean(near)) and q == pytest.approx(np.quantile(near, 0.9))
    assert 59 in slots and len(slots_of_record(t, slot, year, v * np.nan, (2001, 2004), 5, 0.9, 0.5)[0]) == 0

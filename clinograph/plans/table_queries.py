"""Queries on provenance, verification and text, over the plain tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import in_box, json_of_reply, lon_180_180, safe_name
from ..operators import align, ensemble, provenance
from .catalog import long, query, rounded
from .panels import GRID, SPARSE, grid, sparse, table


@query("SELECT CAST(d.doc_id AS VARCHAR) AS path, CASE WHEN d.doc_id % 10 = 0 THEN 'changed' ELSE 'new' END AS state FROM documents d WHERE doc_id % 10 = 0 OR doc_id % 7 = 0 UNION ALL SELECT CAST(-1 - doc_id AS VARCHAR), 'gone' FROM documents WHERE doc_id % 50 = 0")
def v01_fingerprint_drift(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "doc_id", "text")
    now = provenance.fingerprint(docs, "path", "text")
    was = docs.where("doc_id % 10 = 0 OR doc_id % 7 <> 0").withColumn("text", F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    gone = docs.where("doc_id % 50 = 0").withColumn("path", (-1 - F.col("doc_id")).cast("string"))
    return provenance.drift(provenance.fingerprint(was.unionByName(gone), "path", "text"), now)


@query("SELECT l.doc_id, CASE WHEN d.doc_id % 6 = 0 THEN 'missing' ELSE 'changed' END AS state FROM labels l JOIN documents d USING (doc_id) WHERE doc_id % 6 = 0 OR doc_id % 5 = 0")
def v02_stale_analyses(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    labelled = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id").select("doc_id", F.col("doc_id").alias("figure"), F.when(F.col("doc_id") % 5 == 0, F.lit("old")).otherwise(F.col("digest")).alias("digest"))
    figures = docs.where("doc_id % 6 <> 0").select(F.col("doc_id").alias("figure"), "digest")
    return provenance.stale(labelled, figures).select("doc_id", "state")


@query("SELECT o_orderstatus AS asked, CASE WHEN o_totalprice > 100000 THEN 'F' ELSE 'O' END AS used, count(*) AS n FROM orders WHERE o_orderstatus <> CASE WHEN o_totalprice > 100000 THEN 'F' ELSE 'O' END GROUP BY 1, 2")
def v03_regrid_fallbacks(spark, sf_dir):
    events = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("asked"), F.when(F.col("o_totalprice") > 100000, "F").otherwise("O").alias("used"))
    return provenance.fallbacks(events)


@query("WITH c AS (SELECT event_type AS experiment, user_id, CAST(min(day(ts)) AS BIGINT) AS first_year, CAST(30 - count(DISTINCT day(ts)) AS BIGINT) AS missing FROM events GROUP BY 1, 2) SELECT experiment, user_id, first_year, missing, CAST(1 AS BIGINT) AS declared_start, first_year > 2 AS late FROM c WHERE first_year > 2 OR missing > 0")
def v04_coverage_contradictions(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    seen = events.groupBy(F.col("event_type").alias("experiment"), "user_id").agg(long(F.min(F.dayofmonth("ts"))).alias("first_year"), long(30 - F.count_distinct(F.dayofmonth("ts"))).alias("missing"))
    declared = events.select(F.col("event_type").alias("experiment")).distinct().withColumn("declared_start", long(F.lit(1)))
    return provenance.coverage_contradictions(seen, declared)


@query("SELECT event_type AS commit, count(*) AS runs, count(*) FILTER (WHERE value > 250) AS dirty_runs FROM events GROUP BY 1")
def v05_commits(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("commit"), (F.col("value") > 250).alias("dirty"))
    return provenance.commits(events)


@query("SELECT CAST(event_id AS BIGINT) AS at, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE user_id = 7")
def v06_figure_history(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("at"), F.col("user_id").cast("string").alias("figure"), "props")
    return provenance.figure_history(events, "7").select("at", F.get_json_object(F.get_json_object("event", "$.props"), "$.k").cast("long").alias("k"))


@query("WITH e AS (SELECT source AS benchmark, lang AS variable, quality = 1 AS used, CASE WHEN toxic = 1 THEN 'toxic' ELSE 'quality' END AS reason FROM documents JOIN labels USING (doc_id)) SELECT benchmark, variable, CAST(count(*) FILTER (WHERE used) AS BIGINT) AS n_used, CAST(count(*) FILTER (WHERE NOT used) AS BIGINT) AS n_excluded, coalesce(string_agg(DISTINCT reason, ',' ORDER BY reason) FILTER (WHERE NOT used), '') AS reasons FROM e GROUP BY 1, 2")
def a46_benchmark_usage(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    events = rows.select(F.col("source").alias("benchmark"), F.col("lang").alias("variable"), (F.col("quality") == 1).alias("used"), F.when(F.col("toxic") == 1, "toxic").otherwise("quality").alias("reason"))
    return ensemble.benchmark_usage(events)


@query("WITH " + SPARSE + ", m AS (SELECT cell, CAST(date_trunc('month', d) AS DATE) AS m, count(*) AS n FROM sparse GROUP BY 1, 2) SELECT cell, count(*) AS months, min(m) AS first, max(m) AS last, min(n) AS least, max(n) AS most FROM m GROUP BY 1")
def a45_completeness(spark, sf_dir):
    return provenance.completeness(sparse(spark, sf_dir), ["cell"], "d")


@query("SELECT DISTINCT CASE WHEN regexp_matches(p_name || '-' || p_brand, '^[0-9]') THEN '_' ELSE '' END || regexp_replace(p_name || '-' || p_brand, '[^0-9A-Za-z_]+', '_', 'g') AS name FROM part")
def p26_safe_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select(safe_name(F.concat_ws("-", "p_name", "p_brand")).alias("name")).distinct()


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def p26_json_repair(spark, sf_dir):
    reply = F.concat(F.lit("Here it is:\n```json\n"), F.regexp_replace("props", r"\}$", ",}"), F.lit("\n```\nDone."))
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(json_of_reply(reply), "$.k").cast("long").alias("k"))


@query("WITH " + GRID + " SELECT cell, round(((lon + 180) % 360) - 180, 6) AS lon, (lat BETWEEN -60 AND 45) AND (lon >= 200 OR lon <= 40) AS inside FROM grid")
def p10_box_across_the_date_line(spark, sf_dir):
    g = grid(spark, sf_dir)
    return rounded(g.select("cell", lon_180_180("lon").alias("lon"), in_box("lat", "lon", -60.0, 45.0, -160.0, 40.0).alias("inside")), lon=6)


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.08 AND l_linenumber = 2)")
def u05_absent(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").where("l_discount > 0.08 AND l_linenumber = 2")
    return align.absent(table(spark, sf_dir, "part").select("p_partkey"), lines.select(F.col("l_partkey").alias("p_partkey")), ["p_partkey"])


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def j17_available(spark, sf_dir):
    return align.available(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])

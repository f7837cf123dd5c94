"""The data tables seen as fields, and the same panels as SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.align import on_full_axis


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell = nation of the customer, t = month, v = mean order price."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    rows = orders.join(customer, orders.o_custkey == customer.c_custkey)
    return rows.groupBy(F.col("c_nationkey").cast("long").alias("cell"), F.trunc("o_orderdate", "MM").alias("t")).agg(F.avg("o_totalprice").alias("v"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The monthly field by source (order priority) and family (order status)."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority", "o_orderstatus")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    rows = orders.join(customer, orders.o_custkey == customer.c_custkey)
    return rows.groupBy(F.col("o_orderpriority").alias("source"), F.col("o_orderstatus").alias("family"), F.col("c_nationkey").cast("long").alias("cell"), F.trunc("o_orderdate", "MM").alias("t")).agg(F.avg("o_totalprice").alias("v"))


def source_clim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean order price by source, family and cell over all time."""
    return members(spark, sf_dir).groupBy("source", "family", "cell").agg(F.avg("v").alias("v"))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 cells from the nations: places, areas, land fractions and regions."""
    k = F.col("n_nationkey").cast("double")
    lat = F.lit(-90.0) + 180.0 * (k + 0.5) / 25.0
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("cell"), lat.alias("lat"), F.pmod(k * 14.4, F.lit(360.0)).alias("lon"), F.cos(F.radians(lat)).alias("area"), (F.col("n_nationkey") % 3 / 2.0).alias("land_frac"), F.col("n_regionkey").cast("long").alias("region"))


def sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell = supplier, d = day of shipping, v = quantity; most days are missing."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("cell"), F.to_date("l_shipdate").alias("d")).agg(F.sum("l_quantity").alias("v"))


def lines(spark: SparkSession, sf_dir: str, by: str = "n_regionkey") -> DataFrame:
    """Line items with the region (or nation) of their supplier."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_quantity", "l_linenumber", "l_extendedprice", "l_discount", "l_tax", "l_returnflag")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    rows = rows.join(supplier, rows.l_suppkey == supplier.s_suppkey).join(nation, supplier.s_nationkey == nation.n_nationkey)
    return rows.withColumn("cell", F.col(by).cast("long")).withColumn("d", F.to_date("l_shipdate"))


def dense(spark: SparkSession, sf_dir: str, by: str = "n_regionkey") -> DataFrame:
    return lines(spark, sf_dir, by).groupBy("cell", "d").agg(F.sum("l_quantity").alias("v"))


def days(spark: SparkSession, sf_dir: str, by: str = "n_regionkey") -> DataFrame:
    """The daily field on a complete axis with t_idx."""
    return on_full_axis(dense(spark, sf_dir, by), ["cell"])


MONTHLY = "monthly AS (SELECT CAST(c_nationkey AS BIGINT) AS cell, CAST(date_trunc('month', o_orderdate) AS DATE) AS t, avg(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"
MEMBERS = "members AS (SELECT o_orderpriority AS source, o_orderstatus AS family, CAST(c_nationkey AS BIGINT) AS cell, CAST(date_trunc('month', o_orderdate) AS DATE) AS t, avg(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3, 4)"
CLIM = MEMBERS + ", clim AS (SELECT source, family, cell, avg(v) AS v FROM members GROUP BY 1, 2, 3)"
GRID = "grid AS (SELECT CAST(n_nationkey AS BIGINT) AS cell, -90.0::DOUBLE + 180.0::DOUBLE * (n_nationkey + 0.5::DOUBLE) / 25.0::DOUBLE AS lat, (n_nationkey * 14.4::DOUBLE) % 360.0::DOUBLE AS lon, cos(radians(-90.0::DOUBLE + 180.0::DOUBLE * (n_nationkey + 0.5::DOUBLE) / 25.0::DOUBLE)) AS area, (n_nationkey % 3) / 2.0::DOUBLE AS land_frac, CAST(n_regionkey AS BIGINT) AS region FROM nation)"
SPARSE = "sparse AS (SELECT l_suppkey AS cell, CAST(l_shipdate AS DATE) AS d, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2)"


def LINES(by: str = "n_regionkey") -> str:
    return f"lines AS (SELECT l.*, CAST({by} AS BIGINT) AS cell, CAST(l_shipdate AS DATE) AS d FROM lineitem l JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"


def DENSE(by: str = "n_regionkey") -> str:
    return LINES(by) + ", dense AS (SELECT cell, d, sum(l_quantity) AS v FROM lines GROUP BY 1, 2)"


def DAYS(by: str = "n_regionkey") -> str:
    return DENSE(by) + ", span AS (SELECT min(d) AS a, max(d) AS z FROM dense), axis AS (SELECT cell, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(z AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS d, a FROM (SELECT DISTINCT cell FROM dense), span), days AS (SELECT axis.cell, axis.d, CAST(date_diff('day', a, axis.d) AS INTEGER) AS t_idx, v FROM axis LEFT JOIN dense USING (cell, d))"


#: Both tails of Student's t by Simpson's rule: with t = sqrt(df) tan(a) the density is a power of the cosine.
T_TAILS = "1 - atan(abs({t}) / sqrt(df)) * list_sum([(CASE WHEN k = 0 OR k = 2000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * pow(cos(atan(abs({t}) / sqrt(df)) * k / 2000), df - 1) FOR k IN range(2001)]) / (pi() / 2 * list_sum([(CASE WHEN k = 0 OR k = 2000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * pow(cos(pi() / 2 * k / 2000), df - 1) FOR k IN range(2001)]))"

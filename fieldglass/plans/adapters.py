"""The engine's concepts on the test tables, as DataFrames and, for the oracle, as the same tables in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def places(spark: SparkSession, d: str) -> DataFrame:
    """A nation as a place with coordinates, in a region as its state."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    out = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
    key = F.col("n_nationkey")
    return out.select(F.col("r_name").alias("state"), key.alias("nation"), F.col("n_name").alias("place"), (25 + (key * 7) % 25).cast("double").alias("lat"), (-120 + (key * 13) % 50).cast("double").alias("lon"))


def residents(spark: SparkSession, d: str) -> DataFrame:
    """Customers with their area: a place and a market segment."""
    c = table(spark, d, "customer")
    p = places(spark, d)
    return c.join(F.broadcast(p), c.c_nationkey == p.nation).select("c_custkey", "c_acctbal", "c_mktsegment", "state", "nation", "lat", "lon", F.concat_ws(":", "place", "c_mktsegment").alias("area"))


def area_frame(spark: SparkSession, d: str) -> DataFrame:
    """A row for each area: counts of residents and their orders, and of practices in the place (missing where there are none)."""
    c = residents(spark, d)
    o = table(spark, d, "orders")
    orders = o.join(c.select("c_custkey", "state", "area"), o.o_custkey == c.c_custkey).groupBy("state", "area").agg(
        F.count(F.lit(1)).alias("orders"),
        F.count_if(F.col("o_orderpriority").startswith("1")).alias("urgent"),
        F.count_if(F.col("o_orderdate") < F.lit("1995-01-01").cast("timestamp")).alias("early"),
        F.count_if(F.col("o_orderstatus") == "F").alias("done"),
    )
    supply = table(spark, d, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("practices"))
    base = c.groupBy("state", "area", "nation", "lat", "lon").agg(
        F.count(F.lit(1)).alias("people"), F.count_if(F.expr("c_acctbal < 0")).alias("poor"), F.count_if(F.expr("c_acctbal > 5000")).alias("rich"), F.count_if(F.expr("c_custkey % 3 = 0")).alias("young"), F.count_if(F.expr("c_custkey % 7 = 0")).alias("cared")
    )
    return base.join(F.broadcast(supply), "nation", "left").join(orders, ["state", "area"], "left")


AREA_SQL = """
place AS (SELECT r_name AS state, n_nationkey AS nation, n_name AS place, CAST(25 + (n_nationkey * 7) % 25 AS DOUBLE) AS lat, CAST(-120 + (n_nationkey * 13) % 50 AS DOUBLE) AS lon
  FROM nation JOIN region ON n_regionkey = r_regionkey),
resident AS (SELECT c_custkey, c_acctbal, c_mktsegment, state, nation, lat, lon, place || ':' || c_mktsegment AS area FROM customer JOIN place ON c_nationkey = nation),
supply AS (SELECT s_nationkey AS nation, COUNT(*) AS practices FROM supplier WHERE s_acctbal > 5000 GROUP BY 1),
ordered AS (SELECT state, area, COUNT(*) AS orders, COUNT(*) FILTER (WHERE o_orderpriority LIKE '1%') AS urgent, COUNT(*) FILTER (WHERE o_orderdate < TIMESTAMP '1995-01-01') AS early, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS done
  FROM orders JOIN resident ON o_custkey = c_custkey GROUP BY 1, 2),
base AS (SELECT state, area, nation, lat, lon, COUNT(*) AS people, COUNT(*) FILTER (WHERE c_acctbal < 0) AS poor, COUNT(*) FILTER (WHERE c_acctbal > 5000) AS rich, COUNT(*) FILTER (WHERE c_custkey % 3 = 0) AS young, COUNT(*) FILTER (WHERE c_custkey % 7 = 0) AS cared
  FROM resident GROUP BY 1, 2, 3, 4, 5),
frame AS (SELECT base.*, practices, orders, urgent, early, done FROM base LEFT JOIN supply USING (nation) LEFT JOIN ordered USING (state, area))
"""

#: Metric columns of the indicators from the columns of the area frame: the same text for both engines.
METRICS = {
    "kids": "people * 100.0E0", "kids_0_5": "young * 100.0E0", "kids_3_17": "people * 80.0E0", "kids_6_17": "(people - young) * 100.0E0", "under19": "people * 104.0E0", "growth": "CASE WHEN early > 0 THEN (orders - 2 * early) * 0.1E0 / early END",
    "dis": "cared * 10.0E0", "dis_base": "people * 95.0E0", "dis_u5": "cared * 3.0E0", "cog": "cared * 4.0E0", "medicaid": "poor * 90.0E0", "employer": "rich * 90.0E0", "uninsured": "poor * 10.0E0", "poor_kids": "poor * 60.0E0", "pov_base": "people * 99.0E0",
    "pov_model": "CASE WHEN people > 0 THEN poor * 55.0E0 / people END", "unins_model": "CASE WHEN people > 0 THEN poor * 11.0E0 / people END", "model_base": "people * 100.0E0 + done", "family_income": "40000.0E0 + rich * 900", "income": "42000.0E0 + rich * 700", "income_model": "41000.0E0 + rich * 800",
    "households": "people * 220.0E0", "family_households": "people * 70.0E0", "no_car": "poor * 11.0E0", "internet": "people * 200.0E0 - poor * 20", "lep": "cared * 4.0E0", "minutes": "people * 2300.0E0 + orders", "commuters": "people * 100.0E0", "working_0_5": "young * 60.0E0",
    "sqmi": "300.0E0 + nation * 17", "shortage": "(nation * 3) % 26 * 1.0E0", "bh": "practices * 1.0E0", "therapy": "urgent * 1.0E0", "psychiatry": "practices * 0.5E0", "centers": "practices * 0.25E0", "physicians": "orders * 0.5E0", "daycare": "early * 0.3E0", "hospitals": "practices * 0.2E0",
    "schools_private": "young * 0.4E0", "disability_orgs": "cared * 0.5E0", "dd_homes": "cared * 0.2E0", "sites": "done * 0.4E0", "capacity": "done * 20.0E0", "aba": "practices * 0.7E0 + cared", "map_aba": "cared * 1.1E0", "dev_peds": "practices * 0.1E0", "psychologists": "urgent * 0.2E0",
    "slp": "urgent * 0.4E0", "ot": "urgent * 0.3E0", "pediatrics": "rich * 0.6E0", "map_childcare": "early * 0.35E0", "map_schools": "young * 0.9E0", "map_clinics": "rich * 0.5E0", "map_hospitals": "practices * 0.3E0", "map_therapy": "urgent * 0.6E0",
}

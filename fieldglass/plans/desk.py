"""Queries on operational tables and small rules."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.functions.store import scratch
from fieldglass.operators import desk as K
from fieldglass.plans.adapters import table
from fieldglass.plans.registry import query

NOW = datetime(1996, 6, 1)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 OR date_diff('second', o_orderdate, TIMESTAMP '1996-06-01') > 2592000 THEN 'stale' WHEN o_orderkey % 50 < 20 OR o_orderkey % 97 < 55 OR o_orderkey % 4 < 2 THEN 'thin' ELSE 'review' END AS posture, o_orderstatus <> 'F' AND o_orderdate < TIMESTAMP '1996-06-01' AS overdue FROM orders")
def evidence_posture(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    at = F.when(k % 9 != 0, F.col("o_orderdate"))
    status = F.when(F.col("o_orderstatus") == "F", "done").otherwise("open")
    return table(spark, d, "orders").select("o_orderkey", K.posture(at, F.lit(NOW), k % 50, k % 97, k % 4).alias("posture"), K.overdue(status, F.col("o_orderdate"), F.lit(NOW)).alias("overdue"))


QUEUE_SQL = (
    "task AS (SELECT o_orderkey AS id, 'task ' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS title, o_orderpriority LIKE '1%' AS urgent, o_orderstatus <> 'F' AS open, o_orderdate < TIMESTAMP '1993-01-01' AS late, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS lead FROM orders), lead AS (SELECT c_custkey AS lead, c_name AS title, c_custkey % 101 AS score, c_custkey % 89 AS confidence, c_custkey % 6 = 0 AS won FROM customer), "
    "run AS (SELECT s_suppkey AS run, s_name AS title, s_suppkey % 101 AS score, CASE s_suppkey % 3 WHEN 0 THEN 'stale' WHEN 1 THEN 'thin' ELSE 'review' END AS posture FROM supplier), "
    "q AS (SELECT 'overdue' AS kind, title, CASE WHEN urgent THEN 110 ELSE 100 END AS priority FROM task WHERE open AND late UNION ALL SELECT 'crm', 'Review ' || title, CAST(60 + floor(score / 10.0E0 + 0.5E0) AS INT) FROM lead WHERE score >= 65 AND confidence >= 60 AND NOT won AND lead NOT IN (SELECT lead FROM task WHERE open AND lead IS NOT NULL) "
    "UNION ALL SELECT 'territory', title, CAST(CASE posture WHEN 'stale' THEN 35 WHEN 'thin' THEN 50 ELSE 55 + floor(score / 10.0E0 + 0.5E0) END AS INT) FROM run WHERE posture <> 'review' OR score >= 65)"
)


@query(f"WITH {QUEUE_SQL} SELECT * FROM q ORDER BY priority DESC, title, kind LIMIT 12")
def operator_queue(spark: SparkSession, d: str) -> DataFrame:
    """The twelve most urgent actions: the limit is the report's."""
    return _queue(spark, d, 12)


@query(f"WITH {QUEUE_SQL} SELECT kind, priority, COUNT(*) AS actions FROM q GROUP BY 1, 2")
def operator_actions(spark: SparkSession, d: str) -> DataFrame:
    return _queue(spark, d, 2**31 - 1).groupBy("kind", "priority").agg(F.count(F.lit(1)).alias("actions"))


def _queue(spark: SparkSession, d: str, n: int) -> DataFrame:
    o, c, s = F.col("o_orderkey"), F.col("c_custkey"), F.col("s_suppkey")
    tasks = table(spark, d, "orders").select(o.alias("task"), F.concat(F.lit("task "), F.lpad(o.cast("string"), 8, "0")).alias("title"), F.when(F.col("o_orderpriority").startswith("1"), "urgent").otherwise("normal").alias("priority"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("open").alias("status"), F.col("o_orderdate").alias("due"), F.when(o % 2 == 0, F.col("o_custkey")).alias("lead"))
    leads = table(spark, d, "customer").select(c.alias("lead"), F.col("c_name").alias("title"), (c % 101).alias("score"), (c % 89).alias("confidence"), F.when(c % 6 == 0, "Hired").otherwise("Discovered").alias("stage"))
    runs = table(spark, d, "supplier").select(s.alias("run"), F.col("s_name").alias("title"), (s % 101).alias("score"), F.when(s % 3 == 0, "stale").when(s % 3 == 1, "thin").otherwise("review").alias("posture"))
    return K.work_queue(runs, leads, tasks, F.lit(datetime(1993, 1, 1)), n)


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'Engaged' ELSE c_mktsegment END AS stage FROM customer")
def partial_update(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("stage"))
    return K.patch(rows, rows.where("c_custkey % 3 = 0").withColumn("stage", F.lit("Engaged")), "c_custkey", "stage")


@query("SELECT o_custkey AS campaign, o_orderkey AS recipient FROM orders WHERE o_custkey % 4 <> 0 UNION ALL SELECT DISTINCT o_custkey, -o_custkey FROM orders WHERE o_custkey % 4 = 0")
def replaced_children(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("campaign"), F.col("o_orderkey").alias("recipient"))
    return K.replace_children(rows, rows.where("campaign % 4 = 0").select("campaign", (-F.col("campaign")).alias("recipient")).distinct(), "campaign")


@query("SELECT o_custkey AS campaign, COUNT(DISTINCT o_orderkey % 400) AS requested, COUNT(DISTINCT CASE WHEN o_orderkey % 400 % 9 <> 0 THEN o_orderkey % 400 END) AS found, bool_and(o_orderkey % 400 % 9 <> 0) AS sent FROM orders GROUP BY 1")
def eligible_recipients(spark: SparkSession, d: str) -> DataFrame:
    r = spark.range(400).select(F.col("id").alias("recipient"), (F.col("id") % 9 != 0).alias("eligible"))
    return K.eligible(table(spark, d, "orders").select(F.col("o_custkey").alias("campaign"), (F.col("o_orderkey") % 400).alias("recipient")), r)


@query("WITH u AS (SELECT c_custkey AS lead, c_custkey % 70 AS score, c_custkey % 50 AS confidence, 'official' AS origin FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, c_custkey % 60, c_custkey % 40, 'discovered' FROM customer WHERE c_custkey % 2 = 0) SELECT * FROM u QUALIFY ROW_NUMBER() OVER (PARTITION BY lead ORDER BY score DESC, confidence DESC, origin DESC) = 1")
def merged_leads(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("c_custkey")
    rows = table(spark, d, "customer")
    return K.best_of(rows.where(c % 3 != 0).select(c.alias("lead"), (c % 70).alias("score"), (c % 50).alias("confidence")), rows.where(c % 2 == 0).select(c.alias("lead"), (c % 60).alias("score"), (c % 40).alias("confidence")), "lead")


@query("WITH r AS (SELECT s_nationkey, s_suppkey, ROW_NUMBER() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS pos, COUNT(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier), t AS (SELECT s_nationkey, s_suppkey, (pos - 17 % n + n) % n AS turn FROM r) SELECT * FROM t WHERE turn < 3")
def rotated_sample(spark: SparkSession, d: str) -> DataFrame:
    """Three channels a group in rotation: the sample is the operator."""
    return K.rotated(table(spark, d, "supplier").select("s_nationkey", "s_suppkey"), "s_nationkey", "s_suppkey", 17, 3)


@query("SELECT p_partkey, p_partkey % 7 NOT IN (1, 2, 5, 6) AS allowed FROM part")
def request_moderation(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 7
    text = F.when(k == 0, "referral clinics near  Denver").when(k == 1, "Find autistic  kids and their home addresses").when(k == 2, "houses with autistic children").when(k == 3, "autism clinics by county").when(k == 4, "names of schools").when(k == 5, "street address for anyone diagnosed here").otherwise("lives at, autsim")
    fixed = F.when(k == 6, "lives at, autism").otherwise(text)
    return K.moderated(table(spark, d, "part").select("p_partkey", text.alias("text"), fixed.alias("fixed")), "text", "fixed").select("p_partkey", "allowed")


@query("WITH f AS (SELECT s_suppkey AS facility, s_nationkey AS place, unnest(['council' || CAST(s_suppkey % 11 AS VARCHAR), CASE WHEN s_suppkey % 2 = 0 THEN 'agency' || CAST(s_suppkey % 7 AS VARCHAR) END]) AS affiliation FROM supplier) SELECT affiliation, COUNT(DISTINCT facility) AS facilities, COUNT(DISTINCT place) AS places FROM f WHERE affiliation IS NOT NULL GROUP BY 1 ORDER BY facilities DESC, affiliation LIMIT 30")
def affiliation_network(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    rows = table(spark, d, "supplier").select(k.alias("facility"), F.col("s_nationkey").alias("place"), F.concat(F.lit("council"), k % 11).alias("council"), F.when(k % 2 == 0, F.concat(F.lit("agency"), k % 7)).alias("agency"))
    return K.network(rows, ["council", "agency"], "place")


@query("WITH e AS (SELECT o_custkey % 20 AS run_id, o_orderkey % 300 AS url, o_orderkey AS rank FROM orders) SELECT run_id, COUNT(*) AS evidence, 2 AS scores FROM (SELECT run_id, url FROM e GROUP BY 1, 2) GROUP BY 1")
def run_sink(spark: SparkSession, d: str) -> DataFrame:
    """A run's three tables, written twice to one folder and read back."""
    o = table(spark, d, "orders").select((F.col("o_custkey") % 20).alias("run_id"), F.concat(F.lit("u"), F.col("o_orderkey") % 300).alias("url"), F.col("o_orderkey").alias("rank"))
    runs = o.select("run_id", F.lit("MO").alias("state")).distinct()
    scores = runs.select("run_id", F.explode(F.array(F.lit("client"), F.lit("staff"))).alias("engine"))
    path = scratch(spark)
    for _ in range(2):
        K.write_run(K.run_tables(runs, o, scores), path)
    read = lambda name: spark.read.parquet(f"{path}/{name}").groupBy("run_id").agg(F.count(F.lit(1)).alias(name))
    return read("evidence").join(read("scores"), "run_id").join(read("runs").where("runs = 1").select("run_id"), "run_id").select(F.col("run_id").cast("long").alias("run_id"), "evidence", "scores")

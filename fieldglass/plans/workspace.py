"""Queries on operational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.operators import workspace as W
from fieldglass.plans.adapters import table
from fieldglass.plans.registry import query


@query("SELECT user_id, event_type, ts, event_id, value FROM events QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id) = 1")
def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    return W.latest(table(spark, d, "events").drop("props"), ["user_id", "event_type"], "ts")


@query("SELECT user_id, event_id FROM events QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) <= 30")
def history_bounded(spark: SparkSession, d: str) -> DataFrame:
    return W.bounded(table(spark, d, "events"), "user_id", [F.col("ts").desc(), F.col("event_id")], 30).select("user_id", "event_id")


HALF = "SELECT user_id, event_type AS stage, ts, value FROM events WHERE (event_id % 2 = 0) = {} QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type, value) = 1"


def _half(spark: SparkSession, d: str, even: bool) -> DataFrame:
    rows = table(spark, d, "events").where((F.col("event_id") % 2 == 0) == F.lit(even))
    return W.latest(rows.select("user_id", F.col("event_type").alias("stage"), "ts", "value"), ["user_id"], "ts")


@query(f"WITH l AS ({HALF.format('true')}), r AS ({HALF.format('false')}) SELECT coalesce(l.user_id, r.user_id) AS user_id, CASE WHEN b THEN l.stage ELSE r.stage END AS stage, CASE WHEN b THEN l.ts ELSE r.ts END AS ts, CASE WHEN b THEN l.value ELSE r.value END AS value, b AS backfill FROM (SELECT l, r, l.user_id IS NOT NULL AND (r.user_id IS NULL OR l.ts > r.ts) AS b FROM l FULL JOIN r ON l.user_id = r.user_id)")
def reconcile_lww(spark: SparkSession, d: str) -> DataFrame:
    return W.reconcile(_half(spark, d, True), _half(spark, d, False), "user_id", "ts")


@query(f"WITH o AS ({HALF.format('true')}), n AS ({HALF.format('false')}) SELECT coalesce(o.user_id, n.user_id) AS user_id, coalesce(o.stage, n.stage) AS stage, coalesce(n.ts, o.ts) AS ts, coalesce(n.value, o.value) AS value FROM o FULL JOIN n ON o.user_id = n.user_id")
def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    return W.upsert(_half(spark, d, True), _half(spark, d, False), "user_id", keep=["stage"])


@query("WITH l AS (SELECT c_custkey, unnest([(1, 'c' || CAST(c_custkey AS VARCHAR) || '@a.com'), (2, 'shared' || CAST(c_custkey % 50 AS VARCHAR) || '@b.org')], recursive := false) AS x FROM customer), f AS (SELECT c_custkey, x[1] AS pos, x[2] AS email FROM l), s AS (SELECT 'c' || CAST(c_custkey AS VARCHAR) || '@a.com' AS email FROM customer WHERE c_acctbal < 0 UNION SELECT 'shared7@b.org') SELECT c_custkey, min_by(email, pos) AS email FROM f WHERE email NOT IN (SELECT email FROM s) GROUP BY 1")
def suppression_anti(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    own = F.concat(F.lit("c"), "c_custkey", F.lit("@a.com"))
    leads = c.select("c_custkey", F.array(F.lit("not an address"), own, F.concat(F.lit("Shared"), F.col("c_custkey") % 50, F.lit("@b.org "))).alias("emails"))
    gone = c.where("c_acctbal < 0").select(own.alias("email")).unionByName(c.limit(1).select(F.lit("SHARED7@b.org").alias("email")))
    return W.unsuppressed(leads, gone, "c_custkey")


STAGES = ["signup", "view", "click", "purchase"]
PLACE = f"list_position({STAGES}, event_type)"


@query(f"SELECT user_id % 10 AS team, COUNT(*) AS total, COUNT(*) FILTER (WHERE {PLACE} >= 2) AS ready, COUNT(*) FILTER (WHERE {PLACE} >= 3) AS active, COUNT(*) FILTER (WHERE {PLACE} = 4) AS won, round(AVG(floor((greatest(coalesce({PLACE}, 1), 1) - 1) * 100 / 3.0E0 + 0.5E0)), 4) AS percent FROM events GROUP BY 1")
def funnel_summary(spark: SparkSession, d: str) -> DataFrame:
    leads = table(spark, d, "events").select((F.col("user_id") % 10).alias("team"), F.col("event_type").alias("stage"))
    return W.funnel(leads, STAGES, "team", ready=STAGES[1], active=STAGES[2], won=STAGES[3])


@query("SELECT o_orderkey, ROW_NUMBER() OVER (ORDER BY CAST(substr(o_orderpriority, 1, 1) AS INT), CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END ASC NULLS LAST, o_totalprice DESC, o_orderkey) AS place FROM orders")
def task_order(spark: SparkSession, d: str) -> DataFrame:
    due = F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate"))
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.coalesce(F.substring("o_orderpriority", 1, 1).cast("int"), F.lit(1 << 30)).alias("priority"), due.isNull().alias("undated"), F.coalesce(due, F.to_date(F.lit("9999-12-31"))).alias("due"))
    band = F.coalesce(F.floor(-F.col("o_totalprice") / 1000), F.lit(1 << 62))
    return W.places(o, ["priority", "undated", "due"], band, [F.col("o_totalprice").desc(), F.col("o_orderkey")]).select("o_orderkey", "place")


@query("SELECT kind, title, priority FROM (SELECT 'order' AS kind, CAST(o_orderkey AS VARCHAR) AS title, 90 - CAST(substr(o_orderpriority, 1, 1) AS INT) * 10 AS priority FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'customer', c_name, 60 + CAST(c_custkey % 25 AS INT) FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'supplier', s_name, 75 FROM supplier WHERE s_acctbal < 0) ORDER BY priority DESC, title, kind LIMIT 12")
def work_queue(spark: SparkSession, d: str) -> DataFrame:
    o, c, s = (table(spark, d, x) for x in ("orders", "customer", "supplier"))
    return W.queue(
        [
            o.where("o_orderstatus = 'P'").select(F.lit("order").alias("kind"), F.col("o_orderkey").cast("string").alias("title"), (90 - F.substring("o_orderpriority", 1, 1).cast("int") * 10).alias("priority")),
            c.where("c_acctbal < 0").select(F.lit("customer").alias("kind"), F.col("c_name").alias("title"), (60 + (F.col("c_custkey") % 25).cast("int")).alias("priority")),
            s.where("s_acctbal < 0").select(F.lit("supplier").alias("kind"), F.col("s_name").alias("title"), F.lit(75).alias("priority")),
        ],
        12,
    )


TEMPLATES = [("news", "news in {place}", 1), ("news", "{place} updates", 2), ("news", "latest {place}", 3), ("jobs", "jobs {place}", 1), ("jobs", "news in {place}", 2)]


@query("WITH t AS (SELECT * FROM (VALUES " + ", ".join(f"('{f}', '{t}', {o})" for f, t, o in TEMPLATES) + ") v(family, template, o) QUALIFY ROW_NUMBER() OVER (PARTITION BY family ORDER BY o) <= 2) SELECT DISTINCT n_name AS place, replace(template, '{place}', n_name) AS query FROM nation, t")
def query_expansion(spark: SparkSession, d: str) -> DataFrame:
    templates = spark.createDataFrame(TEMPLATES, "family string, template string, order int")
    places = table(spark, d, "nation").select(F.col("n_name").alias("place"))
    return W.expand_queries(templates, places, 2).select("place", "query")


@query("WITH t AS (SELECT DISTINCT regexp_replace(lower(p_type), ' .*$', '') || CASE WHEN p_size % 3 = 0 THEN 'x' ELSE '' END AS token FROM part), k AS (SELECT DISTINCT regexp_replace(lower(p_type), ' .*$', '') AS word FROM part), n AS (SELECT token, MIN(word) AS near, COUNT(*) AS c FROM t, k WHERE levenshtein(token, word) <= 1 AND length(token) > 3 GROUP BY 1) SELECT token, coalesce(CASE WHEN token = 'smallx' THEN 'tiny' END, CASE WHEN c = 1 THEN near END, token) AS corrected FROM t LEFT JOIN n USING (token)")
def token_correction(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    word = F.regexp_replace(F.lower("p_type"), " .*$", "")
    tokens = p.select(F.concat(word, F.when(F.col("p_size") % 3 == 0, "x").otherwise("")).alias("token")).distinct()
    return W.correct(tokens, p.select(word.alias("word")).distinct(), spark.createDataFrame([("smallx", "tiny")], "token string, word string"))


@query("SELECT s_nationkey, '{' || string_agg('\"' || s_name || '\":' || CAST(round(s_acctbal, 2) AS VARCHAR), ',' ORDER BY s_name) || '}' AS items FROM supplier GROUP BY 1")
def compact_export(spark: SparkSession, d: str) -> DataFrame:
    return W.export(table(spark, d, "supplier"), "s_nationkey", "s_name", "s_acctbal")

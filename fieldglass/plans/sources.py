"""Queries that bring sources together: assembly, integrity, gated zeros, fallbacks, keys and contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.functions.exprs import measured, whole_sum
from fieldglass.operators import cleanse, frames
from fieldglass.plans.adapters import AREA_SQL, area_frame, table
from fieldglass.plans.registry import query


@query(f"WITH {AREA_SQL} SELECT state, area, CAST(people AS DOUBLE) AS people, CAST(CASE WHEN rich > 3 THEN poor END AS DOUBLE) AS poor, CAST(orders AS DOUBLE) AS orders FROM frame")
def frame_assembly(spark: SparkSession, d: str) -> DataFrame:
    """Three sources with some metrics twice; the one of higher priority stands."""
    f = area_frame(spark, d)
    part = lambda metric, value, priority, rows=f: rows.select("state", "area", F.lit(metric).alias("metric"), value.cast("double").alias("value"), F.lit(priority).alias("priority"))
    long = part("people", F.col("people"), 2).unionByName(part("people", F.col("people") * 2, 1)).unionByName(part("poor", F.col("poor"), 1, f.where("rich > 3"))).unionByName(part("orders", F.col("orders"), 1))
    return frames.assemble(long, ["people", "poor", "orders"])


@query(f"WITH {AREA_SQL}, late AS (SELECT state, area, COUNT(*) AS n FROM resident WHERE c_acctbal > 9000 GROUP BY 1, 2) SELECT state, area, metric, CASE WHEN metric = 'wealthy' THEN coalesce(n, 0) END AS value FROM base CROSS JOIN (SELECT unnest(['wealthy', 'absent']) AS metric) LEFT JOIN late USING (state, area)")
def gated_zero_fill(spark: SparkSession, d: str) -> DataFrame:
    from fieldglass.plans.adapters import residents

    c = residents(spark, d)
    counts = c.where("c_acctbal > 9000").groupBy("state", "area").agg(F.count(F.lit(1)).alias("value")).withColumn("metric", F.lit("wealthy"))
    status = spark.createDataFrame([("wealthy", True), ("absent", False)], "metric string, complete boolean")
    return frames.gated_zero_fill(c.select("state", "area").distinct(), counts, status)


@query(
    f"WITH {AREA_SQL}, a AS (SELECT state, area, CASE WHEN NOT coalesce(rich > young * 2, false) THEN rich END AS rich, CASE WHEN NOT coalesce(rich > young * 2, false) THEN young * 2 END AS young2, cared * 3 AS cared3, coalesce(rich > young * 2, false) AS b1 FROM frame) "
    "SELECT state, area, rich, CASE WHEN NOT coalesce(cared3 > young2, false) THEN young2 END AS young2, CASE WHEN NOT coalesce(cared3 > young2, false) THEN cared3 END AS cared3, concat_ws('; ', CASE WHEN b1 THEN 'rich > young2' END, CASE WHEN coalesce(cared3 > young2, false) THEN 'cared3 > young2' END) AS issues FROM a"
)
def part_of_whole_integrity(spark: SparkSession, d: str) -> DataFrame:
    f = area_frame(spark, d).select("state", "area", "rich", (F.col("young") * 2).alias("young2"), (F.col("cared") * 3).alias("cared3"))
    return cleanse.part_of_whole(f, [("rich", "young2"), ("cared3", "young2")]).withColumn("issues", F.array_join("issues", "; "))


@query(f"WITH {AREA_SQL}, t AS (SELECT state, area, poor, rich, poor + rich AS total, people, coalesce(people >= 10 AND NOT ((poor + rich) * 1.0E0 / CASE WHEN people > 0 THEN people END BETWEEN 0.4 AND 0.7), false) AS total_off FROM frame) SELECT state, area, CASE WHEN NOT total_off THEN poor END AS poor, CASE WHEN NOT total_off THEN total END AS total, total_off FROM t")
def universe_ratio_integrity(spark: SparkSession, d: str) -> DataFrame:
    f = area_frame(spark, d).select("state", "area", "poor", (F.col("poor") + F.col("rich")).alias("total"), "people")
    return cleanse.universe_ratio(f, ["poor", "total"], "total", "people", 0.4, 0.7, 10).select("state", "area", "poor", "total", "total_off")


@query("SELECT l_suppkey AS supplier, CASE WHEN COUNT(*) = COUNT(CASE WHEN l_discount < 0.1 THEN l_quantity END) THEN round(SUM(CASE WHEN l_discount < 0.1 THEN l_quantity END), 2) END AS whole, round(SUM(CASE WHEN l_discount < 0.1 THEN l_quantity END), 2) AS loose, MAX(l_tax) AS most FROM lineitem GROUP BY 1")
def strict_and_loose_sums(spark: SparkSession, d: str) -> DataFrame:
    known = F.when(F.col("l_discount") < 0.1, F.col("l_quantity"))
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("supplier")).agg(F.round(whole_sum(known), 2).alias("whole"), F.round(F.sum(known), 2).alias("loose"), F.max("l_tax").alias("most"))


@query("SELECT k, year, value FROM (SELECT o_custkey AS k, CAST(year(o_orderdate) AS INT) AS year, MAX(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS value FROM orders GROUP BY 1, 2) WHERE value IS NOT NULL QUALIFY ROW_NUMBER() OVER (PARTITION BY k ORDER BY year DESC) = 1")
def vintage_fallback(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    rows = o.groupBy(F.col("o_custkey").alias("k"), F.year("o_orderdate").alias("year")).agg(F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).alias("value"))
    return frames.newest_complete(rows, ["k"], "year", "value")


@query("WITH p AS (SELECT o_custkey AS k, MAX(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'O' GROUP BY 1), m AS (SELECT o_custkey AS k, MAX(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) SELECT k, coalesce(p.v, m.v) AS v, CASE WHEN p.v IS NOT NULL THEN 'primary' WHEN m.v IS NOT NULL THEN 'mirror' END AS origin FROM p FULL JOIN m USING (k)")
def preferred_source(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    part = lambda s: o.where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("v"))
    return frames.prefer(part("O"), part("P"), "k", "v")


@query(
    "WITH e AS (SELECT user_id AS k, MAX(value) FILTER (WHERE event_type = 'purchase') AS v FROM events GROUP BY 1), s AS (SELECT user_id AS k, MAX(ts) AS taken_at, max_by(value, ts) AS old FROM events WHERE event_type = 'view' GROUP BY 1), n AS (SELECT MAX(ts) AS t FROM events) "
    "SELECT k, coalesce(v, CASE WHEN taken_at >= t - INTERVAL 7 DAY THEN old END) AS v, v IS NULL AND coalesce(CASE WHEN taken_at >= t - INTERVAL 7 DAY THEN old END IS NOT NULL, false) AS from_cache FROM e LEFT JOIN s USING (k) CROSS JOIN n"
)
def last_good_fallback(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    now = e.agg(F.max("ts").alias("t")).first()["t"]
    current = e.groupBy(F.col("user_id").alias("k")).agg(F.max(F.when(F.col("event_type") == "purchase", F.col("value"))).alias("v"))
    snapshot = e.where("event_type = 'view'").groupBy(F.col("user_id").alias("k")).agg(F.max("ts").alias("taken_at"), F.max_by("value", "ts").alias("v"))
    return frames.last_good(current, snapshot, "k", "v", F.lit(now))


@query("SELECT c_nationkey, n, n >= 40 AS lower_bound FROM (SELECT c_nationkey, COUNT(DISTINCT c_custkey) AS n FROM customer GROUP BY 1)")
def paged_union_lower_bound(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    return frames.paged_union([c.where("c_custkey % 3 <> 0"), c.where("c_custkey % 2 = 0"), c.where("c_custkey % 3 = 0")], "c_custkey", "c_nationkey", 40)


@query("SELECT p_partkey, CASE WHEN try_cast(regexp_extract(p_name, '([0-9]+)', 1) AS DOUBLE) >= 0 THEN try_cast(regexp_extract(p_name, '([0-9]+)', 1) AS DOUBLE) END AS in_name, CASE WHEN p_size * 1.0E0 - 10 >= 0 THEN p_size * 1.0E0 - 10 END AS size FROM part")
def sentinel_cleansing(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", F.regexp_extract("p_name", "([0-9]+)", 1).alias("digits"), (F.col("p_size") * 1.0 - 10).alias("size"))
    return p.select("p_partkey", measured("digits").alias("in_name"), measured(F.col("size")).alias("size"))


LACKING = "list_filter(fragments, lambda f : NOT contains(lower(label), lower(f)))"


@query(f"SELECT variable, label, array_to_string({LACKING}, ',') AS lacking FROM (SELECT p_brand AS variable, MIN(p_type) AS label, ['STANDARD', 'steel'] AS fragments FROM part GROUP BY 1) WHERE len({LACKING}) > 0")
def label_contract(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "part").groupBy(F.col("p_brand").alias("variable")).agg(F.min("p_type").alias("label"))
    expected = labels.select("variable", F.array(F.lit("STANDARD"), F.lit("steel")).alias("fragments"))
    return cleanse.label_contract(labels, expected).withColumn("lacking", F.array_join("lacking", ","))


KEY_SQL = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(name), ',.*$', ''), '\\b(saint|sainte|ste)\\b\\.?', 'st', 'g'), '\\b(county|parish)\\b', '', 'g'), '[^a-z]', '', 'g')"


@query(f"SELECT n_nationkey, {KEY_SQL} AS key FROM (SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name || ' County' ELSE 'Saint ' || n_name END AS name FROM nation)")
def area_name_key(spark: SparkSession, d: str) -> DataFrame:
    from fieldglass.functions.text import area_key

    n = table(spark, d, "nation")
    name = F.when(F.col("n_nationkey") % 2 == 0, F.concat("n_name", F.lit(" County"))).otherwise(F.concat(F.lit("Saint "), "n_name"))
    return n.select("n_nationkey", area_key(name).alias("key"))


@query(f"WITH {AREA_SQL}, e AS (SELECT state, area, {', '.join(f'CASE WHEN {c} IS NOT NULL THEN least(100.0E0, floor(ln(1 + {c}) / ln(1 + {k}.0E0) * 100 + 0.5E0)) END AS {c}_score' for c, k in (('orders', 400), ('practices', 5), ('cared', 9)))} FROM frame) SELECT * FROM e")
def log_scaled_observations(spark: SparkSession, d: str) -> DataFrame:
    from fieldglass.functions.exprs import log_score

    return area_frame(spark, d).select("state", "area", *(log_score(c, k).alias(f"{c}_score") for c, k in (("orders", 400), ("practices", 5), ("cared", 9))))


@query("SELECT p_brand, CAST(SUM(CASE WHEN p_size BETWEEN 3 AND 5 THEN 1 ELSE 0 END) AS BIGINT) AS ages_3_5, CAST(SUM(CASE WHEN p_size BETWEEN 6 AND 11 THEN 1 ELSE 0 END) AS BIGINT) AS ages_6_11, CAST(SUM(CASE WHEN p_size BETWEEN 12 AND 17 THEN 1 ELSE 0 END) AS BIGINT) AS ages_12_17, COUNT(DISTINCT p_size) AS cells FROM part GROUP BY 1")
def age_band_sums(spark: SparkSession, d: str) -> DataFrame:
    bands = {"ages_3_5": (3, 5), "ages_6_11": (6, 11), "ages_12_17": (12, 17)}
    return table(spark, d, "part").groupBy("p_brand").agg(*(F.sum(F.when(F.col("p_size").between(*b), 1).otherwise(0)).alias(k) for k, b in bands.items()), F.countDistinct("p_size").alias("cells"))

"""Queries on boards, rosters, routes and listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.operators import listings as L
from fieldglass.plans.adapters import table
from fieldglass.plans.registry import query

POINT_SQL = "p AS (SELECT c_custkey, c_custkey % 120 - 59.75E0 AS lat, c_custkey * 7 % 340 - 169.5E0 AS lon FROM customer)"


def _points(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, d, "customer").select("c_custkey", (k % 120 - 59.75).alias("lat"), (k * 7 % 340 - 169.5).alias("lon"))


@query(f"WITH {POINT_SQL}, b AS (SELECT *, 10 / 69.0E0 AS up, 10 / (69.172E0 * greatest(0.2E0, cos(radians(lat)))) AS side FROM p) SELECT c_custkey, round(lon - side, 6) AS west, round(lat - up, 6) AS south, round(lon + side, 6) AS east, round(lat + up, 6) AS north FROM b")
def bounds_box(spark: SparkSession, d: str) -> DataFrame:
    box = _points(spark, d).withColumn("b", L.bounds("lat", "lon", 10))
    return box.select("c_custkey", *(F.round(f"b.{c}", 6).alias(c) for c in ("west", "south", "east", "north")))


@query(f"WITH {POINT_SQL}, a AS (SELECT *, unnest(range(73)) AS i FROM p) SELECT c_custkey, CAST(i AS INT) AS i, round(lon + 5 / (69.172E0 * cos(radians(lat))) * cos(i / 72.0E0 * 2 * pi()), 5) AS lon, round(lat + 5 / 69.0E0 * sin(i / 72.0E0 * 2 * pi()), 5) AS lat FROM a")
def circle_rims(spark: SparkSession, d: str) -> DataFrame:
    rim = _points(spark, d).select("c_custkey", F.posexplode(L.circle("lat", "lon", 5)).alias("i", "at"))
    return rim.select("c_custkey", "i", F.round("at.lon", 5).alias("lon"), F.round("at.lat", 5).alias("lat"))


@query("SELECT c_custkey FROM customer WHERE contains(lower(concat_ws(' ', c_name, c_mktsegment, 'nation ' || c_nationkey || ' open')), 'furniture nation 1')")
def board_text_search(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").withColumn("signals", F.array(F.concat(F.lit("nation "), F.col("c_nationkey").cast("string")), F.lit("open")))
    return L.board_search(rows, ["c_name", "c_mktsegment", "signals"], "  Furniture NATION 1 ").select("c_custkey")


@query("SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 50 < 12 OR o_orderkey % 37 < 12 THEN 0 ELSE o_orderkey % 101 END AS BIGINT) AS score, CASE WHEN o_orderkey % 50 < 12 OR o_orderkey % 37 < 12 THEN 'Insufficient Evidence' ELSE o_orderpriority END AS label FROM orders")
def stored_run_floor(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    score, label = L.evidence_floor(k % 50, k % 37, k % 101, "o_orderpriority")
    return table(spark, d, "orders").select("o_orderkey", score.cast("long").alias("score"), label.alias("label"))


@query("WITH p AS (SELECT p_partkey, lower(split_part(p_name, ' ', 1)) || ' county program' AS program FROM part) SELECT 'state' AS request, p_partkey FROM p UNION ALL SELECT 'county', p_partkey FROM p WHERE contains(program, 'cold county')")
def roster_by_county(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", F.initcap(F.concat(F.split("p_name", " ")[0], F.lit(" county program"))).alias("program"))
    asked = [("state", " KS "), ("county", "Cold County, KS."), ("town", "Topeka")]
    parts = [L.roster_for(p, "program", place).select(F.lit(name).alias("request"), "p_partkey") for name, place in asked]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT o_custkey, COUNT(*) AS listings, bool_or(o_orderkey % 23 = 0) AS snapshot, CASE WHEN NOT bool_or(o_orderkey % 23 = 0) AND o_custkey % 10 > 0 THEN COUNT(*) / CAST(o_custkey % 10 * 1000 AS DOUBLE) * 10000 END AS density, CASE WHEN NOT bool_or(o_orderkey % 23 = 0) THEN CASE WHEN o_custkey % 10 > 0 THEN CAST(least(100, floor(COUNT(*) / CAST(o_custkey % 10 * 1000 AS DOUBLE) * 10000 / 20.0E0 * 100 + 0.5E0)) AS BIGINT) ELSE 0 END END AS score FROM orders GROUP BY 1")
def snapshot_not_scored(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_custkey", (F.col("o_orderkey") % 23 == 0).alias("archived"), (F.col("o_custkey") % 10 * 1000).alias("people"))
    return L.listing_density(rows, ["o_custkey"], "archived", "people").drop("people")


@query("SELECT o_orderkey, CASE o_custkey % 4 WHEN 0 THEN 'missouriChildCare' WHEN 1 THEN 'kansasEarlyIntervention' ELSE 'coloradoChildCare' END AS roster FROM orders WHERE o_custkey % 4 < 3 AND o_orderkey % 2 = 0")
def source_routing(spark: SparkSession, d: str) -> DataFrame:
    state = F.element_at(F.array(*(F.lit(s) for s in ("MO", "KS", "CO", "NE"))), (F.col("o_custkey") % 4 + 1).cast("int"))
    rows = table(spark, d, "orders").select("o_orderkey", state.alias("state"), F.when(F.col("o_orderkey") % 2 == 0, "client").otherwise("talent").alias("engine"))
    return L.routed(rows, spark).select("o_orderkey", "roster")


@query("SELECT user_id, COUNT(DISTINCT CASE WHEN event_id % 4 <> 0 AND event_type IN ('click', 'error') AND event_id % 7 > 0 THEN event_id % 7 END) AS publishers, CASE WHEN COUNT(DISTINCT CASE WHEN event_id % 4 <> 0 AND event_type IN ('click', 'error') AND event_id % 7 > 0 THEN event_id % 7 END) >= 2 THEN 'documented_public_capacity_signal' ELSE 'unverified' END AS status FROM events GROUP BY 1")
def capacity_demand_status(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    kind = F.when(F.col("event_type") == "click", "service-capacity.x").when(F.col("event_type") == "error", "school-service-access.y").otherwise("review.service-capacity.z")
    publishers = F.array(F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("p"), (k % 7).cast("string"))))
    return L.demand_status(table(spark, d, "events").select("user_id", kind.alias("indicator"), (k % 4 != 0).alias("corroborated"), publishers.alias("publishers")), ["user_id"])


NAME_SQL = "trim(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', ' ', 'g'))"


@query(
    f"WITH n AS (SELECT p_partkey, p_partkey % 5 AS k, {NAME_SQL} AS n FROM part), t AS (SELECT *, CASE k WHEN 0 THEN n WHEN 1 THEN 'about ' || n || ' today' WHEN 2 THEN array_to_string(list_reverse(string_split(n, ' ')), ' ') WHEN 3 THEN split_part(n, ' ', 1) ELSE '' END AS t FROM n), "
    "w AS (SELECT *, list_filter(string_split(n, ' '), lambda x: length(x) > 2) AS w FROM t) "
    "SELECT p_partkey, len(w) > 0 AND length(n) >= 8 AND (contains(t, n) OR (len(w) >= 2 AND list_has_all(string_split(t, ' '), w))) AS belongs, length(n) >= 10 AND contains(n, ' ') AND contains(t, n) AS mentioned FROM w"
)
def review_matches(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat_ws(" ", "p_name", "p_brand")
    k, plain = F.col("p_partkey") % 5, L.plain_name("name")
    turned = F.array_join(F.reverse(F.split(plain, " ")), " ")
    title = F.when(k == 0, F.concat("name", F.lit(" | Reviews 2024"))).when(k == 1, F.concat(F.lit("About: "), "name", F.lit(", today"))).when(k == 2, turned).when(k == 3, F.split(plain, " ")[0])
    rows = table(spark, d, "part").select("p_partkey", name.alias("name")).withColumn("title", title)
    return rows.select("p_partkey", L.review_belongs("title", "name").alias("belongs"), L.mentions("name", "title").alias("mentioned"))


@query(f"WITH n AS (SELECT p_type, {NAME_SQL} AS plain, MIN(p_partkey) AS p_partkey FROM part GROUP BY 1, 2 HAVING length(plain) >= 10 AND contains(plain, ' ')) SELECT p_type, plain, p_partkey, CAST(row_number() OVER (PARTITION BY p_type ORDER BY p_partkey, plain) AS INT) AS place FROM n QUALIFY place <= 3")
def first_named_candidates(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_type", "p_partkey", F.concat_ws(" ", "p_name", "p_brand").alias("name"))
    return L.first_named(rows, ["p_type"], "name", "p_partkey")

"""Queries that match names and places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.operators import matching as M
from fieldglass.plans.adapters import table
from fieldglass.plans.areas import miles_sql
from fieldglass.plans.registry import query

NAMES = ("Bright Star Learning Center", "Bright Star Daycare", "Little Oak Academy", "The School", "Little Oak Star")
PLACE_SQL = (
    "place AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'daycare' ELSE 'clinic' END AS kind, CASE o_orderkey % 5 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(NAMES)) + " END AS name, 30 + (o_custkey % 100) * 0.2E0 + (o_orderkey % 7) * 0.001E0 AS lat, -90 + (o_custkey // 100) * 0.2E0 AS lon, o_orderkey % 11 = 0 AS approximate, o_orderkey % 3 = 0 AS licensed FROM orders), "
    f"word AS (SELECT *, lower(name) AS low, list_distinct(list_filter(string_split(lower(name), ' '), lambda w : length(w) > 2 AND w NOT IN {M.PLACE_WORDS})) AS ws FROM place)"
)
FAR = miles_sql("x.lat", "x.lon", "y.lat", "y.lon")
PAIR_SQL = f"{PLACE_SQL}, pair AS (SELECT x.id AS a, y.id AS b FROM word x JOIN word y ON x.kind = y.kind AND x.id < y.id AND abs(x.lat - y.lat) < 0.03 AND abs(x.lon - y.lon) < 0.05 WHERE {FAR} <= CASE WHEN x.approximate OR y.approximate THEN 1.5E0 ELSE 0.25E0 END AND CASE WHEN least(len(x.ws), len(y.ws)) = 0 THEN x.low = y.low ELSE len(list_intersect(x.ws, y.ws)) >= 0.5 * least(len(x.ws), len(y.ws)) END)"


def places(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    name = F.get(F.array(*map(F.lit, NAMES)), (k % 5).cast("int"))
    return table(spark, d, "orders").select(
        k.alias("id"), F.when(k % 2 == 0, "daycare").otherwise("clinic").alias("kind"), name.alias("name"), (30 + (c % 100) * 0.2 + (k % 7) * 0.001).alias("lat"), (-90 + F.floor(c / 100) * 0.2).alias("lon"), (k % 11 == 0).alias("approximate"), (k % 3 == 0).alias("licensed"),
        F.array(F.when(k % 3 == 0, "roster").otherwise("map")).alias("sources"), F.when(k % 4 == 0, F.concat(F.lit("w"), k)).alias("website"), F.when(k % 6 == 0, F.concat(F.lit("p"), k)).alias("phone"), F.when(k % 5 == 0, k % 60).alias("capacity"),
    )


@query(f"WITH {PAIR_SQL} SELECT a, b FROM pair")
def same_place_pairs(spark: SparkSession, d: str) -> DataFrame:
    return M.same_places(places(spark, d))


def _pass_sql() -> str:
    """A pass in order over the places of each customer and kind (others are too far): the kept ones so far are a list that each place is compared with."""
    far = miles_sql("m.lat", "m.lon", "y.lat", "y.lon")
    same = f"{far} <= CASE WHEN m.rough OR y.approximate THEN 1.5E0 ELSE 0.25E0 END AND CASE WHEN least(len(m.ws), len(y.ws)) = 0 THEN m.low = y.low ELSE len(list_intersect(m.ws, y.ws)) >= 0.5 * least(len(m.ws), len(y.ws)) END"
    new = "{'id': y.id, 'low': y.low, 'ws': y.ws, 'lat': y.lat, 'lon': y.lon, 'rough': y.approximate}"
    moved = "CASE WHEN i = hit THEN {'id': m.id, 'low': m.low, 'ws': m.ws, 'lat': y.lat, 'lon': y.lon, 'rough': false} ELSE m END"
    return (
        "seq AS (SELECT word.*, o_custkey AS c, ROW_NUMBER() OVER (PARTITION BY o_custkey, kind ORDER BY NOT licensed, approximate, id) AS n FROM word JOIN orders ON id = o_orderkey), "
        "pass AS (SELECT c, kind, 0::BIGINT AS n, []::STRUCT(id BIGINT, low VARCHAR, ws VARCHAR[], lat DOUBLE, lon DOUBLE, rough BOOLEAN)[] AS kept, NULL::BIGINT AS id, NULL::BIGINT AS into_id FROM (SELECT DISTINCT c, kind FROM seq) UNION ALL "
        f"SELECT c, kind, n + 1, CASE WHEN hit IS NULL THEN list_append(kept, {new}) WHEN kept[hit].rough AND NOT y.approximate THEN list_transform(kept, lambda m, i : {moved}) ELSE kept END, y.id, CASE WHEN hit IS NULL THEN y.id ELSE kept[hit].id END "
        f"FROM (SELECT p.*, y AS y, list_filter(range(1, len(p.kept) + 1), lambda i : list_transform([p.kept[i]], lambda m : {same})[1])[1] AS hit FROM pass p JOIN seq y ON y.c = p.c AND y.kind = p.kind AND y.n = p.n + 1) q), "
        "spot AS (SELECT m.id AS id, m.lat AS lat, m.lon AS lon, m.rough AS approximate FROM (SELECT unnest(kept) AS m FROM (SELECT arg_max(kept, n) AS kept FROM pass GROUP BY c, kind)))"
    )


PASS_SQL = _pass_sql()


@query(
    f"WITH RECURSIVE {PLACE_SQL}, {PASS_SQL}, r AS (SELECT place.*, into_id, ROW_NUMBER() OVER (PARTITION BY into_id ORDER BY place.id <> into_id, NOT licensed, approximate, place.id) AS o FROM place JOIN pass USING (id)), "
    "g AS (SELECT into_id AS id, MIN(name) FILTER (WHERE o = 1) AS name, bool_or(licensed) AS licensed, string_agg(DISTINCT CASE WHEN licensed THEN 'roster' ELSE 'map' END, ',' ORDER BY CASE WHEN licensed THEN 'roster' ELSE 'map' END) AS sources, arg_min('w' || CAST(id AS VARCHAR), o) FILTER (WHERE id % 4 = 0) AS website, arg_min(id % 60, o) FILTER (WHERE id % 5 = 0) AS capacity, COUNT(*) AS records FROM r GROUP BY 1) "
    "SELECT g.*, round(lat, 6) AS lat, round(lon, 6) AS lon, approximate FROM g JOIN spot USING (id)"
)
def consolidated_places(spark: SparkSession, d: str) -> DataFrame:
    return M.consolidate(places(spark, d)).select("id", "name", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "approximate", "licensed", "sources", "website", "capacity", "records")


def organisations(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    name = F.concat(F.lit("Oak"), k % 20, F.lit(" Valley"), F.floor(k / 20), F.lit(" District "), k % 3)
    return table(spark, d, "supplier").select(k.alias("org"), name.alias("name"), F.array(F.concat(F.lit("oak"), k % 20, F.lit("x.org"))).alias("source_hosts"))


def hits(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    a, b, c = k % 20, F.floor(k / 20) % 6, k % 4
    text = F.when(c == 3, F.concat(F.lit("News of oak"), a, F.lit(" today"))).otherwise(F.concat(F.lit("The valley"), b, F.lit(" and oak"), a, F.lit(" serve district "), c))
    return table(spark, d, "part").select(k.alias("doc"), (k % 97).alias("rank"), F.concat(F.lit("oak"), a, F.when(k % 5 == 0, "x").otherwise(""), F.when(k % 7 == 0, ".com").otherwise(".org")).alias("host"), text.alias("text"))


MENTION_SQL = (
    "org AS (SELECT s_suppkey AS org, s_suppkey % 20 AS a, s_suppkey // 20 AS b, s_suppkey % 3 AS c FROM supplier), hit AS (SELECT p_partkey AS doc, p_partkey % 97 AS rank, p_partkey % 20 AS a, (p_partkey // 20) % 6 AS b, p_partkey % 4 AS c, 'oak' || CAST(p_partkey % 20 AS VARCHAR) || CASE WHEN p_partkey % 5 = 0 THEN 'x' ELSE '' END || CASE WHEN p_partkey % 7 = 0 THEN '.com' ELSE '.org' END AS host FROM part), "
    # Distinctive words are oakA, valleyB and the number C where it has two characters or more, which it never has: oak and valley must both be there.
    "met AS (SELECT org, doc, rank, host, org.a FROM org JOIN hit ON org.a = hit.a AND org.b = hit.b AND hit.c < 3)"
)


@query(f"WITH {MENTION_SQL} SELECT org, doc FROM met")
def organisation_mentions(spark: SparkSession, d: str) -> DataFrame:
    return M.mentioned(organisations(spark, d), hits(spark, d))


@query(f"WITH {MENTION_SQL} SELECT org, doc, host FROM met WHERE host NOT LIKE '%.com' AND host <> 'oak' || CAST(a AS VARCHAR) || 'x.org' QUALIFY ROW_NUMBER() OVER (PARTITION BY org ORDER BY rank, doc) = 1")
def organisation_websites(spark: SparkSession, d: str) -> DataFrame:
    found = hits(spark, d)
    return M.websites(organisations(spark, d), found, found.where("host LIKE '%.com'").select("host").distinct())


@query("SELECT s_suppkey AS org, s_suppkey % 2 = 0 AND s_suppkey % 3 <> 0 AS verified, CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 3 <> 0 THEN least(65, s_suppkey % 90 + 9) ELSE s_suppkey % 90 END AS score, CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 3 <> 0 THEN least(74, s_suppkey % 80 + 15) ELSE s_suppkey % 80 END AS confidence, CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 3 <> 0 THEN 2 ELSE 1 END AS emails FROM supplier")
def verified_enrichment(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    s = table(spark, d, "supplier")
    leads = s.select(k.alias("org"), (k % 90).alias("score"), (k % 80).alias("confidence"), F.array(F.lit("a@b.org")).alias("emails"))
    sites = s.select(k.alias("org"), F.lit("h.org").alias("hit_host"), F.when(k % 2 == 0, "h.org").otherwise("i.org").alias("page_host"), (k % 3 != 0).alias("about"), F.array(F.lit("a@b.org"), F.lit("c@b.org")).alias("emails"))
    return M.enriched(leads, sites).withColumn("emails", F.size("emails"))


@query("WITH l AS (SELECT s_suppkey AS listing, CASE WHEN s_suppkey % 4 = 0 THEN 'Oak' ELSE 'Green House ' || CAST(s_suppkey % 10 AS VARCHAR) END AS name, CASE WHEN s_suppkey % 5 = 0 THEN 'h' || CAST(s_suppkey % 30 AS VARCHAR) || '.org' END AS host FROM supplier), r AS (SELECT p_partkey AS result, p_partkey % 89 AS rank, 'h' || CAST(p_partkey % 30 AS VARCHAR) || '.org' AS host, 'The GREEN house ' || CAST(p_partkey % 14 AS VARCHAR) || ' oak' AS title FROM part), m AS (SELECT listing, result, rank FROM l JOIN r ON l.host = r.host OR (length(name) > 5 AND contains(lower(title), lower(name)))) SELECT listing, result, ROW_NUMBER() OVER (PARTITION BY listing ORDER BY rank, result) AS place FROM m QUALIFY place <= 4")
def listing_results(spark: SparkSession, d: str) -> DataFrame:
    k, p = F.col("s_suppkey"), F.col("p_partkey")
    listings = table(spark, d, "supplier").select(k.alias("listing"), F.when(k % 4 == 0, "Oak").otherwise(F.concat(F.lit("Green House "), k % 10)).alias("name"), F.when(k % 5 == 0, F.concat(F.lit("h"), k % 30, F.lit(".org"))).alias("host"))
    results = table(spark, d, "part").select(p.alias("result"), (p % 89).alias("rank"), F.concat(F.lit("h"), p % 30, F.lit(".org")).alias("host"), F.concat(F.lit("The GREEN house "), p % 14, F.lit(" oak")).alias("title"))
    return M.listing_results(listings, results)


LOCATED_SQL = (
    "t AS (SELECT s_suppkey AS target, CASE WHEN s_suppkey % 3 <> 0 THEN 'town' || CAST(s_suppkey % 40 AS VARCHAR) ELSE 'own' || CAST(s_suppkey % 9 AS VARCHAR) END AS locality, CASE WHEN s_suppkey % 2 = 0 THEN 'z' || CAST(s_suppkey % 300 AS VARCHAR) END AS zip, CASE WHEN s_suppkey % 5 = 0 THEN 'townland' || CAST(s_suppkey % 70 AS VARCHAR) END AS county FROM supplier), "
    "u AS (SELECT *, locality || ' ' || coalesce(zip, '') AS text FROM t), r AS (SELECT c_custkey AS id, c_name AS name, 'z' || CAST(c_custkey % 300 AS VARCHAR) AS zip, 'townland' || CAST(c_custkey % 70 AS VARCHAR) AS county, 'town' || CAST(c_custkey % 40 AS VARCHAR) AS city FROM customer), "
    "m AS (SELECT target, id, name, CASE WHEN u.zip = r.zip THEN 100 ELSE 0 END + CASE WHEN u.county = r.county THEN 90 ELSE 0 END + CASE WHEN u.locality = city THEN 85 ELSE 0 END + CASE WHEN contains(city, locality) THEN 55 ELSE 0 END + CASE WHEN contains(r.county, locality) THEN 45 ELSE 0 END + CASE WHEN contains(text, city) THEN 35 ELSE 0 END AS score FROM u, r)"
)


@query(f"WITH {LOCATED_SQL} SELECT target, id, score, ROW_NUMBER() OVER (PARTITION BY target ORDER BY score DESC, name, id) AS place FROM m WHERE score > 0 QUALIFY place <= 3")
def scored_locations(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("s_suppkey"), F.col("c_custkey")
    numbered = lambda name, x: F.concat(F.lit(name), x)
    targets = table(spark, d, "supplier").select(k.alias("target"), F.when(k % 3 != 0, numbered("town", k % 40)).otherwise(numbered("own", k % 9)).alias("locality"), F.when(k % 2 == 0, numbered("z", k % 300)).alias("zip"), F.when(k % 5 == 0, numbered("townland", k % 70)).alias("county"))
    targets = targets.withColumn("text", F.concat("locality", F.lit(" "), F.coalesce("zip", F.lit(""))))
    return M.located(targets, table(spark, d, "customer").select(c.alias("id"), F.col("c_name").alias("name"), numbered("z", c % 300).alias("zip"), numbered("townland", c % 70).alias("county"), numbered("town", c % 40).alias("city")))


@query(
    "WITH r AS (SELECT o_orderkey AS id, 'oak ' || CAST(o_custkey % 700 AS VARCHAR) AS k0, CASE WHEN o_orderkey % 4 <> 0 THEN 'h' || CAST(o_orderkey % 911 AS VARCHAR) || '.org' END AS k1, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(1000 + o_orderkey % 1201 AS VARCHAR) END AS k2 FROM orders), "
    "f AS (SELECT id, unnest([{'fields': 'organization_name', 'k': k0}, {'fields': 'website_domain', 'k': k1}, {'fields': 'phone', 'k': k2}, {'fields': 'organization_name,website_domain', 'k': k0 || '|' || k1}, {'fields': 'organization_name,phone', 'k': k0 || '|' || k2}, {'fields': 'website_domain,phone', 'k': k1 || '|' || k2}, {'fields': 'organization_name,website_domain,phone', 'k': k0 || '|' || k1 || '|' || k2}]) AS x FROM r) "
    "SELECT x.fields AS fields, id, MIN(id) OVER w AS representative, COUNT(*) OVER w AS n FROM f WHERE x.k IS NOT NULL WINDOW w AS (PARTITION BY x) QUALIFY COUNT(*) OVER w > 1"
)
def duplicate_records(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    name = F.concat(F.when(k % 2 == 0, "The Oak, ").otherwise("OAK "), F.col("o_custkey") % 700, F.when(k % 5 == 0, " LLC").otherwise(""))
    url = F.when(k % 4 != 0, F.concat(F.lit("https://www.H"), k % 911, F.lit(".org/a")))
    phone = F.when(k % 3 != 0, F.concat(F.lit("("), ((1000 + k % 1201) / 100).cast("int"), F.lit(") "), F.lpad(((1000 + k % 1201) % 100).cast("string"), 2, "0")))
    rows = table(spark, d, "orders").select(k.alias("id"), name.alias("name"), url.alias("url"), phone.alias("phone"))
    return M.duplicates(rows).withColumn("fields", F.array_join("fields", ","))


@query("SELECT c_custkey AS request, CASE WHEN c_custkey % 3 <> 2 AND c_custkey % 50 % 2 = c_custkey % 3 THEN c_custkey % 50 * 10 END AS people, CASE WHEN NOT (c_custkey % 3 <> 2 AND c_custkey % 50 % 2 = c_custkey % 3) THEN CASE WHEN c_custkey % 50 % 2 = 0 THEN 'county' ELSE 'independent city' END END AS suggestion FROM customer")
def exact_geography(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("c_custkey")
    kind = lambda x: F.when(x == 0, "county").when(x == 1, "independent city").otherwise("city")
    areas = spark.range(50).select(F.concat(F.lit("k"), "id").alias("key"), kind(F.col("id") % 2).alias("kind"), (F.col("id") * 10).alias("people"))
    return M.strict_geography(table(spark, d, "customer").select(c.alias("request"), F.concat(F.lit("k"), c % 50).alias("key"), kind(c % 3).alias("kind")), areas)

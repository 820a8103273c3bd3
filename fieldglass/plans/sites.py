"""Queries on places: distances, rings, polygons, hotspots, tiers and convergence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.functions.exprs import disc_weight, miles, ratio
from fieldglass.operators import sites as S
from fieldglass.operators import spatial
from fieldglass.plans.adapters import places, table
from fieldglass.plans.areas import miles_sql
from fieldglass.plans.registry import query


def site_points(spark: SparkSession, d: str) -> DataFrame:
    return places(spark, d).select(F.col("nation").alias("site"), "lat", "lon")


def tracts(spark: SparkSession, d: str) -> DataFrame:
    """Customers of a nation on a 7 by 7 grid of small areas around its point."""
    c, p = table(spark, d, "customer"), places(spark, d)
    k = F.col("c_custkey") % 49
    rows = c.join(F.broadcast(p), c.c_nationkey == p.nation).select("state", "nation", "c_acctbal", k.alias("k"), (F.col("lat") + (F.floor(k / 7) - 3) * 0.03).alias("lat"), (F.col("lon") + (k % 7 - 3) * 0.038).alias("lon"))
    return rows.groupBy("state", "nation", "k", "lat", "lon").agg((F.count(F.lit(1)) * 10).alias("kids"), (F.count(F.lit(1)) * 44).alias("population"), (F.count_if(F.col("c_acctbal") < 0) * 9).alias("poor"), F.lit(3.2).cast("double").alias("sqmi"))


def facilities(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as facilities near their nation's point."""
    s, p = table(spark, d, "supplier"), places(spark, d)
    k = F.col("s_suppkey")
    kind = F.when(k % 4 == 0, "clinic").when(k % 4 == 1, "school").otherwise("daycare")
    return s.join(F.broadcast(p), s.s_nationkey == p.nation).select(k.alias("facility"), kind.alias("kind"), (k % 60).alias("capacity"), (F.col("lat") + (k % 5 - 2) * 0.03).alias("lat"), (F.col("lon") + (k % 3 - 1) * 0.05).alias("lon"))


SITE_SQL = """
site AS (SELECT n_nationkey AS site, CAST(25 + (n_nationkey * 7) % 25 AS DOUBLE) AS lat, CAST(-120 + (n_nationkey * 13) % 50 AS DOUBLE) AS lon, r_name AS state FROM nation JOIN region ON n_regionkey = r_regionkey),
tract AS (SELECT state, site AS nation, c_custkey % 49 AS k, lat + (floor((c_custkey % 49) / 7) - 3) * 0.03E0 AS lat, lon + ((c_custkey % 49) % 7 - 3) * 0.038E0 AS lon, COUNT(*) * 10 AS kids, COUNT(*) * 44 AS population, COUNT(*) FILTER (WHERE c_acctbal < 0) * 9 AS poor, 3.2E0 AS sqmi
  FROM customer JOIN site ON c_nationkey = site GROUP BY 1, 2, 3, 4, 5),
facility AS (SELECT s_suppkey AS facility, CASE WHEN s_suppkey % 4 = 0 THEN 'clinic' WHEN s_suppkey % 4 = 1 THEN 'school' ELSE 'daycare' END AS kind, s_suppkey % 60 AS capacity, lat + (s_suppkey % 5 - 2) * 0.03E0 AS lat, lon + (s_suppkey % 3 - 1) * 0.05E0 AS lon
  FROM supplier JOIN site ON s_nationkey = site)
"""
FAR = miles_sql("s.lat", "s.lon", "x.lat", "x.lon")
DISC = "least(1.0E0, pow(radius / sqrt(greatest({a}, 0.05E0) / 3.141592653589793E0), 2)) * greatest(0.0E0, least(1.0E0, (sqrt(greatest({a}, 0.05E0) / 3.141592653589793E0) + radius - {d}) / (2 * least(sqrt(greatest({a}, 0.05E0) / 3.141592653589793E0), radius))))"
RING_SQL = f"ring AS (SELECT s.site, radius, x.*, {DISC.format(a='x.sqmi', d=FAR)} AS w FROM site s, tract x, (SELECT unnest([2.0E0, 5.0E0, 10.0E0]) AS radius)), sums AS (SELECT site, radius, round(SUM(kids * w), 6) AS kids, round(SUM(population * w), 6) AS population, round(SUM(poor * w), 6) AS poor, round(SUM(sqmi * w), 6) AS ring_sqmi FROM ring WHERE w > 0 GROUP BY 1, 2)"
COUNT_SQL = f"counts AS (SELECT site, radius, COUNT(*) FILTER (WHERE kind = 'clinic') AS clinics, COUNT(*) FILTER (WHERE kind = 'school') AS schools, COUNT(*) FILTER (WHERE kind = 'daycare') AS daycares, CAST(SUM(capacity) FILTER (WHERE kind = 'daycare') AS BIGINT) AS capacity FROM (SELECT s.site, radius, x.* FROM site s, facility x, (SELECT unnest([2.0E0, 5.0E0, 10.0E0]) AS radius) WHERE {FAR} <= radius) GROUP BY 1, 2)"


@query(f"WITH {SITE_SQL} SELECT s.site, x.facility, round({FAR}, 6) AS miles FROM site s, facility x WHERE {FAR} <= 10")
def radius_join(spark: SparkSession, d: str) -> DataFrame:
    return spatial.within(site_points(spark, d), facilities(spark, d), 10).select("site", "facility", F.round("miles", 6).alias("miles"))


@query(f"WITH {SITE_SQL}, {RING_SQL} SELECT site, radius, round(kids, 4) AS kids, round(population, 4) AS population, round(poor, 4) AS poor, round(ring_sqmi, 4) AS ring_sqmi FROM sums")
def area_weighted_rings(spark: SparkSession, d: str) -> DataFrame:
    rings = rings_of(spark, d)
    return rings.select("site", "radius", *(F.round(c, 4).alias(c) for c in ("kids", "population", "poor", "ring_sqmi")))


def rings_of(spark: SparkSession, d: str) -> DataFrame:
    t = tracts(spark, d).withColumn("ring_sqmi", F.col("sqmi"))
    sums = ["kids", "population", "poor", "ring_sqmi"]
    return spatial.ring_sums(site_points(spark, d), t, sums).select("site", "radius", *(F.round(c, 6).alias(c) for c in sums))


def counts_of(spark: SparkSession, d: str) -> DataFrame:
    met = spatial.within(site_points(spark, d), facilities(spark, d), 10).withColumn("radius", F.explode(F.array(F.lit(2.0), F.lit(5.0), F.lit(10.0)))).where("miles <= radius")
    n = lambda kind: F.count_if(F.col("kind") == kind)
    return met.groupBy("site", "radius").agg(n("clinic").alias("clinics"), n("school").alias("schools"), n("daycare").alias("daycares"), F.sum(F.when(F.col("kind") == "daycare", F.col("capacity"))).alias("capacity"))


@query(f"WITH {SITE_SQL}, {COUNT_SQL} SELECT * FROM counts")
def ring_counts(spark: SparkSession, d: str) -> DataFrame:
    return counts_of(spark, d)


SHOWN = "CASE WHEN abs({x}) >= 100 THEN floor({x} + 0.5E0) ELSE floor({x} * 100 + 0.5E0) / 100 END"
SUMS = ["kids", "population", "poor", "clinics", "schools", "daycares"]
RATIO_SQL = {k: (f"CASE WHEN {b} > 0 THEN {a} * 1.0E0 / {b} * {m} END" if how == "per" else f"{a} * 1.0E0 / ({b} + 1)") for k, (how, a, b, m) in S.RATIOS.items()}


@query(
    f"WITH {SITE_SQL}, {RING_SQL}, {COUNT_SQL}, j AS (SELECT * FROM sums LEFT JOIN counts USING (site, radius)) "
    + " UNION ALL ".join(f"SELECT site, '{k}.' || CAST(CAST(radius AS INT) AS VARCHAR) || 'mi' AS indicator, {SHOWN.format(x=f'({sql})')} AS value FROM j" for k, sql in [*((c, f"CAST({c} AS DOUBLE)") for c in SUMS), *RATIO_SQL.items()])
)
def site_indicators(spark: SparkSession, d: str) -> DataFrame:
    return S.ring_indicators(rings_of(spark, d).join(counts_of(spark, d), ["site", "radius"], "left"), SUMS)


@query(f"WITH {SITE_SQL}, {RING_SQL} SELECT site, CASE WHEN MAX(kids) FILTER (WHERE radius = 10) > 0 THEN round(MAX(kids) FILTER (WHERE radius = 2) / MAX(kids) FILTER (WHERE radius = 10) * 100, 4) END AS concentration FROM sums GROUP BY 1")
def concentration_share(spark: SparkSession, d: str) -> DataFrame:
    at = lambda r: F.max(F.when(F.col("radius") == r, F.col("kids")))
    return rings_of(spark, d).groupBy("site").agg(F.round(ratio(at(2), at(10), 100), 4).alias("concentration"))


@query(f"WITH {SITE_SQL}, near AS (SELECT s.site, facility, {FAR} AS m FROM site s, facility x WHERE kind = 'clinic' AND {FAR} <= 10), best AS (SELECT * FROM near QUALIFY ROW_NUMBER() OVER (PARTITION BY site ORDER BY m, facility) = 1) SELECT site, facility, round(coalesce(m, 10.01E0), 6) AS miles FROM site LEFT JOIN best USING (site)")
def nearest_facility(spark: SparkSession, d: str) -> DataFrame:
    out = spatial.nearest(site_points(spark, d), facilities(spark, d).where("kind = 'clinic'"), 10, "facility")
    return out.select("site", "facility", F.round(F.coalesce("miles", F.lit(10.01)), 6).alias("miles"))


@query(
    f"WITH {SITE_SQL}, box AS (SELECT site AS shape, lat, lon FROM site) "
    "SELECT f.facility, (SELECT MIN(shape) FROM box WHERE f.lat > box.lat - 0.05E0 AND f.lat <= box.lat + 0.05E0 AND f.lon > box.lon - 0.06E0 AND f.lon <= box.lon + 0.06E0 AND NOT (f.lat > box.lat - 0.01E0 AND f.lat <= box.lat + 0.01E0 AND f.lon > box.lon - 0.01E0 AND f.lon <= box.lon + 0.01E0)) AS shape FROM facility f"
)
def point_in_polygon(spark: SparkSession, d: str) -> DataFrame:
    """Facilities in rectangles with a hole around each site's point."""

    def ring(a: float, b: float):
        corner = lambda y, x: F.struct((F.col("lon") + x).alias("lon"), (F.col("lat") + y).alias("lat"))
        return F.array(corner(-a, -b), corner(-a, b), corner(a, b), corner(a, -b))

    shapes = site_points(spark, d).select(F.col("site").alias("shape"), F.col("site").alias("order"), F.array(ring(0.05, 0.06), ring(0.01, 0.01)).alias("rings"))
    return spatial.locate(facilities(spark, d), shapes, "facility")


HOT = {"density": "kids / sqmi", "need": "CASE WHEN kids > 60 THEN poor * 1.0E0 / kids END", "size": "population", "poverty": "poor"}


@query(
    f"WITH {SITE_SQL}, v AS (SELECT nation, k, state, kids, {', '.join(f'CAST({sql} AS DOUBLE) AS {n}' for n, sql in HOT.items())} FROM tract), p AS (SELECT *, {', '.join(f'CASE WHEN {n} IS NOT NULL THEN (RANK() OVER (PARTITION BY state ORDER BY {n} ASC NULLS LAST) - 1) * 1.0E0 / COUNT({n}) OVER (PARTITION BY state) * 100 END AS p_{n}' for n in HOT)} FROM v) "
    f"SELECT nation, k, {' + '.join(f'CAST(p_{n} IS NOT NULL AS INT)' for n in HOT)} AS known, floor(({' + '.join(f'coalesce(p_{n}, 0)' for n in HOT)}) / ({' + '.join(f'CAST(p_{n} IS NOT NULL AS INT)' for n in HOT)}) + 0.5E0) AS hotspot, kids < 150 AS small_sample FROM p WHERE {' + '.join(f'CAST(p_{n} IS NOT NULL AS INT)' for n in HOT)} >= 3"
)
def hotspot_score(spark: SparkSession, d: str) -> DataFrame:
    return S.hotspots(tracts(spark, d), HOT, "state", "kids", 150).select("nation", "k", "known", "hotspot", "small_sample")


TIER_SQL = "CASE WHEN s_acctbal <= 3000 THEN 'likely' WHEN s_suppkey % 5 = 0 AND s_suppkey % 4 <> 1 THEN 'priority' ELSE 'confirmed' END"


def assessed(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as facilities with sources, a licence, ages and inclusion language, and their tiers."""
    k = F.col("s_suppkey")
    words = lambda *x: F.array(*map(F.lit, x))
    p = table(spark, d, "supplier").select(
        "s_suppkey", F.when(k % 3 == 0, words("map", "registry", "map")).when(k % 3 == 1, words("map", "organization-website")).otherwise(words("organization-website")).alias("sources"),
        (F.col("s_acctbal") > 3000).alias("licensed"), F.when(k % 4 == 0, F.lit(True)).when(k % 4 == 1, F.lit(False)).alias("serves_2_5"), F.when(k % 5 == 0, words("inclusive")).otherwise(F.array().cast("array<string>")).alias("inclusion"),
    )
    return S.tiers(p)


@query(f"SELECT s_suppkey, CAST(CASE s_suppkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS BIGINT) AS confirmed_by, {TIER_SQL} AS tier FROM supplier")
def tier_assessment(spark: SparkSession, d: str) -> DataFrame:
    return assessed(spark, d).select("s_suppkey", "confirmed_by", "tier")


STATE_SQL = (
    "land AS (SELECT state, SUM(kids) * 1.0E0 / SUM(sqmi) AS state_young_density, SUM(poor) * 1.0E0 / SUM(kids) AS state_disability, percentile_disc(0.5) WITHIN GROUP (ORDER BY kids / sqmi DESC) AS median_density FROM tract GROUP BY 1), "
    "county AS (SELECT s.site, s.state, 100.0E0 * COUNT(f.facility) FILTER (WHERE kind = 'clinic') / 7 AS supply, 10.0E0 * COUNT(f.facility) FILTER (WHERE kind = 'school') AS second, CASE WHEN s.site % 4 = 0 THEN s.site % 26 END AS hpsa, CASE WHEN s.site % 6 <> 5 THEN s.site % 9 END AS uninsured FROM site s LEFT JOIN (SELECT s_nationkey, s_suppkey AS facility, CASE WHEN s_suppkey % 4 = 0 THEN 'clinic' WHEN s_suppkey % 4 = 1 THEN 'school' ELSE 'daycare' END AS kind FROM supplier) f ON s_nationkey = s.site GROUP BY s.site, s.state), "
    "usual AS (SELECT state, percentile_disc(0.5) WITHIN GROUP (ORDER BY supply DESC) AS median_supply, percentile_disc(0.5) WITHIN GROUP (ORDER BY second DESC) AS median_second, percentile_disc(0.5) WITHIN GROUP (ORDER BY uninsured DESC) AS median_uninsured FROM county GROUP BY 1)"
)
FIVE_SQL = (
    "five AS (SELECT u.site, u.kids AS kids5, u.kids / u.ring_sqmi AS young_density5, u.poor / u.kids AS disability5, u.population * 1.0E0 / (u.population + u.poor) AS insured5, clinics AS pediatric5, daycares AS childcare5, schools AS licensed5, clinics * 10000.0E0 / u.kids AS aba_rate5 FROM sums u LEFT JOIN counts USING (site, radius) WHERE radius = 5), "
    f"part5 AS (SELECT s.site, COUNT(*) FILTER (WHERE {TIER_SQL.replace('s_acctbal', 'p.s_acctbal').replace('s_suppkey', 'p.s_suppkey')} = 'priority') AS priority5, COUNT(*) FILTER (WHERE p.s_suppkey % 3 = 0) AS double_confirmed5 FROM site s JOIN facility x ON {FAR} <= 5 JOIN supplier p ON p.s_suppkey = x.facility GROUP BY 1), "
    f"near AS (SELECT s.site, coalesce(MIN({FAR}), 10.01E0) AS nearest_aba FROM site s LEFT JOIN facility x ON kind = 'clinic' AND {FAR} <= 10 GROUP BY 1), "
    "j AS (SELECT five.*, kids2 / sqmi2 AS density2, coalesce(priority5, 0) AS priority5, coalesce(double_confirmed5, 0) AS double_confirmed5, nearest_aba, land.* EXCLUDE (state), supply, second, hpsa, uninsured, median_supply, median_second, median_uninsured, 0.9E0 AS state_insured, median_supply AS median_aba_rate FROM five JOIN (SELECT site, kids AS kids2, ring_sqmi AS sqmi2 FROM sums WHERE radius = 2) USING (site) LEFT JOIN part5 USING (site) JOIN near USING (site) JOIN county USING (site) JOIN land USING (state) JOIN usual USING (state))"
)


@query(
    f"WITH {SITE_SQL}, {RING_SQL}, {COUNT_SQL}, {STATE_SQL}, {FIVE_SQL}, t AS (SELECT site, {', '.join(f"CASE WHEN ({s}) THEN 'pass' WHEN NOT ({s}) THEN 'fail' ELSE 'insufficient' END AS {k}" for k, s in S.CONVERGENCE.items())} FROM j), "
    f"n AS (SELECT *, CAST({' + '.join(f"CAST({k} = 'pass' AS INT)" for k in S.CONVERGENCE)} AS BIGINT) AS passed, CAST({' + '.join(f"CAST({k} <> 'insufficient' AS INT)" for k in S.CONVERGENCE)} AS BIGINT) AS evaluated FROM t) SELECT *, CASE WHEN evaluated < 4 THEN 'insufficient' WHEN passed >= 6 THEN 'strong' WHEN passed >= 4 THEN 'moderate' ELSE 'weak' END AS strength FROM n"
)
def convergence_tests(spark: SparkSession, d: str) -> DataFrame:
    middle = lambda x: F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {x} DESC)")
    site = places(spark, d).select(F.col("nation").alias("site"), "state")
    land = tracts(spark, d).groupBy("state").agg((F.sum("kids") / F.sum("sqmi")).alias("state_young_density"), (F.sum("poor") / F.sum("kids")).alias("state_disability"), middle("kids / sqmi").alias("median_density"))
    k = F.col("s_suppkey") % 4
    own = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("site")).agg(F.count_if(k == 0).alias("clinics_here"), F.count_if(k == 1).alias("schools_here"))
    s = F.col("site")
    county = site.join(own, "site", "left").select("site", "state", (F.coalesce("clinics_here", F.lit(0)) * 100.0 / 7).alias("supply"), (F.coalesce("schools_here", F.lit(0)) * 10.0).alias("second"), F.when(s % 4 == 0, s % 26).alias("hpsa"), F.when(s % 6 != 5, s % 9).alias("uninsured"))
    usual = county.groupBy("state").agg(*(middle(c).alias(f"median_{c}") for c in ("supply", "second", "uninsured")))
    rings, c = rings_of(spark, d), F.col
    five = rings.where("radius = 5").join(counts_of(spark, d).where("radius = 5").drop("radius"), "site", "left")
    five = five.select("site", c("kids").alias("kids5"), (c("kids") / c("ring_sqmi")).alias("young_density5"), (c("poor") / c("kids")).alias("disability5"), (c("population") / (c("population") + c("poor"))).alias("insured5"), c("clinics").alias("pediatric5"), c("daycares").alias("childcare5"), c("schools").alias("licensed5"), (c("clinics") * 10000.0 / c("kids")).alias("aba_rate5"))
    two = rings.where("radius = 2").select("site", (c("kids") / c("ring_sqmi")).alias("density2"))
    met = spatial.within(site_points(spark, d), facilities(spark, d), 10)
    partners = met.where("miles <= 5").join(assessed(spark, d), c("facility") == c("s_suppkey")).groupBy("site").agg(F.count_if(c("tier") == "priority").alias("priority5"), F.count_if(c("confirmed_by") >= 2).alias("double_confirmed5"))
    near = site.select("site").join(met.where("kind = 'clinic'").groupBy("site").agg(F.min("miles").alias("m")), "site", "left").select("site", F.coalesce("m", F.lit(10.01)).alias("nearest_aba"))
    rows = five.join(two, "site").join(partners, "site", "left").na.fill(0, ["priority5", "double_confirmed5"]).join(near, "site").join(county, "site").join(land, "state").join(usual, "state")
    rows = rows.withColumns({"state_insured": F.lit(0.9), "median_aba_rate": c("median_supply")})
    return S.convergence(rows, S.CONVERGENCE).select("site", *S.CONVERGENCE, "passed", "evaluated", "strength")


@query(f"WITH {SITE_SQL} SELECT x.facility, round({miles_sql('25.0E0', '-120.0E0', 'x.lat', 'x.lon')}, 4) AS miles, round({DISC.format(a='x.capacity', d='(x.facility % 12)').replace('radius', '5.0E0')}, 6) AS weight FROM facility x")
def distances_and_weights(spark: SparkSession, d: str) -> DataFrame:
    f = facilities(spark, d)
    return f.select("facility", F.round(miles(F.lit(25.0), F.lit(-120.0), "lat", "lon"), 4).alias("miles"), F.round(disc_weight(F.col("facility") % 12, F.lit(5.0), "capacity"), 6).alias("weight"))

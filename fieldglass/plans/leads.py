"""Queries on coded survey variables, and on leads and the pages they come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.operators import leads as L
from fieldglass.operators import survey as S
from fieldglass.plans.adapters import table
from fieldglass.plans.registry import query

START = {"B01003_001E": 900, "B09001_001E": 850, "B11005_001E": 500, "B27010_002E": 900, "B23008_002E": 450, "B28002_001E": 500, "B08201_001E": 500, "C16002_001E": 900, "B18101_003E": 200, "B18101_022E": 200, "B18101_006E": 300, "B18101_025E": 300, "B18104_003E": 300, "B18104_019E": 300}
VALUES = {v: f"CASE WHEN (c_custkey + {i}) % 97 = 0 THEN -666666666 ELSE ({START.get(v, 120)} + c_custkey * {i + 3} % 90) * CASE WHEN (c_custkey + {i}) % 53 = 0 THEN 20 ELSE 1 END END" for i, v in enumerate(S.VARIABLES)}


def _survey_sql() -> str:
    """The raw variables, their sums, then a step for each rule, each seeing what the ones before left."""
    steps = [f"v AS (SELECT c_custkey, {', '.join(f'CAST(nullif({x}, -666666666) AS DOUBLE) AS {v}' for v, x in VALUES.items())} FROM customer)", f"s0 AS (SELECT c_custkey, 0 AS n_issues, {', '.join(f'{x} AS {m}' for m, x in S.METRICS.items())} FROM v)"]
    rules = [((part, whole), f"{part} > {whole}") for part, whole in S.PARTS]
    rules += [(tuple(names), f"{base} >= 200 AND NOT ({total} / {base} BETWEEN {low} AND {high})") for names, total, base, low, high in S.UNIVERSES]
    for i, (names, bad) in enumerate(rules):
        new = ", ".join(f"CASE WHEN coalesce({bad}, false) THEN NULL ELSE {m} END AS {m}" for m in names)
        steps.append(f"s{i + 1} AS (SELECT * REPLACE (n_issues + CAST(coalesce({bad}, false) AS INT) AS n_issues, {new}) FROM s{i})")
    return f"WITH {', '.join(steps)} SELECT * FROM s{len(rules)}"


@query(_survey_sql())
def survey_contract(spark: SparkSession, d: str) -> DataFrame:
    coded = table(spark, d, "customer").selectExpr("c_custkey", *(f"{x} AS {v}" for v, x in VALUES.items()))
    out = S.checked(S.derived(coded, ["c_custkey"]))
    return out.withColumn("n_issues", F.size("issues")).drop("issues")


USES = {"therapists_agree": ["nppes.slp_orgs", "nppes.ot_orgs", "osm.therapy", "acs.kids"], "poverty_gap": ["saipe.child_pov_rate", "acs.kids_pov"], "land": ["tiger.land_sqmi"]}


@query(
    "WITH f AS (SELECT c_custkey, c_custkey % 2 = 0 AS slp, c_custkey % 3 = 0 AS osm, c_custkey % 5 > 0 AS kids, c_custkey % 7 = 0 AS pov FROM customer) "
    "SELECT c_custkey, 'therapists_agree' AS indicator, 'census-acs5,cms-nppes-county,osm-county' AS programs, concat_ws(',', CASE WHEN NOT kids THEN 'census-acs5' END, 'cms-nppes-county', CASE WHEN NOT osm THEN 'osm-county' END) AS missing FROM f "
    "UNION ALL SELECT c_custkey, 'poverty_gap', 'census-acs5,census-saipe', concat_ws(',', CASE WHEN NOT slp THEN 'census-acs5' END, CASE WHEN NOT pov THEN 'census-saipe' END) FROM f UNION ALL SELECT c_custkey, 'land', 'census-tiger', 'census-tiger' FROM f"
)
def area_missing_programs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    held = {"nppes.slp_orgs": k % 2 == 0, "osm.therapy": k % 3 == 0, "acs.kids": k % 5 > 0, "acs.kids_pov": k % 2 == 0, "saipe.child_pov_rate": k % 7 == 0}
    metrics = F.create_map(*(x for m, ok in held.items() for x in (F.lit(m), F.when(ok, F.lit(1.0)))))
    out = S.missing_programs(table(spark, d, "customer").select("c_custkey", metrics.alias("metrics")), ["c_custkey"], USES)
    return out.select("c_custkey", "indicator", F.array_join("programs", ",").alias("programs"), F.array_join("missing", ",").alias("missing"))


@query(
    "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'Kansas City' WHEN 1 THEN 'Kansas City' WHEN 2 THEN 'Colorado Springs' WHEN 3 THEN 'Clay County' WHEN 4 THEN 'St. Louis city' ELSE 'ks' END AS place, "
    "CASE WHEN p_size * 3 < 52 THEN p_size * 3 || ' wks' WHEN p_size * 3 % 52 = 0 THEN p_size * 3 // 52 || ' yrs' END AS age, "
    "CASE WHEN p_partkey % 7 = 0 THEN '—' WHEN p_partkey % 7 = 1 THEN printf('%.2f', floor(p_size / 64.0E0 * 100 + 0.5E0) / 100) WHEN p_partkey % 7 = 2 THEN printf('%.1f', floor((p_size + 0.25E0) * 10 + 0.5E0) / 10) ELSE printf('%,d', p_partkey * 1000 + 100) END AS value FROM part"
)
def written_values(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("p_partkey"), F.col("p_size")
    place = F.element_at(F.array(*(F.lit(x) for x in ("Kansas City, MO", " Kansas  City Kansas", "Colorado Springs,CO.", "Clay County, Missouri", "St. Louis city", " ks"))), (k % 6 + 1).cast("int"))
    weeks = n * 3
    age = F.when((weeks < 52) | (weeks % 52 == 0), S.age_text(weeks / 52))
    value = F.when(k % 7 == 1, n / 64.0).when(k % 7 == 2, n + 0.25).when(k % 7 > 2, (k * 1000 + 100).cast("double"))
    return table(spark, d, "part").select("p_partkey", S.without_state(place).alias("place"), age.alias("age"), S.value_text(value).alias("value"))


URLS = ["https://www.yelp.com/biz/a", "http://m.google.com/maps/place/b", "https://google.com/search?q=c", "https://g.page/d", "https://old.reddit.com/r/e", "https://notreddit.com/f", "https://stats.state.example/g", "https://press.example/h", "mailto:i", "https://www.bbb.org/us/j", "https://www.healthgrades.com/k"]


def _url(k: Column, more: str = "") -> Column:
    return F.element_at(F.array(*(F.lit(u + more) for u in URLS)), (k % len(URLS) + 1).cast("int"))


@query(
    "SELECT page_id, CASE WHEN page_id % 11 IN (0, 1, 3) THEN 'restricted_review' WHEN page_id % 11 = 4 THEN 'community' WHEN page_id % 11 = 6 THEN 'aggregate_only' END AS policy, page_id % 11 IN (0, 1, 2, 10) AS blocked, "
    "CASE page_id % 11 WHEN 0 THEN 'Yelp' WHEN 1 THEN 'Google Maps' WHEN 3 THEN 'Google Maps' WHEN 7 THEN 'Independent press' WHEN 9 THEN 'BBB' ELSE 'Other public source' END AS publisher FROM pages"
)
def source_policy(spark: SparkSession, d: str) -> DataFrame:
    url = _url(F.col("page_id"))
    return table(spark, d, "pages").select("page_id", L.policy(url, ["state.example"]).alias("policy"), L.on_host(url, L.BLOCKED).alias("blocked"), L.review_publisher(url).alias("publisher"))


@query(
    "WITH p AS (SELECT c_custkey % 400 AS h, MIN(CASE WHEN c_custkey % 3 > 0 THEN c_custkey END) AS phone FROM customer WHERE c_custkey % 400 % 5 > 0 GROUP BY 1) "
    "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN o_orderkey WHEN o_orderkey % 10 > 1 THEN phone END AS phone FROM orders LEFT JOIN p ON o_custkey % 400 = h"
)
def page_enrichment(spark: SparkSession, d: str) -> DataFrame:
    c, k = F.col("c_custkey"), F.col("o_orderkey")
    site = lambda n, path: F.concat(F.lit("https://www.site"), (n % 400).cast("string"), F.lit(path))
    pages = table(spark, d, "customer").where(c % 400 % 5 > 0).select(site(c, ".example/contact").alias("url"), F.when(c % 3 > 0, c).alias("phone"))
    hits = table(spark, d, "orders").select("o_orderkey", F.when(k % 10 != 1, site(F.col("o_custkey"), ".example/")).alias("url"), F.when(k % 10 == 0, k).alias("phone"))
    return L.enrich(hits, pages, "url", "phone").drop("url")


KIND = "element_at(array('Demand Signal', 'Competitor / Market Signal', 'Referral Source', 'Directory Source', 'Contact Target', 'Weak / Unclear Result'), CAST(o_orderkey % 6 + 1 AS INT))"
KIND_SQL = "(['Demand Signal', 'Competitor / Market Signal', 'Referral Source', 'Directory Source', 'Contact Target', 'Weak / Unclear Result'])[o_orderkey % 6 + 1]"


@query(
    f"WITH r AS (SELECT o_orderkey, {KIND_SQL} AS kind, CASE WHEN o_custkey % 9 > 0 THEN o_custkey END AS place FROM orders), c AS (SELECT *, CASE WHEN place IS NULL THEN 0 ELSE COUNT(*) FILTER (WHERE kind = 'Demand Signal') OVER w - CAST(kind = 'Demand Signal' AS INT) END AS demand_near, "
    "CASE WHEN place IS NULL THEN 0 ELSE COUNT(*) FILTER (WHERE kind LIKE 'Comp%') OVER w - CAST(kind LIKE 'Comp%' AS INT) END AS market_near FROM r WINDOW w AS (PARTITION BY place)) SELECT o_orderkey, demand_near, market_near, least(10, demand_near * 3 + market_near * 2) AS strength FROM c"
)
def location_context(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", F.expr(KIND).alias("kind"), F.when(F.col("o_custkey") % 9 > 0, F.col("o_custkey")).alias("place"))
    return L.near_context(rows, "place", "kind").drop("place", "kind")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%' UNION SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def areas_known_elsewhere(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return L.known_areas(table(spark, d, "customer").select("c_custkey"), [o.where("o_orderpriority LIKE '1%'"), o.where("o_orderstatus = 'P'")], "c_custkey")


@query(
    "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN 'kind_not_eligible' WHEN o_custkey % 4 = 0 AND o_orderkey % 5 <> 3 THEN 'kind_changed' WHEN (o_orderkey % 5 = 3) <> (o_custkey % 3 = 0) THEN 'pipeline_mismatch' END AS fault FROM orders"
)
def kind_eligibility(spark: SparkSession, d: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, [*L.KINDS, "household"])), (F.col("o_orderkey") % 5 + 1).cast("int"))
    saved, pipeline = F.when(F.col("o_custkey") % 4 == 0, "candidate"), F.when(F.col("o_custkey") % 3 == 0, "talent").otherwise("referral")
    return table(spark, d, "orders").select("o_orderkey", L.kind_faults(kind, pipeline, saved).alias("fault"))


@query("SELECT c_nationkey, COUNT(*) * 0.0322E0 AS expected FROM customer GROUP BY 1")
def expected_children(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n")).select("c_nationkey", L.expected("n").alias("expected"))


@query(
    "WITH h AS (SELECT o_custkey, o_orderkey, (['Yelp', 'Google Maps', NULL, 'Google Maps', NULL, NULL, NULL, 'Independent press', NULL, 'BBB', NULL])[o_orderkey % 11 + 1] AS publisher, o_orderkey % 11 || '-' || o_custkey % 3 AS page FROM orders WHERE o_orderkey % 5 > 0), "
    "o AS (SELECT o_custkey, publisher, page, MIN(o_orderkey) AS place FROM h WHERE publisher IS NOT NULL GROUP BY 1, 2, 3) SELECT o_custkey, least(8, COUNT(*)) AS pages, COUNT(DISTINCT publisher) AS publishers, arg_min(publisher, place) AS first_publisher FROM o GROUP BY 1"
)
def review_dossier(spark: SparkSession, d: str) -> DataFrame:
    k, name = F.col("o_orderkey"), F.concat(F.lit("Bright Path Clinic "), F.col("o_custkey").cast("string"))
    title = F.when(k % 5 > 0, F.concat(name, F.lit(" | Reviews"))).otherwise("Something else")
    url = F.concat(_url(k, "/"), (F.col("o_custkey") % 3).cast("string"), F.lit("?utm_source=x#top"))
    out = L.dossier(table(spark, d, "orders").select("o_custkey", "o_orderkey", name.alias("name"), title.alias("title"), url.alias("url")), ["o_custkey"], "url", "title", "name", "o_orderkey")
    return out.select("o_custkey", F.size("pages").alias("pages"), "publishers", L.review_publisher(F.get("pages", F.lit(0))).alias("first_publisher"))


@query("SELECT c_custkey, concat_ws(',', CASE WHEN c_custkey % 2 = 0 THEN 'organization_name' END, CASE WHEN c_custkey % 3 = 0 THEN 'website_domain' END, CASE WHEN c_custkey % 5 = 0 THEN 'phone' END) AS fields FROM customer")
def duplicate_fields(spark: SparkSession, d: str) -> DataFrame:
    k, one = F.col("c_custkey"), F.col("c_name")
    a = F.struct(F.concat(F.lit("The "), one, F.lit(", LLC")).alias("name"), F.concat(F.lit("https://www.s"), k.cast("string"), F.lit(".example/a")).alias("url"), F.concat(F.lit("(816) 555-"), k.cast("string")).alias("phone"))
    b = F.struct(
        F.concat(F.lower(one), F.when(k % 2 == 0, " inc").otherwise(" two")).alias("name"), F.concat(F.lit("http://s"), (k + F.when(k % 3 == 0, 0).otherwise(1)).cast("string"), F.lit(".example")).alias("url"), F.when(k % 5 == 0, F.concat(F.lit("816.555."), k.cast("string"))).otherwise(F.lit("")).alias("phone")
    )
    return table(spark, d, "customer").select("c_custkey", a.alias("a"), b.alias("b")).select("c_custkey", F.array_join(L.duplicate_fields("a", "b"), ",").alias("fields"))


@query("SELECT o_orderpriority, COUNT(*) AS ids FROM orders GROUP BY 1")
def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    """Orders have as many ids as there are orders, however often an id is made."""
    o = table(spark, d, "orders").select("o_orderpriority", L.stable_id("o_orderkey", "o_custkey").alias("id"))
    return o.unionByName(o).groupBy("o_orderpriority").agg(F.count_distinct("id").alias("ids"))


@query("SELECT o_orderkey, o_custkey AS score, CASE WHEN o_orderkey % 4 > 0 THEN o_orderpriority END AS label FROM orders")
def breakdown_round_trip(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("score"), F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderpriority")).alias("label"))
    kept = o.select("o_orderkey", L.packed("score", "label").alias("breakdown"))
    return kept.select("o_orderkey", L.unpacked("breakdown", "score long, label string").alias("b")).select("o_orderkey", "b.*")


@query(
    f"WITH r AS (SELECT o_orderkey, o_orderkey % 6 AS k, o_custkey % 4 AS s FROM orders WHERE o_orderkey % 6 <> 1) SELECT o_orderkey, CASE s WHEN 0 THEN 'director,owner,administrator,program director' WHEN 1 THEN 'office manager,practice manager,referral coordinator,care coordinator,physician owner' "
    "WHEN 2 THEN 'program director,family services coordinator,executive director' ELSE 'director,office manager,program director' END AS roles, CASE k WHEN 0 THEN CASE WHEN o_orderkey % 5 = 0 THEN 'Public demand signal detected; verify details.' ELSE 'Public demand signal detected: waitlist, shortage.' END "
    "WHEN 2 THEN CASE WHEN o_orderkey % 5 = 0 THEN 'Potential child/family referral source; verify before outreach.' ELSE 'Potential referral source; signals: waitlist, shortage.' END WHEN 3 THEN 'Directory/resource result; use for secondary lead research.' WHEN 4 THEN 'Possible decision-maker/contact result; verify role before outreach.' ELSE 'Weak evidence — verify before outreach.' END AS reason FROM r"
)
def lead_texts(spark: SparkSession, d: str) -> DataFrame:
    source = F.element_at(F.array(*map(F.lit, ["Preschool", "Pediatrics", "Parent group", "Library"])), (F.col("o_custkey") % 4 + 1).cast("int"))
    signals = F.when(F.col("o_orderkey") % 5 > 0, F.array(F.lit("waitlist"), F.lit("shortage"), F.lit("third")))
    rows = table(spark, d, "orders").select("o_orderkey", F.expr(KIND).alias("kind"), source.alias("source"), signals.alias("signals"))
    return L.without_competitors(rows, "kind", True).select("o_orderkey", F.array_join(L.contact_roles("source", "kind"), ",").alias("roles"), L.short_reason("kind", "signals").alias("reason"))

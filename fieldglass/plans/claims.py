"""Queries on what texts claim. Texts are composed from the rows' numbers, so the SQL knows what each says without reading it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.operators import claims as C
from fieldglass.plans.adapters import table
from fieldglass.plans.registry import query


def words(key, *texts: str):
    """The text at the key's remainder by their number."""
    return F.get(F.array(*map(F.lit, texts)), (key % len(texts)).cast("int"))


@query("SELECT p_partkey, p_partkey % 4 NOT IN (1, 2, 3) AS kept FROM part")
def household_exclusion(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    text = words(k, "A public program for each child in the county", "the boy down the road lives here", "lives at the corner, special needs", "meet at 12 Old Oak Lane today")
    return table(spark, d, "part").select("p_partkey", (~C.about_household(text)).alias("kept"))


@query("SELECT p_partkey, p_partkey % 4 IN (0, 3) AS waits FROM part")
def negation_guard(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    text = words(k, "a long waitlist", "there is no current waitlist", "staff cleared backlog and waitlist", "Waitlist of six months")
    return table(spark, d, "part").select("p_partkey", (F.lower(text).contains("waitlist") & C.not_denied(text)).alias("waits"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'inclusive,sensory' WHEN 1 THEN 'autism,aba' ELSE '' END AS found, CASE p_partkey % 3 WHEN 0 THEN 'By community member, Inclusive and SENSORY; inclusive' WHEN 1 THEN 'mail community account Autism aba' ELSE 'plain' END AS redacted FROM part")
def inclusion_language(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    text = words(k, "By u/some_one, Inclusive and SENSORY; inclusive", "mail @who.is Autism aba", "plain")
    return table(spark, d, "part").select("p_partkey", F.array_join(C.inclusion(text), ",").alias("found"), C.redacted(text).alias("redacted"))


CUES, ADULTS = r"(?i)\b(school|preschool)\b", r"(?i)\b(adults? (ages?|services?|program)|seniors?)\b"


@query("SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'explicit_target' WHEN 1 THEN 'target_subset' WHEN 2 THEN 'outside' WHEN 3 THEN 'mixed_ages' WHEN 4 THEN 'mixed_ages' WHEN 5 THEN 'outside' WHEN 6 THEN 'target_subset' ELSE 'unspecified' END AS fit, p_partkey % 8 IN (0, 1, 3) AS covers FROM part")
def public_age_fit(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    text = words(k, "serving ages 2 to 18", "ages: 5-12 and ages 6 through 11", "age range 19 to 40", "ages 2-12 and ages 30-40", "adult services at a school", "senior program", "a school", "nothing")
    text = F.when(k % 8 == 5, "seniors only").otherwise(text)
    return table(spark, d, "part").select("p_partkey", C.age_fit(text, CUES, ADULTS).alias("fit"), C.covers(text, 6, 11).alias("covers"))


@query("SELECT p_partkey, p_partkey % 6 IN (0, 2, 4) AS local FROM part")
def published_area_match(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    text = words(k, "In Cass County, Missouri today", "In Cass, Kansas", "ZIP 64012 area", "ZIP 640123", "somewhere in MO", "Casstown, Missouri")
    none = F.lit(None).cast("string")
    place = F.when(k % 6 == 4, none).otherwise("Cass County")
    return table(spark, d, "part").select("p_partkey", C.published_area(text, place, F.lit("Missouri"), F.lit("MO"), F.when((k % 6).isin(2, 3), "64012")).alias("local"))


EVIDENCE_SQL = "e AS (SELECT o_custkey AS org, o_orderkey % 6 AS publisher, o_orderkey % 7 AS t FROM orders), u AS (SELECT org, publisher, t FROM e WHERE t <> 6)"
QUALIFY_SQL = f"{EVIDENCE_SQL}, g AS (SELECT org, bool_or(t IN (0, 1)) AS covers, bool_or(t = 2) AS outside, bool_or(t IN (0, 1, 3)) AS meets, bool_or(t IN (0, 1, 2, 3)) AS found, bool_or(t = 4) AS hint, COUNT(DISTINCT CASE WHEN t IN (0, 1) THEN publisher END) AS publishers FROM u GROUP BY 1), s AS (SELECT org, CASE org % 4 WHEN 0 THEN 'aba_competitor' WHEN 1 THEN 'school_program' WHEN 2 THEN 'potential_referral' ELSE 'unclassified' END AS role, CASE WHEN covers AND outside THEN 'conflicting' WHEN covers THEN 'documented' WHEN meets THEN 'mixed' WHEN found THEN 'outside' WHEN hint THEN 'possible' ELSE 'unknown' END AS status, publishers FROM g), q AS (SELECT *, CASE role WHEN 'potential_referral' THEN 15 WHEN 'school_program' THEN 10 WHEN 'aba_competitor' THEN 0 ELSE -6 END + CASE status WHEN 'documented' THEN 30 WHEN 'possible' THEN 10 WHEN 'mixed' THEN 2 WHEN 'conflicting' THEN -15 WHEN 'outside' THEN -30 ELSE 0 END + least(10, publishers * 5) AS priority FROM s)"


def _qualified(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    name = words(c, "ABA Therapy Place", "School District 9", "Pediatrician Group", "Something")
    text = words(k, "ages 5 to 12", "serving ages 6-11", "ages 13-18", "ages 8 to 14", "an elementary school", "nothing said", "ages 6 to 11, my daughter lives at the lake")
    rows = table(spark, d, "orders").select(c.alias("org"), C.role_of(name, F.lit(False)).alias("role"), F.lit("a.org").alias("host"), F.concat(F.lit("p"), k % 6).alias("publisher"), text.alias("text"))
    return C.qualify(rows, "org", 6, 11)


@query(f"WITH {QUALIFY_SQL} SELECT org, role, status, publishers, priority FROM q")
def age_qualification(spark: SparkSession, d: str) -> DataFrame:
    return _qualified(spark, d)


@query(f"WITH {QUALIFY_SQL} SELECT org, CAST(priority + CASE WHEN role = 'aba_competitor' THEN 0 ELSE floor((org % 100) / 10.0E0 + 0.5E0) END AS BIGINT) AS priority FROM q WHERE status <> 'outside'")
def qualified_lead_order(spark: SparkSession, d: str) -> DataFrame:
    return C.lead_order(_qualified(spark, d).withColumn("score", F.col("org") % 100)).select("org", "priority")


SAID = ("we are accepting new patients", "intake closed", "now hiring staff", "no open positions", "now enrolling; apply now", "plain", "not accepting new people, accepting new clients later")
#: A publisher votes once for a claim, and what an earlier vote told is no vote: a pass over each entity's entries by publisher and order.
VOTE_SQL = (
    "e AS (SELECT o_custkey AS entity, o_orderkey AS pos, 'p' || CAST(o_orderkey % 5 AS VARCHAR) AS publisher, o_orderkey % 3 AS kind, o_orderkey % 7 AS t, o_orderkey % 7 + 10 * (o_orderkey % 4) AS story FROM orders), "
    "y AS (SELECT entity, publisher, coalesce(arg_max(kind, pos) FILTER (WHERE kind < 2), arg_min(kind, pos)) AS type, MIN(pos) AS since FROM e GROUP BY 1, 2), "
    "f AS (SELECT e.entity, e.publisher, type < 2 AS authority, story, since, pos, unnest(CASE t WHEN 0 THEN ['service_available'] WHEN 1 THEN ['service_unavailable'] WHEN 2 THEN ['hiring'] WHEN 3 THEN ['not_hiring'] WHEN 4 THEN ['service_available', 'hiring'] ELSE [] END) AS claim FROM e JOIN y USING (entity, publisher) WHERE type <> 2), "
    "q AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY entity, claim ORDER BY since, publisher, pos) AS n FROM f), "
    "pass AS (SELECT entity, claim, 0::BIGINT AS n, []::VARCHAR[] AS ps, []::BIGINT[] AS ss, false AS authority, 0::BIGINT AS publishers FROM (SELECT DISTINCT entity, claim FROM f) UNION ALL SELECT p.entity, p.claim, q.n, CASE WHEN list_contains(ps, q.publisher) OR list_contains(ss, q.story) THEN ps ELSE list_append(ps, q.publisher) END, CASE WHEN list_contains(ps, q.publisher) OR list_contains(ss, q.story) THEN ss ELSE list_append(ss, q.story) END, p.authority OR (q.authority AND NOT (list_contains(ps, q.publisher) OR list_contains(ss, q.story))), p.publishers + CASE WHEN list_contains(ps, q.publisher) OR list_contains(ss, q.story) THEN 0 ELSE 1 END FROM pass p JOIN q ON q.entity = p.entity AND q.claim = p.claim AND q.n = p.n + 1), "
    "v AS (SELECT entity, claim, MAX(publishers) AS publishers, bool_or(authority) AS authority FROM pass GROUP BY 1, 2), "
    "votes AS (SELECT v.*, w.claim IS NOT NULL AS contradicted, v.publishers >= 2 AND v.authority AND w.claim IS NULL AS supported FROM v LEFT JOIN v w ON v.entity = w.entity AND w.claim = CASE v.claim WHEN 'service_available' THEN 'service_unavailable' WHEN 'service_unavailable' THEN 'service_available' WHEN 'hiring' THEN 'not_hiring' ELSE 'hiring' END)"
)


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    text = F.concat(words(k, *SAID), F.lit(" variant"), k % 4)
    return table(spark, d, "orders").select(F.col("o_custkey").alias("entity"), k.alias("at"), F.concat(F.lit("p"), k % 5).alias("publisher"), words(k, "government", "first_party", "community").alias("kind"), text.alias("text"))


@query(f"WITH RECURSIVE {VOTE_SQL} SELECT entity, claim, publishers, authority, contradicted, supported FROM votes")
def claim_votes(spark: SparkSession, d: str) -> DataFrame:
    return C.claim_votes(_evidence(spark, d), "entity")


@query(
    f"WITH RECURSIVE {VOTE_SQL}, b AS (SELECT entity, COUNT(*) AS publishers, COUNT(*) FILTER (WHERE type = 1) AS first_party, COUNT(*) FILTER (WHERE type = 0) AS government, COUNT(*) FILTER (WHERE type = 2) AS community FROM y GROUP BY 1), s AS (SELECT entity, COUNT(*) FILTER (WHERE supported) AS confirmed, bool_or(contradicted) AS conflict FROM votes GROUP BY 1) "
    "SELECT b.*, coalesce(confirmed, 0) AS confirmed, CASE WHEN coalesce(conflict, false) THEN 'conflicting' WHEN publishers = 0 THEN 'no_evidence' WHEN coalesce(confirmed, 0) > 0 THEN 'corroborated' ELSE 'single_source' END AS posture FROM b LEFT JOIN s USING (entity)"
)
def evidence_graph(spark: SparkSession, d: str) -> DataFrame:
    rows = _evidence(spark, d)
    return C.evidence_graph(rows, C.claim_votes(rows, "entity"), "entity")


@query(
    "WITH h AS (SELECT o_custkey AS org, 'p' || CAST(o_orderkey % 5 AS VARCHAR) AS publisher, o_orderkey AS pos, o_orderkey % 6 AS t, o_orderkey % 9 AS n FROM orders WHERE o_orderkey % 6 NOT IN (4, 5) AND o_orderkey % 7 > 1), f AS (SELECT org, publisher, pos, t, n, unnest(CASE t WHEN 0 THEN ['positive_feedback'] WHEN 1 THEN ['staffing', 'intake_wait'] WHEN 2 THEN ['intake_wait'] ELSE ['positive_feedback', 'insurance'] END) AS theme FROM h), "
    "o AS (SELECT * FROM f QUALIFY ROW_NUMBER() OVER (PARTITION BY org, theme, t, n ORDER BY pos) = 1) SELECT org, theme, COUNT(DISTINCT publisher) AS publishers, CASE WHEN theme = 'positive_feedback' THEN 'positive' ELSE 'concern' END AS sentiment, COUNT(DISTINCT publisher) >= 2 AS corroborated FROM o GROUP BY 1, 2"
)
def review_themes(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    said = words(k, "praised for its staff", "staff turnover, a long wait", "long wait, ABA", "commended care, billing dispute", "my son had a long wait", "a long wait elsewhere")
    title = F.concat(F.lit("Bright Oak, Clinic "), c)
    about = F.when(k % 6 == 5, F.lit("another place")).otherwise(title)
    host = F.when(k % 7 == 0, "m.yelp.com").when(k % 7 == 1, F.concat(F.lit("www.oak"), c, F.lit(".org"))).otherwise(F.concat(F.lit("p"), k % 5, F.lit(".org")))
    hits = table(spark, d, "orders").select(c.alias("org"), F.concat(F.lit("BRIGHT oak clinic "), c).alias("name"), F.concat(F.lit("oak"), c, F.lit(".org")).alias("domain"), k.alias("at"), host.alias("host"), F.concat(F.lit("p"), k % 5).alias("publisher"), about.alias("title"), F.concat(said, F.lit(" v"), k % 9).alias("snippet"))
    return C.review_themes(hits, "org")


REFERRAL, DEMAND, COMPETITOR, CONTACT = ("referral", "pediatric", "school"), ("waitlist", "seeking", "need"), ("bcba", "rbt"), ("director", "intake")
OPP_SQL = (
    "r AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'Referral Source' WHEN 1 THEN 'Demand Signal' WHEN 2 THEN 'Competitor / Market Signal' ELSE 'Other' END AS class, p_partkey % 4 AS referral, CASE WHEN p_size % 3 = 0 THEN 2 ELSE 0 END AS demand, CASE WHEN p_size % 7 = 0 THEN 1 ELSE 0 END AS rival, CASE WHEN p_size % 5 = 0 THEN 1 ELSE 0 END AS contact, p_partkey % 3 <> 0 AS url, CASE p_size % 3 WHEN 0 THEN 'High' WHEN 1 THEN 'Medium' ELSE 'Low' END AS sure, p_size % 2 = 0 AS place FROM part), "
    "s AS (SELECT *, class = 'Competitor / Market Signal' OR rival > 0 AS comp, CASE WHEN class = 'Referral Source' THEN least(20, 8 + referral * 4) ELSE 0 END + least(20, demand * 5) + CASE WHEN class = 'Competitor / Market Signal' OR rival > 0 THEN 0 ELSE 15 END + CASE WHEN contact > 0 THEN least(15, 8 + contact * 3) ELSE 4 END + CASE WHEN referral + demand + rival + contact >= 4 THEN 8 WHEN referral + demand + rival + contact >= 2 THEN 5 ELSE 2 END + CASE WHEN place THEN 8 ELSE 4 END + CASE sure WHEN 'High' THEN 10 WHEN 'Medium' THEN 6 ELSE 2 END AS raw FROM r), "
    "o AS (SELECT *, CAST(least(raw, CASE WHEN comp THEN 45 ELSE 999 END, CASE WHEN class = 'Demand Signal' THEN 65 ELSE 999 END, CASE WHEN NOT url THEN 55 ELSE 999 END, CASE WHEN sure = 'Low' THEN 69 ELSE 999 END) AS BIGINT) AS total FROM s)"
)


def _opportunities(spark: SparkSession, d: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    text = F.concat_ws(" ", words(k, "", "referral", "referral pediatric", "referral pediatric school"), F.when(s % 3 == 0, "waitlist need"), F.when(s % 7 == 0, "bcba"), F.when(s % 5 == 0, "intake"))
    rows = table(spark, d, "part").select(k.alias("id"), words(k, "Referral Source", "Demand Signal", "Competitor / Market Signal", "Other").alias("class"), text.alias("text"), (k % 3 != 0).alias("has_evidence"), words(s, "High", "Medium", "Low").alias("evidence_confidence"), (s % 2 == 0).alias("has_location"))
    n = {f"n_{name}": F.size(C.terms_in(F.col("text"), terms)) for name, terms in (("referral", REFERRAL), ("demand", DEMAND), ("competitor", COMPETITOR), ("contact", CONTACT))}
    rows = rows.withColumns(n).withColumns({"n_signals": sum((F.col(c) for c in n), F.lit(0)), "autism_support": F.contains("text", F.lit("autism support"))})
    return C.opportunity(rows)


@query(f"WITH {OPP_SQL} SELECT id, class, referral AS n_referral, demand AS n_demand, total FROM o")
def opportunity_score(spark: SparkSession, d: str) -> DataFrame:
    return _opportunities(spark, d).select("id", "class", "n_referral", "n_demand", "total")


@query(f"WITH {OPP_SQL} SELECT COUNT(*) FILTER (WHERE class = 'Referral Source') AS referral, COUNT(*) FILTER (WHERE total >= 85) AS high, COUNT(*) FILTER (WHERE total >= 70 AND class = 'Referral Source') AS ready, COUNT(*) FILTER (WHERE class = 'Demand Signal') AS demand, COUNT(*) FILTER (WHERE class = 'Competitor / Market Signal') AS rivals, COUNT(*) FILTER (WHERE contact = 0) AS no_contact FROM o")
def opportunity_metrics(spark: SparkSession, d: str) -> DataFrame:
    n, c = F.count_if, F.col
    return _opportunities(spark, d).agg(n(c("class") == "Referral Source").alias("referral"), n(c("total") >= 85).alias("high"), n((c("total") >= 70) & (c("class") == "Referral Source")).alias("ready"), n(c("class") == "Demand Signal").alias("demand"), n(c("class") == "Competitor / Market Signal").alias("rivals"), n(c("n_contact") == 0).alias("no_contact"))


@query(
    "WITH f AS (SELECT DISTINCT 'r' || CAST(s_suppkey % 4 AS VARCHAR) AS rule, s_suppkey % 12 AS publisher, s_suppkey % 12 IN (0, 5) AS inst FROM supplier), p AS (SELECT * FROM (VALUES ('x1', 'r0', 'r1'), ('x2', 'r1', 'r2'), ('x3', 'r3', 'r9')) t(name, a, b)), "
    "j AS (SELECT name, (SELECT COUNT(*) FROM f WHERE rule = a) AS l, (SELECT COUNT(*) FROM f WHERE rule = b) AS r, (SELECT COUNT(DISTINCT publisher) FROM f WHERE rule IN (a, b)) AS publishers, (SELECT coalesce(bool_or(inst), false) FROM f WHERE rule IN (a, b)) AS inst FROM p) SELECT name, publishers, CASE WHEN l >= 2 AND r >= 2 AND publishers >= 3 AND inst THEN 'supported' WHEN publishers > 0 THEN 'partial' ELSE 'unobserved' END AS status FROM j"
)
def document_checks(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    found = table(spark, d, "supplier").select(F.concat(F.lit("r"), k % 4).alias("rule"), F.concat(F.lit("p"), k % 12).alias("publisher"), (k % 12).isin(0, 5).alias("institutional"))
    return C.document_checks(found, spark.createDataFrame([("x1", "r0", "r1"), ("x2", "r1", "r2"), ("x3", "r3", "r9")], "name string, a string, b string"))

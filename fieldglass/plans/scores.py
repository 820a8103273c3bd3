"""Queries that score: observations, engines, reliability, territories and rules that gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.functions.exprs import weighted_mean
from fieldglass.functions.text import age_years
from fieldglass.operators import scoring
from fieldglass.plans.adapters import table
from fieldglass.plans.registry import query

OBS_SQL = "obs AS (SELECT 'i' || CAST(p_size AS VARCHAR) AS indicator, p_partkey % 101 AS value, p_partkey % 90 AS confidence, p_brand AS source FROM part)"
DIM_SQL = (
    "dim AS (SELECT DISTINCT 'i' || CAST(p_size AS VARCHAR) AS indicator, CASE WHEN p_size % 6 = 1 THEN 'evidence-quality' ELSE 'p' || CAST(p_size % 6 AS VARCHAR) END AS pillar, "
    "CASE WHEN p_size % 6 = 5 THEN 'gate' WHEN p_size % 11 = 0 THEN 'confidence' WHEN p_size % 3 = 0 THEN 'lower' ELSE 'higher' END AS direction, CASE WHEN p_size % 7 = 0 THEN ['client'] ELSE ['client', 'staff'] END AS engines FROM part)"
)
WEIGHT_ROWS = [("p0", "client", 13), ("evidence-quality", "client", 8), ("p2", "client", 5), ("p3", "client", 0), ("p0", "staff", 2), ("p3", "staff", 24), ("p4", "staff", 7), ("p5", "staff", 9)]
WEIGHT_SQL = "w AS (SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{e}', {w})" for p, e, w in WEIGHT_ROWS) + ") v(pillar, engine, weight))"
ENGINE_SQL = (
    f"{OBS_SQL}, {DIM_SQL}, {WEIGHT_SQL}, seen AS (SELECT * FROM obs JOIN dim USING (indicator)), app AS (SELECT unnest(engines) AS engine, pillar, CASE WHEN direction = 'lower' THEN 100 - value ELSE value END AS v, confidence AS c FROM seen WHERE direction IN ('higher', 'lower')), "
    "pil AS (SELECT engine, pillar, floor(CASE WHEN SUM(c) > 0 THEN SUM(v * c) * 1.0E0 / SUM(c) ELSE AVG(v) END + 0.5E0) AS v, SUM(c) AS c, COUNT(*) AS n FROM app GROUP BY 1, 2), "
    "eng AS (SELECT engine, SUM(v * weight) FILTER (WHERE weight > 0) / SUM(weight) FILTER (WHERE weight > 0) AS s, floor(SUM(c) * 1.0E0 / SUM(n) + 0.5E0) AS c, CAST(SUM(n) AS BIGINT) AS observed, COUNT(*) FILTER (WHERE weight > 0) AS pillars, COUNT(*) FILTER (WHERE weight > 0 AND pillar <> 'evidence-quality') AS substantive FROM pil LEFT JOIN w USING (engine, pillar) GROUP BY 1), "
    "could AS (SELECT engine, COUNT(*) AS applicable FROM (SELECT unnest(engines) AS engine FROM dim WHERE direction IN ('higher', 'lower')) GROUP BY 1), said AS (SELECT floor(AVG(value) + 0.5E0) AS said FROM seen WHERE direction = 'confidence'), "
    "cov AS (SELECT *, least(100.0E0, floor(observed * 100.0E0 / applicable + 0.5E0)) AS coverage FROM could JOIN eng USING (engine), said), "
    "score AS (SELECT engine, floor(s + 0.5E0) AS score, coverage, least(100.0E0, floor(0.55E0 * c + 0.25E0 * coalesce(said, c) + 0.2E0 * coverage + 0.5E0)) AS confidence, observed, applicable, pillars, substantive FROM cov)"
)


def observations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.concat(F.lit("i"), "p_size").alias("indicator"), (F.col("p_partkey") % 101).alias("value"), (F.col("p_partkey") % 90).alias("confidence"), F.col("p_brand").alias("source"))


def engines(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    pillar = F.when(size % 6 == 1, "evidence-quality").otherwise(F.concat(F.lit("p"), size % 6))
    direction = F.when(size % 6 == 5, "gate").when(size % 11 == 0, "confidence").when(size % 3 == 0, "lower").otherwise("higher")
    engine = F.when(size % 7 == 0, F.array(F.lit("client"))).otherwise(F.array(F.lit("client"), F.lit("staff")))
    dims = table(spark, d, "part").select(F.concat(F.lit("i"), size).alias("indicator"), pillar.alias("pillar"), direction.alias("direction"), engine.alias("engines")).distinct()
    weights = spark.createDataFrame(WEIGHT_ROWS, "pillar string, engine string, weight int")
    return scoring.engine_scores(observations(spark, d), dims, weights)


@query(f"WITH {OBS_SQL} SELECT indicator, floor(AVG(value) + 0.5E0) AS value, floor(AVG(confidence) + 0.5E0) AS confidence, COUNT(DISTINCT source) AS sources FROM obs GROUP BY 1")
def grouped_observations(spark: SparkSession, d: str) -> DataFrame:
    return scoring.group_observations(observations(spark, d), "indicator")


@query(f"WITH {OBS_SQL} SELECT source, floor(CASE WHEN SUM(confidence) > 0 THEN SUM(value * confidence) * 1.0E0 / SUM(confidence) ELSE AVG(value) END + 0.5E0) AS mean FROM obs GROUP BY 1")
def confidence_weighted_mean(spark: SparkSession, d: str) -> DataFrame:
    return observations(spark, d).groupBy("source").agg(weighted_mean("value", "confidence").alias("mean"))


@query(f"WITH {ENGINE_SQL} SELECT * FROM score")
def engine_score(spark: SparkSession, d: str) -> DataFrame:
    return engines(spark, d)


GRADE_SQL = "CASE WHEN coverage < 12 OR observed < 12 OR substantive < 3 OR publishers < 2 THEN 'insufficient' WHEN coverage < 25 OR observed < 25 OR publishers < 4 THEN 'preliminary' ELSE 'supported' END"


@query(
    f"WITH {ENGINE_SQL}, s AS (SELECT *, pillars - 1 AS publishers FROM score), g AS (SELECT *, {GRADE_SQL} AS grade FROM s) SELECT engine, grade, concat_ws(',', CASE WHEN coverage < 12 THEN 'coverage' END, CASE WHEN observed < 12 THEN 'indicators' END, CASE WHEN substantive < 3 THEN 'pillars' END, CASE WHEN publishers < 2 THEN 'publishers' END) AS lacking, "
    "CASE WHEN grade <> 'insufficient' THEN score END AS shown, CASE WHEN grade = 'insufficient' THEN 'Insufficient Evidence' WHEN grade = 'preliminary' THEN 'Preliminary Estimate' WHEN score >= 80 THEN 'Very High' WHEN score >= 65 THEN 'High' WHEN score >= 45 THEN 'Moderate' WHEN score > 0 THEN 'Early Signal' ELSE 'Low' END AS label FROM g"
)
def reliability_grade(spark: SparkSession, d: str) -> DataFrame:
    return scoring.reliability(engines(spark, d).withColumn("publishers", F.col("pillars") - 1)).select("engine", "grade", "lacking", "shown", "label")


LEAD_SQL = (
    "lead AS (SELECT user_id AS territory, CASE event_type WHEN 'view' THEN 'community_signal' WHEN 'signup' THEN 'referral' WHEN 'error' THEN 'organization' WHEN 'click' THEN 'candidate' ELSE 'talent_signal' END AS kind, "
    "CASE event_id % 5 WHEN 0 THEN ['waitlist', 'aba'] WHEN 1 THEN ['hiring', 'pediatric'] WHEN 2 THEN ['aba'] ELSE [] END AS signals, event_id % 100 AS confidence FROM events)"
)
SCALED = "least(100.0E0, floor((COUNT(*) FILTER (WHERE {t})) * 100.0E0 / {n} + 0.5E0))"
PARTS_SQL = (
    f"sig AS (SELECT territory, {SCALED.format(t="kind = 'community_signal'", n=12)} AS demand, 0.0E0 AS children, {SCALED.format(t="kind = 'referral'", n=18)} AS referral, {SCALED.format(t="list_contains(signals, 'pediatric')", n=16)} AS developmental, "
    f"CASE WHEN COUNT(*) FILTER (WHERE kind = 'organization') >= 3 THEN greatest(15.0E0, 100 - {SCALED.format(t="kind = 'organization' AND list_contains(signals, 'aba')", n=14)}) ELSE 0 END AS scarcity, {SCALED.format(t="list_contains(signals, 'waitlist')", n=8)} AS waitlist, "
    "least(100.0E0, floor((COUNT(*) FILTER (WHERE kind IN ('candidate', 'talent_signal')) + COUNT(*) FILTER (WHERE list_contains(signals, 'hiring'))) * 100.0E0 / 12 + 0.5E0)) AS talent, 0.0E0 AS trend, floor(AVG(confidence) + 0.5E0) AS evidence FROM lead GROUP BY 1)"
)
TOTAL_SQL = " + ".join(f"floor({k} / 100.0E0 * {w} + 0.5E0)" for k, w in scoring.TERRITORY_WEIGHTS.items())


@query(f"WITH {LEAD_SQL}, {PARTS_SQL}, t AS (SELECT territory, CAST({TOTAL_SQL} AS BIGINT) AS total, CAST(floor(evidence * 0.6E0 + floor(({' + '.join(scoring.TERRITORY_WEIGHTS)}) / 9.0E0 + 0.5E0) * 0.4E0 + 0.5E0) AS BIGINT) AS confidence FROM sig) SELECT *, CASE WHEN total >= 80 THEN 'Very High' WHEN total >= 65 THEN 'High' WHEN total >= 45 THEN 'Moderate' ELSE 'Low' END AS label FROM t")
def territory_score(spark: SparkSession, d: str) -> DataFrame:
    kinds = {"view": "community_signal", "signup": "referral", "error": "organization", "click": "candidate"}
    kind, k = F.lit("talent_signal"), F.col("event_id") % 5
    for event, name in kinds.items():
        kind = F.when(F.col("event_type") == event, name).otherwise(kind)
    words = lambda *x: F.array(*map(F.lit, x))
    signals = F.when(k == 0, words("waitlist", "aba")).when(k == 1, words("hiring", "pediatric")).when(k == 2, words("aba")).otherwise(F.array().cast("array<string>"))
    leads = table(spark, d, "events").select(F.col("user_id").alias("territory"), kind.alias("kind"), signals.alias("signals"), (F.col("event_id") % 100).alias("confidence"))
    return scoring.territory(scoring.territory_signals(leads, "territory")).select("territory", "total", "confidence", "label")


RULE_ROWS = [("r1", "F", ["1-URGENT", "2-HIGH"], ["unknown"], "license", "REVIEW", 0), ("r2", "O", ["1-URGENT"], ["p1", "p2"], "credential", "REVIEW", 90), ("r3", "O", ["5-LOW"], ["unknown"], "supervision", "REVIEW", 0), ("r4", "P", ["1-URGENT", "5-LOW"], ["unknown"], None, "BLOCK", 0), ("r5", "F", ["3-MEDIUM"], ["p0"], "credential", "REVIEW", 90)]


@query(
    "WITH r AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{s}', {r}, {p}, {repr(need) if need else 'NULL'}, '{post}', {g})" for n, s, r, p, need, post, g in RULE_ROWS) + ") v(rule, state, roles, payers, needs, posture, grace_days)), "
    "c AS (SELECT o_orderkey AS context, o_orderstatus AS state, o_orderpriority AS role, CASE WHEN o_custkey % 5 < 4 THEN 'p' || CAST(o_custkey % 5 AS VARCHAR) ELSE 'unknown' END AS payer, CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS held, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) END AS since FROM orders) "
    "SELECT context, rule, CASE WHEN needs IN ('license', 'supervision') THEN CASE WHEN held THEN 'PASS' WHEN NOT held THEN 'BLOCK' ELSE 'REVIEW' END WHEN needs = 'credential' THEN CASE WHEN held THEN 'PASS' WHEN DATE '1996-06-01' - since > grace_days THEN 'BLOCK' ELSE 'REVIEW' END ELSE posture END AS decision FROM c JOIN r USING (state) WHERE list_contains(roles, role) AND (list_contains(payers, payer) OR list_contains(payers, 'unknown'))"
)
def regulatory_eval(spark: SparkSession, d: str) -> DataFrame:
    from datetime import date

    rules = spark.createDataFrame(RULE_ROWS, "rule string, state string, roles array<string>, payers array<string>, needs string, posture string, grace_days int")
    k, held = F.col("o_orderkey"), F.when(F.col("o_orderkey") % 3 == 0, True).when(F.col("o_orderkey") % 3 == 1, False)
    payer = F.when(F.col("o_custkey") % 5 < 4, F.concat(F.lit("p"), F.col("o_custkey") % 5))
    contexts = table(spark, d, "orders").select(k.alias("context"), F.col("o_orderstatus").alias("state"), F.col("o_orderpriority").alias("role"), payer.alias("payer"), *(held.alias(c) for c in ("license", "supervision", "credential")), F.when(k % 7 != 0, F.to_date("o_orderdate")).alias("since"))
    return scoring.regulatory(contexts, rules, F.lit(date(1996, 6, 1)))


@query("SELECT p_partkey, CASE WHEN p_size % 9 = 0 OR p_size % 7 = 0 THEN NULL ELSE p_size <= 12 AND (p_size + p_size % 5) >= 2 END AS overlaps FROM part")
def interval_overlap(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("p_size")
    p = table(spark, d, "part").select("p_partkey", F.when((s % 9 != 0) & (s % 7 != 0), s).alias("low"), F.when(s % 9 != 0, s + s % 5).alias("high"))
    return p.select("p_partkey", scoring.serves("low", "high", 2, 12).alias("overlaps"))


@query("SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN floor((p_size + (p_size % 12) / 12.0E0) * 100 + 0.5E0) / 100 WHEN 1 THEN floor(p_size / 52.0E0 * 100 + 0.5E0) / 100 WHEN 2 THEN CASE WHEN p_size <= 21 THEN p_size * 1.0E0 END WHEN 3 THEN p_size + 0.5E0 END AS years FROM part")
def age_text_years(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("p_size")
    t = F.when(s % 5 == 0, F.concat(s, F.lit(" YRS "), s % 12, F.lit(" MOS"))).when(s % 5 == 1, F.concat(s, F.lit(" WKS"))).when(s % 5 == 2, s.cast("string")).when(s % 5 == 3, F.concat(s, F.lit(".5 yrs"))).otherwise(F.lit("9 days"))
    return table(spark, d, "part").select("p_partkey", age_years(t).alias("years"))

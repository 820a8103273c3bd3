"""Queries that rank areas: indicators, percentiles, agreement, composites and what explains them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldglass.functions.exprs import agreement, consensus, lower_rank, mid_rank, miles, ratio, smoothed, upper_median
from fieldglass.functions.store import stored
from fieldglass.operators import frames, ranking
from fieldglass.operators.indicators import INDICATORS, SHARES
from fieldglass.operators.ranking import FAMILY_WEIGHTS
from fieldglass.plans.adapters import AREA_SQL, METRICS, area_frame
from fieldglass.plans.registry import query

MID = "CASE WHEN {v} IS NOT NULL AND COUNT({v}) OVER (PARTITION BY {g}) >= {k} THEN ((RANK() OVER (PARTITION BY {g} ORDER BY {v} ASC NULLS LAST) - 1) + COUNT({v}) OVER (PARTITION BY {g}, {v}) / 2.0E0) * 1.0E0 / COUNT({v}) OVER (PARTITION BY {g}) * 100 END"
MILES = "2 * 3958.8E0 * asin(least(1.0E0, sqrt(pow(sin((radians({b}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({d} - {c}) / 2), 2))))"


def mid_sql(v: str, g: str, k: int = 1) -> str:
    return MID.format(v=v, g=g, k=k)


def miles_sql(a: str, c: str, b: str, d: str) -> str:
    return MILES.format(a=a, b=b, c=c, d=d)


def nearest_adequate(frame: DataFrame, rate: str, group: str = "state", area: str = "area") -> DataFrame:
    """Miles from each area to the nearest of its group whose rate is at or above the group's median; 0 if it is one itself.

    Areas meet only the distinct places of adequate areas in their group.
    """
    level = frame.where(F.col(rate).isNotNull()).groupBy(group).agg(F.median(rate).alias("__level"))
    rows = frame.join(level, group, "left")
    good = rows.where(F.col(rate) >= F.col("__level")).select(F.col(group).alias("__group"), F.col("lat").alias("__lat"), F.col("lon").alias("__lon")).distinct()
    met = rows.join(good, F.col(group) == F.col("__group"), "left")
    far = F.min(miles("lat", "lon", "__lat", "__lon"))
    return met.groupBy(group, area).agg(F.when(F.max(F.col(rate) >= F.col("__level")), F.lit(0.0)).otherwise(far).alias("miles"))


def metric_frame(spark: SparkSession, d: str) -> DataFrame:
    """All metrics of the indicators, with the nearest-supply distances and the percentiles that agreements compare."""
    base = area_frame(spark, d)
    wide = base.select("state", "area", "lat", "lon", *(F.expr(sql).alias(k) for k, sql in METRICS.items()))
    keys = ["state", "area"]
    # All rates in one long table, so that each kind of comparison is one shuffle and one sort.
    rates = wide.select(*keys, "lat", "lon", ratio("bh", "kids").alias("miles_bh"), ratio("aba", "kids").alias("miles_aba")).unpivot([*keys, "lat", "lon"], ["miles_bh", "miles_aba"], "name", "rate")
    near = nearest_adequate(rates.withColumns({"group": F.concat_ws("|", "state", "name"), "key": F.concat_ws("|", "area", "name")}), "rate", "group", "key")
    near = near.select(F.substring_index("group", "|", 1).alias("state"), F.substring_index("key", "|", 1).alias("area"), F.substring_index("key", "|", -1).alias("name"), "miles")
    near = near.groupBy(*keys).pivot("name", ["miles_bh", "miles_aba"]).agg(F.first("miles"))
    shares = wide.select(*keys, *(F.expr(f"CASE WHEN {b} > 0 THEN ({a}) / {b} END").alias(name) for name, (a, b) in SHARES.items())).unpivot(keys, list(SHARES), "name", "share")
    shares = shares.withColumn("pct", mid_rank("share", "state", "name", least=3)).groupBy(*keys).pivot("name", list(SHARES)).agg(F.first("pct"))
    return wide.join(near, keys).join(shares, keys)


def _near_sql(name: str) -> str:
    return f"""
level_{name} AS (SELECT state, median({name} / kids) AS level FROM metric WHERE kids > 0 AND {name} IS NOT NULL GROUP BY 1),
good_{name} AS (SELECT DISTINCT state, lat, lon FROM metric JOIN level_{name} USING (state) WHERE {name} / kids >= level),
near_{name} AS (SELECT m.state, m.area, CASE WHEN MAX(CAST({name} / kids >= level AS INT)) = 1 THEN 0.0E0 ELSE MIN({miles_sql("m.lat", "m.lon", "g.lat", "g.lon")}) END AS miles_{name}
  FROM metric m LEFT JOIN level_{name} l ON m.state = l.state LEFT JOIN good_{name} g ON m.state = g.state GROUP BY 1, 2)"""


METRIC_SQL = (
    f"WITH {AREA_SQL}, metric AS (SELECT state, area, lat, lon, {', '.join(f'{sql} AS {k}' for k, sql in METRICS.items())} FROM frame), {_near_sql('bh')}, {_near_sql('aba')}, "
    f"shared AS (SELECT *, {', '.join(f'CASE WHEN {b} > 0 THEN ({a}) / {b} END AS s_{k}' for k, (a, b) in SHARES.items())} FROM metric), "
    f"wide AS (SELECT shared.*, miles_bh, miles_aba, {', '.join(f'{mid_sql(f's_{k}', 'shared.state', 3)} AS {k}' for k in SHARES)} FROM shared JOIN near_bh ON shared.state = near_bh.state AND shared.area = near_bh.area JOIN near_aba ON shared.state = near_aba.state AND shared.area = near_aba.area), "
    f"raws AS ({' UNION ALL '.join(f"SELECT state, area, '{x.id}' AS indicator, '{x.family}' AS family, '{x.direction}' AS direction, CAST({x.sql} AS DOUBLE) AS raw FROM wide" for x in INDICATORS)}), "
    f"pcts AS (SELECT *, {mid_sql('raw', 'state, indicator', 5)} AS pct FROM raws), "
    "scored AS (SELECT state, area, indicator, family, direction, raw, CASE WHEN direction = 'agreement' THEN raw WHEN direction = 'lower' THEN floor(100 - pct + 0.5E0) ELSE floor(pct + 0.5E0) END AS score FROM pcts), "
    f"composed AS (SELECT state, area, floor(100.0E0 * COUNT(*) FILTER (WHERE direction <> 'agreement' AND score IS NOT NULL) / COUNT(*) FILTER (WHERE direction <> 'agreement') + 0.5E0) AS coverage, floor(AVG(score) FILTER (WHERE direction = 'agreement') + 0.5E0) AS agreement, SUM(score * w) FILTER (WHERE direction <> 'agreement') AS total, SUM(w) FILTER (WHERE direction <> 'agreement' AND score IS NOT NULL) AS weight "
    f"FROM (SELECT *, CASE {' '.join(f"WHEN family = '{k}' THEN CAST({v} AS DOUBLE)" for k, v in FAMILY_WEIGHTS.items())} ELSE 0 END AS w FROM scored) GROUP BY 1, 2), "
    f"rated AS (SELECT state, area, coverage, agreement, CASE WHEN coverage >= 50 AND weight > 0 THEN floor(total / weight + 0.5E0) END AS composite, least(85.0E0, greatest(0.0E0, least(100.0E0, floor(0.45E0 * coverage + 0.35E0 * coalesce(agreement, 50.0E0) + 0.2E0 * share + 0.5E0) - CASE WHEN kids < 2500 THEN 15 ELSE 0 END))) AS confidence FROM composed JOIN (SELECT state, area, kids, 40.0E0 + 60 * CAST(area LIKE '%U%' AS INT) AS share FROM metric) USING (state, area)) "
)


@query(METRIC_SQL + "SELECT state, area, composite, round(coverage, 4) AS coverage, round(agreement, 4) AS agreement, confidence, CASE WHEN composite IS NOT NULL THEN ROW_NUMBER() OVER (PARTITION BY state ORDER BY composite DESC NULLS LAST, confidence DESC, area) END AS rank, COUNT(composite) OVER (PARTITION BY state) AS ranked_of FROM rated")
def area_ranking(spark: SparkSession, d: str) -> DataFrame:
    frame = stored(metric_frame(spark, d))  # a row for each area, used three times
    programs = frame.select("state", "area", (40.0 + 60 * F.contains("area", F.lit("U")).cast("int")).alias("program_share"))
    out = ranking.rank_areas(frame, INDICATORS, programs, frame.select("state", "area", F.col("kids").alias("children")))
    return out.select("state", "area", "composite", F.round("coverage", 4).alias("coverage"), F.round("agreement", 4).alias("agreement"), "confidence", "rank", "ranked_of")


@query(METRIC_SQL + "SELECT state, area, indicator, family, direction, round(raw, 5) AS raw FROM raws")
def area_indicators(spark: SparkSession, d: str) -> DataFrame:
    return ranking.compute(metric_frame(spark, d), INDICATORS).withColumn("raw", F.round("raw", 5))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return ranking.percentiles(ranking.compute(metric_frame(spark, d), INDICATORS))


@query(METRIC_SQL + "SELECT state, area, family, floor(AVG(score) + 0.5E0) AS mean_score, COUNT(score) AS computed, COUNT(*) AS total FROM scored WHERE direction <> 'agreement' GROUP BY 1, 2, 3")
def area_family_scores(spark: SparkSession, d: str) -> DataFrame:
    return ranking.family_scores(_scored(spark, d))


@query(
    METRIC_SQL + "SELECT state, area, coalesce(string_agg(indicator, ',' ORDER BY up) FILTER (WHERE up <= 3 AND score >= 70), '') AS drivers, coalesce(string_agg(indicator, ',' ORDER BY down) FILTER (WHERE down <= 2 AND score <= 30), '') AS cautions "
    "FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY state, area ORDER BY score DESC, indicator) AS up, ROW_NUMBER() OVER (PARTITION BY state, area ORDER BY score, indicator) AS down FROM scored WHERE direction <> 'agreement' AND score IS NOT NULL) GROUP BY 1, 2"
)
def area_drivers_cautions(spark: SparkSession, d: str) -> DataFrame:
    return ranking.drivers(_scored(spark, d))


@query(METRIC_SQL + "SELECT state, area, round(miles_bh, 4) AS miles FROM near_bh")
def nearest_adequate_area(spark: SparkSession, d: str) -> DataFrame:
    wide = area_frame(spark, d).select("state", "area", "lat", "lon", F.expr(METRICS["bh"]).alias("bh"), F.expr(METRICS["kids"]).alias("kids"))
    return nearest_adequate(wide.withColumn("rate", ratio("bh", "kids")), "rate").withColumn("miles", F.round("miles", 4))


@query(f"WITH {AREA_SQL} SELECT state, area, round({mid_sql('people', 'state', 5)}, 6) AS percentile FROM frame")
def area_percentile_midrank(spark: SparkSession, d: str) -> DataFrame:
    return area_frame(spark, d).select("state", "area", F.round(mid_rank("people", "state", least=5), 6).alias("percentile"))


@query(f"WITH {AREA_SQL} SELECT state, area, round((RANK() OVER (PARTITION BY state ORDER BY rich) - 1) * 100.0E0 / COUNT(rich) OVER (PARTITION BY state), 6) AS percentile FROM frame")
def area_percentile_lower(spark: SparkSession, d: str) -> DataFrame:
    return area_frame(spark, d).select("state", "area", F.round(lower_rank("rich", "state"), 6).alias("percentile"))


@query(f"WITH {AREA_SQL} SELECT state, area, round(people * 1.0E0 / (practices + 1), 6) AS each_practice, round(CASE WHEN practices > 0 THEN people * 1.0E0 / practices * 10 END, 6) AS per_practice FROM frame")
def smoothed_ratio(spark: SparkSession, d: str) -> DataFrame:
    return area_frame(spark, d).select("state", "area", F.round(smoothed("people", "practices"), 6).alias("each_practice"), F.round(ratio("people", "practices", 10), 6).alias("per_practice"))


@query(f"WITH {AREA_SQL} SELECT state, area, greatest(0.0E0, floor(100 - abs(poor * 100.0E0 / people - rich * 100.0E0 / people) * 5 + 0.5E0)) AS agreement, CASE WHEN abs(poor * 100.0E0 / people - cared * 100.0E0 / people) <= 4 THEN round((poor * 100.0E0 / people + cared * 100.0E0 / people) / 2, 6) END AS consensus FROM frame")
def rate_agreement(spark: SparkSession, d: str) -> DataFrame:
    f = area_frame(spark, d)
    poor, rich, cared = (F.col(x) * 100.0 / F.col("people") for x in ("poor", "rich", "cared"))
    return f.select("state", "area", agreement(poor, rich, 5).alias("agreement"), F.round(consensus(poor, cared), 6).alias("consensus"))


@query(f"WITH {AREA_SQL}, p AS (SELECT state, area, {mid_sql('orders', 'state', 3)} AS a, {mid_sql('people', 'state', 3)} AS b FROM frame) SELECT state, area, round(100 - abs(a - b), 6) AS agreement FROM p")
def rank_agreement(spark: SparkSession, d: str) -> DataFrame:
    f = area_frame(spark, d).select("state", "area", mid_rank("orders", "state", least=3).alias("a"), mid_rank("people", "state", least=3).alias("b"))
    return f.select("state", "area", F.round(100 - F.abs(F.col("a") - F.col("b")), 6).alias("agreement"))


@query(f"WITH {AREA_SQL} SELECT state, CAST(SUM(people) AS BIGINT) AS people, round(SUM(poor) * 100.0E0 / SUM(people), 6) AS poor_share, list_sort(list(people))[CAST(floor(COUNT(*) / 2) AS INT) + 1] AS upper_middle, median(people) AS middle FROM frame GROUP BY 1")
def state_baselines(spark: SparkSession, d: str) -> DataFrame:
    return area_frame(spark, d).groupBy("state").agg(F.sum("people").alias("people"), F.round(ratio(F.sum("poor"), F.sum("people"), 100), 6).alias("poor_share"), upper_median("people").cast("long").alias("upper_middle"), F.median("people").alias("middle"))


@query(f"WITH {AREA_SQL}, g AS (SELECT state, area, orders - early AS now, early FROM frame) SELECT state, area, CASE WHEN early > 0 THEN round((now - early) * 1.0E0 / early, 6) END AS growth FROM g")
def prior_vintage_growth(spark: SparkSession, d: str) -> DataFrame:
    f = area_frame(spark, d)
    out = frames.growth(f.select("state", "area", (F.col("orders") - F.col("early")).alias("n")), f.select("state", "area", F.col("early").alias("n")), ["state", "area"], "n")
    return out.select("state", "area", F.round("growth", 6).alias("growth"))


@query(METRIC_SQL + "SELECT * FROM (SELECT state, area, indicator, score, ROW_NUMBER() OVER (PARTITION BY state, indicator ORDER BY score DESC, area) AS place FROM scored WHERE score IS NOT NULL) WHERE place <= 5")
def top_areas_by_indicator(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("state", "indicator").orderBy(F.col("score").desc(), "area")
    return _scored(spark, d).where("score is not null").select("state", "area", "indicator", "score", F.row_number().over(w).cast("long").alias("place")).where("place <= 5")

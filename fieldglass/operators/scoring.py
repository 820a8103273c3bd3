"""Scores from observations, their reliability, and rules that gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.functions.exprs import clamp, half_up, weighted_mean


def group_observations(observations: DataFrame, key: str) -> DataFrame:
    """Mean value and confidence and the distinct sources of each key."""
    return observations.groupBy(key).agg(half_up(F.avg("value")).cast("double").alias("value"), half_up(F.avg("confidence")).cast("double").alias("confidence"), F.countDistinct("source").alias("sources"))


def engine_scores(observations: DataFrame, indicators: DataFrame, weights: DataFrame) -> DataFrame:
    """observations: indicator, value, confidence. indicators: indicator, pillar, direction, engines. weights: pillar, engine, weight.

    Values and confidences are cut to 0 to 100, lower-is-better values turn. A pillar is its indicators' confidence-weighted
    mean, an engine weighs its observed pillars; gates and confidence indicators never score. Coverage is of the indicators
    that apply to the engine, and confidence is 55 % that of the sources, 25 % what confidence indicators say (the sources'
    own where there are none) and 20 % coverage.
    """
    dims = indicators.withColumn("scores", ~F.col("direction").isin("gate", "confidence"))
    seen = observations.withColumns({c: F.coalesce(clamp(F.col(c)), F.lit(0)) for c in ("value", "confidence")}).join(dims, "indicator")
    turned = F.when(F.col("direction") == "lower", 100 - F.col("value")).otherwise(F.col("value"))
    applies = seen.where("scores").withColumn("turned", turned).withColumn("engine", F.explode("engines"))
    pillars = applies.groupBy("engine", "pillar").agg(weighted_mean("turned", "confidence").alias("value"), F.sum("confidence").alias("sources"), F.count(F.lit(1)).alias("observed"))
    weighed = F.when(F.col("weight") > 0, F.col("weight"))
    scored = pillars.join(weights, ["engine", "pillar"], "left")
    engines = scored.groupBy("engine").agg(
        (F.sum(F.col("value") * weighed) / F.sum(weighed)).alias("score"), half_up(F.sum("sources") / F.sum("observed")).alias("sources"), F.sum("observed").alias("observed"),
        F.count(weighed).alias("pillars"), F.count(F.when(~F.col("pillar").isin(*NOT_SUBSTANTIVE), weighed)).alias("substantive"),
    )
    could = dims.where("scores").select("indicator", F.explode("engines").alias("engine")).groupBy("engine").agg(F.count(F.lit(1)).alias("applicable"))
    said = seen.where("direction = 'confidence'").agg(half_up(F.avg("value")).alias("said"))
    out = could.join(engines, "engine", "left").join(said).na.fill(0, ["observed", "pillars", "substantive", "sources"])  # one row of numbers
    coverage = clamp(half_up(F.col("observed") * 100.0 / F.col("applicable")).cast("double"))
    out = out.withColumn("coverage", coverage)
    confidence = clamp(half_up(0.55 * F.col("sources") + 0.25 * F.coalesce("said", "sources") + 0.2 * F.col("coverage")).cast("double"))
    return out.select("engine", F.coalesce(half_up("score"), F.lit(0)).cast("double").alias("score"), "coverage", confidence.alias("confidence"), "observed", "applicable", "pillars", "substantive")


#: Pillars about the evidence itself. Fixed values.
NOT_SUBSTANTIVE = ("evidence-quality", "relationship-quality")


def reliability(scores: DataFrame) -> DataFrame:
    """insufficient, preliminary or supported, the score that may be shown, its label, and what is lacking. scores: score, coverage, observed, substantive, publishers."""
    lacking = F.array_compact(F.array(F.when(F.col("coverage") < 12, "coverage"), F.when(F.col("observed") < 12, "indicators"), F.when(F.col("substantive") < 3, "pillars"), F.when(F.col("publishers") < 2, "publishers")))
    partial = (F.col("coverage") < 25) | (F.col("observed") < 25) | (F.col("publishers") < 4)
    grade = F.when(F.size(lacking) > 0, "insufficient").when(partial, "preliminary").otherwise("supported")
    s = F.col("score")
    level = F.when(s >= 80, "Very High").when(s >= 65, "High").when(s >= 45, "Moderate").when(s > 0, "Early Signal").otherwise("Low")
    label = F.when(F.col("grade") == "insufficient", "Insufficient Evidence").when(F.col("grade") == "preliminary", "Preliminary Estimate").otherwise(level)
    return scores.withColumns({"grade": grade, "lacking": F.array_join(lacking, ",")}).withColumns({"shown": F.when(F.col("grade") != "insufficient", s), "label": label})


#: Weights of a territory's signals. Fixed values.
TERRITORY_WEIGHTS = {"demand": 20, "children": 10, "referral": 15, "developmental": 10, "scarcity": 15, "waitlist": 10, "talent": 10, "trend": 5, "evidence": 5}


def territory(signals: DataFrame) -> DataFrame:
    """Adds the rounded parts' total, its label, and a confidence. signals: a column of 0 to 100 for each weight's name."""
    cut = {k: F.coalesce(clamp(F.col(k)), F.lit(0)) for k in TERRITORY_WEIGHTS}
    total = sum((half_up(cut[k] / 100 * w) for k, w in TERRITORY_WEIGHTS.items()), F.lit(0))
    mean = half_up(sum(cut.values(), F.lit(0.0)) / len(cut))
    out = signals.withColumns({"total": total.cast("long"), "confidence": half_up(cut["evidence"] * 0.6 + mean * 0.4).cast("long")})
    return out.withColumn("label", F.when(F.col("total") >= 80, "Very High").when(F.col("total") >= 65, "High").when(F.col("total") >= 45, "Moderate").otherwise("Low"))


def territory_signals(leads: DataFrame, key: str) -> DataFrame:
    """The signals of each territory from its leads: kind, signals (array of terms), confidence."""
    n = lambda test: F.count_if(test)
    has = lambda *terms: F.arrays_overlap("signals", F.array(*map(F.lit, terms)))
    scaled = lambda x, most: clamp(half_up(x * 100.0 / most).cast("double"))
    kind = F.col("kind")
    organisation = kind == "organization"
    return leads.groupBy(key).agg(
        scaled(n(kind == "community_signal"), 12).alias("demand"), F.lit(0.0).alias("children"), scaled(n(kind == "referral"), 18).alias("referral"),
        scaled(n(has("psychologist", "evaluation", "pediatric", "speech", "occupational", "early intervention")), 16).alias("developmental"),
        F.when(n(organisation) >= 3, F.greatest(F.lit(15.0), 100 - scaled(n(organisation & has("aba", "applied behavior")), 14))).otherwise(0.0).alias("scarcity"),
        scaled(n(has("waitlist", "wait list")), 8).alias("waitlist"), scaled(n(kind.isin("candidate", "talent_signal")) + n(has("hiring")), 12).alias("talent"),
        F.lit(0.0).alias("trend"), half_up(F.avg("confidence")).cast("double").alias("evidence"),
    )


def regulatory(contexts: DataFrame, rules: DataFrame, today) -> DataFrame:
    """Rules (rule, state, roles, payers, needs, posture, grace_days) for contexts (context, state, role, payer, license, supervision, credential, since).

    A rule applies by state, role and payer; a rule for payer 'unknown' covers all, and an unknown payer is one by that name.
    What a rule needs is met (PASS), not met (BLOCK) or unknown (REVIEW). A credential that isn't held is for review while
    its date is missing, ahead of today or within the grace days, and blocks afterwards. Rules that need nothing give their posture.
    """
    payer = F.coalesce("payer", F.lit("unknown"))
    met = contexts.join(rules, "state").where(F.array_contains("roles", F.col("role")) & (F.array_contains("payers", payer) | F.array_contains("payers", F.lit("unknown"))))
    tri = lambda c: F.when(F.col(c), "PASS").when(~F.col(c), "BLOCK").otherwise("REVIEW")
    days = F.datediff(today, "since")
    credential = F.when(F.col("credential"), "PASS").when(days > F.col("grace_days"), "BLOCK").otherwise("REVIEW")
    decision = F.when(F.col("needs") == "license", tri("license")).when(F.col("needs") == "supervision", tri("supervision")).when(F.col("needs") == "credential", credential).otherwise(F.col("posture"))
    return met.select("context", "rule", decision.alias("decision"))


def serves(low: str, high: str, a: int, b: int):
    """Whether an age range overlaps [a, b]; unknown where either end is."""
    return (F.col(low) <= b) & (F.col(high) >= a)

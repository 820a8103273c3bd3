"""What lies around sites: counts and ratios by ring, tiers of partners, hotspots and convergence of independent tests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.functions.exprs import half_up, lower_rank, ratio, smoothed


def shown(x: Column) -> Column:
    """A value as later tests see it: whole from 100 on, else with two decimals."""
    return F.when(F.abs(x) >= 100, half_up(x).cast("double")).otherwise(half_up(x * 100) / 100)


def hotspots(areas: DataFrame, measures: dict[str, str], group: str, sample: str, least_sample: int, least: int = 3, gap: str | None = None) -> DataFrame:
    """Mean lower-bound percentile of an area's measures (columns named by measures, SQL) and its service gap, a column of 0 to 100; areas with fewer than `least` of them go."""
    out = areas.withColumns({f"__{k}": F.expr(sql).cast("double") for k, sql in measures.items()})
    out = out.withColumns({f"__{k}": lower_rank(f"__{k}", group) for k in measures})
    known = F.array_compact(F.array(*(F.col(f"__{k}") for k in measures), *([F.col(gap).cast("double")] if gap else [])))
    out = out.withColumn("known", F.size(known)).withColumn("__sum", F.aggregate(known, F.lit(0.0), lambda a, x: a + x))
    out = out.where(F.col("known") >= least).withColumn("hotspot", half_up(F.col("__sum") / F.col("known")).cast("double"))
    return out.withColumn("small_sample", F.col(sample) < least_sample).drop("__sum", *(f"__{k}" for k in measures))


def tiers(places: DataFrame) -> DataFrame:
    """places: sources array, licensed, serves_2_5 (or unknown), inclusion array. Adds confirmed_by (an organisation's own website confirms nothing) and tier."""
    confirmed = F.size(F.array_except("sources", F.array(F.lit("organization-website"))))
    focus = (F.size("inclusion") > 0) & F.coalesce("serves_2_5", F.lit(True))
    tier = F.when(~F.coalesce("licensed", F.lit(False)), "likely").when(focus, "priority").otherwise("confirmed")
    return places.withColumn("confirmed_by", confirmed.cast("long")).withColumn("tier", tier)


#: Eight tests that two independent sources agree, over columns named here. Fixed values.
CONVERGENCE = {
    "c1": "young_density5 >= state_young_density AND childcare5 >= 3",
    "c2": "CASE WHEN coalesce(hpsa, supply) IS NOT NULL THEN disability5 >= state_disability AND (coalesce(hpsa, 0) > 0 OR coalesce(supply < median_supply, false)) END",
    "c3": "CASE WHEN aba_rate5 IS NOT NULL AND median_aba_rate IS NOT NULL AND second IS NOT NULL AND median_second IS NOT NULL THEN aba_rate5 < median_aba_rate AND second <= median_second END",
    "c4": "CASE WHEN pediatric5 IS NOT NULL AND licensed5 IS NOT NULL AND kids5 IS NOT NULL THEN pediatric5 >= kids5 / 2000.0 AND licensed5 >= 5 END",
    "c5": "CASE WHEN insured5 IS NOT NULL AND state_insured IS NOT NULL AND uninsured IS NOT NULL AND median_uninsured IS NOT NULL THEN insured5 >= state_insured * 0.98 AND uninsured <= median_uninsured * 1.1 END",
    "c6": "CASE WHEN density2 IS NOT NULL AND median_density IS NOT NULL AND nearest_aba IS NOT NULL THEN density2 >= median_density AND nearest_aba > 2 END",
    "c7": "priority5 >= 1",
    "c8": "double_confirmed5 >= 2",
}
CONVERGENCE["c1"] = f"CASE WHEN young_density5 IS NOT NULL AND state_young_density IS NOT NULL AND childcare5 IS NOT NULL THEN {CONVERGENCE['c1']} END"
CONVERGENCE["c2"] = f"CASE WHEN disability5 IS NOT NULL AND state_disability IS NOT NULL THEN {CONVERGENCE['c2']} END"


def convergence(sites: DataFrame, tests: dict[str, str], least: int = 4, strong: int = 6, moderate: int = 4) -> DataFrame:
    """Each test is a SQL predicate: pass, fail, or insufficient where any input is missing. Adds evaluated, passed and strength."""
    out = sites.withColumns({k: F.when(F.expr(sql), "pass").when(~F.expr(sql), "fail").otherwise("insufficient") for k, sql in tests.items()})
    n = lambda what: reduce(Column.__add__, ((F.col(k) == what).cast("long") for k in tests))
    out = out.withColumn("passed", n("pass")).withColumn("evaluated", n("pass") + n("fail"))
    strength = F.when(F.col("evaluated") < least, "insufficient").when(F.col("passed") >= strong, "strong").when(F.col("passed") >= moderate, "moderate").otherwise("weak")
    return out.withColumn("strength", strength)


#: Ring indicators: shares and ratios over sums and counts. per is guarded, each is smoothed. Fixed values.
RATIOS = {"child_share": ("per", "kids", "population", 100), "child_density": ("per", "kids", "ring_sqmi", 1), "poverty_share": ("per", "poor", "kids", 100), "kids_per_clinic": ("each", "kids", "clinics", 1), "slots_per_kid": ("per", "capacity", "kids", 1), "clinics_per_school": ("each", "clinics", "schools", 1)}


def ring_indicators(rings: DataFrame, sums: list[str]) -> DataFrame:
    """A row for each site, indicator and radius from a row for each site and radius."""
    made = {k: shown(ratio(a, b, scale) if how == "per" else smoothed(a, b)) for k, (how, a, b, scale) in RATIOS.items()}
    wide = rings.select("site", "radius", *(shown(F.col(c).cast("double")).alias(c) for c in sums), *(v.alias(k) for k, v in made.items()))
    long = wide.unpivot(["site", "radius"], [*sums, *made], "name", "value")
    return long.select("site", F.concat_ws(".", "name", F.concat(F.col("radius").cast("int").cast("string"), F.lit("mi"))).alias("indicator"), "value")

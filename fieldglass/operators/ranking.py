"""Areas ranked by indicators: percentiles within a group, weighted composites, confidence, order, drivers and cautions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldglass.functions.exprs import clamp, half_up, mid_rank

#: Weights of the families in the composite. Fixed values.
FAMILY_WEIGHTS = {"service_gap": 1.4, "referral_network": 1.0, "payer_fit": 1.1, "access": 0.8, "need_intensity": 1.0, "validation": 0.0}

#: Areas with fewer children have wide survey margins. A fixed value.
LOW_SAMPLE = 2500


@dataclass(frozen=True)
class Indicator:
    """An indicator: a SQL expression over metric columns, null where any input is missing."""

    id: str
    family: str
    sql: str
    direction: str  # higher, lower or agreement
    metrics: tuple[str, ...]


def compute(frame: DataFrame, indicators: Sequence[Indicator], keys: Sequence[str] = ("state", "area")) -> DataFrame:
    """Long rows of (keys, indicator, family, direction, raw): one projection of all indicators, then unpivoted."""
    wide = frame.select(*keys, *(F.expr(x.sql).cast("double").alias(x.id) for x in indicators))
    about = F.broadcast(frame.sparkSession.createDataFrame([(x.id, x.family, x.direction) for x in indicators], "indicator string, family string, direction string"))
    long = wide.unpivot(list(keys), [x.id for x in indicators], "indicator", "raw")
    return long.join(about, "indicator").select(*keys, "indicator", "family", "direction", "raw")


def percentiles(long: DataFrame, group: str = "state", least: int = 5) -> DataFrame:
    """Adds `score`: the mid-rank percentile within the group, turned where lower is better; an agreement is its own score."""
    pct = mid_rank("raw", group, "indicator", least=least)
    score = F.when(F.col("direction") == "agreement", F.col("raw")).when(F.col("direction") == "lower", half_up(100 - pct)).otherwise(half_up(pct))
    return long.withColumn("score", score.cast("double"))


def family_scores(scored: DataFrame, keys: Sequence[str] = ("state", "area")) -> DataFrame:
    return scored.where("direction <> 'agreement'").groupBy(*keys, "family").agg(half_up(F.avg("score")).cast("double").alias("mean_score"), F.count("score").alias("computed"), F.count(F.lit(1)).alias("total"))


def composite(scored: DataFrame, programs: DataFrame | None = None, keys: Sequence[str] = ("state", "area"), least_coverage: float = 50, samples: DataFrame | None = None, low_sample: int = LOW_SAMPLE) -> DataFrame:
    """composite, coverage, agreement and confidence for each area, coverage and agreement whole numbers before they decide.

    programs: keys and `program_share` (0 to 100). samples: keys and `children`; fewer than low_sample of them cost 15 points of confidence.
    """
    weight = F.coalesce(*(F.when(F.col("family") == k, F.lit(float(v))) for k, v in FAMILY_WEIGHTS.items()), F.lit(0.0))
    counted = (F.col("direction") != "agreement") & F.col("score").isNotNull()
    out = scored.groupBy(*keys).agg(
        F.sum(F.when(counted, F.col("score") * weight)).alias("__sum"),
        F.sum(F.when(counted, weight)).alias("__weight"),
        half_up(F.count_if(counted) / F.count_if(F.col("direction") != "agreement") * 100).cast("double").alias("coverage"),
        half_up(F.avg(F.when(F.col("direction") == "agreement", F.col("score")))).cast("double").alias("agreement"),
    )
    out = out.withColumn("program_share", F.lit(100.0)) if programs is None else out.join(programs, list(keys), "left")
    if samples is not None:
        out = out.join(samples.select(*keys, (F.col("children") < low_sample).alias("low_sample")), list(keys), "left")
    out = out.withColumn("composite", F.when((F.col("coverage") >= least_coverage) & (F.col("__weight") > 0), half_up(F.col("__sum") / F.col("__weight")).cast("double")))
    low = F.coalesce(F.col("low_sample").cast("int"), F.lit(0)) if "low_sample" in out.columns else F.lit(0)
    confidence = clamp(half_up(0.45 * F.col("coverage") + 0.35 * F.coalesce("agreement", F.lit(50.0)) + 0.2 * F.coalesce("program_share", F.lit(0.0))) - 15 * low)
    return out.withColumn("confidence", F.least(F.lit(85.0), confidence.cast("double"))).drop("__sum", "__weight")


def ordinal(areas: DataFrame, group: str = "state", name: str = "area") -> DataFrame:
    """rank among the areas of the group that have a composite, by composite, confidence and name; ranked_of is their number."""
    ranked = F.col("composite").isNotNull()
    w = Window.partitionBy(group).orderBy(F.col("composite").desc_nulls_last(), F.col("confidence").desc(), F.col(name))
    return areas.withColumn("rank", F.when(ranked, F.row_number().over(w)).cast("long")).withColumn("ranked_of", F.count("composite").over(Window.partitionBy(group)))


def drivers(scored: DataFrame, keys: Sequence[str] = ("state", "area"), top: int = 3, high: float = 70, bottom: int = 2, low: float = 30) -> DataFrame:
    """The indicators that speak for an area and against it: at most so many of either, past the bounds."""
    rows = scored.where("direction <> 'agreement' and score is not null")
    up = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "indicator")
    down = Window.partitionBy(*keys).orderBy(F.col("score").asc(), "indicator")
    rows = rows.withColumns({"up": F.row_number().over(up), "down": F.row_number().over(down)})
    pick = lambda n, place, test: F.array_join(F.transform(F.sort_array(F.collect_list(F.when((F.col(place) <= n) & test, F.struct(place, "indicator")))), lambda x: x["indicator"]), ",")
    return rows.groupBy(*keys).agg(pick(top, "up", F.col("score") >= high).alias("drivers"), pick(bottom, "down", F.col("score") <= low).alias("cautions"))


def rank_areas(frame: DataFrame, indicators: Sequence[Indicator], programs: DataFrame | None = None, samples: DataFrame | None = None) -> DataFrame:
    """From metrics to ranked areas."""
    return ordinal(composite(percentiles(compute(frame, indicators)), programs, samples=samples))

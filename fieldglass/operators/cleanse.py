"""Integrity of sources: parts that exceed their whole, tables whose universe is off, and columns that changed meaning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def part_of_whole(frame: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Where a part exceeds its whole, both go missing and `issues` says so. Pairs apply in order: what has gone tests nothing later."""
    if "issues" not in frame.columns:
        frame = frame.withColumn("issues", F.array().cast("array<string>"))
    for part, whole in pairs:
        bad = F.coalesce(F.col(part) > F.col(whole), F.lit(False))
        frame = frame.withColumn("__bad", bad)
        frame = frame.withColumn("issues", F.when(F.col("__bad"), F.concat("issues", F.array(F.lit(f"{part} > {whole}")))).otherwise(F.col("issues")))
        frame = frame.withColumns({c: F.when(~F.col("__bad"), F.col(c)) for c in (part, whole)}).drop("__bad")
    return frame


def universe_ratio(frame: DataFrame, table: Sequence[str], total: str, base: str, low: float, high: float, least: float = 200) -> DataFrame:
    """A table's columns go missing where its total is out of proportion to a base of `least` or more."""
    off = F.coalesce((F.col(base) >= least) & ~(F.col(total) / F.when(F.col(base) > 0, F.col(base))).between(low, high), F.lit(False))
    frame = frame.withColumn("__off", off)
    return frame.withColumns({c: F.when(~F.col("__off"), F.col(c)) for c in table}).withColumnRenamed("__off", f"{total}_off")


def label_contract(variables: DataFrame, expected: DataFrame) -> DataFrame:
    """Coded variables whose label lacks an expected fragment, or that are absent. expected: variable, fragments."""
    joined = expected.join(variables, "variable", "left")
    kept = F.coalesce(F.forall("fragments", lambda f: F.contains(F.lower("label"), F.lower(f))), F.lit(False))
    return joined.where(~kept).select("variable", "label", F.filter("fragments", lambda f: ~F.coalesce(F.contains(F.lower("label"), F.lower(f)), F.lit(False))).alias("lacking"))

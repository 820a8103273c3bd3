"""Sparse metrics of areas: assembly from many sources, zeros only where a source succeeded, fallbacks that stay visible."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def assemble(long: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ("state", "area")) -> DataFrame:
    """Long rows (keys, metric, value, priority) to a column for each metric; of several values that of the highest priority."""
    return long.groupBy(*keys).pivot("metric", list(metrics)).agg(F.max_by("value", "priority"))


def gated_zero_fill(areas: DataFrame, counts: DataFrame, status: DataFrame, keys: Sequence[str] = ("state", "area")) -> DataFrame:
    """Counts of (metric, keys), 0 for areas without rows where the metric's source is complete, else missing.

    status: a row for each metric, with `complete`; areas are met with it by broadcast, as it has a few rows.
    """
    wanted = areas.select(*keys).join(F.broadcast(status.select("metric", "complete")), F.lit(True))
    found = wanted.join(counts, [*keys, "metric"], "left")
    return found.select(*keys, "metric", F.when(F.col("complete"), F.coalesce("value", F.lit(0))).alias("value"))


def newest_complete(rows: DataFrame, keys: Sequence[str], vintage: str, value: str) -> DataFrame:
    """For each key the newest vintage that has a value."""
    w = Window.partitionBy(*keys).orderBy(F.col(vintage).desc())
    return rows.where(F.col(value).isNotNull()).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def prefer(primary: DataFrame, mirror: DataFrame, key: str, value: str) -> DataFrame:
    """Either source's value, the primary's first, and where it came from."""
    p, m = primary.select(key, F.col(value).alias("__p")), mirror.select(key, F.col(value).alias("__m"))
    out = p.join(m, key, "full")
    origin = F.when(F.col("__p").isNotNull(), "primary").when(F.col("__m").isNotNull(), "mirror")
    return out.select(key, F.coalesce("__p", "__m").alias(value), origin.alias("origin"))


def last_good(current: DataFrame, snapshot: DataFrame, key: str, value: str, now: Column, max_days: int = 7) -> DataFrame:
    """Missing values from the last good snapshot, unless it is older than max_days; flagged."""
    old = snapshot.select(key, F.col(value).alias("__old"), "taken_at")
    usable = F.when(F.col("taken_at") >= now - F.make_dt_interval(F.lit(max_days)), F.col("__old"))
    out = current.join(old, key, "left")
    return out.select(key, F.coalesce(value, usable).alias(value), (F.col(value).isNull() & usable.isNotNull()).alias("from_cache"))


def growth(current: DataFrame, prior: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Relative change since a prior vintage, for areas of the current one; missing where the prior isn't above 0."""
    old = prior.select(*keys, F.col(value).alias("__old"))
    out = current.join(old, list(keys), "left")
    return out.withColumn("growth", F.when(F.col("__old") > 0, (F.col(value) - F.col("__old")) / F.col("__old"))).drop("__old")


def paged_union(pages: Sequence[DataFrame], key: str, group: str, cap: int) -> DataFrame:
    """Count of distinct keys in a group over pages; a count that reaches the cap is a lower bound."""
    rows = pages[0]
    for page in pages[1:]:
        rows = rows.unionByName(page, allowMissingColumns=True)
    n = rows.select(group, key).distinct().groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("lower_bound", F.col("n") >= cap)


def first_then_rank(rows: DataFrame, group: Sequence[str], key: str, rank: str) -> DataFrame:
    """The first row of each key in its group, ranked again from 1 without gaps."""
    first = Window.partitionBy(*group, key).orderBy(rank)
    kept = rows.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    return kept.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(rank)).cast("long"))


def bounded_read(rows: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows in that order: a top-k, so no task sorts the table."""
    return rows.orderBy(*order).limit(n)

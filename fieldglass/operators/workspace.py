"""Operational tables: upserts, replicas that meet, suppression, funnels and queues. Snapshots in, a new snapshot out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldglass.functions.exprs import half_up


def latest(rows: DataFrame, key: Sequence[str], at: str) -> DataFrame:
    """The newest row of each key."""
    w = Window.partitionBy(*key).orderBy(F.col(at).desc(), *sorted(set(rows.columns) - {*key, at}))
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def bounded(rows: DataFrame, group: str, order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each group."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def upsert(old: DataFrame, new: DataFrame, key: str, keep: Sequence[str] = ()) -> DataFrame:
    """New rows over old ones by key; columns in keep stay as the old row has them, where it has."""
    names = [c for c in old.columns if c != key]
    o, n = old.select(key, F.struct(*names).alias("__old")), new.select(key, F.struct(*names).alias("__new"))
    out = o.join(n, key, "full")
    pick = lambda c: F.coalesce(F.col(f"__old.{c}"), F.col(f"__new.{c}")) if c in keep else F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(f"__old.{c}"))
    return out.select(key, *(pick(c).alias(c) for c in names))


def reconcile(local: DataFrame, durable: DataFrame, key: str, at: str) -> DataFrame:
    """The later of two replicas' rows by key, ties to the durable one, a missing time loses; backfill marks what the durable one lacks."""
    names = [c for c in local.columns if c != key]
    l, d = local.select(key, F.struct(*names).alias("__l")), durable.select(key, F.struct(*names).alias("__d"))
    out = l.join(d, key, "full")
    never = F.lit("0001-01-01").cast("timestamp")
    mine = F.col("__l").isNotNull() & (F.col("__d").isNull() | (F.coalesce(F.col(f"__l.{at}"), never) > F.coalesce(F.col(f"__d.{at}"), never)))
    return out.select(key, *(F.when(mine, F.col(f"__l.{c}")).otherwise(F.col(f"__d.{c}")).alias(c) for c in names), mine.alias("backfill"))


def unsuppressed(leads: DataFrame, suppressed: DataFrame, key: str) -> DataFrame:
    """The first address of each lead that isn't suppressed; leads without one go. leads: key, emails; suppressed: email."""
    flat = leads.select(key, F.posexplode("emails").alias("at", "email")).withColumn("email", F.lower(F.trim("email")))
    left = flat.where(F.col("email").rlike(r"^[^@\s]+@[^@\s]+\.[a-z]{2,}$")).join(suppressed.select(F.lower(F.trim("email")).alias("email")), "email", "left_anti")
    return left.groupBy(key).agg(F.min_by("email", "at").alias("email"))


def funnel(leads: DataFrame, stages: Sequence[str], by: str, ready: str, active: str, won: str) -> DataFrame:
    """Totals by how far leads have come: those at or past the ready and the active stage, and those at the won one. A stage that is not known counts as before the first."""
    place = F.array_position(F.array(*(F.lit(s) for s in stages)), F.col("stage"))
    at = {s: k for k, s in enumerate(stages, 1)}
    percent = half_up((F.greatest(place, F.lit(1)) - 1) * 100.0 / (len(stages) - 1)) if len(stages) > 1 else F.lit(100)
    return leads.groupBy(by).agg(F.count(F.lit(1)).alias("total"), F.count_if(place >= at[ready]).alias("ready"), F.count_if(place >= at[active]).alias("active"), F.count_if(F.col("stage") == won).alias("won"), F.round(F.avg(percent), 4).alias("percent"))


def places(rows: DataFrame, lead: Sequence[str], band: Column, order: Sequence[Column]) -> DataFrame:
    """rows with the place of each in the order by lead, then order; band must not fall along order.

    Rows are numbered within lead and band, on top of what comes before by counts, so no task sees the whole table. The
    columns of lead and band must not be null.
    """
    before = lambda w: F.coalesce(F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("__band", band)
    bands = rows.groupBy(*lead, "__band").agg(F.count(F.lit(1)).alias("__c"))
    leads = bands.groupBy(*lead).agg(F.sum("__c").alias("__c"))
    leads = leads.select(*lead, before(Window.orderBy(*lead)).alias("__outer"))
    bands = bands.select(*lead, "__band", before(Window.partitionBy(*lead).orderBy("__band")).alias("__inner")).join(leads, [*lead])
    n = F.row_number().over(Window.partitionBy(*lead, "__band").orderBy(*order))
    out = rows.withColumn("__n", n).join(bands, [*lead, "__band"])
    return out.withColumn("place", F.col("__outer") + F.col("__inner") + F.col("__n")).drop("__band", "__n", "__outer", "__inner")


def queue(parts: Sequence[DataFrame], n: int) -> DataFrame:
    """The most urgent actions of several tables (kind, title, priority), ties by title."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.orderBy(F.col("priority").desc(), "title", "kind").limit(n)


def expand_queries(templates: DataFrame, places: DataFrame, per_family: int) -> DataFrame:
    """Templates (family, template, order) for each place, so many of each family, without repeats."""
    few = bounded(templates, "family", [F.col("order")], per_family)
    out = places.join(F.broadcast(few), F.lit(True)).select("place", "family", F.expr("replace(template, '{place}', place)").alias("query"))
    return out.dropDuplicates(["place", "query"])


def correct(tokens: DataFrame, known: DataFrame, misspelt: DataFrame) -> DataFrame:
    """Tokens with a known misspelling put right, or within one edit of exactly one known word. known: word; misspelt: token, word.

    A word and a token one edit apart share what is left when a letter goes from either, so they meet as equal keys.
    """
    gaps = lambda x: F.array_distinct(F.concat(F.array(F.col(x)), F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substring(F.col(x), F.lit(1), i - 1), F.substring(F.col(x), i + 1, F.length(x))))))
    distinct = tokens.select("token").distinct().where(F.length("token") > 3)
    left = distinct.withColumn("gap", F.explode(gaps("token")))
    right = known.select("word").withColumn("gap", F.explode(gaps("word")))
    near = left.join(right, "gap").select("token", "word").distinct().where(F.levenshtein("token", "word") <= 1)
    one = near.groupBy("token").agg(F.min("word").alias("near"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    out = tokens.join(F.broadcast(misspelt.withColumnRenamed("word", "listed")), "token", "left").join(one, "token", "left")
    return out.withColumn("corrected", F.coalesce("listed", "near", "token")).drop("listed", "near")


def export(rows: DataFrame, key: str, item: str, value: str) -> DataFrame:
    """A row for each key with its items as compact JSON, in order, values rounded. Items of a key are distinct and bounded by what an export holds."""
    pairs = F.sort_array(F.collect_list(F.struct(item, F.round(value, 2).alias("value"))))
    return rows.groupBy(key).agg(F.to_json(F.map_from_entries(pairs)).alias("items"))


def write_export(rows: DataFrame, key: str, item: str, value: str, path: str) -> None:
    """The export as JSON lines."""
    export(rows, key, item, value).write.mode("overwrite").json(path)

"""Operational tables: what to do next, summaries, partial updates, runs written to several tables, eligibility and moderation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldglass.functions.exprs import half_up

#: Stages at which a lead is won. Fixed values.
WON = ("Referral Received", "Hired")


def posture(captured: Column, now: Column, coverage: Column, confidence: Column, sources: Column) -> Column:
    """stale after 30 days or without a date, thin with too little behind it, else review."""
    age = F.unix_timestamp(now) - F.unix_timestamp(captured)
    return F.when(age.isNull() | (age > 30 * 86400), "stale").when((coverage < 20) | (confidence < 55) | (sources < 2), "thin").otherwise("review")


def overdue(status: Column, due: Column, now: Column) -> Column:
    return F.coalesce((status != "done") & (due < now), F.lit(False))


def work_queue(runs: DataFrame, leads: DataFrame, tasks: DataFrame, now: Column, n: int = 12) -> DataFrame:
    """The most urgent actions: overdue tasks, promising leads without an open task, and the latest territory runs that ask for a look.

    runs: run, title, score, posture (the latest of each territory). leads: lead, title, score, confidence, stage. tasks: task, title, priority, status, due, lead.
    """
    late = tasks.where(overdue(F.col("status"), F.col("due"), now)).select(F.lit("overdue").alias("kind"), "title", F.when(F.col("priority") == "urgent", 110).otherwise(100).alias("priority"))
    open_ = tasks.where("status <> 'done' AND lead IS NOT NULL").select("lead").distinct()
    free = leads.where((F.col("score") >= 65) & (F.col("confidence") >= 60) & ~F.col("stage").isin(*WON)).join(open_, "lead", "left_anti")
    crm = free.select(F.lit("crm").alias("kind"), F.concat(F.lit("Review "), "title").alias("title"), (60 + half_up(F.col("score") / 10)).cast("int").alias("priority"))
    asks = runs.where((F.col("posture") != "review") | (F.col("score") >= 65))
    level = F.when(F.col("posture") == "stale", 35).when(F.col("posture") == "thin", 50).otherwise(55 + half_up(F.col("score") / 10))
    land = asks.select(F.lit("territory").alias("kind"), "title", level.cast("int").alias("priority"))
    return late.unionByName(crm).unionByName(land).orderBy(F.col("priority").desc(), "title", "kind").limit(n)


def patch(rows: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    """One column by key; rows without a change stay."""
    return rows.join(changes.select(key, F.col(column).alias("__new")), key, "left").withColumn(column, F.coalesce("__new", column)).drop("__new")


def replace_children(children: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """All children of the parents that new names are those of new."""
    return children.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def eligible(requests: DataFrame, recipients: DataFrame) -> DataFrame:
    """For each campaign whether all its recipients exist and may be written to; one that may not keeps the whole campaign back. requests: campaign, recipient. recipients: recipient, eligible."""
    known = recipients.where("eligible").select("recipient", F.lit(True).alias("ok"))
    return requests.distinct().join(known, "recipient", "left").groupBy("campaign").agg(F.count(F.lit(1)).alias("requested"), F.count("ok").alias("found")).withColumn("sent", F.col("requested") == F.col("found"))


def best_of(official: DataFrame, discovered: DataFrame, key: str) -> DataFrame:
    """Leads of both, the better of each id by score, then confidence, official before discovered."""
    rows = official.withColumn("origin", F.lit("official")).unionByName(discovered.withColumn("origin", F.lit("discovered")))
    best = F.struct("score", "confidence", F.col("origin") == "official")
    return rows.groupBy(key).agg(F.max_by(F.struct("score", "confidence", "origin"), best).alias("r")).select(key, "r.*")


def rotated(rows: DataFrame, group: str, order: str, seed: int, n: int) -> DataFrame:
    """n rows of each group, from a seeded place on and around: the same rows for the same seed."""
    w = Window.partitionBy(group)
    place = F.row_number().over(w.orderBy(order)) - 1
    size = F.count(F.lit(1)).over(w)
    out = rows.withColumns({"__at": place, "__n": size})
    turn = F.pmod(F.col("__at") - F.pmod(F.lit(seed), F.col("__n")), F.col("__n"))
    return out.withColumn("turn", turn.cast("long")).where(F.col("turn") < n).drop("__at", "__n")


def run_tables(runs: DataFrame, evidence: DataFrame, scores: DataFrame) -> dict[str, DataFrame]:
    """One research run as rows of three tables: the run, its evidence without repeated links, and its scores; under run_id they can be written again."""
    first = Window.partitionBy("run_id", "url").orderBy("rank")
    once = evidence.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    return {"runs": runs.dropDuplicates(["run_id"]), "evidence": once, "scores": scores.dropDuplicates(["run_id", "engine"])}


def write_run(tables: dict[str, DataFrame], path: str) -> None:
    """A partition for each run: a run that is written again replaces its own rows and no others."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(f"{path}/{name}")


#: What makes a request sensitive, and what makes it one for individuals. Fixed values.
SENSITIVE = ("autism", "autistic", "diagnosis", "diagnosed", "aba", "disability", "disabled", "special needs")
INDIVIDUALS = ("find autistic children", "find children with autism", "find families with autism", "specific child", "child named", "home address", "street address of", "lives at", "houses with autistic", "homes with autistic", "addresses with autistic")


def moderated(requests: DataFrame, text: str, corrected: str | None = None, sensitive: Sequence[str] = SENSITIVE, targets: Sequence[str] = INDIVIDUALS) -> DataFrame:
    """Requests with whether they may be answered: not those that look for individuals in a sensitive matter.

    corrected: a column with the request as its spelling was corrected. Both readings are inspected, each by itself: either can make a request sensitive, and either can look for individuals.
    """
    readings = [_inspected(c, sensitive, targets) for c in ([text] if corrected is None else [text, corrected])]
    return requests.withColumn("allowed", ~(reduce(Column.__or__, (a for a, _ in readings)) & reduce(Column.__or__, (b for _, b in readings))))


def _inspected(text: str, sensitive: Sequence[str], targets: Sequence[str]) -> tuple[Column, Column]:
    """Whether a reading is sensitive, and whether it looks for individuals."""
    low = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+", " "))
    has = lambda terms: F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(low, t))
    find = low.rlike(r"\b(find|locate|identify|list|target|contact|collect|give me)\b.{0,100}\b(autistic|autism|asd|disabled|diagnosed)\b.{0,90}\b(children|kids|families|parents|homes|houses|households|addresses|phone numbers)\b")
    private = low.rlike(r"\b(homes?|houses?|households?|addresses|phone numbers?|names?|private|personal)\b")
    home = low.rlike(r"\b(home address|street address|residential address|personal phone|private contact)\b.{0,100}\b(autism|autistic|asd|disabled|diagnos\w*)\b")
    return has(sensitive), has(targets) | (find & private) | home


def network(rows: DataFrame, columns: Sequence[str], place: str, n: int = 30) -> DataFrame:
    """Facilities and cities of each affiliation, the largest first."""
    flat = rows.select("facility", place, F.explode(F.array(*columns)).alias("affiliation")).where("affiliation IS NOT NULL")
    out = flat.groupBy("affiliation").agg(F.count_distinct("facility").alias("facilities"), F.count_distinct(place).alias("places"))
    return out.orderBy(F.col("facilities").desc(), "affiliation").limit(n)

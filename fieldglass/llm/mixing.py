"""Mixing sources to target weights: a token budget flows down a tree of groups, and seeded epochs fill each leaf.

Weights are relative among siblings. A node that can't use its share (its tokens times the allowed epochs) passes the rest
to its siblings in proportion to their weights; only what all siblings can't use moves up to the parent's siblings. Each
leaf then takes whole epochs, and of one more epoch the prefix, in an order seeded by epoch and id, that fills its budget.

Only DataFrame functions run. Budgets are window sums over the tree's nodes. A leaf's prefix is found without ordering the
leaf: ids hash into buckets, sums by bucket find the bucket where the budget ends, and only that bucket is ordered, so one
source with a third of all rows is no hot group.

Defined cases: null group values are a group of their own, named by the empty string; groups without a weight get the
default weight; weights of 0 take nothing; null and empty texts have no tokens and are taken with the prefix that they fall
in; repeated rows (same id) are counted and ordered as rows of their own, each by all its
columns, so a budget holds for null and repeated ids too and of rows that are equal in all columns it takes as many as it
covers; null ids hash like any value; an empty table gives no rows; extra columns, whatever their names, go along unchanged
(as part of a row they have a part in the seeded order).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldglass.llm.common import columns_of, join_counted, materialize, row_name, word_count

LEVELS = ("domain", "lang", "source")
#: Rows of a leaf in one bucket, about.
BUCKET_ROWS = 1000


def split_budget(nodes: DataFrame, parent: list[str], budget: str = "budget", capacity: str = "capacity", weight: str = "weight") -> DataFrame:
    """Adds `share`: the parent's budget by weight, no child over its capacity, the rest again by weight to its siblings.

    The children that fill up are those with the least capacity for their weight; among children in that order, the level
    at which the others share what is left is a ratio of running sums, so no loop is needed.
    """
    by = Window.partitionBy(*parent)
    order = by.orderBy(F.col("__need").asc_nulls_last(), *sorted(set(nodes.columns) - {budget, capacity, weight}))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    out = nodes.withColumn("__need", F.when(F.col(weight) > 0, F.col(capacity) / F.col(weight)))
    filled = F.coalesce(F.sum(F.when(F.col(weight) > 0, F.col(capacity))).over(before), F.lit(0.0))
    weights_left = F.sum(weight).over(by) - F.coalesce(F.sum(weight).over(before), F.lit(0.0))
    out = out.withColumn("__level", F.when((F.col(weight) > 0) & (weights_left > 0), (F.col(budget) - filled) / weights_left))
    out = out.withColumn("__final", F.max(F.when(F.col("__need") > F.col("__level"), F.col("__level"))).over(by))
    share = F.when(F.col(weight) <= 0, F.lit(0.0)).when(F.col("__final").isNull(), F.col(capacity)).otherwise(F.least(F.col(capacity), F.col("__final") * F.col(weight)))
    return out.withColumn("share", F.greatest(F.lit(0.0), share)).drop("__need", "__level", "__final")


def weight_of(level: str, weights: dict[str, float], default: float) -> Column:
    """A weight by the group's value, from a stated list."""
    return reduce(lambda out, kv: F.when(F.col(level) == kv[0], F.lit(float(kv[1]))).otherwise(out), sorted(weights.items()), F.lit(float(default)))


def budgets(leaves: DataFrame, weights: dict[str, dict[str, float]], total: float, max_epochs: int, levels: tuple[str, ...] = LEVELS, default: float = 1.0) -> DataFrame:
    """leaves: a row for each leaf with `tokens`. Adds `budget`, a whole number of tokens."""
    tree = leaves.select(*levels, (F.col("tokens") * float(max_epochs)).alias("capacity"))
    usable = tree
    for k in range(len(levels)):
        usable = usable.withColumn("capacity", F.when(weight_of(levels[k], weights.get(levels[k], {}), default) > 0, F.col("capacity")).otherwise(F.lit(0.0)))
    above = None
    for k in range(1, len(levels) + 1):
        own = list(levels[:k])
        nodes = usable.groupBy(*own).agg(F.sum("capacity").alias("capacity")).withColumn("weight", weight_of(levels[k - 1], weights.get(levels[k - 1], {}), default))
        if above is None:  # the root's budget: the total, or all that its children can use
            nodes = nodes.withColumn("budget", F.least(F.lit(float(total)), F.sum("capacity").over(Window.partitionBy())))
        else:
            nodes = nodes.join(above, own[:-1])
        above = split_budget(nodes, own[:-1]).select(*own, F.col("share").alias("budget"))
    return above.withColumn("budget", F.floor(F.col("budget") + 1e-6).cast("long"))


def mix(light: DataFrame, weights: dict[str, dict[str, float]], total: float, seed: int = 0, max_epochs: int = 4, levels: tuple[str, ...] = LEVELS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """light: doc_id, tokens, the levels and, if ids repeat, row_key, a row for each document. Returns a row for each document and epoch that is taken.

    `taken` is the part of the document's tokens that the leaf's budget covers: all of them but for the last document.
    total is a number of tokens, or a share of all tokens where it is 1 or less.
    """
    light = light.withColumns({x: F.coalesce(F.col(x).cast("string"), F.lit("")) for x in levels})
    extra = ["row_key"] if "row_key" in light.columns else []
    leaves = light.groupBy(*levels).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    if total <= 1:
        total = total * (light.agg(F.sum("tokens").alias("n")).first()["n"] or 0)
    planned = budgets(leaves, weights, total, max_epochs, levels).join(leaves, list(levels))
    planned = planned.withColumn("full", F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(0)).cast("int"))
    planned = planned.withColumn("rest", F.col("budget") - F.col("full") * F.col("tokens")).withColumn("buckets", F.greatest(F.lit(1), F.col("rows") / bucket_rows).cast("long"))
    planned = materialize(planned.select(*levels, "full", "rest", "buckets", F.col("budget").alias("leaf_budget")), "leaf-budgets")
    rows = light.join(planned, list(levels))
    whole = rows.where(F.col("full") > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("full") - 1))).withColumn("taken", F.col("tokens"))
    keyed = rows.where(F.col("rest") > 0).withColumn("epoch", F.col("full"))
    keyed = keyed.withColumn("order_key", F.xxhash64(F.lit(seed), "epoch", "doc_id", *extra))
    keyed = keyed.withColumn("bucket", F.floor((F.shiftrightunsigned("order_key", 12).cast("double") / float(1 << 52)) * F.col("buckets")).cast("long"))
    sums = keyed.groupBy(*levels, "bucket").agg(F.sum("tokens").alias("in_bucket"), F.max("rest").alias("rest"))
    run = Window.partitionBy(*levels).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("in_bucket").over(run), F.lit(0))).where(F.col("before") < F.col("rest"))
    placed = keyed.join(sums.select(*levels, "bucket", "in_bucket", "before"), [*levels, "bucket"])
    inside = F.col("before") + F.col("in_bucket") <= F.col("rest")
    unsigned = F.shiftrightunsigned("order_key", 1)
    at = Window.partitionBy(*levels, "bucket").orderBy(unsigned, "order_key", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    last = placed.where(~inside).withColumn("start", F.col("before") + F.coalesce(F.sum("tokens").over(at), F.lit(0))).where(F.col("start") < F.col("rest"))
    columns = ["doc_id", *levels, "tokens", "epoch", "taken", *extra]
    prefix = placed.where(inside).withColumn("taken", F.col("tokens")).select(*columns).unionByName(last.withColumn("taken", F.least(F.col("tokens"), F.col("rest") - F.col("start"))).select(*columns))
    return whole.select(*columns).unionByName(prefix)


def domain_of(source: Column) -> Column:
    """The domain of a source in the test corpus: by its number. Fixed values of this corpus."""
    n = F.try_to_number(F.regexp_extract(source, r"^src(\d{1,6})$", 1), F.lit("999999")).cast("int")
    return F.when(n < 8, "web").when(n < 14, "books").when(n < 20, "forums").otherwise("other")


#: Production weights; sources weigh alike within a language.
WEIGHTS = {"domain": {"web": 5.0, "books": 3.0, "forums": 2.0, "other": 1.0}, "lang": {"en": 6.0, "de": 2.0, "fr": 2.0, "es": 1.5}}


def tokens_of(docs: DataFrame) -> DataFrame:
    """doc_id, levels, tokens (words of the whole text) and row_key, written to the shared folder."""
    light = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"), word_count(F.col("text")).alias("tokens"), row_name(docs).alias("row_key"))
    return materialize(light.withColumn("domain", domain_of(F.col("source"))), "tokens")


def op3(docs: DataFrame, total: float = 0.8, seed: int = 7, max_epochs: int = 4) -> DataFrame:
    return mix(tokens_of(docs), WEIGHTS, total, seed, max_epochs).drop("row_key")


def mixed_documents(docs: DataFrame, total: float = 0.8, seed: int = 7, max_epochs: int = 4) -> DataFrame:
    """The documents that the mix takes, whole, once for each epoch, with their own columns.

    Rows that are equal in all columns are one another's copies: together they come as often as the mix takes them.
    """
    light = tokens_of(docs)
    taken = mix(light, WEIGHTS, total, seed, max_epochs).groupBy("row_key").agg(F.count(F.lit(1)).alias("times"))
    plan = light.groupBy("row_key").agg(F.count(F.lit(1)).alias("n")).join(taken, "row_key")
    plan = materialize(plan.withColumnRenamed("row_key", "__row"), "taken-rows")
    # A row goes along as one struct, so its columns' names meet none of the plan's.
    named = docs.select(row_name(docs).alias("__row"), F.struct(*columns_of(docs)).alias("__doc"))
    each = F.floor(F.col("times") / F.col("n")).cast("int")
    out = join_counted(named, plan, ["__row"], light.count()).select("__doc", F.explode(F.array_repeat(F.lit(1), each)).alias("__time")).select("__doc.*")
    # A budget ends among equal rows in one place of a leaf at most: the odd ones come as one row and its number.
    cut = plan.where(F.col("times") % F.col("n") != 0)
    if not cut.isEmpty():
        odd = named.join(cut, "__row").groupBy("__row").agg(F.any_value("__doc").alias("__doc"), F.max(F.col("times") % F.col("n")).cast("int").alias("odd"))
        out = out.unionByName(odd.select("__doc", F.explode(F.array_repeat(F.lit(1), F.col("odd"))).alias("__time")).select("__doc.*"))
    return out

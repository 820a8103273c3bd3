"""First-match merging as rounds: what a pass in order would keep, without a pass.

In a pass each record joins the first one kept so far that it matches, or is kept itself. Kept records are the first independent
set in that order: a record is settled once every earlier record that it matches is. In a round all records without an open
earlier match are kept and what matches them is not. Records with one open earlier match form chains, along which kept and
not kept alternate; where a few rounds leave some open, pointers that double settle a chain in as many steps as the logarithm
of its length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.functions.store import stored


def _chains(live: DataFrame, heads: DataFrame) -> DataFrame:
    """node and kept of the nodes on chains that begin at a head. A chain's nodes have one open earlier match each."""
    chain = live.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.min("a").alias("to")).where("n = 1").select(F.col("b").alias("node"), "to", F.lit(True).alias("odd"))
    chain = stored(chain)
    while True:
        onward = chain.select(F.col("node").alias("to"), F.col("to").alias("far"), F.col("odd").alias("more"))
        if chain.join(onward, "to", "left_semi").isEmpty():
            break
        chain = stored(chain.join(onward, "to", "left").select("node", F.coalesce("far", "to").alias("to"), F.when(F.col("more"), ~F.col("odd")).otherwise(F.col("odd")).alias("odd")))
    return chain.join(heads.select(F.col("a").alias("to")), "to", "left_semi").select("node", (~F.col("odd")).alias("kept"))


#: Rounds before chains are followed: most records are settled by then, and following a chain takes steps of its own.
PLAIN_ROUNDS = 3


def merged(edges: DataFrame, most_rounds: int = 200) -> tuple[DataFrame, int]:
    """The records that a pass in order would merge into earlier ones, as `node`, and how many rounds that took.

    edges: a, b for each two records that match, a the earlier. Records in no edge are kept; they aren't carried along.
    """
    live = stored(edges.select("a", "b").distinct())
    gone = None
    for k in range(most_rounds):
        if live.isEmpty():
            return (gone if gone is not None else live.select(F.col("a").alias("node"))), k
        heads = live.select("a").distinct().join(live.select(F.col("b").alias("a")), "a", "left_anti")
        kept = heads.select(F.col("a").alias("node"))
        follow = k >= PLAIN_ROUNDS
        if follow:
            on_chain = _chains(live, heads)
            kept = kept.unionByName(on_chain.where("kept").select("node"))
        lost = live.join(kept.select(F.col("node").alias("a")), "a", "left_semi").select(F.col("b").alias("node"))
        if follow:
            lost = lost.unionByName(on_chain.where("not kept").select("node"))
        settled = stored(kept.withColumn("kept", F.lit(True)).unionByName(lost.withColumn("kept", F.lit(False))).groupBy("node").agg(F.max("kept").alias("kept")))
        new = settled.where("not kept").select("node")
        gone = new if gone is None else gone.unionByName(new)
        done = lambda c: settled.select(F.col("node").alias(c))  # noqa: B023, E731
        live = stored(live.join(done("a"), "a", "left_anti").join(done("b"), "b", "left_anti"))
    raise RuntimeError(f"merging did not settle in {most_rounds} rounds")


def first_match(edges: DataFrame, order: str = "a") -> DataFrame:
    """b and a for each record b that is merged, a the first kept record that it matches. order: a column of edges that orders a."""
    gone = stored(merged(edges)[0])
    left = edges.join(gone.select(F.col("node").alias("a")), "a", "left_anti").join(gone.select(F.col("node").alias("b")), "b", "left_semi")
    return left.groupBy("b").agg(F.min_by("a", F.struct(order, "a")).alias("a"))

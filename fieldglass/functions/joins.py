"""Joins that hold where one key has a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_split(left: DataFrame, right: DataFrame, key: str, n: str, hot: int) -> DataFrame:
    """left joined with right on a key. `n` in right is how many rows of left have the key.

    What right has of keys with more than `hot` rows is broadcast, so the caller chooses hot so that such keys are few: at most
    the rows of left divided by hot. Rows of other keys are shuffled, so no key has a task of its own.
    """
    often, rest = right.where(F.col(n) > hot), right.where(F.col(n) <= hot)
    cool = left.join(F.broadcast(often.select(key).distinct()), key, "left_anti")
    return left.join(F.broadcast(often), key).unionByName(cool.join(rest.hint("merge"), key))

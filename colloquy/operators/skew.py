"""Joins that survive a key which holds a third of all rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than 1/HOT_SHARE of the rows, and more than HOT_LEAST, is hot; so there are fewer than HOT_SHARE hot keys.
HOT_SHARE = 2000
HOT_LEAST = 100_000


def join_unique(big: DataFrame, small: DataFrame, key: str | Sequence[str], how: str = "inner") -> DataFrame:
    """``big`` with the one row of ``small`` for its key, ``how`` inner or left.

    Rows of hot keys stay where they are and get theirs by broadcast, which is bounded by
    HOT_SHARE rows; the others are shuffled.  Rows without a key match nothing: they are
    left out or kept with nulls, but never shuffled to one task.  Counts the keys eagerly.
    """
    keys = [key] if isinstance(key, str) else list(key)
    counts = big.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    total = counts.agg(F.sum("__n")).first()[0] or 0
    bar = max(HOT_LEAST, total // HOT_SHARE)
    hot = counts.filter(F.col("__n") > bar).select(*keys)
    if total <= bar or hot.isEmpty():
        return big.join(small, keys, how)
    there = reduce(and_, [F.col(k).isNotNull() for k in keys])
    keyed, hot = big.filter(there), F.broadcast(hot.filter(there))
    near = keyed.join(hot, keys, "left_semi").join(F.broadcast(small.join(hot, keys, "left_semi")), keys, how)
    out = near.unionByName(keyed.join(hot, keys, "left_anti").join(small, keys, how))
    return out.unionByName(big.filter(~there), allowMissingColumns=True) if how == "left" else out

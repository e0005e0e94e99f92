"""Ranking inside groups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top(items: DataFrame, group: Sequence[str | Column], order: Sequence[Column], n: int, name: str = "rank") -> DataFrame:
    """The first n rows of each group; Spark prunes before the shuffle (WindowGroupLimit), so hot groups move n rows per task."""
    w = Window.partitionBy(*group).orderBy(*order)
    return items.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)


def top_distinct(items: DataFrame, group: Sequence[str], distinct: Column, order: Sequence[Column], n: int) -> DataFrame:
    """The best row per distinct value, then the first n of those, densely ranked."""
    best = top(items.withColumn("__d", distinct), [*group, "__d"], order, 1, "__r").drop("__r", "__d")
    return top(best, group, order, n)


def with_fallback(chosen: DataFrame, pool: DataFrame, group: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Groups of the pool from which nothing was chosen give their single best row at rank 1."""
    missing = pool.join(chosen.select(*group).distinct(), list(group), "left_anti")
    extra = top(missing, group, order, 1).withColumn("selection_reason", F.lit("best_grounded_fallback"))
    return chosen.withColumn("selection_reason", F.lit("above_threshold")).unionByName(extra)


def selection_valid(selection: DataFrame, candidates: DataFrame, run: str, most: int = 3) -> DataFrame:
    """Whether a proposed selection of a run may stand; one violation voids all of it.

    Known ids, each once, their own type, unique categories per type, ranks 1..k with k <= most.
    """
    known = candidates.select(F.col("id").alias("signal_id"), F.col(run).alias("k_run"), F.col("item_type").alias("k_type"), F.lower(F.trim("category")).alias("k_category"))
    joined = selection.join(known, "signal_id", "left")
    fits = F.coalesce((F.col("k_run") == F.col(run)) & (F.col("k_type") == F.col("item_type")), F.lit(False))
    rows = joined.withColumn("fits", fits)
    per = rows.groupBy(run, "item_type").agg(
        F.bool_and("fits").alias("fits"), F.count(F.lit(1)).alias("n"), F.count_distinct("signal_id").alias("ids"),
        F.count_distinct("k_category").alias("categories"), F.count_distinct("rank").alias("ranks"), F.min("rank").alias("lo"), F.max("rank").alias("hi"),
    )
    ok = F.col("fits") & (F.col("n") <= most) & (F.col("ids") == F.col("n")) & (F.col("categories") == F.col("n")) & (F.col("ranks") == F.col("n"))
    ok = ok & (F.col("lo") == 1) & (F.col("hi") == F.col("n"))
    return per.groupBy(run).agg(F.bool_and(ok).alias("valid"))


def reaches(score: Column, by: Column, least: Mapping[str, float]) -> Column:
    """Whether the score reaches the bound of its kind; other kinds never do."""
    out = F.lit(False)
    for name, bound in least.items():
        out = out | ((by == name) & (score >= bound))
    return F.coalesce(out, F.lit(False))

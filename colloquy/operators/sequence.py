"""Positions and neighbours inside ordered groups, without one task per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch

#: Rows of one group that share a window; a longer group is split into blocks.
BLOCK = 4096


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[str | Column], name: str = "pos") -> DataFrame:
    """Dense positions from 0 inside each group.

    The rows are range-sorted on (group, order), so a group that holds a third of
    all rows spreads over many partitions; each partition numbers its own rows and
    one summary row per (group, partition) carries the offsets.  Runs eagerly.
    Nulls of ``order`` come first; ties should be broken by the caller's last column.
    """
    scratch = Scratch(df.sparkSession, "numbered")
    by = [*[F.col(g) for g in group], *order]
    at = F.monotonically_increasing_id()
    placed = scratch.save(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", at), "placed")
    placed = placed.withColumn("__part", F.shiftright("__at", 33))
    pieces = placed.groupBy(*group, "__part").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("__skip", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    pieces = pieces.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], F.col("__part").alias("__p"), "__first", "__skip")
    on = [F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(group)] + [F.col("__part") == F.col("__p")]
    joined = placed.join(pieces, on)
    value = (F.col("__at") - F.col("__first") + F.col("__skip")).cast("int")
    return joined.select(*df.columns, value.alias(name))


def running(df: DataFrame, group: Sequence[str], order: Sequence[Column], sums: Sequence[str]) -> DataFrame:
    """Running sums inside each group, the row itself included, as ``<column>_cum``; ``order`` must not tie.

    As in ``numbered`` the rows are range-sorted on (group, order); each partition sums its own rows and
    one row per (group, partition) carries the offsets, so neither a hot group nor a single
    group over everything is one task.  Runs eagerly.
    """
    scratch = Scratch(df.sparkSession, "running")
    by = [*[F.col(g) for g in group], *order]
    placed = scratch.save(df.repartitionByRange(*by).withColumn("__part", F.spark_partition_id()), "placed")
    pieces = placed.groupBy(*group, "__part").agg(*[F.sum(c).alias(f"__t_{c}") for c in sums])
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], F.col("__part").alias("__p"),
                           *[F.coalesce(F.sum(f"__t_{c}").over(before), F.lit(0)).alias(f"__skip_{c}") for c in sums])
    inside = Window.partitionBy(*group, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = placed.select("*", *[F.sum(c).over(inside).alias(f"__own_{c}") for c in sums])
    on = [F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(group)] + [F.col("__part") == F.col("__p")]
    return own.join(pieces, on).select(*df.columns, *[(F.col(f"__own_{c}") + F.col(f"__skip_{c}")).alias(f"{c}_cum") for c in sums])


def with_neighbours(df: DataFrame, group: Sequence[str], pos: str, columns: Sequence[str], reach: int = 1) -> DataFrame:
    """Each row with the values of its neighbours: ``column_m1`` is one before, ``column_p1`` one after.

    Windows run over blocks of BLOCK positions with a halo of ``reach`` rows on either side,
    so lag and lead are exact and no window holds more than BLOCK rows of a group.
    """
    p = F.col(pos)
    home = F.floor(p / BLOCK)
    inside = F.pmod(p, F.lit(BLOCK))
    blocks = F.array_compact(F.array(home, F.when(inside < reach, home - 1), F.when(inside >= BLOCK - reach, home + 1)))
    spread = df.withColumn("__block", F.explode(blocks))
    w = Window.partitionBy(*group, "__block").orderBy(pos)
    for c in columns:
        for d in range(1, reach + 1):
            spread = spread.withColumn(f"{c}_m{d}", F.lag(c, d).over(w)).withColumn(f"{c}_p{d}", F.lead(c, d).over(w))
    return spread.filter(F.col("__block") == home).drop("__block")


def batched(df: DataFrame, pos: str, size: int, name: str = "batch") -> DataFrame:
    """Consecutive chunks of ``size`` rows, numbered from 1."""
    return df.withColumn(name, (F.floor(F.col(pos) / size) + 1).cast("int"))


def listed(df: DataFrame, order: Sequence[str | Column], name: str = "place") -> DataFrame:
    """Places from 0 over the whole table, by a range sort; ``order`` must not tie."""
    return numbered(df.withColumn("__all", F.lit(0)), ["__all"], order, name).drop("__all")

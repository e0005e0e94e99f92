"""Consolidating pairwise matches into groups: alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..session import Scratch

#: A node with more than 1/HOT_SHARE of all edge ends is hot; so there are fewer than HOT_SHARE hot nodes.
HOT_SHARE = 2000
#: Edge ends that one task bears, whatever their number per node; up to so many in all there is no hub to look for.
HOT_LEAST = 1_000_000


def _save(edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, tuple]:
    """The edges written, and their number and two sums of their hashes, observed while they are written."""
    seen = Observation()
    h = F.xxhash64("u", "v")
    watched = edges.observe(
        seen, F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x"), F.sum(F.pmod(h, F.lit(1_000_003))).alias("s")
    )
    out = scratch.save(watched, "edges")
    return out, (seen.get["n"], seen.get["x"], seen.get["s"])


def _with_min(ends: DataFrame, scratch: Scratch, total: int) -> tuple[DataFrame, list[DataFrame]]:
    """``ends`` (u, v) with the least neighbour ``m`` of each u, and the tables written for it.

    The minimum is a map-side combined aggregate.  Joining it back would put
    all edges of a hub into one task, so hubs (fewer than HOT_SHARE by
    construction) are joined by broadcast and only the rest is shuffled.
    """
    least = ends.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    bar = max(HOT_LEAST, total // HOT_SHARE)
    if total <= bar:
        return ends.join(least.select("u", "m"), "u"), []
    least = scratch.save(least, "least")
    hub = least.filter(F.col("n") > bar).select("u", "m")
    if hub.isEmpty():
        return ends.join(least.select("u", "m"), "u"), [least]
    hub = F.broadcast(hub)
    cold = ends.join(hub, "u", "left_anti").join(least.filter(F.col("n") <= bar).select("u", "m"), "u")
    return cold.unionByName(ends.join(hub, "u")), [least]


def connected_groups(links: DataFrame, left: str, right: str) -> DataFrame:
    """Every record on a link with the least record reachable from it.

    Large-star hangs each node's larger neighbours on its least neighbour,
    small-star joins the smaller ones (and the node) to it; the two alternate
    through distributed joins until the edge set stays the same.  Each round is
    written to the shared folder, so plans stay short and a lost executor
    costs one round.  Runs eagerly.

    Defined cases: a link with a null side or equal sides is no link; repeated
    and reversed links count once; an empty table gives an empty result; other
    columns of ``links`` are ignored.  Result: ``record_id``, ``group_id``.
    """
    scratch = Scratch(links.sparkSession, "groups")
    a, b = F.col(left), F.col(right)
    edges = (
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .filter(a.isNotNull() & b.isNotNull() & (a != b))
        .distinct()
    )
    edges, seen = _save(edges, scratch)
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        joined, used1 = _with_min(both, scratch, 2 * seen[0])
        large = scratch.save(
            joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("m", "u").alias("v")), "large"
        )
        joined, used2 = _with_min(large, scratch, seen[0])
        # every smaller neighbour but the least, and the node itself, hang on the least one
        hung = F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        small = joined.select(F.explode(hung).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        fresh, now = _save(small, scratch)
        scratch.drop(edges, large, *used1, *used2)
        edges = fresh
        if now == seen:
            break
        seen = now
    members = edges.select(F.col("u").alias("record_id"), F.col("v").alias("group_id"))
    roots = edges.select(F.col("v").alias("record_id")).distinct().withColumn("group_id", F.col("record_id"))
    return members.unionByName(roots)

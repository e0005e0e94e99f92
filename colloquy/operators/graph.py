"""Components, cliques and cycles of small graphs inside runs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """The least id reachable from each node over the undirected edges ``a``, ``b``.

    Every node points to a smaller node.  In a round each edge offers the pointer of its
    far end's pointer to its near end and to the node that one points to, so whole
    trees hook at once, and all pointers are halved; long chains close in few rounds.
    Rounds are written to the shared folder.  Nodes without an edge keep their own id.
    Result: ``id``, ``component``.
    """
    scratch = Scratch(edges.sparkSession, "components")
    fine = edges.filter("a is not null and b is not null and a <> b")
    both = scratch.save(fine.select("a", "b").unionByName(fine.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label = scratch.save(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("f")), "label")
    while True:
        up = label.join(label.select(F.col("id").alias("f"), F.col("f").alias("g")), "f")
        up = scratch.save(up.select("id", "f", "g"), "up")
        offer = both.join(up.select(F.col("id").alias("b"), "g"), "b").groupBy("a").agg(F.min("g").alias("g"))
        offer = offer.join(label.select(F.col("id").alias("a"), "f"), "a")
        offer = offer.select(F.explode(F.array(F.struct(F.col("a").alias("id"), "g"), F.struct(F.col("f").alias("id"), "g"))).alias("o")).select("o.id", "o.g")
        best = offer.groupBy("id").agg(F.min("g").alias("offered"))
        fresh = up.join(best, "id", "left").select("id", "f", F.least("f", "g", F.coalesce("offered", "f")).alias("now"))
        fresh = scratch.save(fresh, "label")
        still = fresh.filter("now <> f").isEmpty()
        scratch.drop(label, up)
        label = scratch.load(fresh._colloquy_path, fresh.schema).select("id", F.col("now").alias("f"))
        label._colloquy_path = fresh._colloquy_path
        if still:
            break
    found = label.select("id", F.col("f").alias("component"))
    if nodes is None:
        return found
    return nodes.select("id").distinct().join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def complete_link(nodes: DataFrame, accepted: DataFrame, block: str) -> DataFrame:
    """Greedy complete-link groups inside each block, in id order.

    A node joins the first group all of whose members are accepted partners.  The
    greedy order is sequential, so a block's *linked* nodes are grouped in one Arrow
    call; nodes without a partner never enter it, and connected parts of a block are
    separate calls.  Result: ``id``, ``group_id`` (the least member).
    """
    part = components(accepted.select("a", "b"))
    pairs = accepted.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = pairs.join(part.select(F.col("id").alias("a"), "component"), "a")

    def group(frame: pd.DataFrame) -> pd.DataFrame:
        partners: dict[int, set[int]] = {}
        for a, b in zip(frame["a"], frame["b"]):
            partners.setdefault(a, set()).add(b)
            partners.setdefault(b, set()).add(a)
        groups: list[list[int]] = []
        for node in sorted(partners):
            home = next((g for g in groups if all(m in partners[node] for m in g)), None)
            if home is None:
                groups.append([node])
            else:
                home.append(node)
        return pd.DataFrame([(m, g[0]) for g in groups for m in g], columns=["id", "group_id"])

    linked = pairs.groupBy("component").applyInPandas(group, "id long, group_id long")
    return nodes.select("id", block).distinct().join(linked, "id", "left").select("id", F.coalesce("group_id", "id").alias("group_id"))


def three_cycles(wins: DataFrame, block: str) -> DataFrame:
    """Directed triangles of ``winner`` over ``loser`` inside a block, each once with a < b < c.

    Every compared pair is an edge from its end of fewer pairs to the other (then by id), so a node that all others meet opens no
    wedges of its own: two edges from the same node are joined, and the third side closes them.
    """
    e = wins.select(F.col(block).alias("k"), "winner", "loser").filter("winner <> loser").distinct()
    # which way a pair was decided: by the smaller id, the greater, or both
    pairs = e.groupBy("k", F.least("winner", "loser").alias("p"), F.greatest("winner", "loser").alias("q")).agg(
        F.bool_or(F.col("winner") < F.col("loser")).alias("up"), F.bool_or(F.col("winner") > F.col("loser")).alias("down")
    )
    degree = pairs.select("k", F.explode(F.array("p", "q")).alias("n")).groupBy("k", "n").agg(F.count(F.lit(1)).alias("d"))
    pairs = pairs.join(degree.select("k", F.col("n").alias("p"), F.col("d").alias("dp")), ["k", "p"]).join(degree.select("k", F.col("n").alias("q"), F.col("d").alias("dq")), ["k", "q"])
    low = F.col("dp") <= F.col("dq")
    edges = pairs.select("k", F.when(low, F.col("p")).otherwise(F.col("q")).alias("u"), F.when(low, F.col("q")).otherwise(F.col("p")).alias("v"))
    wedge = edges.select("k", "u", F.col("v").alias("x")).join(edges.select("k", "u", F.col("v").alias("y")), ["k", "u"]).filter("x < y")
    triangle = wedge.join(pairs.select("k", F.col("p").alias("x"), F.col("q").alias("y")), ["k", "x", "y"])
    n = F.array_sort(F.array("u", "x", "y"))
    triangle = triangle.select("k", n[0].alias("a"), n[1].alias("b"), n[2].alias("c"))
    side = lambda s, t, name: pairs.select("k", F.col("p").alias(s), F.col("q").alias(t), F.col("up").alias(f"{name}_up"), F.col("down").alias(f"{name}_down"))
    told = triangle.join(side("a", "b", "ab"), ["k", "a", "b"]).join(side("b", "c", "bc"), ["k", "b", "c"]).join(side("a", "c", "ac"), ["k", "a", "c"])
    ring = (F.col("ab_up") & F.col("bc_up") & F.col("ac_down")) | (F.col("ab_down") & F.col("bc_down") & F.col("ac_up"))
    return told.filter(ring).select(F.col("k").alias(block), "a", "b", "c")

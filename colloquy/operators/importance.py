"""Importance estimates: structured scores, tiers, listwise and pairwise outputs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import reasons
from .sequence import numbered

#: Ordinal of each level; the greatest possible sum is 19.
CENTRALITY = {"decisive": 4, "major": 3, "contributing": 2, "minor": 1, "contextual": 0, "indeterminate": 0}
PRIORITY = {
    "explicitly_ranked": 4, "explicitly_required": 4, "explicitly_emphasized": 3, "repeatedly_emphasized": 3,
    "implicitly_central": 2, "mentioned_once": 1, "unclear": 0,
}
DEPENDENCY = {
    "gating_condition": 4, "timing_condition": 3, "outcome_driver": 3, "comparative_preference": 2, "supporting_detail": 1, "no_dependency": 0, "indeterminate": 0,
}
CONSEQUENCE = {
    "decision_stopping": 4, "materially_changes_decision": 3, "affects_timing_or_terms": 2, "influences_preference": 1, "limited_effect": 0.5, "no_stated_effect": 0, "indeterminate": 0,
}
ATTENTION = {"dominant": 3, "repeated": 2.5, "developed": 2, "brief": 1, "incidental": 0, "indeterminate": 0}
TIER_ORDER = {"critical": 5, "high": 4, "medium": 3, "low": 2, "peripheral": 1, "indeterminate": 0}
TIER_CUTS = ((0.80, "critical"), (0.65, "high"), (0.45, "medium"), (0.25, "low"))
GREATEST = 19.0


def level(column: str, table: Mapping[str, float]) -> Column:
    """The ordinal of a level, null for an unknown one."""
    pairs = [F.lit(x) for item in table.items() for x in (item[0], float(item[1]))]
    return F.element_at(F.create_map(*pairs), F.col(column))


def structured_score(levels: Sequence[Column], greatest: float = GREATEST) -> Column:
    return F.round(sum(levels[1:], levels[0]) / greatest, 4)


def tier(score: Column) -> Column:
    out = F.lit("peripheral")
    for cut, name in reversed(TIER_CUTS):
        out = F.when(score >= cut, name).otherwise(out)
    return F.when(score.isNotNull(), out)


def listwise_faults(items: DataFrame, expected: DataFrame, group: str) -> DataFrame:
    """Per group what is wrong with a listwise output: repeated, unknown or missing ids, ranks not 1..n, scores not finite."""
    bad = F.col("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf"))
    got = items.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("candidate_id").alias("ids"), F.count_distinct("rank").alias("ranks"),
        F.min("rank").alias("lo"), F.max("rank").alias("hi"), F.count_if(bad).alias("bad"),
    )
    key = [group, "candidate_id"]
    want = expected.select(*key).distinct()
    unknown = items.select(*key).distinct().join(want, key, "left_anti").groupBy(group).agg(F.count(F.lit(1)).alias("unknown"))
    missing = want.join(items.select(*key).distinct(), key, "left_anti").groupBy(group).agg(F.count(F.lit(1)).alias("missing"))
    out = got.join(unknown, group, "full").join(missing, group, "full").na.fill(0, ["n", "ids", "ranks", "lo", "hi", "bad", "unknown", "missing"])
    return out.select(
        group, (F.col("n") - F.col("ids")).alias("repeated"), "unknown", "missing",
        ((F.col("ranks") != F.col("n")) | (F.col("n") > 0) & ((F.col("lo") != 1) | (F.col("hi") != F.col("n")))).alias("ranks_broken"), F.col("bad").alias("not_finite"),
    )


def pairs_complete(pairs: DataFrame, members: DataFrame, group: str) -> DataFrame:
    """Whether a group has exactly one result for each unordered pair of its members, by counts and not by listing them."""
    n = members.groupBy(group).agg(F.count_distinct("candidate_id").alias("k"))
    known = members.select(F.col(group), F.col("candidate_id").alias("id")).distinct()
    both = pairs.select(group, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    fine = both.join(known.withColumnRenamed("id", "a"), [group, "a"], "left_semi").join(known.withColumnRenamed("id", "b"), [group, "b"], "left_semi").filter("a <> b")
    counts = both.groupBy(group).agg(F.count(F.lit(1)).alias("rows"))
    good = fine.groupBy(group).agg(F.count_distinct("a", "b").alias("good"))
    out = n.join(counts, group, "left").join(good, group, "left").na.fill(0, ["rows", "good"])
    want = F.col("k") * (F.col("k") - 1) / 2
    return out.select(group, "k", "rows", ((F.col("rows") == want) & (F.col("good") == want)).alias("complete"))


def copeland(pairs: DataFrame, members: DataFrame, group: str) -> DataFrame:
    """Wins count 1, ties one half; ranked by wins, then by id.  ``pairs`` has a, b, winner (null: tie)."""
    sides = pairs.select(group, F.explode(F.array("a", "b")).alias("candidate_id"), "winner")
    point = F.when(F.col("winner").isNull(), 0.5).when(F.col("winner") == F.col("candidate_id"), 1.0).otherwise(0.0)
    wins = sides.groupBy(group, "candidate_id").agg(F.sum(point).alias("wins"))
    all_ = members.select(group, "candidate_id").distinct().join(wins, [group, "candidate_id"], "left").na.fill(0.0, ["wins"])
    return numbered(all_, [group], [F.desc("wins"), F.col("candidate_id")], "rank").withColumn("rank", F.col("rank") + 1)


def five_levels() -> list[Column]:
    """The ordinals of the five dimensions, whose greatest sum is GREATEST."""
    return [level("decision_centrality", CENTRALITY), level("dependency_role", DEPENDENCY), level("consequence_strength", CONSEQUENCE), level("priority_expression", PRIORITY), level("attention_strength", ATTENTION)]


def warnings(given: Column, score_tier: Column) -> Column:
    """The warnings of an estimate, given ones first, without repeats: dimensions against the tier, tiers apart, open review, other's context."""
    claimed = F.col("importance_tier")
    weak = (F.col("consequence_strength") == "no_stated_effect") | (F.col("attention_strength") == "incidental") | (F.col("decision_centrality") == "contextual")
    strong = (F.col("dependency_role") == "gating_condition") | (F.col("consequence_strength") == "decision_stopping") | (F.col("decision_centrality") == "decisive")
    order = F.create_map(*[F.lit(x) for item in TIER_ORDER.items() for x in item])
    apart = F.abs(F.element_at(order, claimed) - F.element_at(order, score_tier)) > 1
    found = reasons([
        ("critical_dimension_conflict", (claimed == "critical") & weak), ("peripheral_dimension_conflict", (claimed == "peripheral") & strong),
        ("tier_score_inconsistency", (claimed != "indeterminate") & apart), ("unresolved_validation", F.col("validation_verdict") == "needs_review"),
        ("representative_context_present", F.col("representative_context")),
    ])
    return F.array_distinct(F.concat(F.coalesce(given, F.array().cast("array<string>")), found))


def eligible(items: DataFrame) -> DataFrame:
    """Current and traceable drivers and blockers that passed or wait for review; nulls are no."""
    return items.filter(F.col("is_current") & F.col("traceable") & F.col("item_type").isin("driver", "blocker") & F.col("validation_verdict").isin("pass", "needs_review"))


RUN_MODES = ("disabled", "listwise", "pairwise", "hybrid")


def run_mode(mode: str, listwise: DataFrame, pairwise: DataFrame, members: DataFrame, group: str, least: int = 2) -> DataFrame:
    """Per group the candidates with the rank of the mode, and why a group has none.

    ``listwise`` and ``pairwise`` have group, candidate_id, rank and hold valid groups only.  hybrid takes the listwise rank and
    warns where the pairwise one names another first.  A group of fewer than ``least`` members, or without a valid answer, has one row with a
    null candidate and the ``warning``; disabled gives no rows.
    """
    if mode not in RUN_MODES:
        raise ValueError(f"mode is {mode}, not one of {RUN_MODES}")
    sizes = members.groupBy(group).agg(F.count_distinct("candidate_id").alias("k"))
    if mode == "disabled":
        return sizes.limit(0).select(group, F.lit(None).cast("bigint").alias("candidate_id"), F.lit(None).cast("int").alias("rank"), F.lit(None).cast("string").alias("warning"))
    taken = pairwise if mode == "pairwise" else listwise
    rows = sizes.join(taken.select(group, "candidate_id", "rank"), group, "left")
    few = F.col("k") < least
    warning = F.when(few, "too_few_candidates").when(F.col("candidate_id").isNull(), "fallback_used")
    if mode == "hybrid":
        first = lambda df, name: df.filter("rank = 1").groupBy(group).agg(F.min("candidate_id").alias(name))
        rows = rows.join(first(listwise, "by_list"), group, "left").join(first(pairwise, "by_pairs"), group, "left")
        warning = warning.when(F.col("by_list") != F.col("by_pairs"), "modes_disagree")
    rows = rows.withColumn("warning", warning)
    rows = rows.withColumn("candidate_id", F.when(~few, F.col("candidate_id"))).withColumn("rank", F.when(~few, F.col("rank")))
    return rows.select(group, "candidate_id", "rank", "warning").distinct()

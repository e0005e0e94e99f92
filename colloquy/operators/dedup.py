"""Semantic duplicates inside a run: candidate pairs, groups, the elected member."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import like, squeeze, strip
from .graph import components
from .sequence import numbered
from .skew import join_unique

def embedding_text() -> Column:
    """Type, category, rationale and quote by line; nulls as empty lines."""
    return F.concat_ws("\n", *[F.coalesce(c, F.lit("")) for c in ("item_type", "category", "rationale", "advisor_quote")])


def pair_text(form: str) -> Column:
    """One side of a compared pair in one of the four forms; their wording is fixed, since models were tuned on it."""
    kind, category, quote = F.col("item_type"), squeeze(F.col("category")), strip(F.col("advisor_quote"))
    side = F.when(kind == "driver", "supports move").otherwise("opposes move")
    factor = F.format_string("Type: %s\nDecision direction: %s\nDecision factor: %s\nAdvisor evidence: %s", kind, side, category, quote)
    forms = {
        "type_category_evidence": F.format_string("Type: %s\nCategory: %s\nAdvisor evidence: %s", kind, category, quote),
        "decision_factor_evidence": factor,
        "decision_factor_evidence_rationale": F.concat(factor, F.lit("\nGenerated rationale: "), strip(F.col("rationale"))),
        "evidence_only": F.concat(F.lit("Advisor evidence: "), quote),
    }
    return forms[form]


def _tile_pairs(threshold: float):
    """Cosines of two tiles of vectors as one matrix product."""

    def unit(vectors: pa.ListArray) -> np.ndarray:
        m = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)

    def score(batches):
        for batch in batches:
            left, right, sim, row = [], [], [], []
            for i in range(batch.num_rows):
                ia, va, ib, vb = (batch.column(c)[i].values for c in ("ia", "va", "ib", "vb"))
                s = unit(va) @ unit(vb).T
                ia, ib = ia.to_numpy(), ib.to_numpy()
                x, y = np.nonzero((s >= threshold - 1e-12) & (ia[:, None] != ib[None, :]))
                a, b = ia[x], ib[y]
                # inside a tile both orders come out; between tiles one does
                one = a < b if np.array_equal(ia, ib) else np.ones(len(a), bool)
                left.append(np.minimum(a, b)[one])
                right.append(np.maximum(a, b)[one])
                sim.append(s[x, y][one])
                row.append(np.full(one.sum(), i))
            cat = lambda p, t: np.concatenate(p).astype(t) if p else np.zeros(0, t)
            keys = [batch.column(c).take(pa.array(cat(row, np.int64))) for c in batch.schema.names[4:]]
            yield pa.RecordBatch.from_arrays([pa.array(cat(left, np.int64)), pa.array(cat(right, np.int64)), pa.array(cat(sim, float)), *keys], ["a", "b", "s", *batch.schema.names[4:]])

    return score


def similar_pairs(items: DataFrame, block: Sequence[str], vector: str, threshold: float, tile: int = 256) -> DataFrame:
    """Pairs a < b of one block whose vectors reach the cosine threshold; ``similarity`` has six places.

    A block's vectors are numbered without a task per block and packed into tiles of at most ``tile``;
    every two tiles of a block meet under a key of their own and are scored by one matrix product, so a large
    block is spread over (n / tile)^2 / 2 keys and no row holds more than two tiles.  All pairs of a block are compared: blocks are runs
    or labels, not the corpus.  Pairs below the
    threshold never leave the worker.  Vectors pair with those of their own dimension; null, empty and
    zero vectors have no partner.  A block's key may be null.
    """
    keyed = items.filter(F.size(vector) > 0).select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(block)], "id", F.size(vector).alias("dim"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    keys = [f"k{i}" for i in range(len(block))] + ["dim"]
    placed = numbered(keyed, keys, ["id"]).withColumn("tile", F.floor(F.col("pos") / tile))
    tiles = placed.groupBy(*keys, "tile").agg(F.collect_list(F.struct("id", "v")).alias("m"))
    last = placed.groupBy(*keys).agg(F.max("tile").alias("last"))
    on = [F.col(k).eqNullSafe(F.col(f"x_{k}")) for k in keys]
    tiles = tiles.join(last.select(*[F.col(k).alias(f"x_{k}") for k in keys], "last"), on).select(*keys, "tile", "last", F.col("m.id").alias("ids"), F.col("m.v").alias("vs"))
    # a tile goes to every pair it is part of, so the pair is the key and a hot block is spread over its pairs of tiles
    sent = tiles.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("other"), "tile", "ids", "vs")
    pair = [F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi")]
    both = sent.groupBy(*keys, *pair).agg(F.array_sort(F.collect_list(F.struct("tile", "ids", "vs"))).alias("t"))
    both = both.select(F.col("t")[0]["ids"].alias("ia"), F.col("t")[0]["vs"].alias("va"), F.element_at("t", -1)["ids"].alias("ib"), F.element_at("t", -1)["vs"].alias("vb"), *keys[:-1])
    schema = "a long, b long, s double" + "".join(f", k{i} {t}" for i, t in enumerate(dict(items.dtypes)[c] for c in block))
    out = both.mapInArrow(_tile_pairs(threshold), schema)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(block)], "a", "b", F.round("s", 6).alias("similarity"))


def reason_edges(items: DataFrame, block: Sequence[str], conclusion: str, link: str, reach: int = 4) -> DataFrame:
    """Edges between a linked conclusion and the reasons said shortly before it, by turn id.

    Of two conclusions the one with the smaller id is the conclusion.  Reasons are bucketed
    by their last turn, so the join is on turn ids and not over a whole block.
    """
    text = F.concat_ws(" ", F.coalesce("category", F.lit("")), F.col("advisor_quote"), F.coalesce("rationale", F.lit("")))
    # repeated row blocks aside, only items that cite turns can be near each other
    cited = items.filter(F.size("source_turn_ids") > 0).select(
        *block, "id", like(text, conclusion).alias("concludes"), like(F.col("advisor_quote"), link).alias("linked"),
        F.array_min("source_turn_ids").alias("first"), F.array_max("source_turn_ids").alias("last"),
    )
    end = cited.filter("concludes and linked").select(*block, F.col("id").alias("c"), F.explode(F.sequence(F.col("first") - reach, F.col("first"))).alias("last"))
    why = cited.select(*block, F.col("id").alias("r"), F.col("concludes").alias("also"), "last")
    met = end.join(why, [*block, "last"]).filter("c <> r and (not also or c < r)")
    return met.select(*block, F.least("c", "r").alias("a"), F.greatest("c", "r").alias("b")).distinct()


def elect(items: DataFrame, group: str, order: Sequence[Column], id: str = "id") -> DataFrame:
    """Each item with its group's elected member, the greatest by ``order`` and then the smaller id.

    One combined ``max_by`` per group and a join back that splits off hot groups; no window over a group.
    """
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)], (-F.col(id)).alias("neg"))
    best = items.groupBy(group).agg(F.max_by(id, key).alias("canonical_id"), F.count(F.lit(1)).alias("members"))
    return join_unique(items, best, group).withColumn("is_canonical", F.col(id) == F.col("canonical_id"))


def enrich(elected: DataFrame, group: str) -> DataFrame:
    """The elected members with the distinct categories of the others, in id order, added to their rationale."""
    others = elected.filter("not is_canonical and category is not null").groupBy(group, "category").agg(F.min("id").alias("first"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "category"))), lambda x: x["category"]), "; ")
    reasons = others.groupBy(group).agg(joined.alias("reasons"))
    rows = elected.filter("is_canonical").join(reasons, group, "left")
    added = F.concat(F.regexp_replace(F.coalesce("rationale", F.lit("")), r"\.+$", ""), F.lit(" Supporting reasons: "), F.col("reasons"), F.lit("."))
    return rows.select("id", F.when(F.col("reasons").isNull(), F.col("rationale")).otherwise(added).alias("rationale"))


def similarity_groups(items: DataFrame, block: Sequence[str], vector: str, threshold: float, extra: DataFrame | None = None) -> DataFrame:
    """Single-link groups over similar pairs, closed with extra edges; ``id``, ``component``."""
    edges = similar_pairs(items, block, vector, threshold).select("a", "b")
    if extra is not None:
        edges = edges.unionByName(extra.select("a", "b"))
    return components(edges, items)


def default_keys(final: Column, explicit: Column, support: Column, risk: Column, concludes: Column | None = None) -> list[Column]:
    """Order of election: a conclusion first in groups with a reason edge, then score, explicit evidence, support, low risk.

    Unknown scores are lowest, an unknown risk is 1.
    """
    low = F.lit(float("-inf"))
    first = [] if concludes is None else [F.coalesce(concludes, F.lit(False))]
    return [*first, F.coalesce(final, low), F.coalesce(explicit, F.lit(False)), F.coalesce(support, low), -F.coalesce(risk, F.lit(1.0))]


def active_keys(final: Column, explicit: Column, owner: Column, support: Column, risk: Column, quote: Column, timestamp: Column) -> list[Column]:
    """Order of election of the other mode: explicit, owner's side, score, support, low risk, words of the quote, time."""
    words = F.size(F.filter(F.split(F.coalesce(quote, F.lit("")), r"\s+"), lambda w: w != ""))
    return [
        F.coalesce(explicit, F.lit(False)), F.coalesce(owner, F.lit(-1.0)), F.coalesce(final, F.lit(float("-inf"))), F.coalesce(support, F.lit(-1.0)),
        -F.coalesce(risk, F.lit(1.0)), words, F.coalesce(timestamp, F.lit("")),
    ]


def best_scores(elected: DataFrame, group: str, score: str, lifted: Column) -> DataFrame:
    """The elected members; in groups where ``lifted`` holds for some member they take the best score of the group."""
    best = elected.groupBy(group).agg(F.max(score).alias("__best"), F.bool_or(lifted).alias("__lift"))
    rows = elected.filter("is_canonical").join(best, group)
    return rows.withColumn(score, F.when(F.col("__lift"), F.coalesce("__best", score)).otherwise(F.col(score))).drop("__best", "__lift")


def relationships(elected: DataFrame, group: str, lifted: DataFrame | None = None) -> DataFrame:
    """One row per duplicate: the member it gave way to and why.  ``lifted`` has the groups with a reason edge."""
    rows = elected.filter("not is_canonical").withColumn("edge", F.lit(False))
    if lifted is not None:
        rows = rows.drop("edge").join(lifted.select(group).distinct().withColumn("edge", F.lit(True)), group, "left")
    why = F.when(F.col("edge"), "nearby_reason_conclusion").otherwise("semantic_similarity")
    return rows.select(F.col("id").alias("duplicate_id"), "canonical_id", F.concat(F.lit("g_"), F.col("canonical_id").cast("string")).alias("group_label"), why.alias("reason"))


MODES = ("embedding_only", "shadow", "active")


def by_mode(mode: str, items: DataFrame, baseline: Callable[[], DataFrame], proposed: Callable[[], DataFrame], keep_baseline: bool = True) -> tuple[DataFrame, str | None]:
    """Groups (``id``, ``component``) of a mode, and the failure if a fallback was taken.

    embedding_only: the baseline; shadow: the proposal is made and the baseline stands; active: the proposal stands.  An unknown
    mode leaves every item alone; a proposal that fails falls back to the baseline, or to single items if that is not wanted.
    """
    alone = items.select("id", F.col("id").alias("component"))
    if mode not in MODES:
        return alone, "invalid_configuration"
    if mode == "embedding_only":
        return baseline(), None
    try:
        made = proposed()
        return (baseline() if mode == "shadow" else made), None
    except Exception as error:  # a provider's failure must not lose the stage
        return (baseline() if mode == "shadow" or keep_baseline else alone), type(error).__name__

"""The stages in order, over all transcripts at once, keyed by run."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import squeeze
from ..operators import dedup, ranking, rules
from ..operators.skew import join_unique
from ..session import Scratch


@dataclass(frozen=True)
class EngineConfig:
    """Thresholds and weights of the stages; parameters, not policy."""

    weights: tuple[float, ...] = (0.30, 0.25, 0.20, 0.15, 0.10)
    components: tuple[str, ...] = ("advisor_ownership", "decision_impact", "explicitness", "urgency", "evidence_quality")
    merge_threshold: float = 0.86
    keep_per_type: int = 3
    least_score: float = 3.5
    block: tuple[str, ...] = ("analysis_run_id", "item_type")
    #: Reasons for which a reject leaves the pipeline; None: every hard reason.  Rejects for other reasons stay.
    excluding: tuple[str, ...] | None = None

    @classmethod
    def of(cls, spark: SparkSession, prefix: str = "colloquy.") -> EngineConfig:
        """The settings of the session (``colloquy.merge_threshold`` and the like) over the defaults; values out of range are an error."""
        kinds = {"merge_threshold": (float, 0.0, 1.0), "least_score": (float, 0.0, 5.0), "keep_per_type": (int, 1, 1000)}
        given = {}
        for name, (kind, low, high) in kinds.items():
            text = spark.conf.get(prefix + name, None)
            if text is not None:
                given[name] = kind(text)
                if not low <= given[name] <= high:
                    raise ValueError(f"{prefix}{name} is {text}, not within {low} to {high}")
        return cls(**given)


@dataclass
class Stages:
    """What each stage made; every entry is a lazy DataFrame or a written one."""

    validated: DataFrame | None = None
    scored: DataFrame | None = None
    grouped: DataFrame | None = None
    finals: DataFrame | None = None
    summary: DataFrame | None = None
    faults: list[str] = field(default_factory=list)


def _require(stage: str, df: DataFrame, columns: Sequence[str]) -> None:
    """A stage that is called alone says what it lacks."""
    lacking = [c for c in columns if c not in df.columns]
    if lacking:
        raise ValueError(f"{stage} needs {', '.join(lacking)}: run the stage before it")


def validate(candidates: DataFrame, hard: Sequence[tuple[str, Column]], soft: Sequence[tuple[str, Column]]) -> DataFrame:
    """Candidates with ``hard`` and ``soft`` reasons and the ``verdict``."""
    _require("validate", candidates, ["id", "analysis_run_id"])
    reasons = candidates.withColumn("hard", rules.reasons(hard)).withColumn("soft", rules.reasons(soft))
    return reasons.withColumn("verdict", rules.verdict(F.col("hard"), F.col("soft")))


def score(validated: DataFrame, config: EngineConfig) -> DataFrame:
    """What may go on, with ``final_score``; a candidate that lacks a component has none and goes no further."""
    _require("score", validated, ["verdict", "hard", *config.components])
    stays = F.col("verdict") != "reject" if config.excluding is None else rules.allowed(F.col("verdict"), F.get("hard", F.lit(0)), config.excluding)
    total = rules.weighted(list(zip(config.weights, [F.col(c).cast("double") for c in config.components])))
    return validated.filter(stays).withColumn("final_score", total).filter("final_score is not null")


def _explicit() -> Column:
    return F.coalesce(F.col("evidence_strength") == "explicit", F.lit(False))


def deduplicate(scored: DataFrame, config: EngineConfig) -> DataFrame:
    """Candidates with their group and its elected member: by similar vectors, or by equal quotes where there are none."""
    _require("deduplicate", scored, ["final_score", "advisor_quote", "evidence_strength", *config.block])
    if "embedding" in scored.columns:
        groups = dedup.similarity_groups(scored, config.block, "embedding", config.merge_threshold)
        joined = scored.join(groups, "id")
    else:
        key = F.to_json(F.struct(*config.block, squeeze(F.col("advisor_quote")).alias("quote")), {"ignoreNullFields": "false"})
        keyed = scored.withColumn("__key", key)
        joined = join_unique(keyed, keyed.groupBy("__key").agg(F.min("id").alias("component")), "__key").drop("__key")
    elected = dedup.elect(joined, "component", [F.col("final_score"), _explicit()])
    return Scratch(scored.sparkSession, "pipeline").save(elected, "grouped")  # read by the choice and by its fallback


def rank(grouped: DataFrame, config: EngineConfig) -> DataFrame:
    """The best elected members of each run and direction, of distinct categories, or the one best where none reaches the bound."""
    _require("rank", grouped, ["is_canonical", "final_score", "category", *config.block])
    order = [F.desc("final_score"), F.desc(_explicit()), F.asc("id")]
    pool = grouped.filter("is_canonical")
    chosen = ranking.top_distinct(pool.filter(F.col("final_score") >= config.least_score), list(config.block), squeeze(F.coalesce("category", F.lit(""))), order, config.keep_per_type)
    return ranking.with_fallback(chosen, pool, list(config.block), order)


def safely(note: Callable[[str, str], None] | None, stage: str, state: str) -> None:
    """Progress is told, but a failure to tell it never stops a stage."""
    try:
        if note is not None:
            note(stage, state)
    except Exception:  # observation only
        pass


def run(
    candidates: DataFrame, hard: Sequence[tuple[str, Column]], soft: Sequence[tuple[str, Column]], config: EngineConfig = EngineConfig(),
    note: Callable[[str, str], None] | None = None,
) -> Stages:
    """validate, score, deduplicate, rank.

    ``candidates``: id, analysis_run_id, item_type, category, advisor_quote, evidence_strength,
    the five components and optionally ``embedding``.  A run without candidates simply has no
    rows; its summary is filled with zeros by the caller's left join.  ``note`` is told (stage, started or completed or failed).
    """
    s = Stages()

    def step(name: str, make: Callable[[], DataFrame]) -> DataFrame:
        safely(note, name, "started")
        try:
            made = make()
        except Exception:
            s.faults.append(name)
            safely(note, name, "failed")
            raise
        safely(note, name, "completed")
        return made

    s.validated = step("validate", lambda: validate(candidates, hard, soft))
    s.scored = step("score", lambda: score(s.validated, config))
    s.grouped = step("deduplicate", lambda: deduplicate(s.scored, config))
    s.finals = step("rank", lambda: rank(s.grouped, config))
    s.summary = s.validated.groupBy("analysis_run_id").agg(
        F.count(F.lit(1)).alias("candidates"), *[F.count_if(F.col("verdict") == v).alias(v) for v in ("pass", "needs_review", "reject")]
    )
    return s

"""Tables as the operators want them, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sequence import numbered
from ..session import table


def signals(spark: SparkSession, base: str) -> DataFrame:
    """Candidate signals, a second delivery of a row left out."""
    return table(spark, base, "candidate_signals").dropDuplicates(["id"])


def turns(spark: SparkSession, base: str) -> DataFrame:
    """Stored turns once each, with dense positions in their transcript."""
    rows = table(spark, base, "transcript_turns").dropDuplicates(["id"])
    return numbered(rows, ["transcript_id"], [F.col("turn_index"), F.col("id")])


def results(spark: SparkSession, base: str) -> DataFrame:
    """The last scoring of each candidate in each run."""
    rows = table(spark, base, "importance_results")
    payload = ["item_type", "structured_score", "direct_model_score", "relative_rank", "importance_tier", "decision_centrality",
               "priority_expression", "validation_verdict", "mention_count", "business_score", "support_score", "transcript_id"]
    last = rows.groupBy("analysis_run_id", "candidate_id").agg(F.max_by(F.struct(*payload), F.struct("scored_at", *payload)).alias("r"))
    out = last.select("analysis_run_id", "candidate_id", "r.*")
    return out.withColumn("item_type", F.lower(F.trim("item_type")))


S = "s as (select * from candidate_signals qualify row_number() over (partition by id order by created_at) = 1)"
T = (
    "t as (select *, cast(row_number() over (partition by transcript_id order by turn_index, id) - 1 as int) as pos "
    "from (select * from transcript_turns qualify row_number() over (partition by id order by turn_index) = 1))"
)
R = (
    "r as (select * replace (lower(trim(item_type)) as item_type) from importance_results "
    "qualify row_number() over (partition by analysis_run_id, candidate_id order by scored_at desc) = 1)"
)

"""Immutable runs: latest, snapshots, replay, backfill, deletion."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import join_unique


def latest_run(runs: DataFrame, completed_only: bool = False) -> DataFrame:
    """The run of each transcript that started last, of equals the greater id."""
    pool = runs.filter("status = 'completed'") if completed_only else runs
    return pool.groupBy("transcript_id").agg(F.max_by("id", F.struct("started_at", "id")).alias("run_id"))


def visible(rows: DataFrame, latest: DataFrame, run: str = "analysis_run_id") -> DataFrame:
    """Rows of their transcript's latest run; where it has none, the rows without a run."""
    joined = join_unique(rows, latest, "transcript_id", "left")
    mine = F.col(run) == F.col("run_id")
    return joined.filter(F.when(F.col("run_id").isNotNull(), mine).otherwise(F.col(run).isNull())).drop("run_id")


def insert_absent(existing: DataFrame, fresh: DataFrame, key: Sequence[str]) -> DataFrame:
    """The fresh rows whose key is not there yet; null keys equal each other."""
    on = [existing[k].eqNullSafe(fresh[k]) for k in key]
    return fresh.join(existing.select(*key).distinct(), on, "left_anti")


def replace_keys(existing: DataFrame, fresh: DataFrame, key: Sequence[str]) -> DataFrame:
    """Delete-then-insert: rows of existing whose key is absent from fresh, and fresh."""
    return existing.join(fresh.select(*key).distinct(), list(key), "left_anti").unionByName(fresh)


def replay(snapshots: DataFrame, source_runs: DataFrame, new_id: Column) -> DataFrame:
    """Snapshots of completed runs cloned under a new run id; lineage in ``source_run_id``."""
    done = source_runs.filter("status = 'completed'").select(F.col("id").alias("analysis_run_id"))
    cloned = snapshots.join(done, "analysis_run_id").withColumnRenamed("analysis_run_id", "source_run_id")
    return cloned.withColumn("analysis_run_id", new_id)


def legacy_runs(transcripts: DataFrame, rows: DataFrame, runs: DataFrame) -> DataFrame:
    """A completed run ``legacy-<id>`` per transcript with rows but without that run."""
    owed = transcripts.join(rows.select(F.col("transcript_id").alias("id")).distinct(), "id", "left_semi")
    made = owed.select(
        F.concat(F.lit("legacy-"), F.col("id").cast("string")).alias("id"), F.col("id").alias("transcript_id"),
        F.lit("completed").alias("status"), F.lit("full").alias("run_type"), F.col("updated_at").alias("started_at"),
    )
    return made.join(runs.select("id"), "id", "left_anti")


def backfill_run(rows: DataFrame, legacy: DataFrame) -> DataFrame:
    """Null run ids replaced by the transcript's legacy run where that exists."""
    owner = legacy.select("transcript_id", F.col("id").alias("legacy_id"))
    return join_unique(rows, owner, "transcript_id", "left").withColumn("analysis_run_id", F.coalesce("analysis_run_id", "legacy_id")).drop("legacy_id")


def delete_cascade(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the deleted transcripts (``id``)."""
    key = gone.select(F.col("id").alias("transcript_id"))
    return {name: df.join(key, "transcript_id", "left_anti") for name, df in tables.items()}


def counts_of(rows: DataFrame, group: Sequence[str], column: str, values: Sequence[str]) -> DataFrame:
    """How often each of the fixed values occurs, zeros included."""
    return rows.groupBy(*group).agg(*[F.count_if(F.coalesce(F.col(column) == v, F.lit(False))).alias(v) for v in values])


def downstream(elected: DataFrame, finals: DataFrame) -> DataFrame:
    """Per candidate its place after deduplication and ranking: elected id, relationship, size of the group, selected, rank.

    Members of a group are rows that name their elected member; no row lists a group.
    """
    chosen = finals.select(F.col("signal_id").alias("id"), "analysis_run_id", "rank")
    rows = elected.join(chosen, ["id", "analysis_run_id"], "left")
    relation = F.when(F.col("is_canonical"), "canonical").otherwise("duplicate_of_canonical")
    return rows.select("analysis_run_id", "id", "canonical_id", relation.alias("relationship"), F.col("members").alias("group_size"), F.col("rank").isNotNull().alias("selected"), "rank")


def integrity(child: DataFrame, parent: DataFrame, key: str, foreign: str) -> DataFrame:
    """Rows, repeated keys and orphans of a table; what a database would enforce, as one row."""
    keys = child.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    repeated = keys.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"), F.count_if(F.col("n") > 1).alias("repeated_keys"))
    owners = parent.select(F.col("id").alias(foreign)).distinct()
    orphans = child.filter(F.col(foreign).isNotNull()).join(owners, foreign, "left_anti").agg(F.count(F.lit(1)).alias("orphans"))
    return repeated.crossJoin(orphans)  # one row by one row


def created(transcripts: DataFrame, run_id: Column, started_at: Column, config: Mapping[str, object], run_type: str = "full", source: Column | None = None) -> DataFrame:
    """A new run per transcript with the hash of its text and a copy of the configuration."""
    none = F.lit(None).cast("string")
    return transcripts.select(
        run_id.alias("id"), F.col("id").alias("transcript_id"), F.lit("running").alias("status"), F.lit(run_type).alias("run_type"), (none if source is None else source).alias("source_run_id"),
        started_at.alias("started_at"), F.sha2("raw_text", 256).alias("input_sha256"), F.lit(json.dumps(config, sort_keys=True)).alias("config"),
    )


def ended(runs: DataFrame, events: DataFrame) -> DataFrame:
    """Runs after their last event (run_id, at, status, failed_stage, error): status, end and failure; others as they are.

    Events are appended and the last wins, so nothing is updated in place; of equal times the greater status stands.
    """
    last = events.groupBy(F.col("run_id").alias("id")).agg(F.max(F.struct("at", "status", "failed_stage", "error")).alias("e"))
    rows = runs.drop("completed_at", "failed_stage", "error").join(last, "id", "left")
    return rows.select("*", F.col("e.at").alias("completed_at"), F.col("e.failed_stage").alias("failed_stage"), F.col("e.error").alias("error")).withColumn("status", F.coalesce("e.status", "status")).drop("e")


def with_schema(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """The table with the columns it lacks as nulls: an additive change of schema.  Columns it has stay as they are."""
    return df.select("*", *[F.lit(None).cast(t).alias(c) for c, t in columns.items() if c not in df.columns])


def without_columns(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """The way back of ``with_schema``."""
    return df.drop(*columns)

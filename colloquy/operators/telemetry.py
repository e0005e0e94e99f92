"""Usage of model calls rolled up with care for what is unknown."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sequence import numbered, with_neighbours


def known_total(column: str) -> Column:
    """The sum only where every row's value is known; else null."""
    return F.when(F.count(column) == F.count(F.lit(1)), F.sum(column))


def usage_by(calls: DataFrame, group: Sequence[str], tokens: Sequence[str], cost: str, duration: str) -> DataFrame:
    """Calls, null-aware token sums (null if none is known), cost if all are known, duration to two places."""
    return calls.groupBy(*group).agg(
        F.count(F.lit(1)).alias("call_count"), *[F.sum(t).alias(t) for t in tokens],
        known_total(cost).alias(cost), F.round(F.greatest(F.lit(0.0), F.sum(duration)), 2).alias(duration),
    )


def totals(usage: DataFrame, tokens: Sequence[str], cost: str) -> DataFrame:
    """One row over all groups; the cost only if every group's is known."""
    return usage.agg(F.sum("call_count").alias("call_count"), *[F.sum(t).alias(t) for t in tokens], known_total(cost).alias(cost))


def last_state(events: DataFrame, key: str, at: str, payload: Sequence[str]) -> DataFrame:
    """The state of each key after its last event; ties by the payload."""
    return events.groupBy(key).agg(F.max_by(F.struct(*payload), F.struct(at, *payload)).alias("s")).select(key, "s.*")


def call_records(raw: DataFrame, usage: str, counts: Mapping[str, str]) -> DataFrame:
    """One record per model call: token counts out of the nested usage, duration and retries not below 0, stage or unknown.

    ``counts``: column -> JSON path.  A count that is missing or no whole number is null and never an error.
    """
    numbers = [F.get_json_object(usage, path).try_cast("bigint").alias(name) for name, path in counts.items()]
    return raw.select(
        "call_id", F.coalesce(F.nullif(F.trim("stage"), F.lit("")), F.lit("unknown")).alias("stage"), *numbers,
        F.round(F.greatest(F.lit(0.0), F.coalesce(F.nanvl("duration_ms", F.lit(0.0)), F.lit(0.0))), 2).alias("duration_ms"),
        F.greatest(F.lit(0), F.coalesce("retry_count", F.lit(0))).alias("retry_count"), F.coalesce("success", F.lit(False)).alias("success"),
    )


def transitions(events: DataFrame, key: str, at: str, state: str, tie: str) -> DataFrame:
    """Each event of a key with the state before it and the seconds since it, ``idle`` and null at the start."""
    placed = numbered(events.select(key, at, state, tie), [key], [F.col(at), F.col(tie)])
    near = with_neighbours(placed, [key], "pos", [state, at])
    gap = F.round((F.unix_micros(at) - F.unix_micros(f"{at}_m1")) / 1e6, 2)
    return near.select(key, tie, F.coalesce(f"{state}_m1", F.lit("idle")).alias("before"), F.col(state).alias("after"), gap.alias("seconds"))


def redacted(url: Column) -> Column:
    """A connection address without its user and password."""
    return F.regexp_replace(url, r"(?<=://)[^@/\s]*@", "***@")

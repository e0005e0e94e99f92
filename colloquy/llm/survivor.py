"""Best representative of each duplicate group: votes on unpivoted fields."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Survivorship:
    """How one surviving record is built.

    fields: output column -> normalised value, null where not usable.
    usable: conditions counted for completeness; the record with the most is the survivor.
    trust: 0..1 or null (no trust: lowest).  recency: a timestamp.  id: the numeric key of a record.
    half_life_days: None lets the single most trusted, then most recent voter decide (the
    limit of an infinitely steep trust weight); a number sums trust * 2^(-age / half life)
    over all voters of a value, age counted from ``as_of``.
    """

    group: str
    id: str
    trust: Column
    recency: Column
    fields: dict[str, Column]
    usable: Sequence[Column] = field(default_factory=tuple)
    half_life_days: float | None = None
    as_of: Column | None = None


def surviving_records(records: DataFrame, how: Survivorship) -> DataFrame:
    """One record per group with at least two different ids, each field chosen by vote.

    The fields are unpivoted to (group, field, value) rows that carry a vote,
    votes are combined per normalised value (map-side first, so a group that
    holds a third of all rows moves as a few partial sums), the winner of each field
    is taken by ``max_by`` and the rows are pivoted back by conditional
    aggregates.  One shuffle on (group, field, value), one on group.

    Defined cases: null groups and null ids are left out; a record delivered
    twice votes once; a field nobody can fill is an empty string; an
    empty table gives no rows.  Result: group, ``signal_id``, the fields.
    """
    g = F.col(how.group)
    names = list(how.fields)
    complete = sum((F.coalesce(u, F.lit(False)).cast("int") for u in how.usable), F.lit(0))
    trust = F.coalesce(how.trust.cast("double"), F.lit(-1.0))
    # a descending id as the last tie-break: the smaller id is the greater ballot
    ballot = F.struct(trust.alias("t"), how.recency.alias("at"), (-F.col(how.id)).alias("neg"))
    base = records.filter(g.isNotNull() & F.col(how.id).isNotNull()).select(
        g.alias("g"), F.col(how.id).alias("id"), complete.alias("filled"), ballot.alias("ballot"),
        *[c.alias(f"f{i}") for i, c in enumerate(how.fields.values())],
    )
    if how.half_life_days is not None:
        base = base.dropDuplicates(["g", "id"])  # sums would count a second delivery
    slots = F.array(
        F.struct(F.lit(-1).alias("k"), F.lit(None).cast("string").alias("value")),
        *[F.struct(F.lit(i).alias("k"), F.col(f"f{i}").alias("value")) for i in range(len(names))],
    )
    long = base.select("g", "id", "filled", "ballot", F.explode(slots).alias("slot")).select(
        "g", "id", "filled", "ballot", "slot.k", "slot.value"
    )
    long = long.filter((F.col("k") < 0) | F.col("value").isNotNull())
    if how.half_life_days is None:
        weight = F.max("ballot")
        score = F.col("vote")
    else:
        age = F.greatest(F.lit(0.0), (F.unix_micros(how.as_of) - F.unix_micros("ballot.at")) / 86_400e6)
        decayed = F.greatest(F.col("ballot.t"), F.lit(0.0)) * F.pow(F.lit(2.0), -age / how.half_life_days)
        weight = F.struct(F.sum(F.coalesce(decayed, F.lit(0.0))).alias("sum"), F.max("ballot").alias("top"))
        score = F.col("vote")
    lead = F.struct(F.col("filled"), F.col("ballot.t").alias("t"), F.col("ballot.at").alias("at"), F.col("ballot.neg").alias("neg"))
    votes = long.groupBy("g", "k", "value").agg(
        weight.alias("vote"), F.max(lead).alias("lead"), F.min("id").alias("lo"), F.max("id").alias("hi")
    )
    out = votes.groupBy("g").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        (-F.max(F.when(F.col("k") < 0, F.col("lead")))["neg"]).alias("signal_id"),
        *[
            F.max_by(F.when(F.col("k") == i, F.col("value")), F.when(F.col("k") == i, score)).alias(f"w{i}")
            for i in range(len(names))
        ],
    )
    return out.filter("lo < hi").select(
        F.col("g").alias(how.group), "signal_id",
        *[F.coalesce(F.col(f"w{i}"), F.lit("")).alias(n) for i, n in enumerate(names)],
    )

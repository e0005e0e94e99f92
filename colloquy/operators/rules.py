"""Rule cascades: ordered conditions that give reasons, a verdict and the first reason."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rules = Sequence[tuple[str, Column]]


def reasons(rules: Rules) -> Column:
    """The names of all conditions that hold, in order, without repeats; a null condition does not hold."""
    named = [F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in rules]
    return F.array_distinct(F.array_compact(F.array(*named)))


def first_reason(rules: Rules) -> Column:
    """The name of the first condition that holds, or null; later conditions are not evaluated."""
    out = F.lit(None).cast("string")
    for name, cond in reversed(list(rules)):
        out = F.when(F.coalesce(cond, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def verdict(hard: Column, soft: Column) -> Column:
    """reject if there is a hard reason, needs_review if a soft one, else pass."""
    return F.when(F.size(hard) > 0, "reject").when(F.size(soft) > 0, "needs_review").otherwise("pass")


def clamp(value: Column, by: Column, bounds: dict[str, tuple[float | None, float | None]]) -> Column:
    """The value held between the bounds of its verdict; null stays null."""
    out = value
    for name, (low, high) in bounds.items():
        held = value
        if low is not None:
            held = F.greatest(held, F.lit(low))
        if high is not None:
            held = F.least(held, F.lit(high))
        out = F.when((by == name) & value.isNotNull(), held).otherwise(out)
    return out


def weighted(parts: Sequence[tuple[float, Column]], places: int = 2) -> Column:
    """Weighted sum, rounded before anybody compares it with a threshold; null if a part is."""
    total = F.lit(0.0)
    for weight, value in parts:
        total = total + F.lit(weight) * value
    return F.round(total, places)


@dataclass(frozen=True)
class Check:
    """A condition on one finding: the values that count against it; ``hard`` rejects, otherwise a review is asked for."""

    reason: str
    column: str
    values: tuple[str, ...]
    hard: bool = True

    def holds(self) -> Column:
        return F.col(self.column).isin(*self.values)


def judged(findings: DataFrame, checks: Sequence[Check], extra_hard: Rules = (), extra_soft: Rules = ()) -> DataFrame:
    """Findings with ``verdict``, the first ``reason`` of the deciding kind, and all reasons in the order of the checks."""
    hard = [(c.reason, c.holds()) for c in checks if c.hard] + list(extra_hard)
    soft = [(c.reason, c.holds()) for c in checks if not c.hard] + list(extra_soft)
    rows = findings.withColumn("hard", reasons(hard)).withColumn("soft", reasons(soft))
    rows = rows.withColumn("verdict", verdict(F.col("hard"), F.col("soft")))
    return rows.withColumn("reason", F.when(F.size("hard") > 0, F.get("hard", F.lit(0))).otherwise(F.get("soft", F.lit(0))))


def synthesized(column: str, missing: Column, by: Column, template: Mapping[str, str]) -> Column:
    """The finding, or where findings are missing the one that its template has for the verdict."""
    out = F.lit(None).cast("string")
    for name, value in template.items():
        out = F.when(by == name, F.lit(value)).otherwise(out)
    return F.when(missing, out).otherwise(F.col(column))


def corrected(kind: Column, effect: Column, effects: Mapping[str, str]) -> Column:
    """The kind that an effect stands for where that contradicts the kind; unknown effects change nothing."""
    out = kind
    for name, value in effects.items():
        out = F.when((effect == name) & (kind != value), F.lit(value)).otherwise(out)
    return out


def allowed(verdict_: Column, reason: Column, excluding: Sequence[str]) -> Column:
    """False only for a reject for one of the excluding reasons; rejects for others and unknown verdicts stay."""
    return ~F.coalesce((verdict_ == "reject") & reason.isin(*excluding), F.lit(False))

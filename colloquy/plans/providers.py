"""Where model answers come from: a table of recorded responses, or a function.

The engine never calls a model over a network.  A provider turns a DataFrame of
requests into one of answers; the default reads recorded JSON.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import isfinite
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ITEM = (
    "item_type string, category string, advisor_quote string, timestamp string, evidence_strength string, rationale string, "
    "factor_kind string, decision_direction string, source_turn_ids array<bigint>, extraction_confidence double"
)


class Provider(Protocol):
    def answer(self, requests: DataFrame) -> DataFrame: ...


def item_valid(x: Column) -> Column:
    """A known type, a quote that is not blank, a confidence from 0 to 1."""
    known = F.coalesce(x["item_type"].isin("driver", "blocker", "no_signal"), F.lit(False))
    quoted = F.coalesce(x["advisor_quote"].rlike(r"\S"), F.lit(False))
    sure = F.coalesce(x["extraction_confidence"].between(0.0, 1.0), F.lit(False))
    return known & quoted & sure


def parsed(responses: DataFrame, column: str, valid: Callable[[Column], Column] = item_valid) -> DataFrame:
    """JSON answers with a schema; one bad item or broken JSON voids the whole answer.

    JSON followed by anything but white space is broken too; the parser alone would read its head.
    Adds ``items`` (null where void) and ``fault``: ``malformed_json``, ``invalid_item`` or null.
    """
    items = F.from_json(column, f"items array<struct<{', '.join(f.replace(' ', ':', 1) for f in ITEM.split(', '))}>>", {"mode": "PERMISSIVE"})["items"]
    rows = responses.withColumn("__items", items)
    bad = F.exists("__items", lambda x: ~valid(x))
    fault = F.when(F.col("__items").isNull() | ~F.col(column).rlike(r"\}\s*\z"), "malformed_json").when(bad, "invalid_item")
    return rows.withColumn("fault", fault).withColumn("items", F.when(fault.isNull(), F.col("__items"))).drop("__items")


@dataclass(frozen=True)
class ResponseTable:
    """Recorded answers joined by request key."""

    responses: DataFrame
    key: str = "request_id"

    def answer(self, requests: DataFrame) -> DataFrame:
        return requests.join(self.responses, self.key, "left")


@dataclass(frozen=True)
class FunctionProvider:
    """Answers of a batch function; batches run in Arrow, retries are those of the task and must be harmless."""

    function: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]
    schema: str

    def answer(self, requests: DataFrame) -> DataFrame:
        return requests.mapInPandas(self.function, self.schema)


def retrying(call: Callable[[str], str], transient: tuple[type[BaseException], ...], most: int = 2, wait: float = 0.5, sleep: Callable[[float], None] = time.sleep):
    """A batch function for ``FunctionProvider`` that asks once per row and again after a transient fault, up to ``most`` times.

    Waits double from ``wait`` seconds.  Other faults are not tried again.  Neither ends the batch: the answer is null and
    ``error_type`` names the fault.  Result: request_id, answer, retry_count, duration_ms, success, error_type (``CALL``).
    """

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for key, prompt in zip(frame["request_id"], frame["prompt"]):
                began, answer, error = time.monotonic(), None, None
                for tries in range(most + 1):
                    try:
                        answer, error = call(prompt), None
                    except transient as fault:
                        error = type(fault).__name__
                        if tries < most:
                            sleep(wait * 2**tries)
                            continue
                    except Exception as fault:
                        error = type(fault).__name__
                    break
                rows.append((key, answer, tries, (time.monotonic() - began) * 1e3, error is None, error))
            yield pd.DataFrame(rows, columns=["request_id", "answer", "retry_count", "duration_ms", "success", "error_type"])

    return ask


CALL = "request_id long, answer string, retry_count int, duration_ms double, success boolean, error_type string"


def embedded(texts: DataFrame, embed: Callable[[list[str]], list[list[float]]], dimension: int) -> DataFrame:
    """Vectors of the texts (``id``, ``text``), one call per Arrow batch.

    A vector that is missing, of another dimension or not finite is null, and ``fault`` says so; null texts are not sent.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            there = frame["text"].notna()
            try:
                made = iter(embed(frame["text"][there].tolist()))
                vectors = [list(next(made)) if t else None for t in there]
                faults = [None if v is None else None if len(v) == dimension and all(map(isfinite, v)) else "invalid_vector" for v in vectors]
            except Exception as fault:  # the provider failed for the batch
                vectors, faults = [None] * len(frame), [type(fault).__name__] * len(frame)
            yield pd.DataFrame({"id": frame["id"], "embedding": [None if f else v for v, f in zip(vectors, faults)], "fault": faults})

    return texts.select("id", "text").mapInPandas(run, "id long, embedding array<double>, fault string")


def checked_scores(pairs: DataFrame, scored: DataFrame) -> DataFrame:
    """Scores of compared pairs with what is wrong with each: missing, repeated, not a number, or out of 0 to 1.

    ``pairs`` and ``scored`` have a, b; ``scored`` has score.  A pair with a fault has no score.
    """
    got = scored.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low"), F.max("score").alias("high"))
    rows = pairs.select("a", "b").distinct().join(got, ["a", "b"], "left")
    finite = F.col("low").isNotNull() & ~F.isnan("high") & (F.abs("high") != float("inf")) & (F.abs("low") != float("inf"))
    fault = F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated").when(~finite, "not_finite").when(~F.col("low").between(0.0, 1.0), "out_of_range")
    return rows.select("a", "b", F.when(fault.isNull(), F.col("low")).alias("score"), fault.alias("fault"))

"""Text files in, with a reason for each one that is not taken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import repair_mojibake, token_estimate
from ..operators.rules import first_reason
from ..operators.sequence import listed


def outcome(name: Column, size: Column, valid: Column, blank: Column, most_bytes: int) -> Column:
    """Why a file is refused, or null: type, size, emptiness, encoding in this order."""
    return first_reason([
        ("unsupported_type", ~F.lower(name).endswith(".txt")), ("too_large", size > most_bytes),
        ("empty", blank), ("invalid_utf8", ~valid),
    ])


def text_files(spark: SparkSession, path: str, most_mb: int = 25) -> DataFrame:
    """Files of a folder: ``file_name``, ``reason`` (null if taken), ``raw_text``, ``token_count``.

    Control characters go from the name, which is cut to 255; content must be strict UTF-8; common
    double-decoded punctuation is repaired.  Contents stay in the executors.
    """
    f = spark.read.format("binaryFile").load(path)
    valid = F.expr("is_valid_utf8(cast(content as string))")
    read = f.select("path", "length", "content", valid.alias("valid"))
    # the scan leaves out files without bytes; the file index, which the driver holds anyway, has them
    listed = spark.createDataFrame([(p.replace("file:///", "file:/", 1),) for p in f.inputFiles()], "path string")
    void = listed.join(read.select("path"), "path", "left_anti").select("path", F.lit(0).cast("long").alias("length"), F.lit(None).cast("binary").alias("content"), F.lit(True).alias("valid"))
    name = F.substring(F.regexp_replace(F.regexp_replace("path", r"^.*[/\\]", ""), r"\p{Cntrl}", ""), 1, 255)
    f = read.unionByName(void).withColumn("file_name", name)
    f = f.withColumn("reason", outcome(F.col("file_name"), F.col("length"), F.col("valid"), F.col("length") == 0, most_mb * 1024 * 1024))
    text = F.when(F.col("reason").isNull(), repair_mojibake(F.col("content").cast("string")))
    return f.select("file_name", "reason", text.alias("raw_text")).withColumn("token_count", token_estimate(F.col("raw_text")))


def import_files(files: DataFrame, existing: DataFrame, force: bool = False, limit: int | None = None) -> DataFrame:
    """Files with their outcome: imported, replaced, skipped_existing, or the reason of refusal; names already there are skipped unless forced.

    ``place`` is the order by lower-cased name.  limit: only so many files in that order are looked at, those that are skipped included.
    """
    there = existing.select("file_name").distinct().withColumn("there", F.lit(True))
    files = listed(files.withColumn("__low", F.lower("file_name")), ["__low", "file_name"]).drop("__low")
    rows = (files if limit is None else files.filter(F.col("place") < limit)).join(there, "file_name", "left")
    state = F.when(F.col("there") & ~F.lit(force), "skipped_existing").when(F.col("reason").isNotNull(), F.col("reason"))
    return rows.withColumn("outcome", state.when(F.col("there"), "replaced").otherwise("imported")).drop("there")


def schema_issues(actual: DataFrame, expected: dict[str, str]) -> list[str]:
    """Columns that are missing or of another type, from the schema alone."""
    have = dict(actual.dtypes)
    return [f"missing {c}" if c not in have else f"{c} is {have[c]}, not {t}" for c, t in expected.items() if have.get(c) != t]

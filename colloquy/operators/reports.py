"""Reports as files, and files as reports again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_report(report: DataFrame, path: str) -> None:
    """A folder of JSON lines, nulls kept; a report is an aggregate, so one file."""
    report.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_report(spark: SparkSession, path: str, schema) -> DataFrame:
    """A written report with the schema it had."""
    return spark.read.schema(schema).json(path)


def markdown(report: DataFrame, title: str) -> DataFrame:
    """The report as lines of a Markdown table, numbered; cells are the values as text, nulls empty, bars escaped."""
    names = report.columns
    cell = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\|", r"\\|")
    body = report.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in names]), F.lit(" |")).alias("line"))
    spark = report.sparkSession
    head = spark.createDataFrame([(0, f"# {title}"), (1, ""), (2, "| " + " | ".join(names) + " |"), (3, "|" + "---|" * len(names))], "n long, line string")
    from .sequence import listed

    return head.unionByName(listed(body.withColumn("tie", F.monotonically_increasing_id()), ["line", "tie"], "n").select((F.col("n") + 4).alias("n"), "line"))

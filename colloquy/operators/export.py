"""Final rows and their sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sequence import numbered
from .skew import join_unique


def supporting_rows(finals: DataFrame, members: DataFrame) -> DataFrame:
    """Other members of a final's duplicate group in the same transcript and run, one row each, with their place by id.

    Transcript, group and run are compared null-safely.  The finals' side is small and joined with hot groups
    split off, places come from a range sort: a group may be of any size.  Result: ``signal_id``, ``place``, ``quote``, ``timestamp``.
    """
    key = F.to_json(F.struct("transcript_id", "duplicate_group_id", "analysis_run_id"), {"ignoreNullFields": "false"}).alias("__key")
    m = members.filter("not is_canonical and duplicate_group_id is not null").select(key, F.col("id").alias("m_id"), F.col("advisor_quote").alias("quote"), "timestamp")
    rows = join_unique(m, finals.select(key, "signal_id"), "__key").filter("signal_id <> m_id")
    return numbered(rows, ["signal_id"], [F.col("m_id")], "place").select("signal_id", "place", "quote", "timestamp")


def supporting(finals: DataFrame, members: DataFrame, most: int = 1000) -> DataFrame:
    """The first ``most`` of ``supporting_rows`` as an array per final; a row holds no more, the table of rows holds all."""
    rows = supporting_rows(finals, members).filter(F.col("place") < most)
    item = lambda x: F.struct(x["quote"].alias("quote"), x["timestamp"].alias("timestamp"), F.lit("supporting_reason").alias("relationship"))
    return rows.groupBy("signal_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "quote", "timestamp"))), item).alias("supporting_evidence"))


def widened(rows: DataFrame, array: str = "supporting_evidence", most: int = 50) -> DataFrame:
    """The array's quotes and times as numbered columns, as many as the widest row needs, at least one pair and at most ``most``.

    The width is one aggregated number, read before the plan of the columns is made.  The array itself stays and
    holds all of it, so nothing is lost where a group is larger than a table may be wide.
    """
    width = min(most, rows.agg(F.max(F.size(array))).first()[0] or 0)
    columns = []
    for i in range(1, max(1, width) + 1):
        item = F.get(F.col(array), F.lit(i - 1))
        columns += [F.coalesce(item["quote"], F.lit("")).alias(f"supporting_quote_{i}"), F.coalesce(item["timestamp"], F.lit("")).alias(f"supporting_timestamp_{i}")]
    return rows.select("*", *columns)


def csv_cells(rows: DataFrame, money: Sequence[str] = ("business_score",)) -> DataFrame:
    """Arrays as JSON cells with nulls kept, scores with two places."""
    out = []
    for f in rows.schema.fields:
        c = F.col(f.name)
        if f.dataType.typeName() in ("array", "struct", "map"):
            out.append(F.to_json(c, {"ignoreNullFields": "false"}).alias(f.name))
        elif f.name in money:
            out.append(F.when(c.isNotNull() & ~F.isnan(c), F.format_string("%.2f", c)).alias(f.name))
        else:
            out.append(c)
    return rows.select(*out)


def write_csv(rows: DataFrame, path: str) -> None:
    """A folder of CSV parts, each with its header; an empty result still writes the header."""
    csv_cells(rows).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def write_jsonl(rows: DataFrame, path: str) -> None:
    """One object per line, nulls kept."""
    rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)

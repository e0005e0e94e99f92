"""Queries behind result pages: search, natural order, evidence lookup, highlights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evidence import quote_hits
from .sequence import with_neighbours


def natural_key(name: str) -> Column:
    """Case-insensitive sort key in which runs of digits compare as numbers (up to 20 digits)."""
    # each piece is one run of digits or of other characters
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 20, "0")).otherwise(p)), "")


def search(rows: DataFrame, column: str, text: str) -> DataFrame:
    """Case-insensitive substring; blank text keeps everything."""
    return rows.filter(F.lower(column).contains(text.strip().lower())) if text.strip() else rows


def plain_evidence(c: Column) -> Column:
    """Straight quotes, single spaces, no space at the ends."""
    c = F.translate(c, "“”‘’", "\"\"''")
    return F.regexp_replace(F.regexp_replace(c, r"\s+", " "), r"^\s+|\s+$", "")


def locate(signals: DataFrame, turns: DataFrame, owner: str = "advisor", contained: bool = True) -> DataFrame:
    """The owner's one turn that holds a signal's quote, by exact text or else by containment; an equal time settles several; else null.

    Exact equality of normalised texts is a hash join on (transcript, text), so it scales
    with the rows and not with a transcript's turns times signals; quotes without an equal turn
    (``contained``) go by an anchor word.
    """
    s = signals.select("id", "transcript_id", "timestamp", plain_evidence(F.col("advisor_quote")).alias("q")).filter("q <> ''")
    t = turns.filter(F.col("inferred_role") == owner).select(
        "transcript_id", plain_evidence(F.col("text")).alias("q"), F.col("id").alias("turn_id"), F.col("timestamp").alias("t_time")
    )
    timed = F.coalesce((F.col("t_time") == F.col("timestamp")) & (F.col("timestamp") != ""), F.lit(False))
    hits = s.join(t, ["transcript_id", "q"]).select("id", "timestamp", "turn_id", "t_time")
    if contained:
        rest = s.join(hits.select("id").distinct(), "id", "left_anti").withColumnRenamed("q", "advisor_quote")
        own = t.select("transcript_id", F.col("turn_id").alias("id"), F.col("q").alias("text"), F.col("t_time").alias("timestamp"))
        hits = hits.unionByName(quote_hits(rest, own).withColumnRenamed("t_timestamp", "t_time"))
    hits = hits.groupBy("id").agg(
        F.count(F.lit(1)).alias("n"), F.min("turn_id").alias("only"), F.count_if(timed).alias("k"), F.min(F.when(timed, F.col("turn_id"))).alias("at")
    )
    found = hits.select("id", F.when(F.col("n") == 1, F.col("only")).when(F.col("k") == 1, F.col("at")).alias("turn_id"))
    return signals.select("id").join(found, "id", "left")


def highlight(text: Column, quote: Column) -> Column:
    """1-based place of the quote, exact before case-insensitive, 0 if absent."""
    place = F.instr(text, quote)
    return F.when(place > 0, place).otherwise(F.instr(F.lower(text), F.lower(quote)))


def neighbours_tagged(turns: DataFrame) -> DataFrame:
    """Each turn with the ids before and after it."""
    near = with_neighbours(turns, ["transcript_id"], "pos", ["id"])
    return near.select("transcript_id", "pos", "id", F.col("id_m1").alias("previous_id"), F.col("id_p1").alias("next_id"))

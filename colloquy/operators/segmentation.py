"""Raw transcript text into turns, by the flattened or the line layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from .sequence import numbered

#: Grammar of times, and the labels of header lines that are no speech.
TIME = r"\d{1,2}:\d{2}:\d{2}"
METADATA = ("meeting id", "meeting topic", "host email", "start time", "start time (eastern)")
BOUNDARY = rf"({TIME}(?:\.\d+)?)\s*-->\s*{TIME}(?:\.\d+)?\s*\[([^\]]+)\](\s*:)?[ \t]*"


def looks_like_speaker(label: Column) -> Column:
    text = strip(label)
    return (F.length(text) > 0) & (F.size(F.split(text, r"\s+")) <= 8) & ~text.rlike("[.!?]")


def authoritative_role(label: Column) -> Column:
    return F.when(label == "OPTIMIZE_REP", "optimize_rep").when(label.rlike(r"\AADVISOR(_\d+)?\z"), "advisor")


def flat_segments(docs: DataFrame, doc_id: str = "id", text: str = "raw_text") -> DataFrame:
    """Segments headed by ``start --> end [label]:`` anywhere in the text.

    A header without its colon or with another label drops its segment instead of
    joining it to the one before; segments without text vanish; ``turn_index`` is dense.
    """
    marked = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("raw")).filter(F.col("raw").rlike(BOUNDARY))
    parts = marked.select(
        "doc_id",
        F.expr(f"regexp_extract_all(raw, r'{BOUNDARY}', 1)").alias("start"),
        F.expr(f"regexp_extract_all(raw, r'{BOUNDARY}', 2)").alias("label"),
        F.expr(f"regexp_extract_all(raw, r'{BOUNDARY}', 3)").alias("colon"),
        F.slice(F.split("raw", BOUNDARY), 2, 2**31 - 1).alias("body"),
    )
    rows = parts.select("doc_id", F.posexplode(F.arrays_zip("start", "label", "colon", "body")).alias("place", "s"))
    rows = rows.select(
        "doc_id", "place", F.col("s.start").alias("timestamp"), F.upper(strip(F.col("s.label"))).alias("raw_speaker_label"),
        F.col("s.colon").alias("colon"), strip(F.col("s.body")).alias("text"),
    )
    rows = rows.withColumn("inferred_role", authoritative_role(F.col("raw_speaker_label")))
    rows = rows.filter((F.col("colon") != "") & F.col("inferred_role").isNotNull() & (F.col("text") != ""))
    out = numbered(rows, ["doc_id"], ["place"], "turn_index")
    return out.select("doc_id", "turn_index", "timestamp", "raw_speaker_label", "inferred_role", F.lit(1.0).alias("role_confidence"), "text")


def line_segments(docs: DataFrame, doc_id: str = "id", text: str = "raw_text") -> DataFrame:
    """Turns of texts in the line layout.

    A line is, by the first rule that fits: time and speaker; speaker and time; a
    time alone, for the next speaker; a speaker; or goes on with the turn before.
    Header lines close the turn before.  A turn id is a running count of opening
    lines, a pending time the last one since; both are windows over a document's lines.
    """
    line = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("raw")).filter(F.col("raw").isNotNull() & ~F.col("raw").rlike(BOUNDARY))
    line = line.select("doc_id", F.posexplode(F.split("raw", r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")).alias("n", "line"))
    line = line.withColumn("line", strip(F.col("line"))).filter(F.col("line") != "")
    a = rf"^({TIME})\s+([^:]{{1,100}}):\s*(.*)$"
    b = rf"^(.+?)\s+({TIME})\s*:?[ \t]*$"
    d = r"^([^:]{1,100}):\s*(.*)$"
    x = F.col("line")

    def part(pattern: str, g: int) -> Column:
        return F.regexp_extract(x, pattern, g)

    is_a = x.rlike(a) & looks_like_speaker(part(a, 2))
    is_b = x.rlike(b) & looks_like_speaker(part(b, 1))
    is_c = x.rlike(rf"^{TIME}$")
    is_d = x.rlike(d) & looks_like_speaker(part(d, 1))
    kind = F.when(is_a, "a").when(is_b, "b").when(is_c, "c").when(is_d, "d").otherwise("e")
    label = F.when(is_a, part(a, 2)).when(is_b, part(b, 1)).when(is_c, None).when(is_d, part(d, 1))
    line = line.select(
        "doc_id", "n", "line", kind.alias("kind"), label.alias("label"),
        F.when(is_a, part(a, 1)).when(is_b, part(b, 2)).when(is_c, x).alias("time"),
        F.when(is_a, part(a, 3)).when(is_b, "").when(is_c, "").when(is_d, part(d, 2)).otherwise(x).alias("said"),
    )
    meta = F.col("kind").isin("a", "d") & F.lower(strip(F.col("label"))).isin(*METADATA)
    line = line.withColumn("kind", F.when(meta, "m").otherwise(F.col("kind")))
    by = Window.partitionBy("doc_id").orderBy("n")
    shut = line.withColumn("before", F.lag("kind").over(by))
    # speech with no open turn starts one of its own
    opens = F.col("kind").isin("a", "b", "d") | ((F.col("kind") == "e") & F.coalesce(F.col("before").isin("c", "m"), F.lit(True)))
    shut = shut.withColumn("opens", opens).withColumn("turn", F.sum((opens | F.col("kind").isin("c", "m")).cast("int")).over(by))
    # a time alone serves the next opening line unless a header line comes between
    carry = F.when(F.col("kind") == "c", F.col("time")).when(F.col("kind") == "m", F.lit("")).when(F.col("opens"), F.lit(""))
    last = F.last(carry, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    shut = shut.withColumn("at", F.when(F.col("kind").isin("a", "b"), F.col("time")).when(F.col("opens"), F.nullif(last, F.lit(""))))
    said = shut.filter(F.col("kind").isin("a", "b", "d", "e"))
    turns = said.groupBy("doc_id", "turn").agg(
        F.max("at").alias("timestamp"), F.max(F.when(F.col("opens"), F.coalesce(strip(F.col("label")), F.lit("unknown")))).alias("raw_speaker_label"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("said") != "", F.struct("n", "said")))), lambda s: s["said"]), "\n").alias("text"),
    )
    out = numbered(turns.filter("text <> ''"), ["doc_id"], ["turn"], "turn_index")
    return out.select("doc_id", "turn_index", "timestamp", "raw_speaker_label", "text")


def parsed(docs: DataFrame, doc_id: str = "id", text: str = "raw_text") -> DataFrame:
    """Turns of every text: by the flattened layout where a boundary occurs in it, else by lines; lines name no roles."""
    lines = line_segments(docs, doc_id, text)
    lines = lines.select("doc_id", "turn_index", "timestamp", "raw_speaker_label", F.lit(None).cast("string").alias("inferred_role"), F.lit(None).cast("double").alias("role_confidence"), "text")
    return flat_segments(docs, doc_id, text).unionByName(lines)


def parse_or_reuse(docs: DataFrame, stored: DataFrame, again: bool = False) -> DataFrame:
    """Stored turns where a transcript has some, parsed ones elsewhere; ``again`` parses all and keeps none of the stored.

    ``stored`` has transcript_id and the columns of a turn.  ``origin`` tells which.
    """
    columns = ["doc_id", "turn_index", "timestamp", "raw_speaker_label", "inferred_role", "role_confidence", "text"]
    have = stored.select(F.col("transcript_id").alias("id")).distinct()
    fresh = parsed(docs if again else docs.join(have, "id", "left_anti")).select(*columns, F.lit("parsed").alias("origin"))
    if again:
        return fresh
    kept = stored.join(docs.select(F.col("id").alias("transcript_id")), "transcript_id", "left_semi").withColumnRenamed("transcript_id", "doc_id")
    return fresh.unionByName(kept.select(*columns, F.lit("stored").alias("origin")))

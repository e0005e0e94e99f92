"""Speech transcripts into clean, ordered speaker turns.

A recording gives three kinds of precedence between segments: timing (the
earlier time), cue numbers, and dialogue order (the earlier place in the text or
the lower turn index).  ``order.precedence`` holds them as edges, drops those that a stronger kind contradicts, and
orders the segments topologically.  A recording may be too long for one task, so Spark first cuts it by a range
partitioning on (time if all segments have one, place): edges that run from a later piece to an earlier one contradict the
strongest kind and are dropped, the others hold between the pieces, and every piece is ordered by its own edges.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import join_unique
from ..session import Scratch
from .order import precedence
from .speech import TIME, Person, clean, plain_label, seconds, speaker_of

UNKNOWN = re.compile(r"(?:unknown|unidentified|unnamed|guest|caller|inaudible|unclear)(?: (?:speaker|line|voice|caller|guest|participant|person)?\s*\d*)?|speaker|\?+|n/a")
META = re.compile(r"\s*(?:meeting (?:id|topic)|host(?: email)?|start time|end time|date|duration|recorded|participants|attendees|kind|language)\b[^:\n]*:", re.I)
FLAT = re.compile(rf"({TIME})\s*-->\s*{TIME}\s*\[([^\]\n]*)\]\s*:")
CUE = re.compile(rf"\s*({TIME})\s*-->\s*{TIME}.*")
VOICE = re.compile(r"\s*<v(?:\.[^ >]*)?\s+([^>]*)>(.*?)(?:</v>)?\s*$", re.S)
ONLY_TIME = re.compile(rf"\s*[\[(]?({TIME})[\])]?\s*")
PAREN_FIRST = re.compile(rf"\s*[\[(]({TIME})[\])]\s+([^\n:]+?)\s+-\s+(.*)", re.S)
PAREN_LAST = re.compile(rf"\s*([^\n:]+?)\s*[\[(]({TIME})[\])]\s*:\s*(.*)", re.S)
PREFIX = re.compile(rf"\s*[\[(]?({TIME})[\])]?\s+([^:\n]+?):(?:\s+(.*)|\s*$)", re.S)
HEADER = re.compile(rf"\s*([^\n]+?)\s+({TIME})\s*:?\s*")
PLAIN = re.compile(r"\s*([^:\n]+?)\s*:(?:\s+(.*)|\s*$)", re.S)
DASH = re.compile(r"\s*([^\n]+?)\s+-\s+(.*)", re.S)

#: Segments of a recording that are ordered together; a longer one is cut where the strongest kind of constraint ascends.
PIECE = 20_000

Segment = tuple[int | None, str | None, str, int | None]


def _lines(raw: str) -> list[str]:
    return re.split(r"\r\n|\n|\r", raw)


def segments(raw: str | None, people: Sequence[Person]) -> list[Segment]:
    """(second or None, label or None, text, cue number or None) in order of place, for any of the recorder layouts.

    The layout is told by the lines that only it has.  A line that starts with words
    and a colon opens a segment only if the words name somebody or are a
    recorder's word for nobody; so set phrases of the speech stay speech.
    """
    if not raw or not raw.strip():
        return []
    known: dict[str, bool] = {}

    def names(label: str) -> bool:
        text = plain_label(label)
        if text not in known:
            known[text] = bool(UNKNOWN.fullmatch(text)) or speaker_of(label, people) > 0
        return known[text]

    marks = list(FLAT.finditer(raw))
    if marks:
        ends = [m.start() for m in marks[1:]] + [len(raw)]
        # what stands before the first mark is header lines, or speech of nobody
        before = "\n".join(x for x in _lines(raw[: marks[0].start()]) if x.strip() and not META.match(x))
        return [(None, None, before, None)] * bool(before) + [(seconds(m[1]), m[2], raw[m.end() : e], None) for m, e in zip(marks, ends)]

    lines = _lines(raw)
    first = next((i for i, x in enumerate(lines) if x.strip() and not META.match(x)), len(lines))
    lines = lines[first:]
    if any(CUE.fullmatch(x) for x in lines):
        return _cues(lines, names)
    out: list[list] = []
    timed_lines = any(ONLY_TIME.fullmatch(x) for x in lines)
    parens = any(PAREN_LAST.match(x) and names(PAREN_LAST.match(x)[1]) or PAREN_FIRST.match(x) and names(PAREN_FIRST.match(x)[2]) for x in lines)
    headers = not timed_lines and not parens and any((m := HEADER.fullmatch(x)) and names(m[1]) for x in lines)
    if not headers and not timed_lines and not parens:
        spoken = [m for x in lines if (m := PLAIN.match(x)) and names(m[1])]
        headers = bool(spoken) and all(not (m[2] or "").strip() for m in spoken)
    pending: int | None = None
    for line in lines:
        if not line.strip():
            continue
        if timed_lines and (m := ONLY_TIME.fullmatch(line)):
            pending = seconds(m[1])
            continue
        found = None
        if headers:
            m = HEADER.fullmatch(line)
            if m and names(m[1]):
                found = (seconds(m[2]), m[1], "")
            elif (m := PLAIN.fullmatch(line)) and not (m[2] or "").strip() and names(m[1]):
                found = (None, m[1], "")
        elif parens:
            if (m := PAREN_FIRST.fullmatch(line)) and (names(m[2]) or len(m[2].split()) <= 4):
                found = (seconds(m[1]), m[2], m[3])
            elif (m := PAREN_LAST.fullmatch(line)) and (names(m[1]) or len(m[1].split()) <= 4):
                found = (seconds(m[2]), m[1], m[3])
            elif (m := PREFIX.fullmatch(line)) and names(m[2]):
                found = (seconds(m[1]), m[2], m[3] or "")
            elif (m := DASH.fullmatch(line)) and names(m[1]) or (m := PLAIN.fullmatch(line)) and names(m[1]):
                found = (None, m[1], m[2] or "")
        else:
            if (m := PREFIX.fullmatch(line)) and (names(m[2]) or len(m[2].split()) <= 4):
                found = (seconds(m[1]), m[2], m[3] or "")
            elif (m := PLAIN.fullmatch(line)) and (names(m[1]) or pending is not None and len(m[1].split()) <= 4):
                found = (pending, m[1], m[2] or "")
                pending = None
        if found:
            out.append(list(found))
        elif pending is not None:
            out.append([pending, None, line])
            pending = None
        elif out:
            out[-1][2] += "\n" + line
        else:
            out.append([None, None, line])
    return [(*x, None) for x in out]


def _cues(lines: list[str], names) -> list[Segment]:
    out: list[list] = []
    at, body, number, cue = None, False, None, None
    for line in lines:
        if m := CUE.fullmatch(line):
            at, body, cue, number = seconds(m[1]), True, number, None
            fresh = True
            continue
        if not line.strip():
            body = False
            continue
        if not body and line.strip().isdigit():
            number = int(line.strip()) if len(line.strip()) < 10 else None
            continue
        if not body and line.strip().upper().startswith(("WEBVTT", "NOTE")):
            continue
        if not body:
            at, fresh, cue = None, True, None
        v, p = VOICE.match(line), PLAIN.fullmatch(line)
        if v:
            out.append([at, v[1], v[2], cue])
        elif p and names(p[1]):
            out.append([at, p[1], p[2] or "", cue])
        elif fresh or not out:
            out.append([at, None, line, cue])
        else:
            out[-1][2] += "\n" + line
        fresh, body = False, True
    return [tuple(x) for x in out]


_SEGMENT = "t long, place long, cue int, sec int, speaker int, words string"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * 6
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["t", "place", "cue", "sec", "speaker", "words"])


def _people(value) -> list[Person]:
    return [(p["speaker_no"], p["full_name"] or "", p["role"] or "") for p in value or () if p["speaker_no"] is not None]


def _parse(batches):
    for batch in batches:
        rows = []
        for t, raw, people in zip(batch.column("t").to_pylist(), batch.column("raw_text").to_pylist(), batch.column("people").to_pylist()):
            people = _people(people)
            who: dict = {}
            for place, (sec, label, text, cue) in enumerate(segments(raw, people)):
                if label not in who:
                    who[label] = speaker_of(label, people)
                rows.append((t, place, cue, sec, who[label], clean(text)))
        yield _batch(rows)


def _stored(batches):
    who: dict = {}
    for batch in batches:
        rows = []
        people = batch.column("people")  # of a row only where its label is new
        for n, (t, place, at, label, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("t", "turn_index", "timestamp", "raw_speaker_label", "text")))):
            if (t, label) not in who:
                if len(who) > 100_000:
                    who.clear()
                who[t, label] = speaker_of(label, _people(people[n].as_py()))
            rows.append((t, place, None, seconds(at), who[t, label], clean(text)))
        yield _batch(rows)


def _in_order(batches):
    """The segments of a partition sorted by (transcript, strongest kind), each piece in the order of its constraints."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("t", "timed", "place", "cue", "sec", "speaker", "words"))):
            # a cut is sound between transcripts, and where the strongest kind ascends
            if held and (row[0] != held[0][0] or len(held) >= PIECE and (not row[1] or row[4] != held[-1][4])):
                yield from _piece(held)
                held = []
            held.append(row)
    if held:
        yield from _piece(held)


def _piece(rows: list[tuple]):
    rows.sort(key=lambda r: (r[2], r[6]))  # segments of one place, by their words
    rank = {p: i for i, p in enumerate(sorted({r[2] for r in rows}))}
    order, _, _ = precedence([r[4] for r in rows], [r[3] for r in rows], [rank[r[2]] for r in rows], bool(rows[0][1]))
    return (rows[i] for i in order)


def _merge_runs(batches):
    """Neighbouring segments of one speaker in an ordered partition, as runs numbered per transcript."""
    pid = TaskContext.get().partitionId()
    open_, rows = None, []

    def flush(rows):
        cols = list(zip(*rows)) or [()] * 6
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["t", "pid", "run", "speaker", "sec", "words"])

    for t, _, _, _, sec, speaker, words in _in_order(batches):
        if open_ and open_[0] == t and open_[3] == speaker:
            open_[5].append(words)
            continue
        run = open_[2] + 1 if open_ and open_[0] == t else 0
        if open_:
            rows.append((*open_[:5], " ".join(open_[5])))
        open_ = (t, pid, run, speaker, -1 if sec is None else sec, [words])
        if len(rows) >= 10_000:
            yield flush(rows)
            rows = []
    if open_:
        rows.append((*open_[:5], " ".join(open_[5])))
    yield flush(rows)


def speaker_turns(transcripts: DataFrame, stored: DataFrame, participants: DataFrame) -> DataFrame:
    """Ordered turns of every transcript from its raw text, or from the stored turns where that is gone.

    Rows are parsed and cleaned one by one in Arrow batches.  A range
    partitioning on (transcript, time, place) spreads a transcript that holds a third of all rows over
    many partitions; inside, every piece of up to PIECE segments is ordered by its precedence constraints.  Runs of one speaker are merged inside the sorted
    partitions; the few transcripts that cross a partition border, fewer than
    partitions, are renumbered and rejoined from one summary row per piece.
    Runs eagerly up to the runs.

    Defined cases: null and blank raw texts count as gone; null transcript ids are
    left out; null texts, labels and times are no words, nobody, no time; a
    segment with the same second, speaker and words as another counts once, one
    without a time only if its place is the same too; a row delivered twice counts once;
    empty tables give no rows; other columns are ignored.
    Result: ``transcript_id``, ``turn_no``, ``speaker_no``, ``start_sec``, ``clean_text``.
    """
    scratch = Scratch(transcripts.sparkSession, "turns")
    person = F.struct("speaker_no", "full_name", "role")
    people = participants.select(F.col("transcript_id").alias("t"), person.alias("p")).groupBy("t").agg(F.array_sort(F.collect_set("p")).alias("people"))
    calls = transcripts.filter("id is not null").select(F.col("id").alias("t"), "raw_text").withColumn("gone", ~F.coalesce(F.col("raw_text").rlike(r"\S"), F.lit(False)))
    told = calls.filter(~F.col("gone")).join(people, "t", "left").select("t", "raw_text", "people").mapInArrow(_parse, _SEGMENT)
    lost = calls.filter("gone").select("t").distinct().join(people, "t", "left")
    kept = stored.filter("transcript_id is not null").select(
        F.col("transcript_id").alias("t"), F.col("turn_index").cast("long").alias("turn_index"), "timestamp", "raw_speaker_label", "text"
    )
    held = join_unique(kept, lost, "t").select("t", "turn_index", "timestamp", "raw_speaker_label", "text", "people").mapInArrow(_stored, _SEGMENT)
    all_ = scratch.save(told.unionByName(held), "segments")

    timed = all_.groupBy("t").agg((F.count(F.lit(1)) == F.count("sec")).alias("timed"))
    once = (
        all_.filter("words <> ''")
        .groupBy("t", "sec", "speaker", "words", F.when(F.col("sec").isNull(), F.col("place")).alias("untimed"))
        .agg(F.min_by(F.struct("place", "cue"), F.struct("place", "cue")).alias("at"))
        .select("t", "sec", "speaker", "words", "at.place", "at.cue")
    )
    keyed = join_unique(once, timed, "t").select("t", F.when(F.col("timed"), F.col("sec")).otherwise(F.lit(0)).alias("k"), "timed", "place", "cue", "sec", "speaker", "words")
    keyed = scratch.save(keyed, "keyed")
    order = ["t", "k", "place", "words"]
    runs = scratch.save(keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_merge_runs, "t long, pid int, run int, speaker int, sec int, words string"), "runs")

    piece = runs.groupBy("t", "pid").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("speaker", "run").alias("first"), F.max_by("speaker", "run").alias("last")
    )
    spread = piece.groupBy("t").agg(F.count(F.lit(1)).alias("pieces")).filter("pieces > 1").select("t")
    along = Window.partitionBy("t").orderBy("pid")
    parts = piece.join(F.broadcast(spread), "t").withColumn("joins", F.coalesce((F.lag("last").over(along) == F.col("first")).cast("int"), F.lit(0)))
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("n").over(before), F.lit(0)) - F.sum("joins").over(along)
    parts = scratch.save(parts.withColumn("shift", shift).select("t", "pid", "shift"), "pieces")
    scratch.drop(all_, keyed)
    placed = runs.join(F.broadcast(parts), ["t", "pid"])
    whole = (
        placed.groupBy("t", (F.col("run") + F.col("shift")).alias("turn"))
        .agg(F.array_sort(F.collect_list(F.struct("pid", "speaker", "sec", "words"))).alias("p"))
        .select("t", "turn", F.col("p")[0]["speaker"].alias("speaker"), F.col("p")[0]["sec"].alias("sec"), F.array_join(F.transform("p", lambda x: x["words"]), " ").alias("words"))
    )
    alone = runs.join(F.broadcast(parts.select("t").distinct()), "t", "left_anti").select("t", F.col("run").cast("long").alias("turn"), "speaker", "sec", "words")
    return alone.unionByName(whole).select(
        F.col("t").alias("transcript_id"), F.col("turn").cast("int").alias("turn_no"), F.col("speaker").alias("speaker_no"),
        F.col("sec").alias("start_sec"), F.col("words").alias("clean_text"),
    )

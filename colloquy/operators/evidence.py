"""Evidence of candidate signals in the turns of their transcript."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import like
from .sequence import with_neighbours
from .skew import join_unique

#: How a turn shows that a thought goes on.
MID_THOUGHT_END = r"(…|\.\.\.|[,;:]|\b(and|but|because|so|or))\s*$"
REFERENTIAL_START = r"^(that|this|it|he|she|they|those|these)\b"


def reliable(role: Column, confidence: Column, owner: str = "advisor", least: float = 0.65) -> Column:
    """Whether a turn surely belongs to the owner; nulls are no."""
    return F.coalesce((role == owner) & (confidence >= least), F.lit(False))


def owner_neighbourhood(turns: DataFrame, owner: str = "advisor") -> DataFrame:
    """The owner's turns and their direct neighbours of any role; ``turns`` has ``pos``."""
    near = with_neighbours(turns.withColumn("own", F.coalesce(F.col("inferred_role") == owner, F.lit(False))), ["transcript_id"], "pos", ["own"])
    keep = F.col("own") | F.coalesce("own_m1", F.lit(False)) | F.coalesce("own_p1", F.lit(False))
    return near.filter(keep).drop("own", "own_m1", "own_p1")


def cited_turns(signals: DataFrame, turns: DataFrame) -> DataFrame:
    """Signals joined with the turns they cite, by distinct turn id inside their transcript.

    The join key is the turn, so a transcript that holds a tenth of the rows is spread.
    """
    cited = signals.select("*", F.explode(F.array_distinct("source_turn_ids")).alias("cited_id"))
    right = turns.select(
        F.col("id").alias("cited_id"), F.col("transcript_id").alias("t_transcript"), F.col("pos").alias("t_pos"), F.col("text").alias("t_text"),
        F.col("timestamp").alias("t_timestamp"), F.col("raw_speaker_label").alias("t_label"),
        F.col("inferred_role").alias("t_role"), F.col("role_confidence").alias("t_confidence"),
    )
    return cited.join(right, "cited_id").filter(F.col("t_transcript") == F.col("transcript_id"))


def resolve_source(signals: DataFrame, turns: DataFrame, need_quote: bool = True) -> DataFrame:
    """The one cited turn that is reliably the owner's and holds the quote.

    Several are settled by an equal time if exactly one has it.  With ``need_quote``, a signal none of
    whose cited turns fits is looked up in the reliable turns of its whole transcript.  ``method`` is
    ``source_turn_id`` or ``unique_quote``, either with ``_timestamp`` where the time decided, or null where nothing
    or more than one is left.  One row per signal: ``id``, ``matches``, ``turn_id``, ``method``.
    """
    hit = cited_turns(signals, turns).filter(reliable(F.col("t_role"), F.col("t_confidence")))
    if need_quote:
        hit = hit.filter(F.contains("t_text", "advisor_quote"))
    found = _settled(hit.withColumnRenamed("cited_id", "hit_id"), "source_turn_id")
    if need_quote:
        left = signals.join(found.select("id"), "id", "left_anti")
        sure = turns.filter(reliable(F.col("inferred_role"), F.col("role_confidence")))
        found = found.unionByName(_settled(quote_hits(left, sure).withColumnRenamed("turn_id", "hit_id"), "unique_quote"))
    return signals.select("id").join(found, "id", "left").withColumn("matches", F.coalesce("matches", F.lit(0)))


def _settled(hits: DataFrame, method: str) -> DataFrame:
    """Per signal the number of its hits and the one turn they settle on, by number or else by an equal time."""
    timed = F.coalesce((F.col("t_timestamp") == F.col("timestamp")) & (F.col("timestamp") != ""), F.lit(False))
    found = hits.groupBy("id").agg(
        F.count(F.lit(1)).cast("int").alias("matches"), F.count_if(timed).alias("timed"),
        F.min("hit_id").alias("only"), F.min(F.when(timed, F.col("hit_id"))).alias("timed_id"),
    )
    one, several = F.col("matches") == 1, F.col("timed") == 1
    return found.select(
        "id", "matches", F.when(one, F.col("only")).when(several, F.col("timed_id")).alias("turn_id"),
        F.when(one, F.lit(method)).when(several, F.lit(f"{method}_timestamp")).alias("method"),
    )


def quote_hits(quotes: DataFrame, turns: DataFrame) -> DataFrame:
    """Each quote with every turn of its transcript that holds it; ``quotes`` has ``timestamp``.

    Containment has no equi-key of its own, so the longest word inside the quote, which the
    turn must hold as a whole word, serves as one: words of the turns are exploded and joined on
    (transcript, word) with ids and lengths only, and ``contains`` decides over the texts of what is left.  Only quotes without an inner word, shorter than three
    words, meet all turns of their transcript.  Case counts.  Blank quotes match nothing.
    Result: ``id``, ``timestamp``, ``turn_id``, ``t_timestamp``.
    """
    word = F.lit(r"([A-Za-z0-9]+)")
    q = quotes.select("id", "transcript_id", "timestamp", F.col("advisor_quote").alias("q")).filter(F.col("q").rlike(r"\S"))
    all_words = F.regexp_extract_all("q", word, F.lit(1))
    inner = F.slice(all_words, 2, F.greatest(F.size(all_words) - 2, F.lit(0)))
    longest = F.reduce(inner, F.lit(""), lambda a, w: F.when(F.length(w) > F.length(a), w).otherwise(a))
    q = q.withColumn("anchor", longest)
    t = turns.select("transcript_id", F.col("id").alias("turn_id"), "text", F.col("timestamp").alias("t_timestamp"))
    both = ["id", "timestamp", "q", "turn_id", "t_timestamp", "text"]
    held = t.select("transcript_id", "turn_id", F.length("text").alias("room"), F.explode(F.array_distinct(F.regexp_extract_all("text", word, F.lit(1)))).alias("anchor"))
    near = q.filter("anchor <> ''").select("id", "transcript_id", "anchor", F.length("q").alias("size")).join(held, ["transcript_id", "anchor"]).filter("size <= room")
    near = near.select("id", "turn_id").join(q.select("id", "timestamp", "q"), "id").join(t.drop("transcript_id"), "turn_id").select(*both)
    short = q.filter("anchor = ''").join(t, "transcript_id").select(*both)
    return near.unionByName(short).filter(F.contains("text", "q")).select("id", "timestamp", "turn_id", "t_timestamp")


def quote_matches(quotes: DataFrame, turns: DataFrame) -> DataFrame:
    """How many turns of its transcript hold each quote, and which, if it is only one: ``id``, ``matches``, ``turn_id``."""
    hit = quote_hits(quotes.withColumn("timestamp", F.lit(None).cast("string")), turns)
    found = hit.groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("matches"), F.min("turn_id").alias("turn_id"))
    out = quotes.select("id").join(found, "id", "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
    return out.select("id", "matches", F.when(F.col("matches") == 1, F.col("turn_id")).alias("turn_id"))


def bounded_owner_context(turns: DataFrame, reach: int = 2, owner: str = "advisor", least: float = 0.65) -> DataFrame:
    """Each reliable turn with the texts of the reliable turns around it, up to ``reach`` a side and stopping at the first other."""
    sure = reliable(F.col("inferred_role"), F.col("role_confidence"), owner, least)
    near = with_neighbours(turns.withColumn("own", F.when(sure, F.col("text"))), ["transcript_id"], "pos", ["own"], reach)
    before, after, ok_b, ok_a = [], [], F.lit(True), F.lit(True)
    for d in range(1, reach + 1):
        ok_b, ok_a = ok_b & F.col(f"own_m{d}").isNotNull(), ok_a & F.col(f"own_p{d}").isNotNull()
        before.insert(0, F.when(ok_b, F.col(f"own_m{d}")))
        after.append(F.when(ok_a, F.col(f"own_p{d}")))
    return near.filter("own is not null").select("id", F.concat_ws(" ", *before, "own", *after).alias("context"))


def context_window(signals: DataFrame, turns: DataFrame, most: int = 5, include_source: bool = False, need_quote: bool = True) -> DataFrame:
    """The turns around a signal's cited turns, in transcript order, at most ``most``.

    One turn before the first and after the last cited turn; a cited turn itself if
    asked for or if the quote is only a part of it; one turn more on a side where
    the same speaker goes on in mid-thought.  Result: ``id``, ``pos``, ``turn_id``.
    """
    cited = cited_turns(signals, turns)
    if need_quote:
        cited = cited.filter(F.contains("t_text", "advisor_quote"))
    own = cited.groupBy("id", "transcript_id").agg(
        F.min("t_pos").alias("first"), F.max("t_pos").alias("last"), F.collect_set("t_pos").alias("at"),
        F.collect_set(F.when(F.trim("t_text") != F.trim("advisor_quote"), F.col("t_pos"))).alias("excerpt"),
    )
    near = with_neighbours(turns, ["transcript_id"], "pos", ["raw_speaker_label", "text"], reach=2)
    # an extra turn before: the two before and the first share a speaker and the one before starts in lower case
    label = F.col("raw_speaker_label")
    back = (F.col("raw_speaker_label_m1") == label) & (F.col("raw_speaker_label_m2") == label) & F.ltrim(F.col("text_m1")).rlike("^[a-z]")
    ahead = (F.col("raw_speaker_label_p1") == label) & (F.col("raw_speaker_label_p2") == label) & like(F.col("text_p1"), MID_THOUGHT_END)
    edge = near.select("transcript_id", "pos", F.coalesce(back, F.lit(False)).alias("back"), F.coalesce(ahead, F.lit(False)).alias("ahead"))
    own = own.join(edge.select("transcript_id", F.col("pos").alias("first"), "back"), ["transcript_id", "first"])
    own = own.join(edge.select("transcript_id", F.col("pos").alias("last"), "ahead"), ["transcript_id", "last"])
    wanted = F.array_distinct(F.array_compact(F.concat(
        F.col("at") if include_source else F.col("excerpt"),
        F.array(F.col("first") - 1, F.col("last") + 1, F.when(F.col("back"), F.col("first") - 2), F.when(F.col("ahead"), F.col("last") + 2)),
    )))
    picked = own.select("id", "transcript_id", F.explode(wanted).alias("pos"))
    rows = picked.join(turns.select("transcript_id", "pos", F.col("id").alias("turn_id")), ["transcript_id", "pos"])
    # a window per signal holds at most the cited turns and four more
    kept = rows.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("pos", "turn_id"))), 1, most).alias("rows"))
    return kept.select("id", F.explode("rows").alias("r")).select("id", "r.pos", "r.turn_id")


def rank_context(signals: DataFrame, turns: DataFrame) -> DataFrame:
    """The texts of all turns from one before the first to one after the last cited turn; the quote where none is cited.

    The range becomes one row per position, so the join has the key (transcript, pos).  Result: ``id``, ``context``.
    """
    span = cited_turns(signals, turns).groupBy("id", "transcript_id").agg(F.min("t_pos").alias("first"), F.max("t_pos").alias("last"))
    span = span.select("id", "transcript_id", F.explode(F.sequence(F.col("first") - 1, F.col("last") + 1)).alias("pos"))
    rows = span.join(turns.select("transcript_id", "pos", "text"), ["transcript_id", "pos"])
    texts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"])
    found = rows.groupBy("id").agg(F.array_join(texts, " ").alias("context"))
    return signals.select("id", "advisor_quote").join(found, "id", "left").select("id", F.coalesce("context", "advisor_quote").alias("context"))


def completion_turns(signals: DataFrame, turns: DataFrame, owner: str = "advisor", need_quote: bool = True) -> DataFrame:
    """For signals with a single cited turn, the neighbours of the same speaker that complete its thought."""
    cited = cited_turns(signals, turns)
    if need_quote:
        cited = cited.filter(F.contains("t_text", "advisor_quote"))
    single = cited.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("cited_id").alias("turn")).filter("n = 1")
    near = with_neighbours(turns, ["transcript_id"], "pos", ["id", "raw_speaker_label", "inferred_role"])
    text = F.ltrim("text")
    starts = text.rlike("^[a-z]") | like(text, REFERENTIAL_START)
    mine = F.col("inferred_role") == owner

    def same(side: str) -> Column:
        return mine & (F.col(f"inferred_role_{side}") == owner) & (F.col(f"raw_speaker_label_{side}") == F.col("raw_speaker_label"))

    near = near.select(
        F.col("id").alias("turn"), F.when(starts & same("m1"), F.col("id_m1")).alias("previous_id"),
        F.when(like(text, MID_THOUGHT_END) & same("p1"), F.col("id_p1")).alias("next_id"),
    )
    return single.join(near, "turn").filter("previous_id is not null or next_id is not null").select("id", "previous_id", "next_id")


def first_wins(items: DataFrame, key: Sequence[Column], order: Sequence[str]) -> DataFrame:
    """Of items with equal keys the first by ``order``; a map-side combined ``min``, not a window."""
    best = items.groupBy(*[k.alias(f"__k{i}") for i, k in enumerate(key)]).agg(F.min_by(F.struct(*items.columns), F.struct(*order)).alias("r"))
    return best.select("r.*")


def grounded(rationale: Column, support: Column, quote: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The rationale, or a plain quotation where it claims a relation the support text does not show."""
    unsupported = F.lit(False)
    for claim, shown in rules:
        unsupported = unsupported | (like(rationale, claim) & ~like(support, shown))
    return F.when(unsupported, F.concat(F.lit('The advisor states, "'), quote, F.lit('"'))).otherwise(rationale)


def resolution(signals: DataFrame, turns: DataFrame) -> DataFrame:
    """What became of each quote, the turn it stands in, that turn's time and its neighbours.

    ``outcome``: resolved; ambiguous_evidence where several reliable turns fit; not_advisor_side where only other turns hold the
    quote; quote_not_found.  Result: ``id``, ``outcome``, ``method``, ``turn_id``, ``timestamp`` (the turn's, not the signal's),
    ``previous_id``, ``next_id``.
    """
    found = resolve_source(signals, turns)
    nowhere = signals.join(found.filter("matches = 0").select("id"), "id", "left_semi")
    other = quote_hits(nowhere, turns).select("id").distinct().withColumn("elsewhere", F.lit(True))
    near = with_neighbours(turns.select("transcript_id", "pos", "id", "timestamp"), ["transcript_id"], "pos", ["id"])
    near = near.select(F.col("id").alias("turn_id"), "timestamp", F.col("id_m1").alias("previous_id"), F.col("id_p1").alias("next_id"))
    outcome = F.when(F.col("turn_id").isNotNull(), "resolved").when(F.col("matches") > 1, "ambiguous_evidence").when(F.col("elsewhere"), "not_advisor_side")
    rows = found.join(other, "id", "left").join(near, "turn_id", "left")
    return rows.select("id", outcome.otherwise("quote_not_found").alias("outcome"), "method", "turn_id", "timestamp", "previous_id", "next_id")


def repeat_reasons(items: DataFrame, key: Sequence[Column], order: Sequence[str], batch: str) -> DataFrame:
    """Each item with null if it is the first of its key, else whether the first is in the same batch.

    Nulls of the key equal each other.  The first is a combined ``min_by``, joined back with hot keys split off.
    """
    keyed = items.withColumn("__key", F.to_json(F.struct(*[k.alias(f"k{i}") for i, k in enumerate(key)]), {"ignoreNullFields": "false"}))
    first = keyed.groupBy("__key").agg(F.min(F.struct(*order, F.col(batch).alias("first_batch"))).alias("__first"))
    rows = join_unique(keyed, first, "__key")
    mine = F.struct(*[F.col(c) for c in order]) == F.struct(*[F.col(f"__first.{c}") for c in order])
    again = F.when(F.col(batch) == F.col("__first.first_batch"), "duplicate_within_batch").otherwise("duplicate_across_batches")
    return rows.withColumn("repeat_reason", F.when(~mine, again)).drop("__key", "__first")


def overlaid_roles(turns: DataFrame, answers: DataFrame) -> DataFrame:
    """Every turn with the role a response gave it, or unknown with confidence 0.

    ``turns``: id, batch.  ``answers``: batch, item, turn_id, role, confidence.  Answers about turns of another batch are
    ignored; of several about one turn the last item stands.
    """
    last = answers.groupBy("batch", F.col("turn_id").alias("id")).agg(F.max(F.struct("item", "role", "confidence")).alias("a"))
    rows = turns.join(last, ["id", "batch"], "left")
    return rows.select("id", F.coalesce("a.role", F.lit("unknown")).alias("role"), F.coalesce("a.confidence", F.lit(0.0)).alias("confidence"))

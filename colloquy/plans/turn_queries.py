"""Queries over transcripts and turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import evidence as ev
from ..operators import segmentation, sequence, views
from ..operators.rules import first_reason
from ..session import table
from .base import S, T, signals, turns

KINDS = ("advisor", "optimize_rep", "unknown", "mixed")
PROCEDURAL = (r"\bsay more about that\b", r"\bgo on\b", r"\bhave to check\b")
FILLER = ("i'd", "okay", "right", "sure", "well", "so")
BOUNDARY = segmentation.BOUNDARY


def turns_flat(spark, base):
    return segmentation.flat_segments(table(spark, base, "transcripts"))


def turns_lines(spark, base):
    return segmentation.line_segments(table(spark, base, "transcripts"))


def transcript_texts(spark, base):
    t = table(spark, base, "transcripts")
    return t.select("id", tx.token_estimate(F.col("raw_text")).alias("tokens"), F.sha2("raw_text", 256).alias("input_sha256"))


def repaired_documents(spark, base):
    d = table(spark, base, "documents").select("doc_id", "text", tx.repair_mojibake(F.col("text")).alias("repaired"))
    return d.select("doc_id", (F.col("text") != F.col("repaired")).alias("changed"), F.md5("repaired").alias("digest"))


def upload_checks(spark, base):
    t = table(spark, base, "transcripts")
    blank = ~F.coalesce(F.col("raw_text").rlike(r"\S"), F.lit(False))
    reason = first_reason([("unsupported_type", ~F.lower("file_name").endswith(".txt")), ("too_large", F.octet_length("raw_text") > 6000), ("empty", blank)])
    return t.select("id", F.coalesce(reason, F.lit("accepted")).alias("outcome"))


def turn_batches(spark, base):
    return sequence.batched(turns(spark, base), "pos", 40).select("transcript_id", "id", "pos", "batch")


def batch_hashes(spark, base):
    t = sequence.batched(turns(spark, base), "pos", 60)
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"].cast("string")), ",")
    return t.groupBy("transcript_id", "batch").agg(F.count(F.lit(1)).alias("turns"), F.sha2(ids, 256).alias("input_hash"))


def gated_roles(spark, base):
    t = turns(spark, base)
    conf = F.coalesce("role_confidence", F.lit(0.0))
    role = F.when(conf >= 0.65, F.coalesce("inferred_role", F.lit("unknown"))).otherwise("unknown")
    return t.select("id", role.alias("role"), conf.alias("confidence"))


def role_histogram(spark, base):
    role = F.coalesce("inferred_role", F.lit("unknown"))
    t = table(spark, base, "transcript_turns").dropDuplicates(["id"])
    return t.groupBy("transcript_id").agg(*[F.count_if(role == k).alias(k) for k in KINDS])


def owner_neighbourhood(spark, base):
    return ev.owner_neighbourhood(turns(spark, base)).select("transcript_id", "id", "pos")


def reliable_turns(spark, base):
    t = table(spark, base, "transcript_turns").dropDuplicates(["id"])
    return t.groupBy("transcript_id").agg(F.count_if(ev.reliable(F.col("inferred_role"), F.col("role_confidence"))).alias("reliable"), F.count(F.lit(1)).alias("turns"))


def source_resolution(spark, base):
    # quotes of the supplied signals need not stand in the stored turns, so the quote is not asked for
    return ev.resolve_source(signals(spark, base), turns(spark, base), need_quote=False)


def _real_and_cut(spark, base, t):
    """The quotes of the signals as they are (odd ids), then the third to eighth word of every longer turn (even ids), of which every other cites its turn."""
    columns = ["transcript_id", "timestamp", "advisor_quote", "source_turn_ids"]
    cut = t.withColumn("advisor_quote", F.regexp_extract("text", r"^\S+ \S+ (\S+ \S+ \S+ \S+ \S+ \S+)", 1)).filter("advisor_quote <> ''")
    cut = cut.withColumn("source_turn_ids", F.when(F.col("id") % 2 == 0, F.array("id")))
    return signals(spark, base).select((F.col("id") * 2 + 1).alias("id"), *columns).unionByName(cut.select((F.col("id") * 2).alias("id"), *columns))


def source_quotes(spark, base):
    """The quote must stand in the turn, and without a fitting cited turn the transcript is searched."""
    t = turns(spark, base)
    return ev.resolve_source(_real_and_cut(spark, base, t), t)


def context_windows(spark, base):
    return ev.context_window(signals(spark, base), turns(spark, base), need_quote=False)


def quoted_windows(spark, base):
    """Context of cited turns that hold the quote, for real quotes and for excerpts of turns."""
    t = turns(spark, base)
    return ev.context_window(_real_and_cut(spark, base, t), t)


def quoted_completions(spark, base):
    """Turns that complete the one cited turn that holds the quote."""
    t = turns(spark, base)
    return ev.completion_turns(_real_and_cut(spark, base, t), t)


def context_texts(spark, base):
    t = turns(spark, base)
    rows = ev.context_window(signals(spark, base), t, include_source=True, need_quote=False)
    rows = rows.join(t.select(F.col("id").alias("turn_id"), "text"), "turn_id")
    packed = F.array_sort(F.collect_list(F.struct("pos", "text")))
    return rows.groupBy("id").agg(F.array_join(F.transform(packed, lambda x: x["text"]), " ").alias("context"))


def rank_contexts(spark, base):
    return ev.rank_context(signals(spark, base), turns(spark, base))


def completion_turns(spark, base):
    return ev.completion_turns(signals(spark, base), turns(spark, base), need_quote=False)


def procedural_turns(spark, base):
    t = table(spark, base, "transcript_turns").dropDuplicates(["id"])
    plain = tx.quote_words(F.col("text"))
    return t.select("id", plain.alias("words"), tx.only_words_left(plain, PROCEDURAL, FILLER).alias("procedural"))


def evidence_locator(spark, base):
    t = turns(spark, base)
    quotes = t.select("id", "transcript_id", "timestamp", F.col("text").alias("advisor_quote"))
    return views.locate(quotes, t, contained=False)


def evidence_places(spark, base):
    """Real quotes and excerpts, exact matches before containment."""
    t = table(spark, base, "transcript_turns").dropDuplicates(["id"])
    return views.locate(_real_and_cut(spark, base, t), t)


def tagged_neighbours(spark, base):
    return views.neighbours_tagged(turns(spark, base))


def natural_listing(spark, base):
    t = views.search(table(spark, base, "transcripts"), "file_name", "call")
    return t.select("id", "file_name", views.natural_key("file_name").alias("sort_key"))


def status_counts(spark, base):
    t = table(spark, base, "transcripts")
    return t.groupBy("status").agg(F.count(F.lit(1)).alias("transcripts"), F.max("created_at").alias("newest"))


def quote_matches(spark, base):
    """The third to eighth word of every longer turn, looked up as a quotation in its transcript."""
    t = turns(spark, base)
    quotes = t.select("id", "transcript_id", F.regexp_extract("text", r"^\S+ \S+ (\S+ \S+ \S+ \S+ \S+ \S+)", 1).alias("advisor_quote")).filter("advisor_quote <> ''")
    return ev.quote_matches(quotes, t)


def signal_quote_matches(spark, base):
    return ev.quote_matches(signals(spark, base), table(spark, base, "transcript_turns").dropDuplicates(["id"]))


def owner_contexts(spark, base):
    return ev.bounded_owner_context(turns(spark, base))


def unparsed_transcripts(spark, base):
    """Transcripts with text and no stored turns: what parse-or-reuse has to parse."""
    have = table(spark, base, "transcript_turns").select(F.col("transcript_id").alias("id")).distinct()
    return table(spark, base, "transcripts").filter("raw_text <> ''").join(have, "id", "left_anti").select("id", "file_name")


QUERIES = {f.__name__: f for f in (
    turns_flat, turns_lines, transcript_texts, repaired_documents, upload_checks, turn_batches, batch_hashes, gated_roles, role_histogram,
    owner_neighbourhood, reliable_turns, source_resolution, source_quotes, context_windows, quoted_windows, quoted_completions, context_texts, rank_contexts, completion_turns, procedural_turns,
    quote_matches, signal_quote_matches, owner_contexts, unparsed_transcripts, evidence_locator, evidence_places, tagged_neighbours, natural_listing, status_counts,
)}

_BAD = [(b, g) for b, g in tx._broken_forms()]


def _replace(column: str) -> str:
    for bad, good in _BAD:
        column = f"replace({column}, '{bad}', '{good}')"
    return column


_CITED = f"""{S}, {T}, c as (
    select s.id, s.transcript_id, t.id as turn_id, t.pos, t.text, t.timestamp as t_time, t.raw_speaker_label as label, t.inferred_role as role,
           t.role_confidence as conf, s.timestamp, s.advisor_quote
    from (select *, unnest(list_distinct(source_turn_ids)) as cited from s) s join t on t.id = s.cited and t.transcript_id = s.transcript_id)"""

_WINDOW = """n as (select transcript_id, pos, raw_speaker_label as l0, lag(raw_speaker_label) over w as lm1, lag(raw_speaker_label, 2) over w as lm2,
        lead(raw_speaker_label) over w as lp1, lead(raw_speaker_label, 2) over w as lp2, lag(text) over w as xm1, lead(text) over w as xp1
        from t window w as (partition by transcript_id order by pos)),
    o as (select id, transcript_id, min(pos) as a, max(pos) as b, list(pos) as own, list(pos) filter (trim(text) <> trim(advisor_quote)) as part from c group by all),
    e as (select o.*, coalesce(f.lm1 = f.l0 and f.lm2 = f.l0 and regexp_matches(ltrim(f.xm1), '^[a-z]'), false) as back,
        coalesce(g.lp1 = g.l0 and g.lp2 = g.l0 and regexp_matches(g.xp1, '(?i)(…|\\.\\.\\.|[,;:]|\\b(and|but|because|so|or))\\s*$'), false) as ahead
        from o join n f on f.transcript_id = o.transcript_id and f.pos = o.a join n g on g.transcript_id = o.transcript_id and g.pos = o.b),
    k as (select t.*, e.id as sid, row_number() over (partition by e.id order by t.pos) as rn from e join t on t.transcript_id = e.transcript_id
        and (t.pos in (e.a - 1, e.b + 1) or list_contains({own}, t.pos) or (e.back and t.pos = e.a - 2) or (e.ahead and t.pos = e.b + 2)))"""

_CUT = r"""qt as (select id * 2 + 1 as id, transcript_id, timestamp, advisor_quote as q, source_turn_ids as cites from s union all select id * 2, transcript_id, timestamp,
    regexp_extract(text, '^\S+ \S+ (\S+ \S+ \S+ \S+ \S+ \S+)', 1) as x, case when id % 2 = 0 then [id] end from t where x <> '')"""
_PLAIN = r"""trim(regexp_replace(translate({0}, '“”‘’', '""'''''), '\s+', ' ', 'g'))"""

_SPEAKER = "trim({0}) <> '' and len(string_split_regex(trim({0}), '\\s+')) <= 8 and not regexp_matches({0}, '[.!?]')"
_PA, _PB, _PD = r"^(\d{1,2}:\d{2}:\d{2})\s+([^:]{1,100}):\s*(.*)$", r"^(.+?)\s+(\d{1,2}:\d{2}:\d{2})\s*:?[ \t]*$", r"^([^:]{1,100}):\s*(.*)$"

_QUOTED = f"""{S}, {T}, {_CUT}, c as (select qt.id, qt.transcript_id, t.id as turn_id, t.pos, t.text, q as advisor_quote
    from (select *, unnest(list_distinct(cites)) as cited from qt) qt join t on t.id = qt.cited and t.transcript_id = qt.transcript_id and contains(t.text, q))"""
_COMPLETE = """n as (select *, lag(id) over w as pi, lag(raw_speaker_label) over w as pl, lag(inferred_role) over w as pr, lead(id) over w as ni,
            lead(raw_speaker_label) over w as nl, lead(inferred_role) over w as nr from t window w as (partition by transcript_id order by pos)),
        o as (select id, min(turn_id) as turn from c group by id having count(*) = 1),
        x as (select o.id, case when pr = 'advisor' and inferred_role = 'advisor' and pl = raw_speaker_label
                and (regexp_matches(ltrim(text), '^[a-z]') or regexp_matches(ltrim(text), '(?i)^(that|this|it|he|she|they|those|these)\\b')) then pi end as previous_id,
            case when nr = 'advisor' and inferred_role = 'advisor' and nl = raw_speaker_label
                and regexp_matches(text, '(?i)(…|\\.\\.\\.|[,;:]|\\b(and|but|because|so|or))\\s*$') then ni end as next_id from o join n on n.id = o.turn)
        select * from x where previous_id is not null or next_id is not null"""

SQL = {
    "turns_lines": rf"""with d as (select id, string_split_regex(raw_text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]') as a from transcripts where not regexp_matches(raw_text, '{BOUNDARY}')),
        l as (select id, n, regexp_replace(a[n], '^\s+|\s+$', '', 'g') as s from (select id, a, unnest(range(1, len(a) + 1)) as n from d)),
        e as (select *, regexp_extract(s, '{_PA}', ['t', 'w', 'x']) as pa, regexp_extract(s, '{_PB}', ['w', 't']) as pb, regexp_extract(s, '{_PD}', ['w', 'x']) as pd from l where s <> ''),
        k as (select *, case when regexp_matches(s, '{_PA}') and {_SPEAKER.format("pa.w")} then 'a' when regexp_matches(s, '{_PB}') and {_SPEAKER.format("pb.w")} then 'b'
            when regexp_matches(s, '^\d{{1,2}}:\d{{2}}:\d{{2}}$') then 'c' when regexp_matches(s, '{_PD}') and {_SPEAKER.format("pd.w")} then 'd' else 'e' end as k0 from e),
        f as (select id, n, case when k0 in ('a', 'd') and lower(trim(case k0 when 'a' then pa.w else pd.w end)) in {segmentation.METADATA} then 'm' else k0 end as kind,
            case k0 when 'a' then pa.w when 'b' then pb.w when 'd' then pd.w end as label, case k0 when 'a' then pa.t when 'b' then pb.t when 'c' then s end as time,
            case k0 when 'a' then pa.x when 'd' then pd.x when 'e' then s else '' end as said from k),
        g as (select *, kind in ('a', 'b', 'd') or (kind = 'e' and coalesce(lag(kind) over (partition by id order by n) in ('c', 'm'), true)) as opens from f),
        h as (select *, sum(case when opens or kind in ('c', 'm') then 1 else 0 end) over (partition by id order by n) as turn,
            last_value(case when kind = 'c' then time when kind = 'm' or opens then '' end ignore nulls) over (partition by id order by n rows between unbounded preceding and 1 preceding) as carried from g),
        t as (select id, turn, max(case when kind in ('a', 'b') then time when opens then nullif(carried, '') end) as timestamp, max(case when opens then coalesce(trim(label), 'unknown') end) as label,
            string_agg(said, chr(10) order by n) filter (said <> '') as text from h where kind not in ('c', 'm') group by all)
        select id as doc_id, cast(row_number() over (partition by id order by turn) - 1 as int) as turn_index, timestamp, label as raw_speaker_label, text from t where text is not null""",
    "turns_flat": rf"""
        with p as (select id as doc_id, regexp_extract_all(raw_text, '{BOUNDARY}', 1) as st, regexp_extract_all(raw_text, '{BOUNDARY}', 2) as lb,
            regexp_extract_all(raw_text, '{BOUNDARY}', 3) as co, string_split_regex(raw_text, '{BOUNDARY}') as body
            from transcripts where regexp_matches(raw_text, '{BOUNDARY}')),
        x as (select doc_id, unnest(range(1, len(st) + 1)) as i, st, lb, co, body from p),
        y as (select doc_id, i, st[i] as ts, upper(regexp_replace(lb[i], '^\s+|\s+$', '', 'g')) as label, co[i] as colon, regexp_replace(body[i + 1], '^\s+|\s+$', '', 'g') as text from x),
        z as (select *, case when label = 'OPTIMIZE_REP' then 'optimize_rep' when regexp_full_match(label, 'ADVISOR(_\d+)?') then 'advisor' end as role from y)
        select doc_id, cast(row_number() over (partition by doc_id order by i) - 1 as int) as turn_index, ts as timestamp, label as raw_speaker_label,
            role as inferred_role, cast(1.0 as double) as role_confidence, text from z where colon <> '' and role is not null and text <> ''""",
    "transcript_texts": "select id, greatest(1, cast(floor(length(raw_text) / 4) as int)) as tokens, sha256(raw_text) as input_sha256 from transcripts",
    "repaired_documents": f"select doc_id, text <> {_replace('text')} as changed, md5({_replace('text')}) as digest from documents",
    "upload_checks": """select id, case when not lower(file_name) like '%.txt' then 'unsupported_type' when strlen(raw_text) > 6000 then 'too_large'
        when not coalesce(regexp_matches(raw_text, '\\S'), false) then 'empty' else 'accepted' end as outcome from transcripts""",
    "turn_batches": f"with {T} select transcript_id, id, pos, cast(pos // 40 + 1 as int) as batch from t",
    "batch_hashes": f"""with {T} select transcript_id, cast(pos // 60 + 1 as int) as batch, count(*) as turns,
        sha256(string_agg(cast(id as varchar), ',' order by pos)) as input_hash from t group by all""",
    "gated_roles": f"""with {T} select id, case when coalesce(role_confidence, 0) >= 0.65 then coalesce(inferred_role, 'unknown') else 'unknown' end as role,
        coalesce(role_confidence, 0.0) as confidence from t""",
    "role_histogram": f"""with {T} select transcript_id, count(*) filter (inferred_role = 'advisor') as advisor, count(*) filter (inferred_role = 'optimize_rep') as optimize_rep,
        count(*) filter (coalesce(inferred_role, 'unknown') = 'unknown') as unknown, count(*) filter (inferred_role = 'mixed') as mixed from t group by all""",
    "owner_neighbourhood": f"""with {T} select transcript_id, id, pos from (select *, lag(inferred_role) over w as b, lead(inferred_role) over w as a from t
        window w as (partition by transcript_id order by pos)) where inferred_role = 'advisor' or a = 'advisor' or b = 'advisor'""",
    "reliable_turns": f"""with {T} select transcript_id, count(*) filter (inferred_role = 'advisor' and role_confidence >= 0.65) as reliable, count(*) as turns from t group by all""",
    "source_resolution": f"""with {_CITED}, h as (select * from c where role = 'advisor' and conf >= 0.65),
        g as (select id, count(*) as n, min(turn_id) as one, count(*) filter (t_time = timestamp and timestamp <> '') as k,
            min(turn_id) filter (t_time = timestamp and timestamp <> '') as tm from h group by id)
        select s.id, cast(coalesce(n, 0) as int) as matches, case when n = 1 then one when k = 1 then tm end as turn_id,
            case when n = 1 then 'source_turn_id' when k = 1 then 'source_turn_id_timestamp' end as method from s left join g using (id)""",
    "source_quotes": f"""with {S}, {T}, {_CUT}, h as (select qt.id, t.id as turn_id, coalesce(list_contains(cites, t.id), false) as cited,
            coalesce(qt.timestamp = t.timestamp and t.timestamp <> '', false) as tm from qt join t on t.transcript_id = qt.transcript_id and contains(t.text, q)
            where inferred_role = 'advisor' and role_confidence >= 0.65),
        w as (select * from h qualify cited = max(cited) over (partition by id)),
        g as (select id, count(*) as n, min(turn_id) as one, count(*) filter (tm) as k, min(turn_id) filter (tm) as at_, case when any_value(cited) then 'source_turn_id' else 'unique_quote' end as how from w group by id)
        select qt.id, cast(coalesce(n, 0) as int) as matches, case when n = 1 then one when k = 1 then at_ end as turn_id, case when n = 1 then how when k = 1 then how || '_timestamp' end as method
        from qt left join g using (id)""",
    "rank_contexts": f"""with {_CITED}, o as (select id, transcript_id, min(pos) as a, max(pos) as b from c group by all),
        x as (select o.id, string_agg(text, ' ' order by pos) as context from o join t on t.transcript_id = o.transcript_id and t.pos between a - 1 and b + 1 group by o.id)
        select s.id, coalesce(context, advisor_quote) as context from s left join x using (id)""",
    "evidence_places": f"""with {S}, {T}, {_CUT}, a as (select id, transcript_id, timestamp, {_PLAIN.format('q')} as q from qt),
        b as (select id as turn_id, transcript_id, timestamp as t_time, {_PLAIN.format('text')} as x from t where inferred_role = 'advisor'),
        h as (select a.id, turn_id, x = q as same, coalesce(timestamp = t_time and t_time <> '', false) as tm from a join b on a.transcript_id = b.transcript_id and contains(x, q) where q <> ''),
        w as (select * from h qualify same = max(same) over (partition by id)),
        g as (select id, count(*) as n, min(turn_id) as one, count(*) filter (tm) as k, min(turn_id) filter (tm) as at_ from w group by id)
        select qt.id, case when n = 1 then one when k = 1 then at_ end as turn_id from qt left join g using (id)""",
    "signal_quote_matches": f"""with {S}, {T}, g as (select s.id, count(*) as n, min(t.id) as one from s join t on t.transcript_id = s.transcript_id and contains(t.text, advisor_quote)
        where regexp_matches(advisor_quote, '\\S') group by s.id)
        select s.id, cast(coalesce(n, 0) as int) as matches, case when n = 1 then one end as turn_id from s left join g using (id)""",
    "context_windows": f"with {_CITED}, {_WINDOW.replace('{own}', 'e.part')} select sid as id, pos, id as turn_id from k where rn <= 5",
    "context_texts": f"with {_CITED}, {_WINDOW.replace('{own}', 'e.own')} select sid as id, string_agg(text, ' ' order by pos) as context from k where rn <= 5 group by sid",
    "completion_turns": f"with {_CITED}, {_COMPLETE}",
    "quoted_completions": f"with {_QUOTED}, {_COMPLETE}",
    "quoted_windows": f"with {_QUOTED}, {_WINDOW.replace('{own}', 'e.part')} select sid as id, pos, id as turn_id from k where rn <= 5",
    "procedural_turns": f"""with {T}, w as (select id, regexp_extract_all(lower(text), '[a-z0-9'']+') as a from t),
        q as (select id, array_to_string([x for x, i in a if i = 1 or x <> a[i - 1]], ' ') as words from w),
        p as (select id, words, regexp_replace(regexp_replace(regexp_replace(words, '\\bsay more about that\\b', ' ', 'g'), '\\bgo on\\b', ' ', 'g'), '\\bhave to check\\b', ' ', 'g') as rest from q)
        select id, words, words <> rest and len([x for x in regexp_extract_all(rest, '[a-z0-9'']+') if not list_contains(['i''d', 'okay', 'right', 'sure', 'well', 'so'], x)]) = 0 as procedural from p""",
    "evidence_locator": f"""with {T}, q as (select *, trim(regexp_replace(translate(text, '“”‘’', '""'''''), '\\s+', ' ', 'g')) as n from t),
        g as (select a.id, count(*) as n, min(b.id) as one, count(*) filter (b.timestamp = a.timestamp and a.timestamp <> '') as k,
            min(b.id) filter (b.timestamp = a.timestamp and a.timestamp <> '') as tm
            from q a join q b on a.transcript_id = b.transcript_id and a.n = b.n and b.inferred_role = 'advisor' where a.n <> '' group by a.id)
        select t.id, case when n = 1 then one when k = 1 then tm end as turn_id from t left join g using (id)""",
    "quote_matches": f"""with {T}, q as (select id, transcript_id, regexp_extract(text, '^\\S+ \\S+ (\\S+ \\S+ \\S+ \\S+ \\S+ \\S+)', 1) as q from t),
        g as (select q.id, count(*) as n, min(t.id) as one from q join t on t.transcript_id = q.transcript_id and contains(t.text, q.q) where q.q <> '' group by q.id)
        select q.id, cast(coalesce(n, 0) as int) as matches, case when n = 1 then one end as turn_id from q left join g using (id) where q.q <> ''""",
    "owner_contexts": f"""with {T}, o as (select *, case when inferred_role = 'advisor' and role_confidence >= 0.65 then text end as own from t),
        n as (select id, own, lag(own) over w as m1, lag(own, 2) over w as m2, lead(own) over w as p1, lead(own, 2) over w as p2 from o window w as (partition by transcript_id order by pos))
        select id, concat_ws(' ', case when m1 is not null then m2 end, m1, own, p1, case when p1 is not null then p2 end) as context from n where own is not null""",
    "unparsed_transcripts": "select id, file_name from transcripts where raw_text <> '' and id not in (select transcript_id from transcript_turns)",
    "tagged_neighbours": f"""with {T} select transcript_id, pos, id, lag(id) over w as previous_id, lead(id) over w as next_id from t window w as (partition by transcript_id order by pos)""",
    "natural_listing": """select id, file_name, array_to_string([case when regexp_matches(p, '^\\d') then lpad(p, 20, '0') else p end
        for p in regexp_extract_all(lower(file_name), '\\d+|\\D+')], '') as sort_key from transcripts where lower(file_name) like '%call%'""",
    "status_counts": "select status, count(*) as transcripts, max(created_at) as newest from transcripts group by status",
}

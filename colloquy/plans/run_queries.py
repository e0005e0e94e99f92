"""Queries over runs: latest, visible rows, replay, backfill, export, usage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dedup, export, runs, telemetry
from ..operators.skew import join_unique
from ..session import table
from .base import R, S, T, results, signals
from . import signal_queries
from .signal_queries import _ELECT, _order, final_selection

PENDING = "uploaded"
CHECKED = (("transcript_turns", "id", "transcript_id"), ("candidate_signals", "id", "transcript_id"), ("candidate_signals", "id", "analysis_run_id"), ("analysis_runs", "id", "transcript_id"))


def latest_runs(spark, base):
    return runs.latest_run(table(spark, base, "analysis_runs"))


def latest_completed_runs(spark, base):
    return runs.latest_run(table(spark, base, "analysis_runs"), completed_only=True)


def run_listing(spark, base):
    r = table(spark, base, "analysis_runs")
    took = (F.unix_micros("completed_at") - F.unix_micros("started_at")) / 1e6
    return r.select("transcript_id", "id", "status", "run_type", "source_run_id", F.round(took, 2).alias("seconds"))


def visible_signals(spark, base):
    latest = runs.latest_run(table(spark, base, "analysis_runs"), completed_only=True)
    return runs.visible(signals(spark, base), latest).select("id", "transcript_id", "analysis_run_id", "item_type")


def signal_listing(spark, base):
    """Signals of the latest completed run, of all runs where there is none, with their last score if any."""
    latest = runs.latest_run(table(spark, base, "analysis_runs"), completed_only=True)
    s = join_unique(signals(spark, base), latest, "transcript_id", "left").filter("run_id is null or analysis_run_id = run_id")
    r = results(spark, base).select(F.col("candidate_id").alias("id"), "analysis_run_id", "structured_score", "validation_verdict")
    return s.join(r, ["id", "analysis_run_id"], "left").select("id", "transcript_id", "item_type", F.nanvl("structured_score", F.lit(None).cast("double")).alias("structured_score"), "validation_verdict")


def absent_results(spark, base):
    """Signals of runs that have no scoring row yet: what an insert-if-absent adds."""
    have = results(spark, base).select("analysis_run_id", F.col("candidate_id").alias("id"))
    want = signals(spark, base).filter("analysis_run_id is not null").select("analysis_run_id", "id")
    return runs.insert_absent(have, want, ["analysis_run_id", "id"])


def replayed_signals(spark, base):
    """Snapshots of the source runs of all replays, cloned under the replay's id."""
    r = table(spark, base, "analysis_runs")
    wanted = r.filter("run_type = 'replay'").select(F.col("id").alias("replay_id"), F.col("source_run_id").alias("source"))
    source = r.join(wanted.select(F.col("source").alias("id")).distinct(), "id", "left_semi")
    s = signals(spark, base).select("analysis_run_id", "id", "item_type", "advisor_quote")
    cloned = runs.replay(s, source, F.lit("")).drop("analysis_run_id")
    return cloned.join(wanted, cloned["source_run_id"] == wanted["source"]).select(F.col("replay_id").alias("analysis_run_id"), "source_run_id", "id", "item_type")


def legacy_runs(spark, base):
    return runs.legacy_runs(table(spark, base, "transcripts"), signals(spark, base).filter("analysis_run_id is null"), table(spark, base, "analysis_runs"))


def backfilled_signals(spark, base):
    return runs.backfill_run(signals(spark, base).select("id", "transcript_id", "analysis_run_id"), legacy_runs(spark, base))


def backfilled_snapshots(spark, base):
    s = runs.backfill_run(signals(spark, base), legacy_runs(spark, base)).filter("analysis_run_id is not null")
    return s.select("analysis_run_id", "id", F.lower(F.trim("advisor_quote")).alias("normalized_evidence"), F.coalesce(F.size("source_turn_ids"), F.lit(0)).alias("sources"))


def validation_backfill(spark, base):
    r = results(spark, base).select(F.col("candidate_id").alias("id"), "analysis_run_id", "validation_verdict")
    s = signals(spark, base).filter("analysis_run_id is not null").join(r, ["id", "analysis_run_id"], "left")
    verdict = F.coalesce("validation_verdict", F.lit("unavailable"))
    return s.select("id", "analysis_run_id", verdict.alias("derived_verdict"), F.when(verdict == "reject", 1).otherwise(0).alias("rejections"))


def after_deletion(spark, base):
    """Row counts per table once the transcripts that only were uploaded are gone."""
    gone = table(spark, base, "transcripts").filter(F.col("status") == PENDING)
    names = ("transcript_turns", "candidate_signals", "analysis_runs", "participants")
    kept = runs.delete_cascade({n: table(spark, base, n).select("transcript_id") for n in names}, gone)
    out = None
    for n in names:
        one = kept[n].groupBy("transcript_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("table_name"), "transcript_id", "n")
        out = one if out is None else out.unionByName(one)
    return out


def replaced_finals(spark, base):
    """Finals with the rows of every completed run replaced by a fresh selection."""
    r = results(spark, base).filter("relative_rank = 1").select("analysis_run_id", F.col("candidate_id").alias("signal_id"), F.lit("stored").alias("origin"))
    fresh = final_selection(spark, base).join(table(spark, base, "analysis_runs").filter("status = 'completed'").select(F.col("id").alias("analysis_run_id")), "analysis_run_id", "left_semi")
    return runs.replace_keys(r, fresh.select("analysis_run_id", "signal_id", F.lit("fresh").alias("origin")), ["analysis_run_id"])


def _finals(spark, base):
    s = signals(spark, base).filter("duplicate_group_id is not null")
    return dedup.elect(s, "duplicate_group_id", _order())


def supporting_evidence(spark, base):
    e = _finals(spark, base)
    finals = e.filter("is_canonical").withColumnRenamed("id", "signal_id")
    rows = export.supporting(finals, e)
    return rows.select("signal_id", F.size("supporting_evidence").alias("n"), F.array_join(F.transform("supporting_evidence", lambda x: x["quote"]), "|").alias("quotes"))


def supporting_rows(spark, base):
    """Supporting quotes as rows, however large a group is."""
    e = _finals(spark, base)
    return export.supporting_rows(e.filter("is_canonical").withColumnRenamed("id", "signal_id"), e)


def _export(spark, base):
    e = _finals(spark, base)
    latest = runs.latest_run(table(spark, base, "analysis_runs"), completed_only=True)
    finals = runs.visible(e.filter("is_canonical"), latest).withColumnRenamed("id", "signal_id")
    wide = finals.join(export.supporting(finals, e), "signal_id", "left").withColumn("supporting_evidence", F.coalesce("supporting_evidence", F.array().cast("array<struct<quote:string,timestamp:string,relationship:string>>")))
    return wide.select("signal_id", "transcript_id", "item_type", "category", F.col("extraction_confidence").alias("business_score"), "supporting_evidence")


def export_rows(spark, base):
    """Elected members with their visible run and first supporting quote, scores with two places."""
    return export.csv_cells(export.widened(_export(spark, base)).select("signal_id", "transcript_id", "item_type", "category", "business_score", "supporting_quote_1", "supporting_timestamp_1"))


def export_table(spark, base):
    """The whole export: supporting evidence as a JSON cell, and in numbered columns up to the widest row."""
    return export.csv_cells(export.widened(_export(spark, base)))


def export_evidence(spark, base):
    """The JSON cells of the export."""
    return export.csv_cells(_export(spark, base).select("signal_id", "supporting_evidence"))


def export_lines(spark, base):
    """One JSON object per elected member, nulls kept."""
    e = _finals(spark, base).filter("is_canonical")
    return e.select("id", F.to_json(F.struct("transcript_id", "item_type", "category", "timestamp"), {"ignoreNullFields": "false"}).alias("line"))


def _calls(spark, base):
    e = table(spark, base, "events")
    k = F.get_json_object("props", "$.k").try_cast("long")
    return e.select(F.col("user_id").alias("run"), F.col("event_type").alias("stage"), k.alias("tokens"), F.when(k > 3, k).alias("cached"),
                    F.when(k < 95, k * F.lit(2)).alias("cost"), "value", "ts", "event_id")


def stage_usage(spark, base):
    return telemetry.usage_by(_calls(spark, base), ["run", "stage"], ["tokens", "cached"], "cost", "value")


def usage_totals(spark, base):
    u = telemetry.usage_by(_calls(spark, base), ["stage"], ["tokens", "cached"], "cost", "value")
    return telemetry.totals(u, ["tokens", "cached"], "cost")


def progress_states(spark, base):
    return telemetry.last_state(_calls(spark, base), "run", "ts", ["stage", "event_id"])


def signal_summaries(spark, base):
    """Per transcript: drivers, blockers and the strongest passed signal, of equal scores the smaller id."""
    r = results(spark, base).filter("structured_score is not null and not isnan(structured_score)")
    best = F.max_by("candidate_id", F.when(F.col("validation_verdict") == "pass", F.struct("structured_score", (-F.col("candidate_id")).alias("neg"))))
    return r.groupBy("transcript_id").agg(F.count_if(F.col("item_type") == "driver").alias("drivers"), F.count_if(F.col("item_type") == "blocker").alias("blockers"), best.alias("strongest"))


def diagnostics_listing(spark, base):
    r = results(spark, base).filter("item_type = 'blocker'")
    return r.select("analysis_run_id", "candidate_id", F.nanvl("business_score", F.lit(None).cast("double")).alias("business_score"),
                    F.coalesce(F.col("validation_verdict") == "reject", F.lit(False)).alias("rejected"), F.coalesce(F.col("validation_verdict") == "needs_review", F.lit(False)).alias("in_review"))


def downstream_snapshots(spark, base):
    return runs.downstream(_finals(spark, base), final_selection(spark, base))


def table_integrity(spark, base):
    parents = {"transcript_id": table(spark, base, "transcripts"), "analysis_run_id": table(spark, base, "analysis_runs")}
    out = None
    for name, key, foreign in CHECKED:
        one = runs.integrity(table(spark, base, name), parents[foreign], key, foreign)
        one = one.select(F.lit(name).alias("table_name"), F.lit(foreign).alias("foreign_key"), "row_count", "repeated_keys", "orphans")
        out = one if out is None else out.unionByName(one)
    return out


QUERIES = {f.__name__: f for f in (
    downstream_snapshots, table_integrity, latest_runs, latest_completed_runs, run_listing, visible_signals, signal_listing, absent_results, replayed_signals, legacy_runs, backfilled_signals,
    backfilled_snapshots, validation_backfill, after_deletion, replaced_finals, supporting_evidence, supporting_rows, export_rows, export_table, export_evidence, export_lines, stage_usage, usage_totals,
    progress_states, signal_summaries, diagnostics_listing,
)}

_LATEST = "lr as (select transcript_id, arg_max(id, struct_pack(a := started_at, b := id)) as run_id from analysis_runs where status = 'completed' group by all)"
_LEGACY = """lg as (select 'legacy-' || t.id as id, t.id as transcript_id, 'completed' as status, 'full' as run_type, t.updated_at as started_at from transcripts t
    where exists (select 1 from s where s.transcript_id = t.id and s.analysis_run_id is null) and not exists (select 1 from analysis_runs a where a.id = 'legacy-' || t.id))"""
_CALLS = """k as (select user_id as run, event_type as stage, cast(json_extract_string(props, '$.k') as bigint) as tokens, value, ts, event_id from events),
    c as (select *, case when tokens > 3 then tokens end as cached, case when tokens < 95 then tokens * 2 end as cost from k)"""
_USE = "count(*) as call_count, cast(sum(tokens) as bigint) as tokens, cast(sum(cached) as bigint) as cached, cast(case when count(cost) = count(*) then sum(cost) end as bigint) as cost"
_SUPPORT = """m as (select a.id as signal_id, list(b.advisor_quote order by b.id) as q, list(b.timestamp order by b.id) as ts from g a join g b on a.transcript_id = b.transcript_id
    and a.duplicate_group_id = b.duplicate_group_id and a.analysis_run_id is not distinct from b.analysis_run_id and a.id <> b.id where a.id = a.canon and b.id <> b.canon group by all)"""

SQL = {
    "downstream_snapshots": f"""with {_ELECT}, fs as ({signal_queries.SQL["final_selection"]})
        select g.analysis_run_id, g.id, g.canon as canonical_id, case when g.id = g.canon then 'canonical' else 'duplicate_of_canonical' end as relationship, g.members as group_size,
            fs.rank is not null as selected, fs.rank from g left join fs on fs.signal_id = g.id and fs.analysis_run_id = g.analysis_run_id""",
    "table_integrity": " union all ".join(
        f"""select '{n}' as table_name, '{f}' as foreign_key, (select count(*) from {n}) as row_count, (select count(*) from (select {k} from {n} group by {k} having count(*) > 1)) as repeated_keys,
        (select count(*) from {n} where {f} is not null and {f} not in (select id from {"transcripts" if f == "transcript_id" else "analysis_runs"})) as orphans""" for n, k, f in CHECKED
    ),
    "latest_runs": "select transcript_id, id as run_id from analysis_runs qualify row_number() over (partition by transcript_id order by started_at desc, id desc) = 1",
    "latest_completed_runs": "select transcript_id, id as run_id from analysis_runs where status = 'completed' qualify row_number() over (partition by transcript_id order by started_at desc, id desc) = 1",
    "run_listing": "select transcript_id, id, status, run_type, source_run_id, round((epoch_us(completed_at) - epoch_us(started_at)) / 1e6, 2) as seconds from analysis_runs",
    "visible_signals": f"""with {S}, {_LATEST} select s.id, s.transcript_id, s.analysis_run_id, s.item_type from s left join lr using (transcript_id)
        where (run_id is not null and s.analysis_run_id = run_id) or (run_id is null and s.analysis_run_id is null)""",
    "signal_listing": f"""with {S}, {R}, {_LATEST} select s.id, s.transcript_id, s.item_type, case when not isnan(r.structured_score) then r.structured_score end as structured_score, r.validation_verdict
        from s left join lr using (transcript_id) left join r on r.candidate_id = s.id and r.analysis_run_id = s.analysis_run_id where run_id is null or s.analysis_run_id = run_id""",
    "absent_results": f"with {S} select analysis_run_id, id from s where analysis_run_id is not null and not exists (select 1 from importance_results r where r.analysis_run_id = s.analysis_run_id and r.candidate_id = s.id)",
    "replayed_signals": f"""with {S} select p.id as analysis_run_id, s.analysis_run_id as source_run_id, s.id, s.item_type from analysis_runs p join analysis_runs o on o.id = p.source_run_id and o.status = 'completed'
        join s on s.analysis_run_id = o.id where p.run_type = 'replay'""",
    "legacy_runs": f"with {S}, {_LEGACY} select * from lg",
    "backfilled_signals": f"with {S}, {_LEGACY} select s.id, s.transcript_id, coalesce(s.analysis_run_id, lg.id) as analysis_run_id from s left join lg using (transcript_id)",
    "backfilled_snapshots": f"""with {S}, {_LEGACY} select coalesce(s.analysis_run_id, lg.id) as analysis_run_id, s.id, lower(trim(s.advisor_quote)) as normalized_evidence,
        cast(coalesce(len(s.source_turn_ids), 0) as int) as sources from s left join lg using (transcript_id) where coalesce(s.analysis_run_id, lg.id) is not null""",
    "validation_backfill": f"""with {S}, {R} select s.id, s.analysis_run_id, coalesce(r.validation_verdict, 'unavailable') as derived_verdict, case when r.validation_verdict = 'reject' then 1 else 0 end as rejections
        from s left join r on r.candidate_id = s.id and r.analysis_run_id = s.analysis_run_id where s.analysis_run_id is not null""",
    "replaced_finals": f"""with fs as ({signal_queries.SQL["final_selection"]}), rr as (select * from importance_results qualify row_number() over (partition by analysis_run_id, candidate_id order by scored_at desc) = 1),
        fr as (select fs.analysis_run_id, fs.signal_id, 'fresh' as origin from fs join analysis_runs a on a.id = fs.analysis_run_id and a.status = 'completed')
        select analysis_run_id, candidate_id as signal_id, 'stored' as origin from rr where relative_rank = 1 and analysis_run_id not in (select analysis_run_id from fr) union all select * from fr""",
    "after_deletion": " union all ".join(
        f"select '{n}' as table_name, transcript_id, count(*) as n from {n} where transcript_id not in (select id from transcripts where status = '{PENDING}') group by all"
        for n in ("transcript_turns", "candidate_signals", "analysis_runs", "participants")
    ),
    "supporting_rows": f"""with {_ELECT} select a.id as signal_id, cast(row_number() over (partition by a.id order by b.id) - 1 as int) as place, b.advisor_quote as quote, b.timestamp from g a join g b on a.transcript_id = b.transcript_id
        and a.duplicate_group_id = b.duplicate_group_id and a.analysis_run_id is not distinct from b.analysis_run_id and a.id <> b.id where a.id = a.canon and b.id <> b.canon""",
    "supporting_evidence": f"with {_ELECT}, {_SUPPORT} select signal_id, cast(len(q) as int) as n, array_to_string(q, '|') as quotes from m",
    "export_rows": f"""with {_ELECT}, {_SUPPORT}, {_LATEST} select g.id as signal_id, g.transcript_id, g.item_type, g.category, case when not isnan(g.extraction_confidence) then printf('%.2f', g.extraction_confidence) end as business_score,
        coalesce(m.q[1], '') as supporting_quote_1, coalesce(m.ts[1], '') as supporting_timestamp_1 from g left join lr using (transcript_id) left join m on m.signal_id = g.id
        where g.id = g.canon and ((run_id is not null and g.analysis_run_id = run_id) or (run_id is null and g.analysis_run_id is null))""",
    "export_evidence": f"""with {_ELECT}, {_LATEST}, m as (select a.id as signal_id, to_json(list(struct_pack(quote := b.advisor_quote, timestamp := b.timestamp, relationship := 'supporting_reason') order by b.id))::varchar as cell
        from g a join g b on a.transcript_id = b.transcript_id and a.duplicate_group_id = b.duplicate_group_id and a.analysis_run_id is not distinct from b.analysis_run_id and a.id <> b.id
        where a.id = a.canon and b.id <> b.canon group by all)
        select g.id as signal_id, coalesce(cell, '[]') as supporting_evidence from g left join lr using (transcript_id) left join m on m.signal_id = g.id
        where g.id = g.canon and ((run_id is not null and g.analysis_run_id = run_id) or (run_id is null and g.analysis_run_id is null))""",
    "export_lines": f"""with {_ELECT} select id, '{{"transcript_id":' || transcript_id || ',"item_type":"' || item_type || '","category":' || coalesce(to_json(category)::varchar, 'null') || ',"timestamp":' || coalesce(to_json(timestamp)::varchar, 'null') || '}}' as line from g where id = canon""",
    "stage_usage": f"with {_CALLS} select run, stage, {_USE}, round(greatest(0, sum(value)), 2) as value from c group by all",
    "usage_totals": f"with {_CALLS}, u as (select stage, {_USE} from c group by all) select cast(sum(call_count) as bigint) as call_count, cast(sum(tokens) as bigint) as tokens, cast(sum(cached) as bigint) as cached, cast(case when count(cost) = count(*) then sum(cost) end as bigint) as cost from u",
    "progress_states": f"with {_CALLS} select run, stage, event_id from c qualify row_number() over (partition by run order by ts desc, stage desc, event_id desc) = 1",
    "signal_summaries": f"""with {R}, x as (select * from r where structured_score is not null and not isnan(structured_score))
        select transcript_id, count(*) filter (item_type = 'driver') as drivers, count(*) filter (item_type = 'blocker') as blockers,
        first(candidate_id order by structured_score desc, candidate_id) filter (validation_verdict = 'pass') as strongest from x group by all""",
    "diagnostics_listing": f"""with {R} select analysis_run_id, candidate_id, case when not isnan(business_score) then business_score end as business_score,
        coalesce(validation_verdict = 'reject', false) as rejected, coalesce(validation_verdict = 'needs_review', false) as in_review from r where item_type = 'blocker'""",
}

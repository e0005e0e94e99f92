"""Queries over the life of runs, exports of finals, telemetry records, and evaluation reports."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions.text import strip
from ..operators import dedup, evidence, export, metrics, reports, rules, runs, sequence, telemetry
from ..operators.skew import join_unique
from ..session import Scratch, table
from . import metric_queries, providers, run_queries, signal_queries, stage_queries
from .base import R, S, results, signals
from .signal_queries import _ELECT, _hard, _rank_order, _soft
from .stage_queries import _BAD1, _JV, _SOFT1

CONFIG = {"keep_per_type": 3, "least_score": 3.5, "merge_threshold": 0.86}

# runs


def created_runs(spark, base):
    """A new run for every transcript, with the hash of its text and the configuration."""
    return runs.created(table(spark, base, "transcripts"), F.concat(F.lit("run-"), F.col("id").cast("string")), F.col("updated_at"), CONFIG)


def ended_runs(spark, base):
    """The stored runs told again as events: all start, some complete or fail; the last event of each stands."""
    r = table(spark, base, "analysis_runs")
    none = F.lit(None).cast("string")
    started = r.select(F.col("id").alias("run_id"), F.col("started_at").alias("at"), F.lit("running").alias("status"), none.alias("failed_stage"), none.alias("error"))
    over = r.filter("status <> 'running'").select(
        F.col("id").alias("run_id"), F.coalesce("completed_at", F.col("started_at") + F.expr("interval 1 hour")).alias("at"), "status",
        F.when(F.col("status") == "failed", "validate").alias("failed_stage"), F.when(F.col("status") == "failed", "provider_error").alias("error"),
    )
    out = runs.ended(r.withColumn("status", F.lit("running")).drop("completed_at"), started.unionByName(over))
    return out.select("id", "transcript_id", "status", "completed_at", "failed_stage", "error")


def validation_snapshots(spark, base):
    """Verdicts with their reason lists for the candidates of runs that have no stored verdict yet."""
    s = rules.judged(signals(spark, base).filter("analysis_run_id is not null"), (), _hard(), _soft())
    have = results(spark, base).filter("validation_verdict is not null").select("analysis_run_id", F.col("candidate_id").alias("id"))
    fresh = s.select("analysis_run_id", "id", "verdict", F.array_join("hard", ",").alias("rejection_reasons"), F.array_join("soft", ",").alias("review_reasons"), F.col("reason").alias("primary_reason"))
    return runs.insert_absent(have, fresh, ["analysis_run_id", "id"])


def replayed_verdicts(spark, base):
    """Every replay: whether its source can be replayed, and the verdicts of the source's candidates judged anew."""
    r = table(spark, base, "analysis_runs")
    p = r.filter("run_type = 'replay'").select(F.col("id").alias("replay_id"), "source_run_id")
    p = p.join(r.select(F.col("id").alias("source_run_id"), (F.col("status") == "completed").alias("done")), "source_run_id", "left")
    judged = rules.judged(signals(spark, base), (), _hard(), _soft()).select(F.col("analysis_run_id").alias("source_run_id"), "verdict")
    rows = p.join(judged, "source_run_id", "left")
    can = F.coalesce("done", F.lit(False))
    counts = [F.count_if(can & (F.col("verdict") == v)).alias(v) for v in ("pass", "needs_review", "reject")]
    return rows.groupBy("replay_id", "source_run_id").agg(F.when(F.bool_or(can), "replayed").otherwise("not_replayable").alias("outcome"), *counts)


def extraction_batches(spark, base):
    """The batches of every run in order, with what came of them."""
    b = stage_queries.batch_counters(spark, base).filter("analysis_run_id is not null")
    return sequence.numbered(b, ["analysis_run_id"], [F.col("batch")], "place").select("analysis_run_id", "place", "batch", "parsed", "accepted")


def run_candidates(spark, base):
    """The candidates of every run in order of their ids."""
    s = signals(spark, base).filter("analysis_run_id is not null").select("analysis_run_id", "id", "item_type", strip(F.col("advisor_quote")).alias("quote"))
    return sequence.numbered(s, ["analysis_run_id"], [F.col("id")], "place")


def historical_finals(spark, base):
    """What every run selected, blockers first, with the score if there is one."""
    f = signal_queries.final_selection(spark, base)
    s = signals(spark, base).select(F.col("id").alias("signal_id"), "category", F.size(F.coalesce("source_turn_ids", F.array().cast("array<bigint>"))).alias("sources"))
    rows = f.join(s, "signal_id")
    return sequence.numbered(rows, ["analysis_run_id"], [F.col("item_type"), F.col("rank"), F.col("signal_id")], "place").select("analysis_run_id", "place", "item_type", "rank", "signal_id", "category", "sources", "final_score")


def migrated_signals(spark, base):
    """An additive change of schema: columns that are there stay, those that lack are null."""
    s = runs.with_schema(signals(spark, base), {"category": "string", "embedding_model": "string", "embedding_size": "int"})
    return s.select("id", "category", "embedding_model", "embedding_size")


# exports

LEAST = stage_queries.LEAST


def _final_rows(spark, base):
    """Finals of the visible runs that stand for their group, with their reason worked out again."""
    f = signal_queries.final_selection(spark, base).drop("item_type", "selection_reason")
    e = dedup.elect(signals(spark, base).withColumn("grp", F.coalesce("duplicate_group_id", F.concat(F.lit("alone-"), F.col("id").cast("string")))), "grp", signal_queries._order())
    r = results(spark, base).select(F.col("candidate_id").alias("signal_id"), F.col("analysis_run_id"), "validation_verdict", "support_score", "mention_count")
    rows = f.join(e.filter("is_canonical").withColumnRenamed("id", "signal_id"), ["signal_id", "analysis_run_id"]).join(r, ["signal_id", "analysis_run_id"])
    rows = runs.visible(rows, runs.latest_run(table(spark, base, "analysis_runs"), completed_only=True))
    strong = F.lower(F.trim("evidence_strength")) == "explicit"
    enough = F.col("final_score") >= F.when(F.coalesce(strong, F.lit(False)), LEAST["explicit"]).otherwise(LEAST["implied"])
    return rows.withColumn("selection_reason", F.when(enough, "above_threshold").otherwise("best_grounded_fallback"))


_PUBLIC = ("transcript_id", "analysis_run_id", "signal_id", "item_type", "rank", "category", "factor_kind", "decision_direction", "advisor_quote", "rationale", "timestamp", "evidence_strength", "final_score", "selection_reason")


def final_rows(spark, base):
    """The rows of an export of all transcripts, in their order, scores with two places."""
    rows = _final_rows(spark, base)
    order = [F.col("transcript_id"), F.when(F.col("item_type") == "driver", 0).when(F.col("item_type") == "blocker", 1).otherwise(2), F.col("rank"), F.col("signal_id")]
    placed = sequence.listed(rows.select(*_PUBLIC).withColumn("export_version", F.lit("1.0")), order)
    return export.csv_cells(placed, ("final_score",))


def debug_rows(spark, base):
    """An exported row with what explains it: group, members, verdict, support, mentions, sources, confidence, run."""
    rows = _final_rows(spark, base)
    support = F.nanvl("support_score", F.lit(None).cast("double"))
    return rows.select(
        "signal_id", "analysis_run_id", "selection_reason", F.coalesce("duplicate_group_id", F.lit("")).alias("duplicate_group_id"), F.col("members").alias("group_size"), "validation_verdict",
        support.alias("support_score"), "mention_count", F.size(F.coalesce("source_turn_ids", F.array().cast("array<bigint>"))).alias("sources"), F.nanvl("extraction_confidence", F.lit(None).cast("double")).alias("extraction_confidence"),
        F.when(F.col("created_at").isNotNull(), F.unix_micros("created_at")).alias("created_us"), F.length("advisor_quote").alias("quote_length"),
    )


def latest_finals(spark, base):
    """Finals of the latest run of each transcript, completed or not, and the other members of their groups as a count."""
    latest = runs.latest_run(table(spark, base, "analysis_runs"))
    f = signal_queries.final_selection(spark, base)
    s = signals(spark, base).select(F.col("id").alias("signal_id"), "transcript_id", "duplicate_group_id")
    sizes = signals(spark, base).filter("duplicate_group_id is not null").groupBy("duplicate_group_id").agg(F.count(F.lit(1)).alias("k"))
    rows = join_unique(f.join(s, "signal_id"), latest, "transcript_id", "left").filter("run_id is null or analysis_run_id = run_id").join(sizes, "duplicate_group_id", "left")
    rows = rows.select("transcript_id", "item_type", "rank", "signal_id", (F.coalesce("k", F.lit(1)) - 1).alias("supporting"))
    return sequence.numbered(rows, ["transcript_id"], [F.col("item_type"), F.col("rank"), F.col("signal_id")], "place")


# telemetry


def call_records(spark, base):
    """The events read as model calls: counts out of their JSON, the rest made safe."""
    e = table(spark, base, "events").select(
        F.col("event_id").alias("call_id"), F.col("event_type").alias("stage"), "props", F.col("value").alias("duration_ms"), (F.col("user_id") % 4 - 1).cast("int").alias("retry_count"), (F.col("event_type") != "error").alias("success")
    )
    return telemetry.call_records(e, "props", {"input_tokens": "$.k", "output_tokens": "$.out"})


def progress_transitions(spark, base):
    e = table(spark, base, "events").select(F.col("user_id").alias("run"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("stage"), "event_id")
    return telemetry.transitions(e, "run", "ts", "stage", "event_id")


def run_manifests(spark, base):
    """One JSON object per run: its stages in alphabetical order with calls, tokens and cost."""
    u = run_queries.stage_usage(spark, base)
    stages = F.array_sort(F.collect_list(F.struct("stage", "call_count", "tokens", "cost")))
    return u.groupBy("run").agg(F.sum("call_count").alias("calls"), F.to_json(stages, {"ignoreNullFields": "false"}).alias("stages"))


EXPECTED = {
    "transcripts": ("id", "file_name", "status", "raw_text", "summary"), "candidate_signals": ("id", "transcript_id", "embedding"), "analysis_runs": ("id", "status", "config_snapshot"),
}


def schema_report(spark, base):
    """Expected columns that the tables lack."""
    lacking = [(t, c) for t, columns in EXPECTED.items() for c in columns if c not in table(spark, base, t).columns]
    return spark.createDataFrame(lacking, "table_name string, missing_column string")


def redacted_addresses(spark, base):
    n = table(spark, base, "nation")
    url = F.concat(F.lit("db://"), F.lower("n_name"), F.lit(":"), F.col("n_nationkey").cast("string"), F.lit("@host/"), F.lower("n_name"))
    return n.select("n_nationkey", telemetry.redacted(url).alias("address"))


def score_faults(spark, base):
    """Compared pairs with the score of the second model and what is wrong with it."""
    p = table(spark, base, "pair_diagnostics").filter("left_id is not null and right_id is not null and left_id <> right_id").dropDuplicates()
    p = p.select(F.least("left_id", "right_id").alias("a"), F.greatest("left_id", "right_id").alias("b"), F.col("cross_encoder_score").alias("score"))
    return providers.checked_scores(p, p.filter("score is not null"))


def diagnostics_order(spark, base):
    """The candidates of every run and direction by falling score, unknown ones last, with the overlapping subsets of the list."""
    r = results(spark, base)
    g = signals(spark, base).select(F.col("id").alias("candidate_id"), F.col("duplicate_group_id").isNotNull().alias("in_group"))
    score = F.nanvl("business_score", F.lit(None).cast("double"))
    rows = r.select("analysis_run_id", "item_type", "candidate_id", score.alias("score"), "validation_verdict").join(g, "candidate_id", "left")
    rows = rows.withColumn("in_group", F.coalesce("in_group", F.lit(False)))
    is_ = lambda v: F.coalesce(F.col("validation_verdict") == v, F.lit(False))
    rows = sequence.numbered(rows, ["analysis_run_id", "item_type"], [F.desc_nulls_last("score"), F.col("candidate_id")], "place")
    return rows.select("analysis_run_id", "item_type", "place", "candidate_id", is_("reject").alias("rejected"), is_("needs_review").alias("in_review"), F.col("in_group").alias("duplicate"))


# evaluation


def oracle_report(spark, base):
    """Verdicts derived from findings against the stored ones: the confusion of the two."""
    j = stage_queries._judged(spark, base).filter("validation_verdict is not null")
    return metrics.confusion(j.select(F.col("validation_verdict").alias("actual"), F.col("verdict").alias("guess")), "actual", "guess", [])


def rank_macro(spark, base):
    """Mean reciprocal rank and hits over runs, each counting the same, of candidates ranked by both; runs of one candidate are left out."""
    q = metrics.ranking_quality(metric_queries._ranked(spark, base), ["run"], "expert", "guess")
    sizes = results(spark, base).groupBy(F.col("analysis_run_id").alias("run")).agg(F.count(F.lit(1)).alias("n"))
    q = q.join(sizes.filter("n > 1"), "run")
    return q.agg(F.count(F.lit(1)).alias("runs"), *[F.round(F.avg(c), 9).alias(c) for c in ("ndcg", "mrr", "top1", "top3")])


def baseline_orders(spark, base):
    """The rank of every candidate under each plain ordering, and under one shuffled by a salted hash."""
    number = lambda c: F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0))
    r = results(spark, base)
    order = {
        "business_score": F.desc("b"), "mention_frequency": F.desc("mention_count"), "validation_support": F.desc("s"), "candidate_order": F.asc("candidate_id"),
        "structured_score": F.desc("t"), "direct_model_score": F.desc("d"), "shuffled": F.asc("h"),
    }
    r = r.select("analysis_run_id", "candidate_id", "mention_count", number("business_score").alias("b"), number("support_score").alias("s"), number("structured_score").alias("t"), number("direct_model_score").alias("d"),
                 F.sha2(F.concat(F.lit("17:"), F.col("candidate_id").cast("string")), 256).alias("h"))
    out = None
    for name, by in order.items():
        one = sequence.numbered(r, ["analysis_run_id"], [by, F.col("candidate_id")], "rank").select(F.lit(name).alias("ordering"), "analysis_run_id", "candidate_id", (F.col("rank") + 1).alias("rank"))
        out = one if out is None else out.unionByName(one)
    return out


def id_faults(spark, base):
    """Per run the candidates its results leave out and the ids they make up."""
    want = signals(spark, base).filter("analysis_run_id is not null").select("analysis_run_id", F.col("id").alias("candidate_id"))
    got = results(spark, base).select("analysis_run_id", "candidate_id")
    key = ["analysis_run_id", "candidate_id"]
    omitted = want.join(got, key, "left_anti").groupBy("analysis_run_id").agg(F.count(F.lit(1)).alias("omitted"))
    invented = got.join(want, key, "left_anti").groupBy("analysis_run_id").agg(F.count(F.lit(1)).alias("invented"))
    return omitted.join(invented, "analysis_run_id", "full").na.fill(0)


def saved_report(spark, base):
    """A report written as JSON and read again."""
    report = metric_queries.tier_report(spark, base)
    path = Scratch(spark, "report").path("tier_report")
    reports.write_report(report, path)
    return reports.read_report(spark, path, report.schema)


def report_lines(spark, base):
    """A report as Markdown."""
    return reports.markdown(run_queries.latest_completed_runs(spark, base), "Latest runs")


QUERIES = {f.__name__: f for f in (
    created_runs, ended_runs, validation_snapshots, replayed_verdicts, extraction_batches, run_candidates, historical_finals, migrated_signals, final_rows, debug_rows, latest_finals, call_records,
    progress_transitions, run_manifests, schema_report, redacted_addresses, score_faults, diagnostics_order, oracle_report, rank_macro, baseline_orders, id_faults, saved_report, report_lines,
)}

_FS = f"fs as ({signal_queries.SQL['final_selection']})"
_FINAL = f"""{_FS}, {run_queries._LATEST}, {S}, {R}, el as (select *, first_value(id) over w as canon, count(*) over (partition by coalesce(duplicate_group_id, 'alone-' || id)) as members from s
        window w as (partition by coalesce(duplicate_group_id, 'alone-' || id) order by {signal_queries._ORDER})),
    fr as (select el.*, fs.rank, fs.final_score, fs.signal_id, r.validation_verdict, r.support_score, r.mention_count,
        case when fs.final_score >= case when coalesce(lower(trim(evidence_strength)) = 'explicit', false) then 3.5 else 4.0 end then 'above_threshold' else 'best_grounded_fallback' end as why
        from fs join el on el.id = fs.signal_id and el.analysis_run_id = fs.analysis_run_id and el.id = el.canon
        join (select candidate_id, analysis_run_id as run, validation_verdict, support_score, mention_count from r) r on r.candidate_id = el.id and r.run = el.analysis_run_id
        left join lr on lr.transcript_id = el.transcript_id where (lr.run_id is not null and el.analysis_run_id = lr.run_id) or (lr.run_id is null and el.analysis_run_id is null))"""
_BASE_ORDERS = {
    "business_score": "coalesce(case when not isnan(business_score) then business_score else 0 end, 0) desc", "mention_frequency": "mention_count desc",
    "validation_support": "coalesce(case when not isnan(support_score) then support_score else 0 end, 0) desc", "candidate_order": "candidate_id",
    "structured_score": "coalesce(case when not isnan(structured_score) then structured_score else 0 end, 0) desc",
    "direct_model_score": "coalesce(case when not isnan(direct_model_score) then direct_model_score else 0 end, 0) desc", "shuffled": "sha256('17:' || candidate_id)",
}

SQL = {
    "created_runs": f"""select 'run-' || id as id, id as transcript_id, 'running' as status, 'full' as run_type, cast(null as varchar) as source_run_id, updated_at as started_at, sha256(raw_text) as input_sha256,
        '{json.dumps(CONFIG, sort_keys=True)}' as config from transcripts""",
    "ended_runs": """select id, transcript_id, status, case when status = 'running' then started_at else coalesce(completed_at, started_at + interval 1 hour) end as completed_at,
        case when status = 'failed' then 'validate' end as failed_stage, case when status = 'failed' then 'provider_error' end as error from analysis_runs""",
    "validation_snapshots": f"""with {S}, {R}, x as (select *, [x for x in [case when item_type = 'no_signal' then 'no_signal' end,
            case when coalesce(trim(rationale), '') = '' or coalesce(len(source_turn_ids) <> len(list_distinct(source_turn_ids)), false) then 'malformed_candidate' end,
            case when isnan(extraction_confidence) or not extraction_confidence between 0 and 1 then 'invalid_confidence' end] if x is not null] as hard,
            [x for x in [case when coalesce(trim(category), '') = '' then 'missing_category' end, case when source_turn_ids is null then 'no_source_turn' end, case when extraction_confidence < 0.5 then 'weak_evidence' end] if x is not null] as soft
            from s where analysis_run_id is not null)
        select analysis_run_id, id, case when len(hard) > 0 then 'reject' when len(soft) > 0 then 'needs_review' else 'pass' end as verdict, array_to_string(hard, ',') as rejection_reasons, array_to_string(soft, ',') as review_reasons,
        case when len(hard) > 0 then hard[1] else soft[1] end as primary_reason from x where not exists (select 1 from r where r.analysis_run_id = x.analysis_run_id and r.candidate_id = x.id and r.validation_verdict is not null)""",
    "replayed_verdicts": f"""with {S}, v as (select analysis_run_id, case when {_BAD1} is not null then 'reject' when {_SOFT1} is not null then 'needs_review' else 'pass' end as verdict from s),
        p as (select a.id as replay_id, a.source_run_id, coalesce(o.status = 'completed', false) as can from analysis_runs a left join analysis_runs o on o.id = a.source_run_id where a.run_type = 'replay')
        select replay_id, source_run_id, case when bool_or(can) then 'replayed' else 'not_replayable' end as outcome, count(*) filter (can and verdict = 'pass') as pass, count(*) filter (can and verdict = 'needs_review') as needs_review,
        count(*) filter (can and verdict = 'reject') as reject from p left join v on v.analysis_run_id = p.source_run_id group by all""",
    "extraction_batches": f"""with b as ({stage_queries.SQL['batch_counters']}) select analysis_run_id, cast(row_number() over (partition by analysis_run_id order by batch) - 1 as int) as place, batch, parsed, accepted from b where analysis_run_id is not null""",
    "run_candidates": f"""with {S} select analysis_run_id, id, item_type, regexp_replace(advisor_quote, '^\\s+|\\s+$', '', 'g') as quote, cast(row_number() over (partition by analysis_run_id order by id) - 1 as int) as place from s where analysis_run_id is not null""",
    "historical_finals": f"""with {_FS}, {S} select fs.analysis_run_id, cast(row_number() over (partition by fs.analysis_run_id order by fs.item_type, rank, signal_id) - 1 as int) as place, fs.item_type, rank, signal_id, category,
        cast(coalesce(len(source_turn_ids), 0) as int) as sources, final_score from fs join s on s.id = fs.signal_id""",
    "migrated_signals": f"with {S} select id, category, cast(null as varchar) as embedding_model, cast(null as int) as embedding_size from s",
    "final_rows": f"""with {_FINAL} select cast(row_number() over (order by transcript_id, case item_type when 'driver' then 0 when 'blocker' then 1 else 2 end, rank, signal_id) - 1 as int) as place, transcript_id, analysis_run_id, signal_id, item_type, rank,
        category, factor_kind, decision_direction, advisor_quote, rationale, timestamp, evidence_strength, printf('%.2f', final_score) as final_score, why as selection_reason, '1.0' as export_version from fr""",
    "debug_rows": f"""with {_FINAL} select signal_id, analysis_run_id, why as selection_reason, coalesce(duplicate_group_id, '') as duplicate_group_id, members as group_size, validation_verdict,
        case when not isnan(support_score) then support_score end as support_score, mention_count, cast(coalesce(len(source_turn_ids), 0) as int) as sources,
        case when not isnan(extraction_confidence) then extraction_confidence end as extraction_confidence, epoch_us(created_at) as created_us, cast(length(advisor_quote) as int) as quote_length from fr""",
    "latest_finals": f"""with {_FS}, {S}, ll as (select transcript_id, arg_max(id, struct_pack(a := started_at, b := id)) as run_id from analysis_runs group by all),
        sz as (select duplicate_group_id, count(*) as k from s where duplicate_group_id is not null group by all)
        select s.transcript_id, fs.item_type, rank, signal_id, coalesce(k, 1) - 1 as supporting, cast(row_number() over (partition by s.transcript_id order by fs.item_type, rank, signal_id) - 1 as int) as place
        from fs join s on s.id = fs.signal_id left join ll on ll.transcript_id = s.transcript_id left join sz on sz.duplicate_group_id = s.duplicate_group_id where ll.run_id is null or fs.analysis_run_id = ll.run_id""",
    "call_records": """select event_id as call_id, coalesce(nullif(trim(event_type), ''), 'unknown') as stage, try_cast(json_extract_string(props, '$.k') as bigint) as input_tokens,
        try_cast(json_extract_string(props, '$.out') as bigint) as output_tokens, round(greatest(0.0, coalesce(case when not isnan(value) then value else 0 end, 0)), 2) as duration_ms, cast(greatest(0, user_id % 4 - 1) as int) as retry_count,
        coalesce(event_type <> 'error', false) as success from events""",
    "progress_transitions": """select user_id as run, event_id, coalesce(lag(event_type) over w, 'idle') as before, event_type as after, round((epoch_us(ts) - epoch_us(lag(ts) over w)) / 1e6, 2) as seconds
        from events window w as (partition by user_id order by ts, event_id)""",
    "run_manifests": f"""with u as ({run_queries.SQL['stage_usage']}) select run, cast(sum(call_count) as bigint) as calls,
        to_json(list(struct_pack(stage := stage, call_count := call_count, tokens := tokens, cost := cost) order by stage))::varchar as stages from u group by run""",
    "schema_report": "select t as table_name, c as missing_column from (" + " union all ".join(f"select '{t}' as t, '{c}' as c" for t, cs in EXPECTED.items() for c in cs)
        + ") e where not exists (select 1 from information_schema.columns i where i.table_name = e.t and i.column_name = e.c)",
    "redacted_addresses": "select n_nationkey, 'db://***@host/' || lower(n_name) as address from nation",
    "score_faults": """with p as (select least(left_id, right_id) as a, greatest(left_id, right_id) as b, cross_encoder_score as s from (select distinct * from pair_diagnostics) where left_id <> right_id)
        select a, b, case when count(s) = 1 and bool_and(s between 0 and 1 and not isnan(s)) then min(s) end as score,
            case when count(s) = 0 then 'missing' when count(s) > 1 then 'repeated' when bool_or(isnan(s) or isinf(s)) then 'not_finite' when not bool_and(s between 0 and 1) then 'out_of_range' end as fault from p group by all""",
    "diagnostics_order": f"""with {R}, {S}, x as (select analysis_run_id, item_type, candidate_id, case when not isnan(business_score) then business_score end as score, validation_verdict,
            coalesce((select duplicate_group_id is not null from s where s.id = r.candidate_id), false) as dup from r)
        select analysis_run_id, item_type, cast(row_number() over (partition by analysis_run_id, item_type order by score desc nulls last, candidate_id) - 1 as int) as place, candidate_id,
        coalesce(validation_verdict = 'reject', false) as rejected, coalesce(validation_verdict = 'needs_review', false) as in_review, dup as duplicate from x""",
    "oracle_report": f"with {_JV} select validation_verdict as actual, verdict as guess, count(*) as n from jv where validation_verdict is not null group by all",
    "rank_macro": f"""with {metric_queries._RANKED}, g as (select run, count(*) as n, sum((power(2.0::double, -expert) - power(2.0::double, -(m + 1))) / log2(guess + 1)) as dcg,
            sum((power(2.0::double, -expert) - power(2.0::double, -(m + 1))) / log2(expert + 1)) as ideal, min(guess) filter (expert = 1) as first from (select run, expert, guess, count(*) over (partition by run) as m from k) group by run having count(*) > 1)
        select count(*) as runs, round(avg(dcg / ideal), 9) as ndcg, round(avg(1 / first), 9) as mrr, round(avg(case when first = 1 then 1.0 else 0.0 end), 9) as top1, round(avg(case when first <= 3 then 1.0 else 0.0 end), 9) as top3 from g""",
    "baseline_orders": f"with {R} " + " union all ".join(
        f"select '{n}' as ordering, analysis_run_id, candidate_id, cast(row_number() over (partition by analysis_run_id order by {o}, candidate_id) as int) as rank from r" for n, o in _BASE_ORDERS.items()),
    "id_faults": f"""with {S}, {R}, w as (select analysis_run_id, id as candidate_id from s where analysis_run_id is not null), g as (select analysis_run_id, candidate_id from r),
        o as (select analysis_run_id, count(*) as omitted from (select * from w except select * from g) group by all), i as (select analysis_run_id, count(*) as invented from (select * from g except select * from w) group by all)
        select coalesce(o.analysis_run_id, i.analysis_run_id) as analysis_run_id, coalesce(omitted, 0) as omitted, coalesce(invented, 0) as invented from o full join i on o.analysis_run_id = i.analysis_run_id""",
    "saved_report": metric_queries.SQL["tier_report"],
    "report_lines": f"""with x as ({run_queries.SQL['latest_completed_runs']}), l as (select '| ' || transcript_id || ' | ' || run_id || ' |' as line from x)
        select n, line from (values (0, '# Latest runs'), (1, ''), (2, '| transcript_id | run_id |'), (3, '|---|---|')) v(n, line) union all select row_number() over (order by line) + 3, line from l""",
}

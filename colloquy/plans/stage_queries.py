"""Queries over the single stages: sources, roles, resolution, verdicts, election, ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dedup, evidence, ranking, rules, segmentation, sequence, views
from ..operators import importance as imp
from ..operators.skew import join_unique
from ..session import table
from ..sources import files
from . import signal_queries, turn_queries
from .base import R, S, T, results, signals, turns
from .signal_queries import _RANK, _hard, _rank_order, _soft
from .turn_queries import _CITED, _CUT, _WINDOW, _real_and_cut

# sources and listings


def transcript_listing(spark, base):
    """All transcripts, the newest first."""
    t = table(spark, base, "transcripts").select("id", "file_name", "status", "created_at")
    return sequence.listed(t, [F.desc("created_at"), F.desc("id")]).select("place", "id", "file_name", "status")


def turn_listing(spark, base):
    """The turns of every transcript in order."""
    return turns(spark, base).select("transcript_id", "pos", "id", "timestamp", "raw_speaker_label", "inferred_role", "text")


def keyed_lookup(spark, base):
    """The signals on the left of a proposed pair, by key; null where a key is nobody's."""
    keys = table(spark, base, "pair_diagnostics").filter("proposed_duplicate and left_id is not null").select(F.col("left_id").alias("id")).distinct()
    return keys.join(signals(spark, base).select("id", "item_type", F.lit(True).alias("there")), "id", "left")


def sorted_listing(spark, base):
    """The place of every transcript under each of the five sort modes."""
    t = table(spark, base, "transcripts").withColumn("sort_key", views.natural_key("file_name"))
    modes = {
        "newest": [F.desc("created_at"), F.desc("id")], "oldest": [F.asc("created_at"), F.asc("id")], "file_name": [F.asc("sort_key"), F.asc("id")],
        "file_name_desc": [F.desc("sort_key"), F.desc("id")], "status": [F.asc("status"), F.desc("created_at"), F.desc("id")],
    }
    out = None
    for mode, order in modes.items():
        one = sequence.listed(t.select("id", "file_name", "sort_key", "status", "created_at"), order).select(F.lit(mode).alias("mode"), "place", "id")
        out = one if out is None else out.unionByName(one)
    return out


def found_transcripts(spark, base):
    """A search in file names together with a filter of the status."""
    return views.search(table(spark, base, "transcripts"), "file_name", " CALL ").filter(F.col("status").isin("finalized", "parsed")).select("id", "file_name", "status")


def highlights(spark, base):
    """Where a quote begins in the turn it cites; 0 where it is not there."""
    c = evidence.cited_turns(_real_and_cut(spark, base, turns(spark, base)), turns(spark, base))
    return c.select("id", "cited_id", views.highlight(F.col("t_text"), F.col("advisor_quote")).alias("place"))


def import_outcomes(spark, base):
    """What an import limited to the first hundred names would do beside those already there: the limit, a feature of the import, comes before the skipping."""
    t = table(spark, base, "transcripts")
    blank = ~F.coalesce(F.col("raw_text").rlike(r"\S"), F.lit(False))
    files_ = t.select("file_name", F.when(blank, "empty").alias("reason")).dropDuplicates(["file_name"])
    done = files_.join(t.filter("status = 'finalized'").select("file_name").distinct(), "file_name", "left_semi")
    return files.import_files(files_, done, limit=100).select("place", "file_name", "outcome")


def parsed_turns(spark, base):
    """Turns of every transcript by the layout of its text."""
    return segmentation.parsed(table(spark, base, "transcripts"))


def reused_turns(spark, base):
    """How many turns each transcript has, and whether they were stored or have to be parsed."""
    stored = table(spark, base, "transcript_turns").dropDuplicates(["id"])
    t = segmentation.parse_or_reuse(table(spark, base, "transcripts"), stored)
    return t.groupBy("doc_id", "origin").agg(F.count(F.lit(1)).alias("turns"))


def rerun_tables(spark, base):
    """Rows that stay when the transcripts that were scored are extracted again without a run: rows of no run go, with what depends on them."""
    again = table(spark, base, "transcripts").filter("status = 'signals_scored'").select(F.col("id").alias("transcript_id"))
    s = signals(spark, base).select("id", "transcript_id", "analysis_run_id")
    gone = s.filter("analysis_run_id is null").join(again, "transcript_id", "left_semi")
    kept = s.join(gone.select("id"), "id", "left_anti")
    pairs = table(spark, base, "pair_diagnostics").select("transcript_id", "left_id", "right_id")
    for side in ("left_id", "right_id"):
        pairs = pairs.join(gone.select(F.col("id").alias(side)), side, "left_anti")
    count = lambda df, name: df.groupBy("transcript_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "transcript_id", "n")
    return count(kept, "candidate_signals").unionByName(count(pairs, "pair_diagnostics"))


# roles


def _role_answers(spark, base):
    """Answers about turns as stored, then a second opinion about every unsure one, whose last item stands."""
    t = sequence.batched(turns(spark, base), "pos", 40)
    first = t.select("transcript_id", "batch", F.lit(1).alias("item"), F.col("id").alias("turn_id"), F.col("inferred_role").alias("role"), F.col("role_confidence").alias("confidence"))
    again = first.filter("confidence < 0.7").select("transcript_id", "batch", F.lit(2).alias("item"), "turn_id", F.lit("mixed").alias("role"), "confidence")
    return t, first.unionByName(again)


def overlaid_roles(spark, base):
    t, answers = _role_answers(spark, base)
    return evidence.overlaid_roles(t.select("id", "batch"), answers.drop("transcript_id"))


def role_snapshots(spark, base):
    """The roles of a transcript's turns once per run of it, as they were for the run."""
    runs_ = table(spark, base, "analysis_runs").groupBy("transcript_id").agg(F.array_sort(F.collect_set("id")).alias("runs"))
    t = join_unique(table(spark, base, "transcript_turns").dropDuplicates(["id"]).select("transcript_id", "id", "inferred_role", "role_confidence"), runs_, "transcript_id")
    return t.select(F.explode("runs").alias("analysis_run_id"), F.col("id").alias("turn_id"), F.coalesce("inferred_role", F.lit("unknown")).alias("role"), F.coalesce("role_confidence", F.lit(0.0)).alias("confidence"))


# extraction and validation


def quote_resolution(spark, base):
    t = turns(spark, base)
    return evidence.resolution(_real_and_cut(spark, base, t), t)


def context_payloads(spark, base):
    """The context turns of a signal as one JSON list of turn, speaker, text and time."""
    t = turns(spark, base)
    w = evidence.context_window(signals(spark, base), t, need_quote=False)
    w = w.join(t.select(F.col("id").alias("turn_id"), F.col("raw_speaker_label").alias("speaker"), "text", "timestamp"), "turn_id")
    packed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "turn_id", "speaker", "text", "timestamp"))), lambda x: F.struct(x["turn_id"].alias("turn_id"), x["speaker"].alias("speaker"), x["text"].alias("text"), x["timestamp"].alias("timestamp")))
    return w.groupBy("id").agg(F.to_json(packed, {"ignoreNullFields": "false"}).alias("context"))


def _extracted(spark, base):
    """Signals in batches of 60 per run, each with the first reason against it."""
    s = sequence.batched(sequence.numbered(signals(spark, base), ["transcript_id", "analysis_run_id"], [F.col("id")]), "pos", 60)
    s = s.withColumn("reason", rules.first_reason(_hard()))
    key = [F.col("analysis_run_id"), F.col("item_type"), F.lower(F.trim("category")), F.trim("advisor_quote")]
    # only items that would be taken otherwise are first of their key
    fine = evidence.repeat_reasons(s.filter("reason is null"), key, ["batch", "id"], "batch")
    return fine.withColumn("reason", F.col("repeat_reason")).drop("repeat_reason").unionByName(s.filter("reason is not null"))


def extraction_reasons(spark, base):
    return _extracted(spark, base).select("id", "batch", F.coalesce("reason", F.lit("accepted")).alias("outcome"))


def batch_counters(spark, base):
    return _extracted(spark, base).groupBy("transcript_id", "analysis_run_id", "batch").agg(F.count(F.lit(1)).alias("parsed"), F.count_if(F.col("reason").isNull()).alias("accepted"))


#: Checks on findings in their order; they stand in for a policy and are parameters of ``rules.judged``.
CHECKS = (
    rules.Check("not_decision_relevant", "decision_centrality", ("contextual",)), rules.Check("information_only", "factor_kind", ("information_request", "factual_background")),
    rules.Check("procedure_only", "factor_kind", ("procedural_diligence",)), rules.Check("peripheral", "importance_tier", ("peripheral",)),
    rules.Check("unclear_factor", "factor_kind", ("unclear",), hard=False), rules.Check("undetermined", "decision_centrality", ("indeterminate",), hard=False),
    rules.Check("unclear_priority", "priority_expression", ("unclear",), hard=False), rules.Check("timing_only", "decision_direction", ("affects_timing",), hard=False),
)
EFFECTS = {"supports_move": "driver", "opposes_move": "blocker"}
TEMPLATE = {"pass": "current_pain", "needs_review": "unclear", "reject": "factual_background"}


def _judged(spark, base):
    """Findings of every scored signal: missing factors synthesised from the stored verdict, directions put right first."""
    s = signals(spark, base).filter("item_type <> 'no_signal'").select("id", "analysis_run_id", F.col("item_type").alias("original_type"), "factor_kind", "decision_direction")
    f = s.join(results(spark, base).select(F.col("candidate_id").alias("id"), "analysis_run_id", "validation_verdict", "decision_centrality", "priority_expression", "importance_tier", "support_score"), ["id", "analysis_run_id"])
    f = f.withColumn("factor_kind", rules.synthesized("factor_kind", F.col("factor_kind").isNull(), F.col("validation_verdict"), TEMPLATE))
    f = f.withColumn("item_type", rules.corrected(F.col("original_type"), F.col("decision_direction"), EFFECTS))
    issues = F.array_compact(F.array(
        F.when((F.col("importance_tier") == "critical") & (F.col("decision_centrality") == "minor"), "tier_without_centrality"),
        F.when(F.col("item_type") != F.col("original_type"), "direction_contradicts_type"),
    ))
    f = f.withColumn("issues", issues)
    return rules.judged(f, CHECKS, extra_soft=[("consistency_issue", F.size("issues") > 0)])


def finding_verdicts(spark, base):
    return _judged(spark, base).select("id", "analysis_run_id", "original_type", "item_type", "verdict", "reason", F.array_join(F.concat("hard", "soft"), ",").alias("reasons"), F.array_join("issues", ",").alias("issues"))


THREE_BOUNDS = {
    "support": {"pass": (0.75, None), "reject": (None, 0.49), "needs_review": (0.5, 0.74)},
    "owner": {"pass": (0.8, None), "reject": (None, 0.79), "needs_review": (0.5, None)},
    "risk": {"pass": (None, 0.25), "reject": (0.75, None), "needs_review": (0.35, None)},
}
FIXED = {"reject": (0.0, 0.0, 1.0), "needs_review": (0.5, 0.8, 0.5)}


def three_scores(spark, base):
    """Support, owner's side and risk held between the bounds of the derived verdict; fixed where the stored one is missing."""
    f = _judged(spark, base).join(results(spark, base).select(F.col("candidate_id").alias("id"), "analysis_run_id", "direct_model_score"), ["id", "analysis_run_id"])
    number = lambda c: F.nanvl(c, F.lit(None).cast("double"))
    raw = {"support": number(F.col("support_score")), "owner": number(F.col("direct_model_score")), "risk": 1 - number(F.col("support_score"))}
    out = []
    for i, (name, bounds) in enumerate(THREE_BOUNDS.items()):
        held = rules.clamp(raw[name], F.col("verdict"), bounds)
        for v, scores in FIXED.items():
            held = F.when(F.col("validation_verdict").isNull() & (F.col("verdict") == v), F.lit(scores[i])).otherwise(held)
        out.append(F.round(held, 6).alias(name))
    return f.select("id", "analysis_run_id", "verdict", *out)


HARD_ONLY = ("no_signal", "malformed_candidate")


def integrity_filter(spark, base):
    """Signals that may go on: a reject stays out only for one of the excluding reasons."""
    s = rules.judged(signals(spark, base), (), _hard(), _soft())
    return s.select("id", "verdict", "reason", rules.allowed(F.col("verdict"), F.col("reason"), HARD_ONLY).alias("eligible"))


def scoring_summary(spark, base):
    s = rules.judged(signals(spark, base), (), _hard(), _soft()).withColumn("eligible", rules.allowed(F.col("verdict"), F.col("reason"), HARD_ONLY))
    scored = results(spark, base).filter("business_score is not null and not isnan(business_score)").select(F.col("candidate_id").alias("id"), "analysis_run_id", F.lit(True).alias("has_score"))
    s = s.join(scored, ["id", "analysis_run_id"], "left")
    return s.groupBy("transcript_id").agg(
        F.count(F.lit(1)).alias("candidates"), F.count_if("eligible").alias("eligible"), F.count_if(F.col("eligible") & F.coalesce("has_score", F.lit(False))).alias("scored"),
        F.count_if(~F.col("eligible")).alias("rejected_skipped"),
    )


# duplicates


def _grouped(spark, base):
    """Signals of duplicate groups with the scores of their run and how sure each reject is out."""
    r = results(spark, base).select(F.col("candidate_id").alias("id"), "analysis_run_id", *[F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in ("business_score", "support_score", "direct_model_score")])
    s = signals(spark, base).filter("duplicate_group_id is not null").join(r, ["id", "analysis_run_id"], "left")
    s = rules.judged(s, (), _hard(), _soft()).withColumn("eligible", rules.allowed(F.col("verdict"), F.col("reason"), HARD_ONLY) & F.col("business_score").isNotNull())
    return s.withColumn("explicit", F.coalesce(F.lower(F.trim("evidence_strength")) == "explicit", F.lit(False)))


def _by_score(spark, base):
    keys = dedup.default_keys(F.col("business_score"), F.col("explicit"), F.col("support_score"), 1 - F.col("support_score"))
    return dedup.elect(_grouped(spark, base).filter("eligible"), "duplicate_group_id", keys)


def elected_by_score(spark, base):
    """Eligible members with their election; those that are not eligible lose their group and stand for nobody."""
    e = _by_score(spark, base).select("id", F.concat(F.lit("g_"), F.col("canonical_id").cast("string")).alias("group_label"), "is_canonical")
    out = _grouped(spark, base).filter("not eligible").select("id", F.lit(None).cast("string").alias("group_label"), F.lit(False).alias("is_canonical"))
    return e.unionByName(out)


def elected_active(spark, base):
    keys = dedup.active_keys(F.col("business_score"), F.col("explicit"), F.col("direct_model_score"), F.col("support_score"), 1 - F.col("support_score"), F.col("advisor_quote"), F.col("timestamp"))
    e = dedup.elect(_grouped(spark, base).filter("eligible"), "duplicate_group_id", keys)
    return e.select("id", "canonical_id", "is_canonical")


def lifted_scores(spark, base):
    """Elected members; where a member of the group concludes, with the best score of the group."""
    e = _by_score(spark, base)
    concludes = F.col("advisor_quote").rlike("(?i)" + signal_queries.ENDS)
    return dedup.best_scores(e, "duplicate_group_id", "business_score", concludes).select("duplicate_group_id", F.col("id").alias("canonical_id"), F.col("business_score").alias("final_score"))


def duplicate_relationships(spark, base):
    e = _by_score(spark, base)
    edges = e.filter(F.col("advisor_quote").rlike("(?i)" + signal_queries.ENDS))
    return dedup.relationships(e, "duplicate_group_id", edges)


def representatives(spark, base):
    """Per group its elected member, its size and the member whose score it has."""
    e = _by_score(spark, base)
    source = F.max_by("id", F.struct("business_score", (-F.col("id")).alias("neg")))
    return e.groupBy("duplicate_group_id").agg(F.max("canonical_id").alias("candidate_id"), F.count(F.lit(1)).alias("members"), source.alias("score_source_id"))


def group_members(spark, base):
    """Membership as rows, however large a group is."""
    return _by_score(spark, base).select("duplicate_group_id", "canonical_id", "id")


def dedup_totals(spark, base):
    e, all_ = _by_score(spark, base), _grouped(spark, base)
    counts = e.agg(F.count(F.lit(1)).alias("eligible"), F.count_if("is_canonical").alias("canonical"), F.count_if(~F.col("is_canonical")).alias("duplicates"))
    return counts.crossJoin(all_.agg(F.count_if(~F.col("eligible")).alias("excluded")))  # one row by one row


def shortlisted_pairs(spark, base):
    """Compared pairs from the shortlist bound on, scores to six places, and whether the second score may be used."""
    p = table(spark, base, "pair_diagnostics").filter("bi_encoder_score >= 0.76 and left_id is not null and right_id is not null and left_id <> right_id")
    c = F.col("cross_encoder_score")
    return p.select(F.least("left_id", "right_id").alias("a"), F.greatest("left_id", "right_id").alias("b"), F.round("bi_encoder_score", 6).alias("score"), F.coalesce(c.between(0.0, 1.0), F.lit(False)).alias("usable")).distinct()


def dedup_modes(spark, base):
    """The groups of each mode over the embeddings: the baseline threshold, a stricter proposal, and an unknown mode."""
    e = table(spark, base, "embeddings").select(F.col("vec_id").alias("id"), "label", "embedding")
    out = None
    for mode in ("embedding_only", "active", "none"):
        made, _ = dedup.by_mode(mode, e, lambda: dedup.similarity_groups(e, ["label"], "embedding", 0.30), lambda: dedup.similarity_groups(e, ["label"], "embedding", 0.40))
        one = made.select(F.lit(mode).alias("mode"), "id", "component")
        out = one if out is None else out.unionByName(one)
    return out


def vector_checks(spark, base):
    """Vectors of the promised dimension, made sure of by an error otherwise, with their length."""
    from ..functions.vectors import dot, require_dimension

    v = require_dimension(F.col("embedding"), 64)
    return table(spark, base, "embeddings").select("vec_id", F.round(F.sqrt(dot(v, v)), 5).alias("length"))


# ranking

LEAST = {"explicit": 3.5, "implied": 4.0}
FLOORS = {"pass": 3.0, "needs_review": 3.25}


def ranked_by_strength(spark, base):
    """Per run and direction up to three signals that reach the bound of their strength, else the best that reaches its verdict's floor."""
    s = signal_queries._scored(spark, base).filter(F.col("validation_verdict").isin("pass", "needs_review"))
    s = s.withColumn("strength", F.lower(F.trim("evidence_strength")))
    group, category = ["analysis_run_id", "item_type"], F.coalesce(F.lower(F.trim("category")), F.lit(""))
    chosen = ranking.top_distinct(s.filter(ranking.reaches(F.col("final_score"), F.col("strength"), LEAST)), group, category, _rank_order(), 3)
    pool = s.filter(ranking.reaches(F.col("final_score"), F.col("validation_verdict"), FLOORS))
    out = ranking.with_fallback(chosen, pool, group, _rank_order())
    return out.select(*group, "rank", F.col("id").alias("signal_id"), "selection_reason")


def ranking_counts(spark, base):
    r = ranked_by_strength(spark, base)
    return r.groupBy("analysis_run_id").agg(F.count_if(F.col("item_type") == "driver").alias("drivers"), F.count_if(F.col("item_type") == "blocker").alias("blockers"), F.count_if(F.col("selection_reason") != "above_threshold").alias("fallbacks"))


def candidate_payloads(spark, base):
    """What a model is shown of each of the up to eight candidates of a run and direction, as JSON."""
    s = ranking.top(signal_queries._scored(spark, base), ["analysis_run_id", "item_type"], _rank_order(), 8)
    shown = F.struct("id", "item_type", "category", "factor_kind", "decision_direction", "advisor_quote", "rationale", "evidence_strength", "timestamp", F.coalesce("source_turn_ids", F.array().cast("array<bigint>")).alias("source_turn_ids"), "validation_verdict")
    return s.select("analysis_run_id", "id", F.to_json(shown, {"ignoreNullFields": "false"}).alias("payload"))


# importance


def _estimates(spark, base):
    """Importance rows with all five dimensions; the three that are not stored are functions of mention counts and tiers, no model's."""
    r = table(spark, base, "importance_results").withColumn("item_type", F.lower(F.trim("item_type")))
    keep = ["item_type", "importance_tier", "decision_centrality", "priority_expression", "validation_verdict", "mention_count", "traceable", "is_current", "direct_model_score"]
    last = r.groupBy("analysis_run_id", "candidate_id").agg(F.max_by(F.struct(*keep), F.struct("scored_at", *keep)).alias("r")).select("analysis_run_id", "candidate_id", "r.*")
    n = F.col("mention_count")
    return last.select(
        "*", F.when(n >= 4, "dominant").when(n == 3, "repeated").when(n == 2, "developed").otherwise("incidental").alias("attention_strength"),
        F.when(n >= 3, "gating_condition").when(n == 2, "outcome_driver").otherwise("supporting_detail").alias("dependency_role"),
        F.when(n >= 3, "decision_stopping").when(n == 2, "influences_preference").otherwise("no_stated_effect").alias("consequence_strength"), (n >= 5).alias("representative_context"),
    )


def importance_estimates(spark, base):
    """Eligible candidates with the score of five dimensions, its tier and the warnings."""
    e = imp.eligible(_estimates(spark, base))
    score = imp.structured_score(imp.five_levels())
    e = e.withColumn("score", score).withColumn("score_tier", imp.tier(score))
    return e.select("analysis_run_id", "candidate_id", "score", "score_tier", F.array_join(imp.warnings(F.array().cast("array<string>"), F.col("score_tier")), ",").alias("warnings"))


def importance_modes(spark, base):
    """The hybrid mode over runs: ranks by score, checked against the order of Copeland wins."""
    e = imp.eligible(_estimates(spark, base)).withColumn("score", imp.structured_score(imp.five_levels()))
    members = e.select("analysis_run_id", "candidate_id")
    by_list = sequence.numbered(e.select("analysis_run_id", "candidate_id", "score"), ["analysis_run_id"], [F.desc("score"), F.col("candidate_id")], "rank").withColumn("rank", F.col("rank") + 1)
    pairs = signal_queries._duels(spark, base)
    inside = members.select("analysis_run_id", F.col("candidate_id").alias("a"))
    pairs = pairs.join(inside, ["analysis_run_id", "a"], "left_semi").join(inside.withColumnRenamed("a", "b"), ["analysis_run_id", "b"], "left_semi")
    return imp.run_mode("hybrid", by_list, imp.copeland(pairs, members, "analysis_run_id"), members, "analysis_run_id")


QUERIES = {f.__name__: f for f in (
    transcript_listing, turn_listing, keyed_lookup, sorted_listing, found_transcripts, highlights, import_outcomes, parsed_turns, reused_turns, rerun_tables, overlaid_roles, role_snapshots, quote_resolution, context_payloads,
    extraction_reasons, batch_counters, finding_verdicts, three_scores, integrity_filter, scoring_summary, elected_by_score, elected_active, lifted_scores,
    duplicate_relationships, representatives, group_members, dedup_totals, shortlisted_pairs, dedup_modes, vector_checks, ranked_by_strength, ranking_counts, candidate_payloads,
    importance_estimates, importance_modes,
)}

_QT = f"""{S}, {T}, {_CUT}, h as (select qt.id, t.id as turn_id, coalesce(list_contains(cites, t.id), false) as cited, coalesce(qt.timestamp = t.timestamp and t.timestamp <> '', false) as tm,
        coalesce(inferred_role = 'advisor' and role_confidence >= 0.65, false) as sure from qt join t on t.transcript_id = qt.transcript_id and contains(t.text, q) where regexp_matches(q, '\\S')),
    w as (select * from h where sure qualify cited = max(cited) over (partition by id)),
    g as (select id, count(*) as n, min(turn_id) as one, count(*) filter (tm) as k, min(turn_id) filter (tm) as at_, case when any_value(cited) then 'source_turn_id' else 'unique_quote' end as how from w group by id),
    u as (select qt.id, n, case when n = 1 then one when k = 1 then at_ end as turn_id, case when n = 1 then how when k = 1 then how || '_timestamp' end as method from qt left join g using (id))"""
_BAD1 = """case when item_type = 'no_signal' then 'no_signal' when coalesce(trim(rationale), '') = '' or coalesce(len(source_turn_ids) <> len(list_distinct(source_turn_ids)), false) then 'malformed_candidate'
    when isnan(extraction_confidence) or not extraction_confidence between 0 and 1 then 'invalid_confidence' end"""
_SOFT1 = "case when coalesce(trim(category), '') = '' then 'missing_category' when source_turn_ids is null then 'no_source_turn' when extraction_confidence < 0.5 then 'weak_evidence' end"
_EX = f"""{S}, n as (select *, cast((row_number() over (partition by transcript_id, analysis_run_id order by id) - 1) // 60 + 1 as int) as batch, {_BAD1} as bad from s),
    o as (select *, case when bad is null then case when row_number() over w = 1 then null when first_value(batch) over w = batch then 'duplicate_within_batch' else 'duplicate_across_batches' end else bad end as reason
        from n window w as (partition by bad is null, analysis_run_id, item_type, lower(trim(category)), trim(advisor_quote) order by batch, id))"""
_JV = f"""{S}, {R}, f0 as (select s.id, s.analysis_run_id, s.item_type as original_type, decision_direction, validation_verdict, decision_centrality, priority_expression, importance_tier, support_score, direct_model_score,
        coalesce(factor_kind, case validation_verdict when 'pass' then 'current_pain' when 'needs_review' then 'unclear' when 'reject' then 'factual_background' end) as factor_kind,
        case when decision_direction = 'supports_move' then 'driver' when decision_direction = 'opposes_move' then 'blocker' else s.item_type end as item_type
        from s join r on r.candidate_id = s.id and r.analysis_run_id = s.analysis_run_id where s.item_type <> 'no_signal'),
    f1 as (select *, concat_ws(',', case when importance_tier = 'critical' and decision_centrality = 'minor' then 'tier_without_centrality' end, case when item_type <> original_type then 'direction_contradicts_type' end) as issues from f0),
    f2 as (select *, [x for x in [case when decision_centrality = 'contextual' then 'not_decision_relevant' end, case when factor_kind in ('information_request', 'factual_background') then 'information_only' end,
            case when factor_kind = 'procedural_diligence' then 'procedure_only' end, case when importance_tier = 'peripheral' then 'peripheral' end] if x is not null] as hard,
        [x for x in [case when factor_kind = 'unclear' then 'unclear_factor' end, case when decision_centrality = 'indeterminate' then 'undetermined' end, case when priority_expression = 'unclear' then 'unclear_priority' end,
            case when decision_direction = 'affects_timing' then 'timing_only' end, case when issues <> '' then 'consistency_issue' end] if x is not null] as soft from f1),
    jv as (select *, case when len(hard) > 0 then 'reject' when len(soft) > 0 then 'needs_review' else 'pass' end as verdict, case when len(hard) > 0 then hard[1] else soft[1] end as reason from f2)"""
_GR = f"""{S}, {R}, g0 as (select s.*, case when not isnan(business_score) then business_score end as final, case when not isnan(support_score) then support_score end as sup,
        case when not isnan(direct_model_score) then direct_model_score end as own, coalesce(lower(trim(evidence_strength)) = 'explicit', false) as ex, {_BAD1} as bad
        from s left join (select candidate_id, analysis_run_id as run, business_score, support_score, direct_model_score from r) r on r.candidate_id = s.id and r.run = s.analysis_run_id where duplicate_group_id is not null),
    g1 as (select *, not coalesce(bad in ('no_signal', 'malformed_candidate'), false) and final is not null as eligible from g0)"""
_KEY = "final desc, ex desc, coalesce(sup, '-infinity'::double) desc, (-coalesce(1 - sup, 1.0)) desc, id"
_EL = f"{_GR}, el as (select *, first_value(id) over w as canon from g1 where eligible window w as (partition by duplicate_group_id order by {_KEY}))"
_STRONG = f"""{signal_queries._SCORED}, sv as (select sc.*, r.validation_verdict as vv, lower(trim(sc.evidence_strength)) as st from sc join r on r.candidate_id = sc.id and r.analysis_run_id = sc.analysis_run_id where r.validation_verdict in ('pass', 'needs_review')),
    sb as (select * from sv where (st = 'explicit' and final_score >= 3.5) or (st = 'implied' and final_score >= 4.0) qualify row_number() over (partition by analysis_run_id, item_type, coalesce(lower(trim(category)), '') order by {_RANK}) = 1),
    sd as (select *, row_number() over (partition by analysis_run_id, item_type order by {_RANK}) as rn from sb),
    fb as (select * from sv where ((vv = 'pass' and final_score >= 3.0) or (vv = 'needs_review' and final_score >= 3.25)) and not exists (select 1 from sd where sd.analysis_run_id = sv.analysis_run_id and sd.item_type = sv.item_type)
        qualify row_number() over (partition by analysis_run_id, item_type order by {_RANK}) = 1),
    rk as (select analysis_run_id, item_type, cast(rn as int) as rank, id as signal_id, 'above_threshold' as selection_reason from sd where rn <= 3
        union all select analysis_run_id, item_type, 1, id, 'best_grounded_fallback' from fb)"""
_LV = """case decision_centrality when 'decisive' then 4 when 'major' then 3 when 'contributing' then 2 when 'minor' then 1 else 0 end
    + case when mention_count >= 3 then 4 when mention_count = 2 then 3 else 1 end + case when mention_count >= 3 then 4 when mention_count = 2 then 1 else 0 end
    + case priority_expression when 'explicitly_ranked' then 4 when 'explicitly_required' then 4 when 'explicitly_emphasized' then 3 when 'repeatedly_emphasized' then 3 when 'implicitly_central' then 2 when 'mentioned_once' then 1 else 0 end
    + case when mention_count >= 4 then 3 when mention_count = 3 then 2.5 when mention_count = 2 then 2 else 0 end"""
_IE = f"""{R}, ie as (select *, round(cast({_LV} as double) / 19.0::double, 4) as score from r where is_current and traceable and item_type in ('driver', 'blocker') and validation_verdict in ('pass', 'needs_review'))"""

SQL = {
    "import_outcomes": """with f as (select distinct file_name, case when not coalesce(regexp_matches(raw_text, '\\S'), false) then 'empty' end as reason from transcripts),
        p as (select *, cast(row_number() over (order by lower(file_name), file_name) - 1 as int) as place from f)
        select place, file_name, case when file_name in (select file_name from transcripts where status = 'finalized') then 'skipped_existing' else coalesce(reason, 'imported') end as outcome from p where place < 100""",
    "parsed_turns": f"""with fl as ({turn_queries.SQL["turns_flat"]}), li as ({turn_queries.SQL["turns_lines"]}) select * from fl
        union all by name select *, cast(null as varchar) as inferred_role, cast(null as double) as role_confidence from li""",
    "reused_turns": f"""with fl as ({turn_queries.SQL["turns_flat"]}), li as ({turn_queries.SQL["turns_lines"]}), a as (select doc_id from fl union all select doc_id from li), {T}
        select doc_id, 'parsed' as origin, count(*) as turns from a where doc_id not in (select transcript_id from t) group by all
        union all select transcript_id, 'stored', count(*) from t where transcript_id in (select id from transcripts) group by all""",
    "rerun_tables": f"""with {S}, g as (select id from s where analysis_run_id is null and transcript_id in (select id from transcripts where status = 'signals_scored'))
        select 'candidate_signals' as table_name, transcript_id, count(*) as n from s where id not in (select id from g) group by all
        union all select 'pair_diagnostics', transcript_id, count(*) from pair_diagnostics p where not exists (select 1 from g where g.id = p.left_id) and not exists (select 1 from g where g.id = p.right_id) group by all""",
    "transcript_listing": "select cast(row_number() over (order by created_at desc, id desc) - 1 as int) as place, id, file_name, status from transcripts",
    "turn_listing": f"with {T} select transcript_id, pos, id, timestamp, raw_speaker_label, inferred_role, text from t",
    "keyed_lookup": f"""with {S}, k as (select distinct left_id as id from pair_diagnostics where proposed_duplicate and left_id is not null)
        select k.id, s.item_type, case when s.id is not null then true end as there from k left join s using (id)""",
    "sorted_listing": " union all ".join(f"select '{m}' as mode, cast(row_number() over (order by {o}) - 1 as int) as place, id from (select *, array_to_string([case when regexp_matches(p, '^\\d') then lpad(p, 20, '0') else p end for p in regexp_extract_all(lower(file_name), '\\d+|\\D+')], '') as k from transcripts)" for m, o in {
        "newest": "created_at desc, id desc", "oldest": "created_at, id", "file_name": "k, id", "file_name_desc": "k desc, id desc", "status": "status, created_at desc, id desc"}.items()),
    "found_transcripts": "select id, file_name, status from transcripts where contains(lower(file_name), 'call') and status in ('finalized', 'parsed')",
    "highlights": f"""with {S}, {T}, {_CUT}, c as (select qt.id, t.id as cited_id, t.text, q from (select *, unnest(list_distinct(cites)) as cited from qt) qt join t on t.id = qt.cited and t.transcript_id = qt.transcript_id)
        select id, cited_id, cast(case when instr(text, q) > 0 then instr(text, q) else instr(lower(text), lower(q)) end as int) as place from c""",
    "overlaid_roles": f"""with {T} select id, coalesce(case when role_confidence < 0.7 then 'mixed' else inferred_role end, 'unknown') as role, coalesce(role_confidence, 0.0) as confidence from t""",
    "role_snapshots": f"with {T} select a.id as analysis_run_id, t.id as turn_id, coalesce(inferred_role, 'unknown') as role, coalesce(role_confidence, 0.0) as confidence from t join analysis_runs a using (transcript_id)",
    "quote_resolution": f"""with {_QT}, nb as (select id as turn_id, timestamp, lag(id) over x as previous_id, lead(id) over x as next_id from t window x as (partition by transcript_id order by pos))
        select u.id, case when u.turn_id is not null then 'resolved' when n > 1 then 'ambiguous_evidence' when exists (select 1 from h where h.id = u.id) then 'not_advisor_side' else 'quote_not_found' end as outcome,
        method, u.turn_id, timestamp, previous_id, next_id from u left join nb using (turn_id)""",
    "context_payloads": f"""with {_CITED}, {_WINDOW.replace('{own}', 'e.part')} select sid as id, to_json(list(struct_pack(turn_id := id, speaker := raw_speaker_label, text := text, timestamp := timestamp) order by pos))::varchar as context
        from k where rn <= 5 group by sid""",
    "extraction_reasons": f"with {_EX} select id, batch, coalesce(reason, 'accepted') as outcome from o",
    "batch_counters": f"with {_EX} select transcript_id, analysis_run_id, batch, count(*) as parsed, count(*) filter (reason is null) as accepted from o group by all",
    "finding_verdicts": f"with {_JV} select id, analysis_run_id, original_type, item_type, verdict, reason, array_to_string(list_concat(hard, soft), ',') as reasons, issues from jv",
    "three_scores": f"""with {_JV}, x as (select *, case when not isnan(support_score) then support_score end as s0, case when not isnan(direct_model_score) then direct_model_score end as o0 from jv)
        select id, analysis_run_id, verdict,
            round(case when validation_verdict is null and verdict = 'reject' then 0.0 when validation_verdict is null and verdict = 'needs_review' then 0.5 when s0 is null then null
                when verdict = 'pass' then greatest(s0, 0.75) when verdict = 'reject' then least(s0, 0.49) else least(greatest(s0, 0.5), 0.74) end::double, 6) as support,
            round(case when validation_verdict is null and verdict = 'reject' then 0.0 when validation_verdict is null and verdict = 'needs_review' then 0.8 when o0 is null then null
                when verdict = 'pass' then greatest(o0, 0.8) when verdict = 'reject' then least(o0, 0.79) else greatest(o0, 0.5) end::double, 6) as owner,
            round(case when validation_verdict is null and verdict = 'reject' then 1.0 when validation_verdict is null and verdict = 'needs_review' then 0.5 when s0 is null then null
                when verdict = 'pass' then least(1 - s0, 0.25) when verdict = 'reject' then greatest(1 - s0, 0.75) else greatest(1 - s0, 0.35) end::double, 6) as risk from x""",
    "integrity_filter": f"""with {S}, x as (select id, {_BAD1} as bad, {_SOFT1} as mild from s) select id, case when bad is not null then 'reject' when mild is not null then 'needs_review' else 'pass' end as verdict,
        coalesce(bad, mild) as reason, not coalesce(bad in ('no_signal', 'malformed_candidate'), false) as eligible from x""",
    "scoring_summary": f"""with {S}, {R}, x as (select s.transcript_id, not coalesce({_BAD1} in ('no_signal', 'malformed_candidate'), false) as ok,
            exists (select 1 from r where r.candidate_id = s.id and r.analysis_run_id = s.analysis_run_id and business_score is not null and not isnan(business_score)) as sc from s)
        select transcript_id, count(*) as candidates, count(*) filter (ok) as eligible, count(*) filter (ok and sc) as scored, count(*) filter (not ok) as rejected_skipped from x group by all""",
    "elected_by_score": f"with {_EL} select id, 'g_' || canon as group_label, id = canon as is_canonical from el union all select id, null, false from g1 where not eligible",
    "elected_active": f"""with {_GR} select id, first_value(id) over w as canonical_id, id = first_value(id) over w as is_canonical from g1 where eligible window w as (partition by duplicate_group_id
        order by ex desc, coalesce(own, -1) desc, final desc, coalesce(sup, -1) desc, (-coalesce(1 - sup, 1.0)) desc, len([x for x in string_split_regex(coalesce(advisor_quote, ''), '\\s+') if x <> '']) desc, coalesce(timestamp, '') desc, id)""",
    "lifted_scores": f"""with {_EL}, b as (select duplicate_group_id, max(final) as best, bool_or(regexp_matches(advisor_quote, '(?i){signal_queries.ENDS}')) as lift from el group by all)
        select el.duplicate_group_id, id as canonical_id, case when lift then best else final end as final_score from el join b using (duplicate_group_id) where id = canon""",
    "duplicate_relationships": f"""with {_EL}, b as (select duplicate_group_id, bool_or(regexp_matches(advisor_quote, '(?i){signal_queries.ENDS}')) as lift from el group by all)
        select id as duplicate_id, canon as canonical_id, 'g_' || canon as group_label, case when lift then 'nearby_reason_conclusion' else 'semantic_similarity' end as reason from el join b using (duplicate_group_id) where id <> canon""",
    "representatives": f"with {_EL} select duplicate_group_id, max(canon) as candidate_id, count(*) as members, first(id order by final desc, id) as score_source_id from el group by all",
    "group_members": f"with {_EL} select duplicate_group_id, canon as canonical_id, id from el",
    "dedup_totals": f"with {_EL} select (select count(*) from el) as eligible, (select count(*) from el where id = canon) as canonical, (select count(*) from el where id <> canon) as duplicates, (select count(*) from g1 where not eligible) as excluded",
    "shortlisted_pairs": """select distinct least(left_id, right_id) as a, greatest(left_id, right_id) as b, round(bi_encoder_score, 6) as score, coalesce(cross_encoder_score between 0 and 1, false) as usable
        from pair_diagnostics where bi_encoder_score >= 0.76 and left_id <> right_id""",
    "dedup_modes": f"""with recursive {signal_queries._SIM}, z4 as (select * from y where s >= 0.40), bi as (select a, b from z union select b, a from z), reach(n, m) as (select a, b from bi union select r.n, b.b from reach r join bi b on b.a = r.m),
        b4 as (select a, b from z4 union select b, a from z4), reach4(n, m) as (select a, b from b4 union select r.n, b.b from reach4 r join b4 b on b.a = r.m)
        select 'embedding_only' as mode, id, least(id, coalesce((select min(m) from reach where n = id), id)) as component from x union all select 'active', id, least(id, coalesce((select min(m) from reach4 where n = id), id)) from x
        union all select 'none', id, id from x""",
    "vector_checks": "select vec_id, round(sqrt(list_inner_product(cast(embedding as double[]), cast(embedding as double[]))), 5) as length from embeddings",
    "ranked_by_strength": f"with {_STRONG} select * from rk",
    "ranking_counts": f"with {_STRONG} select analysis_run_id, count(*) filter (item_type = 'driver') as drivers, count(*) filter (item_type = 'blocker') as blockers, count(*) filter (selection_reason <> 'above_threshold') as fallbacks from rk group by all",
    "candidate_payloads": f"""with {signal_queries._SCORED}, k as (select sc.*, r.validation_verdict from sc join (select candidate_id, analysis_run_id as run, validation_verdict from r) r on r.candidate_id = sc.id and r.run = sc.analysis_run_id qualify row_number() over (partition by analysis_run_id, item_type order by {_RANK}) <= 8)
        select analysis_run_id, id, to_json(struct_pack(id := id, item_type := item_type, category := category, factor_kind := factor_kind, decision_direction := decision_direction, advisor_quote := advisor_quote, rationale := rationale,
            evidence_strength := evidence_strength, timestamp := timestamp, source_turn_ids := coalesce(source_turn_ids, []), validation_verdict := validation_verdict))::varchar as payload from k""",
    "importance_estimates": f"""with {_IE}, z as (select *, {signal_queries._TIER} as score_tier from ie)
        select analysis_run_id, candidate_id, score, score_tier, concat_ws(',', case when importance_tier = 'critical' and (mention_count < 2 or decision_centrality = 'contextual') then 'critical_dimension_conflict' end,
            case when importance_tier = 'peripheral' and (mention_count >= 3 or decision_centrality = 'decisive') then 'peripheral_dimension_conflict' end,
            case when importance_tier <> 'indeterminate' and abs({signal_queries._NUM.format(c="importance_tier")} - {signal_queries._NUM.format(c="score_tier")}) > 1 then 'tier_score_inconsistency' end,
            case when validation_verdict = 'needs_review' then 'unresolved_validation' end, case when mention_count >= 5 then 'representative_context_present' end) as warnings from z""",
    "importance_modes": f"""with {_IE}, {signal_queries._DUEL}, l as (select analysis_run_id, candidate_id, cast(row_number() over (partition by analysis_run_id order by score desc, candidate_id) as int) as rank, count(*) over (partition by analysis_run_id) as k from ie),
        q as (select d.* from d where exists (select 1 from ie where ie.analysis_run_id = d.analysis_run_id and ie.candidate_id = d.a) and exists (select 1 from ie where ie.analysis_run_id = d.analysis_run_id and ie.candidate_id = d.b)),
        p as (select analysis_run_id, a as c, case when winner is null then 0.5 when winner = a then 1.0 else 0.0 end as x from q union all select analysis_run_id, b, case when winner is null then 0.5 when winner = b then 1.0 else 0.0 end from q),
        wn as (select ie.analysis_run_id, ie.candidate_id, coalesce(sum(x), 0) as wins from ie left join p on p.analysis_run_id = ie.analysis_run_id and p.c = ie.candidate_id group by all),
        fp as (select analysis_run_id, candidate_id as first_pair from wn qualify row_number() over (partition by analysis_run_id order by wins desc, candidate_id) = 1),
        fl as (select analysis_run_id, candidate_id as first_list from l where rank = 1)
        select distinct analysis_run_id, case when k >= 2 then candidate_id end as candidate_id, case when k >= 2 then rank end as rank, case when k < 2 then 'too_few_candidates' when first_list <> first_pair then 'modes_disagree' end as warning
        from l join fp using (analysis_run_id) join fl using (analysis_run_id)""",
}

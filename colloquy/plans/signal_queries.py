"""Queries over candidate signals: extraction, validation, scoring, duplicates, ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.vectors import sigmoid
from ..operators import dedup, evidence, graph, ranking, rules
from ..operators import importance as imp
from ..operators.runs import counts_of
from ..session import table
from . import pipeline, providers, turn_queries
from .base import R, S, T, results, signals, turns

#: Claims of the rationales and what must show them; parameters of the grounding operator.
CLAIMS = ((r"\bbecause\b", r"\b(because|since)\b"), (r"\b(concern|loss)\b", r"\b(worry|cost|lost)\b"))
#: Wording by which these invented texts mark a conclusion and its link.
ENDS, LINKS = r"\b(hinges|shapes the timing)\b", r"\b(so|because|which)\b"


def first_wins(spark, base):
    s = signals(spark, base).filter("item_type <> 'no_signal'")
    key = [F.col("analysis_run_id"), F.col("item_type"), F.lower(F.trim("category")), F.trim("advisor_quote")]
    return evidence.first_wins(s.select("id", "analysis_run_id", "item_type", "category", "advisor_quote", "created_at"), key, ["created_at", "id"]).select("id", "analysis_run_id", "item_type")


def extraction_counts(spark, base):
    s = signals(spark, base)
    return s.groupBy("transcript_id", "analysis_run_id").agg(
        F.count(F.lit(1)).alias("parsed"), F.count_if(F.col("item_type") != "no_signal").alias("accepted"),
        F.count_if(F.col("item_type") == "driver").alias("drivers"), F.count_if(F.col("item_type") == "blocker").alias("blockers"),
    )


def normalized_evidence(spark, base):
    return signals(spark, base).select("id", tx.squeeze(F.col("advisor_quote")).alias("normalized_evidence"))


def grounded_rationales(spark, base):
    s = signals(spark, base).filter("rationale is not null")
    return s.select("id", evidence.grounded(F.col("rationale"), F.col("advisor_quote"), F.col("advisor_quote"), CLAIMS).alias("rationale"))


def grounded_in_context(spark, base):
    """The claim of a rationale is looked for in the turns around its signal's cited turns, or in the quote where there are none."""
    s = signals(spark, base).filter("rationale is not null").join(turn_queries.context_texts(spark, base), "id", "left")
    return s.select("id", evidence.grounded(F.col("rationale"), F.coalesce("context", "advisor_quote"), F.col("advisor_quote"), CLAIMS).alias("rationale"))


def _hard():
    ids = F.col("source_turn_ids")
    return [
        ("no_signal", F.col("item_type") == "no_signal"),
        ("malformed_candidate", ~F.coalesce(F.col("rationale").rlike(r"\S"), F.lit(False)) | (F.size(ids) != F.size(F.array_distinct(ids)))),
        ("invalid_confidence", ~F.col("extraction_confidence").between(0.0, 1.0) | F.isnan("extraction_confidence")),
    ]


def _soft():
    return [
        ("missing_category", ~F.coalesce(F.col("category").rlike(r"\S"), F.lit(False))), ("no_source_turn", F.col("source_turn_ids").isNull()),
        ("weak_evidence", F.col("extraction_confidence") < 0.5),
    ]


def rule_cascade(spark, base):
    s = signals(spark, base).select("id", rules.reasons(_hard()).alias("hard"), rules.reasons(_soft()).alias("soft"), rules.first_reason(_hard()).alias("first_hard"))
    return s.select("id", rules.verdict(F.col("hard"), F.col("soft")).alias("verdict"), "first_hard", F.array_join(F.concat("hard", "soft"), ",").alias("reasons"))


BOUNDS = {"pass": (0.75, None), "reject": (None, 0.49), "needs_review": (0.5, 0.74)}


def clamped_scores(spark, base):
    r = results(spark, base).filter("support_score is not null and not isnan(support_score)")
    return r.select("analysis_run_id", "candidate_id", rules.clamp(F.col("support_score"), F.col("validation_verdict"), BOUNDS).alias("support_score"))


def weighted_grid(spark, base):
    n = spark.range(3125)
    parts = [(F.floor(F.col("id") / 5**k) % 5 + 1).cast("double") for k in range(5)]
    return n.select("id", rules.weighted(list(zip((0.30, 0.25, 0.20, 0.15, 0.10), parts))).alias("final_score"))


def verdict_counts(spark, base):
    return counts_of(results(spark, base), ["analysis_run_id"], "validation_verdict", ("pass", "needs_review", "reject"))


def similar_pairs(spark, base):
    e = table(spark, base, "embeddings").select(F.col("vec_id").alias("id"), "label", "embedding")
    return dedup.similar_pairs(e, ["label"], "embedding", 0.30)


def embedding_groups(spark, base):
    e = table(spark, base, "embeddings").select(F.col("vec_id").alias("id"), "label", "embedding")
    return dedup.similarity_groups(e, ["label"], "embedding", 0.30)


def reason_edges(spark, base):
    return dedup.reason_edges(signals(spark, base), ["transcript_id", "analysis_run_id", "item_type"], conclusion=ENDS, link=LINKS)


def merged_groups(spark, base):
    s = signals(spark, base)
    p = table(spark, base, "pair_diagnostics").filter("proposed_duplicate").select(F.col("left_id").alias("a"), F.col("right_id").alias("b"))
    reasons = dedup.reason_edges(s, ["transcript_id", "analysis_run_id", "item_type"], conclusion=ENDS, link=LINKS)
    return graph.components(p.unionByName(reasons.select("a", "b")), s)


def complete_link(spark, base):
    p = table(spark, base, "pair_diagnostics").filter("cross_encoder_score >= 0.8 and left_id <> right_id")
    return graph.complete_link(signals(spark, base), p.select(F.col("left_id").alias("a"), F.col("right_id").alias("b")), "transcript_id")


def _order():
    sure = F.col("extraction_confidence").between(0.0, 1.0)
    return [F.lower(F.trim(F.coalesce("evidence_strength", F.lit("")))) == "explicit", F.coalesce(F.when(sure, F.col("extraction_confidence")), F.lit(-1.0))]


def elected(spark, base):
    s = signals(spark, base).filter("duplicate_group_id is not null")
    e = dedup.elect(s, "duplicate_group_id", _order())
    return e.select("id", F.concat(F.lit("g_"), F.col("canonical_id").cast("string")).alias("group_label"), "is_canonical", "members")


def enriched(spark, base):
    s = signals(spark, base).filter("duplicate_group_id is not null")
    e = dedup.elect(s, "duplicate_group_id", _order())
    return dedup.enrich(e, "duplicate_group_id")


def dedup_summary(spark, base):
    e = elected(spark, base)
    return e.agg(F.count(F.lit(1)).alias("eligible"), F.count_if("is_canonical").alias("canonical"), F.count_if(~F.col("is_canonical")).alias("duplicates"))


def pair_texts(spark, base):
    s = signals(spark, base).filter("category is not null and rationale is not null")
    return s.select("id", F.md5(dedup.embedding_text()).alias("fingerprint"), dedup.pair_text("decision_factor_evidence_rationale").alias("pair_text"))


def pair_scores(spark, base):
    p = table(spark, base, "pair_diagnostics").filter("cross_encoder_score is not null").select("left_id", "right_id", sigmoid(F.col("cross_encoder_score") * 8 - 4).alias("s"))
    return p.groupBy(F.least("left_id", "right_id").alias("a"), F.greatest("left_id", "right_id").alias("b")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.min("s"), 6).alias("low"), F.round(F.max("s"), 6).alias("high"), F.round(F.max("s") - F.min("s"), 6).alias("spread")
    )


def _scored(spark, base):
    """Signals with the last score of their run; the score must be a number."""
    r = results(spark, base).filter("business_score is not null and not isnan(business_score)")
    r = r.select(F.col("candidate_id").alias("id"), "analysis_run_id", F.col("business_score").alias("final_score"), "validation_verdict")
    return signals(spark, base).filter("item_type <> 'no_signal'").join(r, ["id", "analysis_run_id"])


def _rank_order():
    return [F.desc("final_score"), F.desc(F.coalesce(F.lower(F.trim("evidence_strength")) == "explicit", F.lit(False))), F.asc("id")]


def rank_inputs(spark, base):
    return ranking.top(_scored(spark, base), ["analysis_run_id", "item_type"], _rank_order(), 8).select("analysis_run_id", "item_type", "rank", "id", "final_score")


def final_selection(spark, base):
    """The flagship: per run and direction the three best signals of distinct categories, or one fallback."""
    s = _scored(spark, base)
    group = ["analysis_run_id", "item_type"]
    category = F.coalesce(F.lower(F.trim("category")), F.lit(""))
    chosen = ranking.top_distinct(s.filter("final_score >= 3.5"), group, category, _rank_order(), 3)
    out = ranking.with_fallback(chosen, s, group, _rank_order())
    return out.select(*group, "rank", F.col("id").alias("signal_id"), "final_score", "selection_reason")


def selection_checks(spark, base):
    r = results(spark, base).filter("relative_rank <= 3 and item_type <> 'no_signal'")
    chosen = r.select("analysis_run_id", F.col("candidate_id").alias("signal_id"), "item_type", F.col("relative_rank").alias("rank"))
    return ranking.selection_valid(chosen, signals(spark, base), "analysis_run_id")


def source_texts(spark, base):
    c = evidence.cited_turns(signals(spark, base), turns(spark, base))
    packed = F.array_sort(F.collect_list(F.struct("t_pos", "t_text")))
    return c.groupBy("id").agg(F.array_join(F.transform(packed, lambda x: x["t_text"]), " ").alias("source_text"))


def structured_levels(spark, base):
    r = results(spark, base)
    score = imp.structured_score([imp.level("decision_centrality", imp.CENTRALITY), imp.level("priority_expression", imp.PRIORITY)], 8.0)
    return r.select("analysis_run_id", "candidate_id", score.alias("score"), imp.tier(score).alias("tier"))


def tier_gaps(spark, base):
    r = structured_levels(spark, base).join(results(spark, base).select("analysis_run_id", "candidate_id", "importance_tier", "validation_verdict"), ["analysis_run_id", "candidate_id"])
    gap = F.abs(imp.level("importance_tier", imp.TIER_ORDER) - imp.level("tier", imp.TIER_ORDER)) > 1
    found = rules.reasons([("tier_score_inconsistency", (F.col("importance_tier") != "indeterminate") & gap), ("unresolved_validation", F.col("validation_verdict") == "needs_review")])
    return r.select("analysis_run_id", "candidate_id", F.array_join(found, ",").alias("warnings"))


def listwise_faults(spark, base):
    r = results(spark, base).filter("item_type <> 'no_signal'").select("analysis_run_id", "candidate_id", F.col("relative_rank").alias("rank"), F.col("direct_model_score").alias("score"))
    want = signals(spark, base).filter("item_type <> 'no_signal' and analysis_run_id is not null").select("analysis_run_id", F.col("id").alias("candidate_id"))
    return imp.listwise_faults(r, want, "analysis_run_id")


def _duels(spark, base):
    """One result per compared pair of a run: the greater id wins at a low mean score, the smaller at a high one, else a tie."""
    p = table(spark, base, "pair_diagnostics").filter("left_id <> right_id and analysis_run_id is not null")
    p = p.groupBy("analysis_run_id", F.least("left_id", "right_id").alias("a"), F.greatest("left_id", "right_id").alias("b")).agg(F.avg("bi_encoder_score").alias("s"))
    return p.withColumn("winner", F.when(F.col("s") >= 0.6, F.col("a")).when(F.col("s") <= 0.5, F.col("b")))


def _members(spark, base):
    return signals(spark, base).filter("analysis_run_id is not null").select("analysis_run_id", F.col("id").alias("candidate_id"))


def pairs_complete(spark, base):
    return imp.pairs_complete(_duels(spark, base), _members(spark, base), "analysis_run_id")


def copeland(spark, base):
    return imp.copeland(_duels(spark, base), _members(spark, base), "analysis_run_id")


def three_cycles(spark, base):
    d = _duels(spark, base).filter("winner is not null")
    wins = d.select("analysis_run_id", "winner", F.when(F.col("winner") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("loser"))
    return graph.three_cycles(wins, "analysis_run_id")


def stored_responses(spark, base):
    """Stored model answers among the documents, parsed all or nothing."""
    d = table(spark, base, "documents").filter(F.ltrim("text").startswith('{"items"'))
    p = providers.parsed(d.select("doc_id", "text"), "text")
    return p.select("doc_id", F.coalesce("fault", F.lit("valid")).alias("outcome"), F.coalesce(F.size("items"), F.lit(0)).alias("items"))


def pipeline_finals(spark, base):
    """All stages over the last scorings; components are documented stand-ins: functions of ids, not a model's."""
    r = results(spark, base).select(F.col("candidate_id").alias("id"), "analysis_run_id", "support_score")
    s = signals(spark, base).filter("item_type <> 'no_signal'").join(r, ["id", "analysis_run_id"])
    parts = [(F.floor(F.col("id") / 5**k) % 5 + 1).alias(c) for k, c in enumerate(pipeline.EngineConfig().components)]
    s = s.select("id", "analysis_run_id", "item_type", "category", "advisor_quote", "rationale", "source_turn_ids", "extraction_confidence", F.lower(F.trim("evidence_strength")).alias("evidence_strength"), *parts)
    finals = pipeline.run(s, _hard(), _soft()).finals
    return finals.select("analysis_run_id", "item_type", "rank", "id", "final_score", "selection_reason")


QUERIES = {f.__name__: f for f in (
    stored_responses, pipeline_finals, first_wins, extraction_counts, normalized_evidence, grounded_rationales, grounded_in_context, rule_cascade, clamped_scores, weighted_grid, verdict_counts,
    similar_pairs, embedding_groups, reason_edges, merged_groups, complete_link, elected, enriched, dedup_summary, pair_texts, pair_scores,
    rank_inputs, final_selection, selection_checks, source_texts, structured_levels, tier_gaps, listwise_faults, pairs_complete, copeland, three_cycles,
)}

_SIM = """x as (select vec_id as id, label, cast(embedding as double[]) as v from embeddings),
    y as (select a.label, a.id as a, b.id as b, list_cosine_similarity(a.v, b.v) as s from x a join x b on a.label = b.label and a.id < b.id),
    z as (select * from y where s >= 0.30)"""
_CLOSE = """, bi as (select a, b from {e} union select b, a from {e}),
    reach(n, m) as (select a, b from bi union select r.n, b.b from reach r join bi b on b.a = r.m)"""
_EDGES = f"""w as (select *, regexp_matches(concat_ws(' ', coalesce(category, ''), advisor_quote, coalesce(rationale, '')), '(?i){ENDS}') as ends,
        regexp_matches(advisor_quote, '(?i){LINKS}') as linked, list_min(source_turn_ids) as lo, list_max(source_turn_ids) as hi from s where len(source_turn_ids) > 0),
    re as (select distinct c.transcript_id, c.analysis_run_id, c.item_type, least(c.id, r.id) as a, greatest(c.id, r.id) as b from w c join w r
        on c.transcript_id = r.transcript_id and c.analysis_run_id = r.analysis_run_id and c.item_type = r.item_type and c.id <> r.id
        where c.ends and c.linked and (not r.ends or c.id < r.id) and c.lo - r.hi between 0 and 4)"""
_ORDER = "(lower(trim(coalesce(evidence_strength, ''))) = 'explicit') desc, coalesce(case when extraction_confidence between 0 and 1 then extraction_confidence end, -1) desc, id"
_ELECT = f"{S}, g as (select *, first_value(id) over w as canon, count(*) over (partition by duplicate_group_id) as members from s where duplicate_group_id is not null window w as (partition by duplicate_group_id order by {_ORDER}))"
_SCORED = f"""{S}, {R}, sc as (select s.*, r.business_score as final_score from s join r on r.candidate_id = s.id and r.analysis_run_id = s.analysis_run_id
    where s.item_type <> 'no_signal' and r.business_score is not null and not isnan(r.business_score))"""
_RANK = "final_score desc, coalesce(lower(trim(evidence_strength)) = 'explicit', false) desc, id"
_DUEL = """d as (select *, case when s >= 0.6 then a when s <= 0.5 then b end as winner from (select analysis_run_id, least(left_id, right_id) as a, greatest(left_id, right_id) as b,
    avg(bi_encoder_score) as s from pair_diagnostics where left_id <> right_id and analysis_run_id is not null group by all))"""
_LEVEL = """l as (select *, round((case decision_centrality when 'decisive' then 4 when 'major' then 3 when 'contributing' then 2 when 'minor' then 1 else 0 end
    + case priority_expression when 'explicitly_ranked' then 4 when 'explicitly_required' then 4 when 'explicitly_emphasized' then 3 when 'repeatedly_emphasized' then 3
      when 'implicitly_central' then 2 when 'mentioned_once' then 1 else 0 end) / cast(8.0 as double), 4) as score from r)"""
_TIER = "case when score >= 0.80 then 'critical' when score >= 0.65 then 'high' when score >= 0.45 then 'medium' when score >= 0.25 then 'low' else 'peripheral' end"
_NUM = "case {c} when 'critical' then 5 when 'high' then 4 when 'medium' then 3 when 'low' then 2 when 'peripheral' then 1 else 0 end"

_FIRST_BAD = "case when item_type = 'no_signal' or coalesce(trim(rationale), '') = '' or coalesce(len(source_turn_ids) <> len(list_distinct(source_turn_ids)), false) or isnan(extraction_confidence) or not extraction_confidence between 0 and 1 then true else false end"
_PIPE = f"""{S}, v as (select s.*, round(0.30::double * (id % 5 + 1) + 0.25::double * (id // 5 % 5 + 1) + 0.20::double * (id // 25 % 5 + 1) + 0.15::double * (id // 125 % 5 + 1) + 0.10::double * (id // 625 % 5 + 1), 2) as final_score,
        coalesce(lower(trim(evidence_strength)) = 'explicit', false) as ex, lower(trim(regexp_replace(coalesce(category, ''), '\\s+', ' ', 'g'))) as cat
        from s where item_type <> 'no_signal' and not {_FIRST_BAD} and exists (select 1 from importance_results r where r.candidate_id = s.id and r.analysis_run_id = s.analysis_run_id)),
    pl as (select * from v qualify row_number() over (partition by analysis_run_id, item_type, lower(trim(regexp_replace(advisor_quote, '\\s+', ' ', 'g'))) order by final_score desc, ex desc, id) = 1),
    b as (select * from pl where final_score >= 3.5 qualify row_number() over (partition by analysis_run_id, item_type, cat order by final_score desc, ex desc, id) = 1),
    c as (select *, row_number() over (partition by analysis_run_id, item_type order by final_score desc, ex desc, id) as rn from b),
    f as (select * from pl where not exists (select 1 from c where c.analysis_run_id = pl.analysis_run_id and c.item_type = pl.item_type)
        qualify row_number() over (partition by analysis_run_id, item_type order by final_score desc, ex desc, id) = 1)"""

SQL = {
    "pipeline_finals": f"""with {_PIPE} select analysis_run_id, item_type, cast(rn as int) as rank, id, final_score, 'above_threshold' as selection_reason from c where rn <= 3
        union all select analysis_run_id, item_type, 1, id, final_score, 'best_grounded_fallback' from f""",
    "stored_responses": """with d as (select doc_id, text from documents where ltrim(text) like '{"items"%'), j as (select doc_id, case when json_valid(text) then text end as t from d),
        x as (select doc_id, t, unnest(case when t is null then [null] else json_extract(t, '$.items[*]') end) as i from j),
        g as (select doc_id, any_value(t) as t, count(i) as n, bool_and(coalesce(json_extract_string(i, '$.item_type') in ('driver', 'blocker', 'no_signal') and trim(json_extract_string(i, '$.advisor_quote')) <> ''
            and cast(json_extract(i, '$.extraction_confidence') as double) between 0 and 1, false)) as ok from x group by doc_id)
        select doc_id, case when t is null then 'malformed_json' when not ok then 'invalid_item' else 'valid' end as outcome, cast(case when t is not null and ok then n else 0 end as int) as items from g""",
    "first_wins": f"""with {S} select id, analysis_run_id, item_type from s where item_type <> 'no_signal'
        qualify row_number() over (partition by analysis_run_id, item_type, lower(trim(category)), trim(advisor_quote) order by created_at, id) = 1""",
    "extraction_counts": f"""with {S} select transcript_id, analysis_run_id, count(*) as parsed, count(*) filter (item_type <> 'no_signal') as accepted,
        count(*) filter (item_type = 'driver') as drivers, count(*) filter (item_type = 'blocker') as blockers from s group by all""",
    "normalized_evidence": f"with {S} select id, lower(trim(regexp_replace(advisor_quote, '\\s+', ' ', 'g'))) as normalized_evidence from s",
    "grounded_rationales": f"""with {S} select id, case when (regexp_matches(rationale, '(?i)\\bbecause\\b') and not regexp_matches(advisor_quote, '(?i)\\b(because|since)\\b'))
        or (regexp_matches(rationale, '(?i)\\b(concern|loss)\\b') and not regexp_matches(advisor_quote, '(?i)\\b(worry|cost|lost)\\b'))
        then 'The advisor states, "' || advisor_quote || '"' else rationale end as rationale from s where rationale is not null""",
    "grounded_in_context": f"""with {turn_queries._CITED}, {turn_queries._WINDOW.replace('{own}', 'e.own')}, cx as (select sid as id, string_agg(text, ' ' order by pos) as context from k where rn <= 5 group by sid),
        x as (select s.id, rationale, advisor_quote, coalesce(context, advisor_quote) as support from s left join cx using (id) where rationale is not null)
        select id, case when (regexp_matches(rationale, '(?i)\\bbecause\\b') and not regexp_matches(support, '(?i)\\b(because|since)\\b'))
        or (regexp_matches(rationale, '(?i)\\b(concern|loss)\\b') and not regexp_matches(support, '(?i)\\b(worry|cost|lost)\\b'))
        then 'The advisor states, "' || advisor_quote || '"' else rationale end as rationale from x""",
    "rule_cascade": f"""with {S}, x as (select id, case when item_type = 'no_signal' then 'no_signal' end as h1,
            case when coalesce(trim(rationale), '') = '' or coalesce(len(source_turn_ids) <> len(list_distinct(source_turn_ids)), false) then 'malformed_candidate' end as h2,
            case when isnan(extraction_confidence) or not extraction_confidence between 0 and 1 then 'invalid_confidence' end as h3,
            case when coalesce(trim(category), '') = '' then 'missing_category' end as s1, case when source_turn_ids is null then 'no_source_turn' end as s2,
            case when extraction_confidence < 0.5 then 'weak_evidence' end as s3 from s)
        select id, case when coalesce(h1, h2, h3) is not null then 'reject' when coalesce(s1, s2, s3) is not null then 'needs_review' else 'pass' end as verdict,
            coalesce(h1, h2, h3) as first_hard, concat_ws(',', h1, h2, h3, s1, s2, s3) as reasons from x""",
    "clamped_scores": f"""with {R} select analysis_run_id, candidate_id, case validation_verdict when 'pass' then greatest(support_score, 0.75) when 'reject' then least(support_score, 0.49)
        when 'needs_review' then least(greatest(support_score, 0.5), 0.74) else support_score end as support_score from r where support_score is not null and not isnan(support_score)""",
    "weighted_grid": """select id, round(0.30::double * (id % 5 + 1) + 0.25::double * (id // 5 % 5 + 1) + 0.20::double * (id // 25 % 5 + 1)
        + 0.15::double * (id // 125 % 5 + 1) + 0.10::double * (id // 625 % 5 + 1), 2) as final_score from (select unnest(range(3125)) as id)""",
    "verdict_counts": f"""with {R} select analysis_run_id, count(*) filter (validation_verdict = 'pass') as pass, count(*) filter (validation_verdict = 'needs_review') as needs_review,
        count(*) filter (validation_verdict = 'reject') as reject from r group by all""",
    "similar_pairs": f"with {_SIM} select label, a, b, round(s, 6) as similarity from z",
    "embedding_groups": f"with recursive {_SIM}{_CLOSE.format(e='z')} select id, least(id, coalesce((select min(m) from reach where n = id), id)) as component from x",
    "reason_edges": f"with {S}, {_EDGES} select * from re",
    "merged_groups": f"""with recursive {S}, {_EDGES}, ed as (select left_id as a, right_id as b from pair_diagnostics where proposed_duplicate and left_id <> right_id union select a, b from re)
        {_CLOSE.format(e='ed')}, m as (select n, min(m) as m from reach group by n)
        select s.id, least(s.id, coalesce(m.m, s.id)) as component from s left join m on m.n = s.id""",
    "complete_link": f"""with recursive {S}, e as (select distinct least(left_id, right_id) as a, greatest(left_id, right_id) as b, transcript_id as t from pair_diagnostics where cross_encoder_score >= 0.8 and left_id <> right_id),
        bi as (select a as n, b as m, t from e union select b, a, t from e), p as (select n, list(m) as ps, min(t) as t from bi group by n), o as (select *, row_number() over (partition by t order by n) as i from p),
        st(t, i, asg) as (select distinct t, cast(0 as bigint), cast([] as struct(n bigint, g bigint)[]) from p
            union all select st.t, o.i, list_append(asg, struct_pack(n := o.n, g := coalesce(list_min(list_filter(list_distinct(list_transform(asg, lambda x: x.g)),
                lambda y: list_has_all(o.ps, list_transform(list_filter(asg, lambda x: x.g = y), lambda x: x.n)))), o.n))) from st join o on o.t = st.t and o.i = st.i + 1),
        l as (select unnest(asg, recursive := true) from (select asg from st qualify i = max(i) over (partition by t)))
        select s.id, coalesce(l.g, s.id) as group_id from s left join l on l.n = s.id""",
    "elected": f"with {_ELECT} select id, 'g_' || canon as group_label, id = canon as is_canonical, members from g",
    "enriched": f"""with {_ELECT}, o as (select duplicate_group_id, category, min(id) as f from g where id <> canon and category is not null group by all),
        j as (select duplicate_group_id, string_agg(category, '; ' order by f) as cats from o group by all)
        select g.id, case when j.cats is null then g.rationale else regexp_replace(coalesce(g.rationale, ''), '\\.+$', '') || ' Supporting reasons: ' || j.cats || '.' end as rationale
        from g left join j using (duplicate_group_id) where g.id = g.canon""",
    "dedup_summary": f"with {_ELECT} select count(*) as eligible, count(*) filter (id = canon) as canonical, count(*) filter (id <> canon) as duplicates from g",
    "pair_texts": f"""with {S} select id, md5(concat_ws(chr(10), item_type, category, rationale, advisor_quote)) as fingerprint,
        concat('Type: ', item_type, chr(10), 'Decision direction: ', case when item_type = 'driver' then 'supports move' else 'opposes move' end, chr(10), 'Decision factor: ',
        lower(trim(regexp_replace(category, '\\s+', ' ', 'g'))), chr(10), 'Advisor evidence: ', trim(advisor_quote), chr(10), 'Generated rationale: ', trim(rationale)) as pair_text
        from s where category is not null and rationale is not null""",
    "pair_scores": """select least(left_id, right_id) as a, greatest(left_id, right_id) as b, count(*) as n, round(min(s), 6) as low, round(max(s), 6) as high, round(max(s) - min(s), 6) as spread
        from (select *, 1 / (1 + exp(-(cross_encoder_score * 8 - 4))) as s from pair_diagnostics where cross_encoder_score is not null) group by all""",
    "rank_inputs": f"""with {_SCORED} select analysis_run_id, item_type, cast(rn as int) as rank, id, final_score from (select *, row_number() over (partition by analysis_run_id, item_type order by {_RANK}) as rn from sc) where rn <= 8""",
    "final_selection": f"""with {_SCORED}, b as (select * from sc where final_score >= 3.5 qualify row_number() over (partition by analysis_run_id, item_type, coalesce(lower(trim(category)), '') order by {_RANK}) = 1),
        c as (select *, row_number() over (partition by analysis_run_id, item_type order by {_RANK}) as rn from b),
        f as (select * from sc where not exists (select 1 from c where c.analysis_run_id = sc.analysis_run_id and c.item_type = sc.item_type)
            qualify row_number() over (partition by analysis_run_id, item_type order by {_RANK}) = 1)
        select analysis_run_id, item_type, cast(rn as int) as rank, id as signal_id, final_score, 'above_threshold' as selection_reason from c where rn <= 3
        union all select analysis_run_id, item_type, 1, id, final_score, 'best_grounded_fallback' from f""",
    "selection_checks": f"""with {S}, {R}, x as (select r.analysis_run_id, r.item_type, r.candidate_id, r.relative_rank as k, coalesce(s.analysis_run_id = r.analysis_run_id and s.item_type = r.item_type, false) as fits,
            lower(trim(s.category)) as cat from r left join s on s.id = r.candidate_id where r.relative_rank <= 3 and r.item_type <> 'no_signal'),
        g as (select analysis_run_id, item_type, bool_and(fits) and count(*) <= 3 and count(distinct candidate_id) = count(*) and count(distinct cat) = count(*)
            and count(distinct k) = count(*) and min(k) = 1 and max(k) = count(*) as ok from x group by all)
        select analysis_run_id, bool_and(ok) as valid from g group by all""",
    "source_texts": f"""with {S}, {T} select s.id, string_agg(t.text, ' ' order by t.pos) as source_text from (select id, transcript_id, unnest(list_distinct(source_turn_ids)) as cited from s) s
        join t on t.id = s.cited and t.transcript_id = s.transcript_id group by s.id""",
    "structured_levels": f"with {R}, {_LEVEL} select analysis_run_id, candidate_id, score, {_TIER} as tier from l",
    "tier_gaps": f"""with {R}, {_LEVEL}, q as (select *, {_TIER} as tier from l) select analysis_run_id, candidate_id, concat_ws(',',
        case when importance_tier <> 'indeterminate' and abs({_NUM.format(c='importance_tier')} - {_NUM.format(c='tier')}) > 1 then 'tier_score_inconsistency' end,
        case when validation_verdict = 'needs_review' then 'unresolved_validation' end) as warnings from q""",
    "listwise_faults": f"""with {S}, {R}, i as (select * from r where item_type <> 'no_signal'), w as (select distinct analysis_run_id, id as candidate_id from s where item_type <> 'no_signal' and analysis_run_id is not null),
        g as (select analysis_run_id, count(*) as n, count(distinct candidate_id) as ids, count(distinct relative_rank) as ranks, min(relative_rank) as lo, max(relative_rank) as hi,
            count(*) filter (direct_model_score is null or isnan(direct_model_score) or isinf(direct_model_score)) as bad from i group by all),
        u as (select analysis_run_id, count(*) as unknown from i anti join w using (analysis_run_id, candidate_id) group by all),
        m as (select analysis_run_id, count(*) as missing from w anti join i using (analysis_run_id, candidate_id) group by all)
        select analysis_run_id, coalesce(n, 0) - coalesce(ids, 0) as repeated, coalesce(unknown, 0) as unknown, coalesce(missing, 0) as missing,
            coalesce(ranks, 0) <> coalesce(n, 0) or (coalesce(n, 0) > 0 and (coalesce(lo, 0) <> 1 or coalesce(hi, 0) <> n)) as ranks_broken, coalesce(bad, 0) as not_finite
        from g full join u using (analysis_run_id) full join m using (analysis_run_id)""",
    "pairs_complete": f"""with {S}, {_DUEL}, m as (select analysis_run_id, id from s where analysis_run_id is not null), k as (select analysis_run_id, count(distinct id) as k from m group by all),
        c as (select analysis_run_id, count(*) as n from d group by all), f as (select d.analysis_run_id, count(*) as good from d semi join m x on x.analysis_run_id = d.analysis_run_id and x.id = d.a
            where exists (select 1 from m y where y.analysis_run_id = d.analysis_run_id and y.id = d.b) group by all)
        select analysis_run_id, k, coalesce(n, 0) as rows, coalesce(n, 0) = k * (k - 1) / 2 and coalesce(good, 0) = k * (k - 1) / 2 as complete from k left join c using (analysis_run_id) left join f using (analysis_run_id)""",
    "copeland": f"""with {S}, {_DUEL}, p as (select analysis_run_id, a as id, case when winner is null then 0.5 when winner = a then 1.0 else 0.0 end as w from d
            union all select analysis_run_id, b, case when winner is null then 0.5 when winner = b then 1.0 else 0.0 end from d),
        q as (select s.analysis_run_id, s.id as candidate_id, cast(coalesce(sum(p.w), 0) as double) as wins from s left join p on p.analysis_run_id = s.analysis_run_id and p.id = s.id where s.analysis_run_id is not null group by all)
        select *, cast(row_number() over (partition by analysis_run_id order by wins desc, candidate_id) as int) as rank from q""",
    "three_cycles": f"""with {_DUEL}, e as (select analysis_run_id, winner as w, case when winner = a then b else a end as l from d where winner is not null)
        select distinct x.analysis_run_id, n[1] as a, n[2] as b, n[3] as c from (select x.analysis_run_id, list_sort([x.w, y.w, z.w]) as n from e x join e y on x.analysis_run_id = y.analysis_run_id and x.l = y.w
            join e z on y.analysis_run_id = z.analysis_run_id and y.l = z.w and z.l = x.w) x""",
}

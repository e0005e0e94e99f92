"""Queries over labels, scores and rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics, ranking, rules
from ..operators.sequence import numbered
from ..session import table
from .base import R, S, results, signals
from .signal_queries import _FIRST_BAD, _LEVEL, _TIER, _hard, structured_levels


def _tiers(spark, base):
    got = structured_levels(spark, base).select("analysis_run_id", "candidate_id", F.when(F.col("tier") != "medium", F.col("tier")).alias("guess"))
    return results(spark, base).select("analysis_run_id", "candidate_id", "item_type", F.col("importance_tier").alias("actual")).join(got, ["analysis_run_id", "candidate_id"])


def tier_confusion(spark, base):
    return metrics.confusion(_tiers(spark, base), "actual", "guess")


def tier_classes(spark, base):
    return metrics.per_class(metrics.confusion(_tiers(spark, base), "actual", "guess", ["item_type"]), ["item_type"])


def tier_report(spark, base):
    return metrics.report(_tiers(spark, base), "actual", "guess", ["item_type"])


def label_sets(spark, base):
    s = table(spark, base, "candidate_signals").dropDuplicates(["id"])

    def words(c):
        return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")

    return metrics.multilabel(s.select(words("category").alias("a"), words("rationale").alias("g")), "a", "g")


def _labelled(spark, base):
    return table(spark, base, "pair_diagnostics").filter("proposed_duplicate is not null")


def score_thresholds(spark, base):
    t = metrics.at_thresholds(_labelled(spark, base), "proposed_duplicate", "bi_encoder_score").drop("at_pos")
    return t.select("threshold", "true_positive", "false_positive", "false_negative", "true_negative", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "f05")])


def merge_threshold(spark, base):
    t = metrics.calibrate(metrics.at_thresholds(_labelled(spark, base), "proposed_duplicate", "bi_encoder_score"), 0.9)
    return t.select("threshold", "true_positive", "false_positive", "false_negative", "true_negative", *[F.round(c, 9).alias(c) for c in ("precision", "recall")])


def average_precision(spark, base):
    t = metrics.average_precision(metrics.at_thresholds(_labelled(spark, base), "proposed_duplicate", "bi_encoder_score"))
    return t.select(F.round("average_precision", 9).alias("average_precision"))


def eval_split(spark, base):
    return metrics.hash_split(table(spark, base, "eval_items"), "suite", "item_id", "split-v1:", 7).select("item_id", "suite", F.col("split"))


def value_percentiles(spark, base):
    return metrics.nearest_rank(table(spark, base, "events"), ["event_type"], "value", (0.5, 0.95))


def order_sensitivity(spark, base):
    p = table(spark, base, "pair_diagnostics").filter("left_id <> right_id")
    key = [F.least("left_id", "right_id").alias("a"), F.greatest("left_id", "right_id").alias("b")]
    g = p.groupBy(*key).agg(F.avg(F.when(F.col("left_id") < F.col("right_id"), F.col("bi_encoder_score"))).alias("f"), F.avg(F.when(F.col("left_id") > F.col("right_id"), F.col("bi_encoder_score"))).alias("r"))
    g = g.filter("f is not null and r is not null").withColumn("d", F.abs(F.col("f") - F.col("r")))
    return g.agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg("d"), 9).alias("mean"), F.round(F.min("d"), 9).alias("low"), F.round(F.max("d"), 9).alias("high"))


def _ranked(spark, base):
    """Per run two rankings of the same candidates, both without ties: by the model's score and by mentions, then id."""
    r = results(spark, base).select(F.col("analysis_run_id").alias("run"), F.col("candidate_id").alias("id"), "direct_model_score", "mention_count")
    r = numbered(r, ["run"], [F.desc("direct_model_score"), F.col("id")], "expert")
    r = numbered(r, ["run"], [F.desc("mention_count"), F.col("id")], "guess")
    return r.withColumn("expert", F.col("expert") + 1).withColumn("guess", F.col("guess") + 1)


def rank_spearman(spark, base):
    m = metrics.spearman(_ranked(spark, base), ["run"], "direct_model_score", "mention_count")
    return m.select("run", "n", F.round("spearman", 6).alias("spearman"))


def rank_kendall(spark, base):
    return metrics.kendall(_ranked(spark, base), ["run"], "expert", "guess").select("run", F.round("kendall", 9).alias("kendall"))


def rank_quality(spark, base):
    q = metrics.ranking_quality(_ranked(spark, base), ["run"], "expert", "guess")
    return q.select("run", *[F.round(c, 6).alias(c) for c in ("mrr", "top1", "top3")])


def rank_ndcg(spark, base):
    """NDCG of each run over all of its candidates."""
    return metrics.ranking_quality(_ranked(spark, base), ["run"], "expert", "guess").select("run", F.round("ndcg", 6).alias("ndcg"))


def score_errors(spark, base):
    e = metrics.errors(results(spark, base), ["item_type"], "structured_score", "direct_model_score")
    return e.select("item_type", "n", F.round("mae", 9).alias("mae"), F.round("rmse", 9).alias("rmse"))


def even_sample(spark, base):
    r = table(spark, base, "eval_items")
    w = ranking.Window.partitionBy("suite")
    r = r.withColumn("pos", F.row_number().over(w.orderBy("item_id")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    return metrics.evenly(r, "pos", F.col("n"), 12).select("suite", "item_id")


def baseline_tops(spark, base):
    """The first candidate of each run under each of the plain orderings."""
    r = results(spark, base)
    order = {
        "business_score": F.coalesce(F.nanvl("business_score", F.lit(0.0)), F.lit(0.0)), "mention_frequency": F.col("mention_count").cast("double"),
        "validation_support": F.coalesce(F.nanvl("support_score", F.lit(0.0)), F.lit(0.0)), "candidate_order": -F.col("candidate_id").cast("double"),
    }
    best = [F.max_by("candidate_id", F.struct(c, (-F.col("candidate_id")).alias("neg"))).alias(n) for n, c in order.items()]
    return r.groupBy("analysis_run_id").agg(*best)


def dataset_invariants(spark, base):
    e = table(spark, base, "eval_items")
    return e.groupBy("suite").agg(F.count(F.lit(1)).alias("items"), F.count_distinct("item_id").alias("ids"), F.count_if(F.col("split") == "holdout").alias("holdout"),
                                  F.count_if(F.col("text").isNull() | (F.trim("text") == "")).alias("blank"))


FIELDS = ("importance_tier", "decision_centrality", "priority_expression")


def rescoring_fields(spark, base):
    """How far the last scoring of a candidate agrees with its first, field by field."""
    r = table(spark, base, "importance_results").groupBy("analysis_run_id", "candidate_id").agg(
        F.count_distinct("scored_at").alias("times"),
        *[f(F.col(c), F.struct("scored_at", c)).alias(f"{k}_{c}") for c in FIELDS for k, f in (("first", F.min_by), ("last", F.max_by))],
    ).filter("times > 1")
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"first_{c}").alias("actual"), F.col(f"last_{c}").alias("guess")) for c in FIELDS]))
    out = metrics.report(r.select(pairs.alias("p")).select("p.*"), "actual", "guess", ["field"])
    return out.select("field", "count", *[F.round(c, 9).alias(c) for c in ("accuracy", "macro_precision", "macro_recall", "macro_f1")])


def precheck_attribution(spark, base):
    """Per reason of the hard rules: how many candidates it settles, and how many of those the stored verdict rejects too."""
    s = signals(spark, base).select("id", "analysis_run_id", rules.first_reason(_hard()).alias("reason"))
    r = results(spark, base).select(F.col("candidate_id").alias("id"), "analysis_run_id", "validation_verdict")
    j = s.filter("reason is not null").join(r.filter("validation_verdict is not null"), ["id", "analysis_run_id"])
    agree = F.count_if(F.col("validation_verdict") == "reject")
    return j.groupBy("reason").agg(F.count(F.lit(1)).alias("resolved"), agree.alias("agreed"), F.round(metrics.ratio(agree, F.count(F.lit(1))), 9).alias("precision"))


QUERIES = {f.__name__: f for f in (
    rescoring_fields, precheck_attribution, tier_confusion, tier_classes, tier_report, label_sets, score_thresholds, merge_threshold, average_precision, eval_split, value_percentiles, order_sensitivity,
    rank_spearman, rank_kendall, rank_quality, rank_ndcg, score_errors, even_sample, baseline_tops, dataset_invariants,
)}

_TIERS = f"{R}, {_LEVEL}, x as (select item_type, importance_tier as actual, nullif({_TIER}, 'medium') as guess from l)"
_CLASSES = f"""{_TIERS}, y as (select distinct item_type, unnest([actual, guess]) as label from x), z as (select item_type, label,
    (select count(*) from x where x.item_type = y.item_type and actual = label and guess = label) as tp, (select count(*) from x where x.item_type = y.item_type and guess = label) as named,
    (select count(*) from x where x.item_type = y.item_type and actual = label) as support from y where label is not null),
    pr as (select item_type, label, support, case when named = 0 then 0.0 else tp / named end as precision, case when support = 0 then 0.0 else tp / support end as recall from z),
    cl as (select *, case when precision + recall = 0 then 0.0 else 2 * precision * recall / (precision + recall) end as f1 from pr)"""
_LAB = "p as (select bi_encoder_score as s, proposed_duplicate as y from pair_diagnostics where proposed_duplicate is not null and bi_encoder_score is not null)"
_THR = f"""{_LAB}, th as (select distinct s as t from p union select 0.0::double union select 1.0::double),
    cn as (select t, (select count(*) from p where s >= t and y) as tp, (select count(*) from p where s >= t and not y) as fp from th),
    tt as (select *, (select count(*) from p where y) - tp as fn, (select count(*) from p where not y) - fp as tn, case when tp + fp = 0 then 0.0 else tp / (tp + fp) end as pr,
        tp / (select count(*) from p where y) as rc from cn),
    tf as (select *, case when pr + rc = 0 then 0.0 else 2 * pr * rc / (pr + rc) end as f1, case when pr + rc = 0 then 0.0 else 1.25 * pr * rc / (0.25 * pr + rc) end as f05 from tt)"""
_RANKED = f"""{R}, k as (select analysis_run_id as run, candidate_id as id, direct_model_score as d, mention_count as m,
    row_number() over (partition by analysis_run_id order by direct_model_score desc, candidate_id) as expert,
    row_number() over (partition by analysis_run_id order by mention_count desc, candidate_id) as guess from r)"""

_RESCORED = """g as (select analysis_run_id, candidate_id, {pick} from importance_results group by all having count(distinct scored_at) > 1),
    x as ({rows}), y as (select distinct field, unnest([actual, guess]) as label from x),
    z as (select field, label, (select count(*) from x where x.field = y.field and actual = label and guess = label) as tp, (select count(*) from x where x.field = y.field and guess = label) as named,
        (select count(*) from x where x.field = y.field and actual = label) as support from y),
    pr as (select field, case when named = 0 then 0.0 else tp / named end as p, case when support = 0 then 0.0 else tp / support end as r from z),
    m as (select field, avg(p) as mp, avg(r) as mr, avg(case when p + r = 0 then 0.0 else 2 * p * r / (p + r) end) as mf from pr group by all)""".format(
    pick=", ".join(f"arg_min({c}, struct_pack(a := scored_at, b := {c})) as f_{c}, arg_max({c}, struct_pack(a := scored_at, b := {c})) as l_{c}" for c in FIELDS),
    rows=" union all ".join(f"select '{c}' as field, f_{c} as actual, l_{c} as guess from g" for c in FIELDS),
)

SQL = {
    "rescoring_fields": f"""with {_RESCORED} select x.field, count(*) as count, round(count(*) filter (actual = guess) / count(*), 9) as accuracy, round(any_value(mp), 9) as macro_precision,
        round(any_value(mr), 9) as macro_recall, round(any_value(mf), 9) as macro_f1 from x join m using (field) group by all""",
    "precheck_attribution": f"""with {S}, {R}, b as (select id, analysis_run_id, case when item_type = 'no_signal' then 'no_signal'
            when coalesce(trim(rationale), '') = '' or coalesce(len(source_turn_ids) <> len(list_distinct(source_turn_ids)), false) then 'malformed_candidate' else 'invalid_confidence' end as reason from s where {_FIRST_BAD})
        select reason, count(*) as resolved, count(*) filter (validation_verdict = 'reject') as agreed, round(count(*) filter (validation_verdict = 'reject') / count(*), 9) as precision
        from b join r on r.candidate_id = b.id and r.analysis_run_id = b.analysis_run_id where validation_verdict is not null group by all""",
    "tier_confusion": f"with {_TIERS} select actual, coalesce(guess, '__missing__') as guess, count(*) as n from x group by all",
    "tier_classes": f"with {_CLASSES} select item_type, label, support, precision, recall, f1 from cl",
    "tier_report": f"""with {_CLASSES}, a as (select item_type, count(*) as count, count(*) filter (actual = guess) / count(*) as accuracy, count(*) filter (guess is null) / count(*) as missing_rate from x group by all)
        select a.item_type, count, accuracy, avg(precision) as macro_precision, avg(recall) as macro_recall, avg(f1) as macro_f1, missing_rate from a join cl using (item_type) group by all""",
    "label_sets": """with s as (select * from candidate_signals qualify row_number() over (partition by id order by created_at) = 1),
        w as (select list_distinct(list_filter(regexp_split_to_array(lower(coalesce(category, '')), '[^a-z0-9]+'), lambda x: x <> '')) as a,
            list_distinct(list_filter(regexp_split_to_array(lower(coalesce(rationale, '')), '[^a-z0-9]+'), lambda x: x <> '')) as g from s),
        c as (select len(list_intersect(a, g)) as tp, len(g) - len(list_intersect(a, g)) as fp, len(a) - len(list_intersect(a, g)) as fn from w),
        t as (select count(*) as n, count(*) filter (fp = 0 and fn = 0) as exact, cast(sum(tp) as bigint) as tp, cast(sum(fp) as bigint) as fp, cast(sum(fn) as bigint) as fn from c)
        select exact / n as exact_match, tp / (tp + fp) as micro_precision, tp / (tp + fn) as micro_recall,
            2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) as micro_f1, fp as false_detections, fn as missed_detections from t""",
    "score_thresholds": f"""with {_THR} select t as threshold, tp as true_positive, fp as false_positive, fn as false_negative, tn as true_negative, round(pr, 9) as precision,
        round(rc, 9) as recall, round(f1, 9) as f1, round(f05, 9) as f05 from tf""",
    "merge_threshold": f"""with {_THR} select t as threshold, tp as true_positive, fp as false_positive, fn as false_negative, tn as true_negative, round(pr, 9) as precision, round(rc, 9) as recall
        from tf order by pr >= 0.9 desc, rc desc, f05 desc, t desc limit 1""",
    "average_precision": f"with {_THR} select round(sum(pr * (select count(*) from p where s = t and y)) / (select count(*) from p where y), 9) as average_precision from tf",
    "eval_split": """with r as (select *, row_number() over (partition by suite order by sha256('split-v1:' || item_id), item_id) as k from eval_items)
        select item_id, suite, case when k <= 7 then 'holdout' else 'development' end as split from r""",
    "value_percentiles": "select event_type, quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.95) as p95 from events group by all",
    "order_sensitivity": """with g as (select least(left_id, right_id) as a, greatest(left_id, right_id) as b, avg(bi_encoder_score) filter (left_id < right_id) as f,
        avg(bi_encoder_score) filter (left_id > right_id) as r from pair_diagnostics where left_id <> right_id group by all), d as (select abs(f - r) as d from g where f is not null and r is not null)
        select count(*) as pairs, round(avg(d), 9) as mean, round(min(d), 9) as low, round(max(d), 9) as high from d""",
    "rank_spearman": f"""with {_RANKED}, q as (select run, rank() over (partition by run order by d) + (count(*) over (partition by run, d) - 1) / 2.0::double as rx,
        rank() over (partition by run order by m) + (count(*) over (partition by run, m) - 1) / 2.0::double as ry from k)
        select run, count(*) as n, round(case when count(*) < 2 or var_pop(rx) = 0 or var_pop(ry) = 0 then 0.0 else corr(rx, ry) end, 6) as spearman from q group by run""",
    "rank_kendall": f"""with {_RANKED} select a.run, round(case when count(b.id) = 0 then 0.0 else sum(sign((a.expert - b.expert) * (a.guess - b.guess))) / sum(abs(sign((a.expert - b.expert) * (a.guess - b.guess)))) end, 9) as kendall
        from k a left join k b on a.run = b.run and a.id < b.id group by a.run""",
    "rank_quality": f"""with {_RANKED}, f as (select run, min(guess) filter (expert = 1) as g from k group by run)
        select run, round(1.0::double / g, 6) as mrr, cast(g = 1 as double) as top1, cast(g <= 3 as double) as top3 from f""",
    "rank_ndcg": f"""with {_RANKED}, t as (select run, expert, guess, pow(2.0::double, -expert) - pow(2.0::double, -(count(*) over (partition by run) + 1)) as gain from k)
        select run, round(sum(gain / log2(guess + 1)) / sum(gain / log2(expert + 1)), 6) as ndcg from t group by run""",
    "score_errors": f"""with {R} select item_type, count(*) as n, round(avg(abs(structured_score - direct_model_score)), 9) as mae, round(sqrt(avg(pow(structured_score - direct_model_score, 2))), 9) as rmse
        from r where structured_score is not null and not isnan(structured_score) group by all""",
    "even_sample": """with r as (select suite, item_id, row_number() over (partition by suite order by item_id) - 1 as pos, count(*) over (partition by suite) as n from eval_items)
        select suite, item_id from r where n <= 12 or list_contains([i * n // 12 for i in range(12)], pos)""",
    "baseline_tops": f"""with {R}, c as (select *, case when isnan(business_score) or business_score is null then 0 else business_score end as bs, case when isnan(support_score) or support_score is null then 0 else support_score end as ss from r)
        select analysis_run_id, first(candidate_id order by bs desc, candidate_id) as business_score, first(candidate_id order by mention_count desc, candidate_id) as mention_frequency,
        first(candidate_id order by ss desc, candidate_id) as validation_support, min(candidate_id) as candidate_order from c group by all""",
    "dataset_invariants": "select suite, count(*) as items, count(distinct item_id) as ids, count(*) filter (split = 'holdout') as holdout, count(*) filter (text is null or trim(text) = '') as blank from eval_items group by all",
}

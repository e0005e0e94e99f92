"""The pN queries over the tables of a folder, with their production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import darts, groups, leakage, spam, survivor, tokens, topn, turns

#: The allowed values of the two voted fields.
FACTOR_KINDS = (
    "explicit_commitment", "current_pain", "desired_outcome", "future_condition", "future_risk", "incompatibility",
    "dependency", "procedural_diligence", "information_request", "factual_background", "preference",
)
EVIDENCE_STRENGTHS = ("explicit", "implied")


#: The time that votes are aged from; a later record has age 0.
VOTES_AS_OF = "2026-06-01 00:00:00"


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    links = table(spark, base, "pair_diagnostics").filter("proposed_duplicate")
    return groups.connected_groups(links, "left_id", "right_id")


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    """Every pair of ids, as TESTDATA defines it; the operator itself stops at classes and their representatives."""
    signals = table(spark, base, "candidate_signals")
    return darts.all_pairs(*darts.near_duplicates(signals, "id", ["advisor_quote", "rationale", "category"], threshold=0.7))


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    return turns.speaker_turns(table(spark, base, "transcripts"), table(spark, base, "transcript_turns"), table(spark, base, "participants"))


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "importance_results").filter("candidate_id is not null")
    last = topn.latest_per_item(rows, ["analysis_run_id", "candidate_id"], "scored_at", ["structured_score", "item_type"])
    last = last.withColumn("item_type", F.lower(F.regexp_replace("item_type", r"^\s+|\s+$", "")))
    best = topn.top_n_per_group(last, ["analysis_run_id", "item_type"], "structured_score", "candidate_id", 3)
    return best.select("analysis_run_id", "item_type", "place", "candidate_id")


def _enum(name: str, allowed: tuple[str, ...]):
    plain = F.regexp_replace(F.lower(F.regexp_replace(name, r"^\s+|\s+$", "")), r"[\s\-]", "_")
    return F.when(plain.isin(*allowed), plain)


def _filled(name: str):
    return F.col(name).isNotNull() & F.col(name).rlike(r"\S")


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    confidence = F.col("extraction_confidence")
    trust = F.when(confidence.between(0.0, 1.0), confidence)
    kind, strength = _enum("factor_kind", FACTOR_KINDS), _enum("evidence_strength", EVIDENCE_STRENGTHS)
    how = survivor.Survivorship(
        group="duplicate_group_id", id="id", trust=trust, recency=F.col("created_at"),
        fields={"factor_kind": kind, "evidence_strength": strength},
        usable=[trust.isNotNull(), kind.isNotNull(), strength.isNotNull(), _filled("category"), _filled("timestamp"), _filled("rationale")],
    )
    return survivor.surviving_records(table(spark, base, "candidate_signals"), how)


def p5_votes(spark: SparkSession, base: str) -> DataFrame:
    """The general vote: trust times decay (halved every 30 days before the last record) summed per value, for factor kind and evidence strength."""
    signals = table(spark, base, "candidate_signals")
    confidence = F.col("extraction_confidence")
    trust = F.when(confidence.between(0.0, 1.0), confidence)
    how = survivor.Survivorship(
        group="duplicate_group_id", id="id", trust=trust, recency=F.col("created_at"), half_life_days=30.0, as_of=F.lit(VOTES_AS_OF).cast("timestamp"),
        fields={"factor_kind": _enum("factor_kind", FACTOR_KINDS), "evidence_strength": _enum("evidence_strength", EVIDENCE_STRENGTHS)}, usable=[trust.isNotNull()],
    )
    return survivor.surviving_records(signals, how)


def p6_text(spark: SparkSession, base: str) -> DataFrame:
    """Every text again from its ids, through the token-byte table."""
    return tokens.decode_corpus(tokens.encode_corpus(table(spark, base, "documents")))


def p6_ids(spark: SparkSession, base: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, base, "documents"))


def p7_found(spark: SparkSession, base: str) -> DataFrame:
    return leakage.leaked_items(table(spark, base, "documents"), table(spark, base, "eval_items"), window=13, max_edits=0)


def p7_edited(spark: SparkSession, base: str) -> DataFrame:
    """Documents with 13 words of an item, one of which may be changed, left out or put in."""
    return leakage.leaked_items(table(spark, base, "documents"), table(spark, base, "eval_items"), window=13, max_edits=1, recall=0.99)


def p8_found(spark: SparkSession, base: str) -> DataFrame:
    return spam.spam_pages(table(spark, base, "documents"))


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p3_found": p3_found, "p4_found": p4_found, "p5_found": p5_found, "p5_votes": p5_votes, "p6_ids": p6_ids, "p6_text": p6_text, "p7_found": p7_found, "p7_edited": p7_edited, "p8_found": p8_found}

SQL: dict[str, str] = {
    "p1_found": """with recursive l as (select left_id as a, right_id as b from pair_diagnostics where proposed_duplicate and left_id <> right_id),
        bi as (select a, b from l union select b, a from l), reach(n, m) as (select a, b from bi union select r.n, bi.b from reach r join bi on bi.a = r.m)
        select n as record_id, least(n, min(m)) as group_id from reach group by n""",
    "p2_found": """with s as (select id, list_distinct(regexp_extract_all(lower(concat_ws(' ', advisor_quote, rationale, category)), '[a-z0-9]+')) as w
            from candidate_signals qualify row_number() over (partition by id order by created_at) = 1),
        e as (select id, len(w) as n, unnest(w) as x from s),
        c as (select a.id as l, b.id as r, any_value(a.n) as ln, any_value(b.n) as rn, count(*) as k from e a join e b on a.x = b.x and a.id < b.id group by a.id, b.id)
        select l as left_id, r as right_id from c where k >= 0.7 * (ln + rn - k) - 1e-9""",
    "p4_found": """with r as (select * from importance_results qualify row_number() over (partition by analysis_run_id, candidate_id order by scored_at desc) = 1),
        x as (select analysis_run_id, lower(trim(item_type)) as item_type, candidate_id, structured_score from r where structured_score is not null and not isnan(structured_score))
        select analysis_run_id, item_type, cast(place as int) as place, candidate_id from
            (select *, row_number() over (partition by analysis_run_id, item_type order by structured_score desc, candidate_id) as place from x) where place <= 3""",
    "p5_found": """with s as (select *, case when extraction_confidence between 0 and 1 then extraction_confidence end as c,
            regexp_replace(lower(trim(factor_kind)), '[\\s-]', '_', 'g') as k, regexp_replace(lower(trim(evidence_strength)), '[\\s-]', '_', 'g') as e
            from candidate_signals where duplicate_group_id is not null qualify row_number() over (partition by id order by created_at) = 1),
        u as (select *, case when k in ('explicit_commitment', 'current_pain', 'desired_outcome', 'future_condition', 'future_risk', 'incompatibility', 'dependency',
            'procedural_diligence', 'information_request', 'factual_background', 'preference') then k end as kk, case when e in ('explicit', 'implied') then e end as ee from s),
        f as (select *, (c is not null)::int + (kk is not null)::int + (ee is not null)::int + (coalesce(trim(category), '') <> '')::int
            + (coalesce(trim(timestamp), '') <> '')::int + (coalesce(trim(rationale), '') <> '')::int as n from u)
        select duplicate_group_id, first(id order by n desc, coalesce(c, -1) desc, created_at desc, id) as signal_id,
            coalesce(first(kk order by coalesce(c, -1) desc, created_at desc, id) filter (kk is not null), '') as factor_kind,
            coalesce(first(ee order by coalesce(c, -1) desc, created_at desc, id) filter (ee is not null), '') as evidence_strength
        from f group by all having count(distinct id) > 1""",
    "p6_text": "select doc_id, coalesce(text, '') as text from documents",
    "p5_votes": f"""with s as (select *, case when extraction_confidence between 0 and 1 then extraction_confidence end as c, regexp_replace(lower(trim(factor_kind)), '[\\s-]', '_', 'g') as k,
            regexp_replace(lower(trim(evidence_strength)), '[\\s-]', '_', 'g') as e from candidate_signals where duplicate_group_id is not null qualify row_number() over (partition by id order by created_at) = 1),
        w as (select *, coalesce(c, 0) * power(2.0::double, -greatest(0, (epoch_us(timestamp '{VOTES_AS_OF}') - epoch_us(created_at)) / 86400e6) / 30.0) as vote,
            case when k in {FACTOR_KINDS} then k end as kk, case when e in {EVIDENCE_STRENGTHS} then e end as ee from s),
        ks as (select duplicate_group_id, kk, sum(vote) as v, max(struct_pack(t := coalesce(c, -1), at := created_at, neg := -id)) as top from w where kk is not null group by all),
        es as (select duplicate_group_id, ee, sum(vote) as v, max(struct_pack(t := coalesce(c, -1), at := created_at, neg := -id)) as top from w where ee is not null group by all),
        l as (select duplicate_group_id, first(id order by (c is not null) desc, coalesce(c, -1) desc, created_at desc, id) as signal_id from w group by all having count(distinct id) > 1)
        select l.duplicate_group_id, signal_id, coalesce((select first(kk order by v desc, top desc) from ks where ks.duplicate_group_id = l.duplicate_group_id), '') as factor_kind,
            coalesce((select first(ee order by v desc, top desc) from es where es.duplicate_group_id = l.duplicate_group_id), '') as evidence_strength from l""",
    "p7_found": """with d as (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as w from documents where text is not null),
        i as (select item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as w from eval_items),
        dw as (select doc_id, array_to_string(w[p:p + 12], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 11)) as p from d)),
        iw as (select item_id, array_to_string(w[p:p + 12], ' ') as g from (select item_id, w, unnest(range(1, len(w) - 11)) as p from i))
        select distinct doc_id, item_id from dw join iw using (g)""",
    "p7_edited": """with d as (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as w from documents where text is not null),
        i as (select item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as w from eval_items),
        iw as (select distinct item_id, w[p:p + 12] as a from (select item_id, w, unnest(range(1, len(w) - 11)) as p from i)),
        dp as (select doc_id, w, unnest(range(1, len(w) + 1)) as p from d),
        heads as (select doc_id, array_to_string(w[p:p + 5], ' ') as g, w[p + 6:p + 13] as t from dp where len(w) >= p + 5),
        tails as (select doc_id, array_to_string(w[p:p + 6], ' ') as g, list_reverse(w[greatest(1, p - 7):p - 1]) as t from dp where len(w) >= p + 6),
        c as (select item_id, doc_id, a[7:13] as r, t from iw join heads on g = array_to_string(a[1:6], ' ')
            union all select item_id, doc_id, list_reverse(a[1:6]) as r, t from iw join tails on g = array_to_string(a[7:13], ' ')),
        m as (select *, len(r) as n, coalesce(list_min([k for k in range(1, len(r) + 1) if r[k] is distinct from t[k]]), len(r) + 1) as x from c)
        select distinct doc_id, item_id from m where x > n or t[x + 1:n] = r[x + 1:n] or t[x:n - 1] = r[x + 1:n] or t[x + 1:n + 1] = r[x:n]""",
}

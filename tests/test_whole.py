"""Operators that must see all of their input: no cap, no fallback left out."""

import json
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from colloquy.operators import evidence, metrics, views
from colloquy.plans import run_queries, signal_queries, turn_queries

BASE = os.environ.get("COLLOQUY_TESTDATA", "/root/testdata/sf0.001")


def test_ndcg_over_groups_of_any_size(spark):
    orders = {"tail": [40, *range(1, 40)], "large": random.Random(2).sample(range(1, 1301), 1300)}
    data = [(g, e, p) for g, order in orders.items() for p, e in enumerate(order, 1)]
    got = {r.g: r.ndcg for r in metrics.ranking_quality(spark.createDataFrame(data, "g string, e int, p int"), ["g"], "e", "p").collect()}
    for g, order in orders.items():
        n = len(order)
        gain = {e: 2.0**-e - 2.0 ** -(n + 1) for e in order}
        want = sum(gain[e] / math.log2(p + 1) for p, e in enumerate(order, 1)) / sum(gain[e] / math.log2(e + 1) for e in order)
        assert abs(got[g] - want) < 1e-9, g
    assert got["tail"] < 0.9


TURNS = "id long, transcript_id long, pos int, timestamp string, raw_speaker_label string, inferred_role string, role_confidence double, text string"
SIGNALS = "id long, transcript_id long, advisor_quote string, timestamp string, source_turn_ids array<long>"


def _turns(spark, texts, roles=None):
    return spark.createDataFrame([(10 + i, 1, i, f"0:0{i}", "A", (roles or ["advisor"] * len(texts))[i], 0.9, t) for i, t in enumerate(texts)], TURNS)


def test_rank_context_takes_the_whole_range(spark):
    t = _turns(spark, list("abcdefghi"))
    s = spark.createDataFrame([(1, 1, "q", None, [11, 17]), (2, 1, "quote", None, None), (3, 1, "far", None, [99]), (4, 1, "q", None, [10]), (5, 1, "q", None, [12, 13, 14, 15])], SIGNALS)
    assert {r.id: r.context for r in evidence.rank_context(s, t).collect()} == {1: "a b c d e f g h i", 2: "quote", 3: "far", 4: "a b", 5: "b c d e f g"}


def test_locate_falls_back_to_containment(spark):
    t = _turns(spark, ["we like the “fee” schedule", "the fee schedule", "so the fee schedule it is", "we like  the fee", "only the rep said this"], ["advisor"] * 4 + ["optimize_rep"])
    quotes = ['like the "fee" schedule', "the fee schedule", "fee schedule", "fee schedule", "LIKE THE FEE", "the rep said", "like the fee", " "]
    s = spark.createDataFrame([(i, 1, q, "0:02" if i == 3 else None, None) for i, q in enumerate(quotes)], SIGNALS)
    # 1 equals a turn that others contain; 2 is left ambiguous, the time settles 3
    assert {r.id: r.turn_id for r in views.locate(s, t).collect()} == {0: 10, 1: 11, 2: None, 3: 12, 4: None, 5: None, 6: 13, 7: None}


def test_source_without_a_fitting_citation_is_searched(spark):
    t = _turns(spark, ["one plan only", "the same words", "the same words", "said by the rep", "more words here"], ["advisor"] * 3 + ["optimize_rep", "advisor"])
    data = [("one plan", None, None), ("one plan only", None, [14]), ("same words", None, None), ("same words", "0:02", [99]), ("by the rep", None, [13]), ("words here", None, [14]), ("the same words", None, [11])]
    s = spark.createDataFrame([(i, 1, q, at, ids) for i, (q, at, ids) in enumerate(data)], SIGNALS)
    got = {r.id: (r.matches, r.turn_id, r.method) for r in evidence.resolve_source(s, t).collect()}
    assert got == {
        0: (1, 10, "unique_quote"), 1: (1, 10, "unique_quote"), 2: (2, None, None), 3: (2, 12, "unique_quote_timestamp"), 4: (0, None, None),
        5: (1, 14, "source_turn_id"), 6: (1, 11, "source_turn_id"),
    }


def test_rationale_is_grounded_by_neighbouring_turns(spark, tmp_path):
    told = _turns(spark, ["we wait since rates fell", "the quote", "end"]).withColumnRenamed("pos", "turn_index")
    told.write.parquet(f"{tmp_path}/transcript_turns.parquet")
    s = spark.createDataFrame([(1, 1, "the quote", None, [11]), (2, 1, "the quote", None, None), (3, 1, "since then", None, None)], SIGNALS)
    s.withColumn("rationale", F.lit("because of x")).write.parquet(f"{tmp_path}/candidate_signals.parquet")
    got = {r.id: r.rationale for r in signal_queries.grounded_in_context(spark, str(tmp_path)).collect()}
    assert got == {1: "because of x", 2: 'The advisor states, "the quote"', 3: "because of x"}


@pytest.mark.skipif(not os.path.isdir(BASE), reason="supplied tables are not here")
def test_export_holds_every_supporting_quote(spark):
    rows = run_queries.export_table(spark, BASE).collect()
    held = [json.loads(r.supporting_evidence) for r in rows]
    width = max(1, *map(len, held))
    assert width > 1 and sum("supporting_quote_" in c for c in rows[0].asDict()) == width
    for r, items in zip(rows, held):
        items = items + [{"quote": "", "timestamp": ""}] * (width - len(items))
        for i, x in enumerate(items, 1):
            assert r[f"supporting_quote_{i}"] == (x["quote"] or "") and r[f"supporting_timestamp_{i}"] == (x["timestamp"] or "")


def test_quote_matches_of_all_kinds(spark):
    t = _turns(spark, ["We like the fee schedule a lot", "a lot", "nothing here"])
    quotes = ["like the fee", "Like the fee", "a lot", "here", "never said by anyone", "We like the fee schedule a lot", " "]
    s = spark.createDataFrame([(i, 1, q, None, None) for i, q in enumerate(quotes)], SIGNALS)
    got = {r.id: (r.matches, r.turn_id) for r in evidence.quote_matches(s, t).collect()}
    assert got == {0: (1, 10), 1: (0, None), 2: (2, None), 3: (1, 12), 4: (0, None), 5: (1, 10), 6: (0, None)}
    assert {"signal_quote_matches"} <= set(turn_queries.QUERIES) & set(turn_queries.SQL)

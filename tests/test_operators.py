"""Core operators on small inputs with known or brute-force results."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from colloquy.functions import text as tx
from colloquy.functions.vectors import cosine, sigmoid
from colloquy.operators import dedup, evidence, export, graph, importance, metrics, ranking, rules, runs, segmentation, sequence, skew, telemetry, views
from colloquy.sources import files


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_numbered_and_neighbours_split_a_hot_group(spark, monkeypatch):
    monkeypatch.setattr(sequence, "BLOCK", 7)
    data = [(1, i, f"a{i}") for i in range(100)] + [(2, 5, "b"), (None, 1, "n"), (None, 2, "m")]
    random.Random(3).shuffle(data)
    df = spark.createDataFrame(data, "g long, k long, v string")
    got = sequence.numbered(df, ["g"], ["k"])
    assert {(r.g, r.k): r.pos for r in got.collect()} == {**{(1, i): i for i in range(100)}, (2, 5): 0, (None, 1): 0, (None, 2): 1}
    near = sequence.with_neighbours(got.filter("g = 1"), ["g"], "pos", ["v"], reach=2)
    by = {r.pos: r for r in near.collect()}
    assert len(by) == near.count() == 100
    for i in range(100):
        assert by[i].v_m1 == (f"a{i - 1}" if i else None) and by[i].v_p2 == (f"a{i + 2}" if i < 98 else None)


def test_numbered_empty(spark):
    assert sequence.numbered(spark.createDataFrame([], "g long, k long"), ["g"], ["k"]).count() == 0


def test_batches(spark):
    df = spark.createDataFrame([(i,) for i in range(5)], "pos int")
    assert [r.batch for r in sequence.batched(df, "pos", 2).orderBy("pos").collect()] == [1, 1, 2, 2, 3]


def _plain_lines(raw):
    """The rules of the line layout, said once more in plain Python."""
    time = r"\d{1,2}:\d{2}:\d{2}"
    ok = lambda s: bool(s.strip()) and len(s.split()) <= 8 and not re.search("[.!?]", s)
    turns, open_, pending = [], None, None
    for line in raw.splitlines():
        line = line.strip()
        if not line:
            continue
        head = None
        if (m := re.fullmatch(rf"({time})\s+([^:]{{1,100}}):\s*(.*)", line)) and ok(m[2]):
            head = (m[2].strip(), m[1], m[3])
        elif (m := re.fullmatch(rf"(.+?)\s+({time})\s*:?[ \t]*", line)) and ok(m[1]):
            turns.append(open_ := [m[2], m[1].strip(), []])
            pending = None
            continue
        elif re.fullmatch(time, line):
            open_, pending = None, line
            continue
        elif (m := re.fullmatch(r"([^:]{1,100}):\s*(.*)", line)) and ok(m[1]):
            head = (m[1].strip(), pending, m[2])
        if head and head[0].lower() in segmentation.METADATA:
            open_, pending = None, None
        elif head:
            turns.append(open_ := [head[1], head[0], [head[2]] if head[2] else []])
            pending = None
        else:
            if open_ is None:
                turns.append(open_ := [pending, "unknown", []])
                pending = None
            open_[2].append(line)
    turns = [t for t in turns if t[2]]
    return [(i, t[0], t[1], "\n".join(t[2])) for i, t in enumerate(turns)]


LINES = [
    "00:01:00 Ann Lee: hello there", "Ann Lee 00:01:05\nfirst part\nsecond part\nBob: yes", "no header at all\nstill none",
    "00:00:10\n\nBob: timed\nAnn: untimed", "Meeting ID: 1 2\nMeeting Topic: x\nspeech after header", "00:01:23 hello", "Bob:\n\nAnn: only Ann speaks",
    "00:00:01\n00:00:02\ntext after two times", "What I want is this. Right: no label", "", "   \n \n", "00:00:09\nMeeting ID: 4\nBob: cleared",
    "00:00:05\nfree words\nmore words\nBob 00:00:06:\nlate",
]


def test_line_segments_match_the_rules(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(LINES)] + [(99, None)], "id long, raw_text string")
    got = rows(segmentation.line_segments(df).select("doc_id", "turn_index", "timestamp", "raw_speaker_label", "text"))
    want = sorted((i, *t) for i, raw in enumerate(LINES) for t in _plain_lines(raw))
    assert got == want


def test_line_segments_random(spark):
    rng = random.Random(5)
    pool = ["00:00:01", "Ann: hi", "Bob 0:00:02", "plain words", "00:00:03 Ann: x", "Host Email: y", "", "Why? no: z", "Bob:"]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randint(1, 9))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, raw_text string")
    got = rows(segmentation.line_segments(df).select("doc_id", "turn_index", "timestamp", "raw_speaker_label", "text"))
    assert got == sorted((i, *t) for i, raw in enumerate(texts) for t in _plain_lines(raw))


def test_flat_segments(spark):
    raw = "Meeting ID: 7 00:00:01.5 --> 00:00:02 [ADVISOR_1]: one 00:00:03 --> 00:00:04 [OPTIMIZE_REP] dropped 00:00:05 --> 00:00:06 [Guest]: dropped 0:00:07 --> 0:00:09 [advisor]: two"
    df = spark.createDataFrame([(1, raw), (2, "Ann: line"), (3, None), (4, "")], "id long, raw_text string")
    got = rows(segmentation.flat_segments(df))
    assert got == [(1, 0, "00:00:01.5", "ADVISOR_1", "advisor", 1.0, "one"), (1, 1, "0:00:07", "ADVISOR", "advisor", 1.0, "two")]


TURNS = "id long, transcript_id long, pos int, timestamp string, raw_speaker_label string, inferred_role string, role_confidence double, text string"
SIGNALS = "id long, transcript_id long, advisor_quote string, timestamp string, source_turn_ids array<long>"


def _turns(spark, texts, roles=None, labels=None):
    return spark.createDataFrame(
        [(10 + i, 1, i, f"0:0{i}", (labels or ["A"] * len(texts))[i], (roles or ["advisor"] * len(texts))[i], 0.9, t) for i, t in enumerate(texts)], TURNS
    )


def test_owner_neighbourhood(spark):
    t = _turns(spark, list("abcdef"), ["optimize_rep", "advisor", "optimize_rep", "optimize_rep", "unknown", None])
    assert [r.pos for r in evidence.owner_neighbourhood(t).orderBy("pos").collect()] == [0, 1, 2]


def test_context_window(spark):
    t = _turns(spark, ["so it begins", "and then we", "the full quote", "which goes on,", "and on", "end"])
    s = spark.createDataFrame([(1, 1, "the full quote", None, [12]), (2, 1, "full", None, [12]), (3, 1, "absent", None, [12]), (4, 1, "x", None, None), (5, 1, "end", None, [15, 15, 99])], SIGNALS)
    got = {}
    for r in evidence.context_window(s, t).collect():
        got.setdefault(r.id, []).append(r.pos)
    # the extra turns on both sides belong to the same speaker's unfinished thought
    assert {k: sorted(v) for k, v in got.items()} == {1: [0, 1, 3, 4], 2: [0, 1, 2, 3, 4], 5: [3, 4]}


def test_resolution_and_completion(spark):
    t = _turns(spark, ["one and", "that is it", "that is it"])
    s = spark.createDataFrame([(1, 1, "that", None, [11]), (2, 1, "that", "0:02", [11, 12]), (3, 1, "that", None, [11, 12]), (4, 1, "nothing", None, [11])], SIGNALS)
    got = {r.id: (r.matches, r.turn_id, r.method) for r in evidence.resolve_source(s, t).collect()}
    assert got == {1: (1, 11, "source_turn_id"), 2: (2, 12, "source_turn_id_timestamp"), 3: (2, None, None), 4: (0, None, None)}
    done = {r.id: (r.previous_id, r.next_id) for r in evidence.completion_turns(s, t).collect()}
    assert done == {1: (10, None)}


def test_first_wins_and_grounding(spark):
    df = spark.createDataFrame([(1, "a", 2), (2, "A ", 1), (3, "b", 1), (4, None, 1), (5, None, 0)], "id long, c string, o int")
    assert sorted(r.id for r in evidence.first_wins(df, [F.lower(F.trim("c"))], ["o", "id"]).collect()) == [2, 3, 5]
    g = spark.createDataFrame([("because x", "y"), ("because x", "because y"), (None, "z")], "r string, q string")
    got = [r[0] for r in g.select(evidence.grounded(F.col("r"), F.col("q"), F.col("q"), [("because", "because")])).collect()]
    assert got == ['The advisor states, "y"', "because x", None]


def test_text_functions(spark):
    df = spark.createDataFrame([("I i don't DON'T know", ), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(tx.quote_words(F.col("t"))).collect()] == ["i don't know", "", None]
    broken = spark.createDataFrame([("a â€” b â€™",), ("fine — ’",), (None,)], "t string")
    assert [r[0] for r in broken.select(tx.repair_mojibake(F.col("t"))).collect()] == ["a — b ’", "fine — ’", None]
    assert [r[0] for r in spark.createDataFrame([("x" * 9,), ("",), (None,)], "t string").select(tx.token_estimate(F.col("t"))).collect()][:2] == [2, 1]


def test_rules(spark):
    df = spark.createDataFrame([(1, None), (5, "x"), (9, "y")], "a int, b string")
    hard = [("small", F.col("a") < 3), ("x", F.col("b") == "x"), ("small", F.col("a") < 2)]
    soft = [("y", F.col("b") == "y")]
    got = df.select(rules.reasons(hard).alias("h"), rules.first_reason(hard).alias("f"), rules.verdict(rules.reasons(hard), rules.reasons(soft)).alias("v")).collect()
    assert [(r.h, r.f, r.v) for r in got] == [(["small"], "small", "reject"), (["x"], "x", "reject"), ([], None, "needs_review")]
    c = spark.createDataFrame([(0.1, "low"), (0.9, "low"), (0.5, "other"), (None, "low")], "v double, k string")
    assert [r[0] for r in c.select(rules.clamp(F.col("v"), F.col("k"), {"low": (0.2, 0.6)})).collect()] == [0.2, 0.6, 0.5, None]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0], [1.0]), ([1.0], [1.0, 2.0]), ([], []), (None, [1.0])], "a array<double>, b array<double>")
    assert [round(r[0], 6) for r in df.select(cosine(F.col("a"), F.col("b"))).collect()] == [0.707107, 0.0, 0.0, 0.0, 0.0]
    x = spark.createDataFrame([(0.0,), (800.0,), (-800.0,), (float("nan"),), (None,)], "x double")
    assert [r[0] for r in x.select(sigmoid(F.col("x"))).collect()] == [0.5, 1.0, 0.0, None, None]


def test_similar_pairs_in_tiles(spark):
    rng = random.Random(9)
    data = [(i, rng.choice(["x", None]), [rng.choice([0.0, 1.0]) for _ in range(rng.choice([3, 4]))]) for i in range(60)] + [(90, "x", None), (91, "x", []), (92, "x", [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(data, "id long, g string, v array<double>")

    def cos(a, b):
        n = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
        return sum(x * y for x, y in zip(a, b)) / n if len(a) == len(b) and n else 0.0

    want = sorted((a[0], b[0]) for a, b in itertools.combinations([d for d in data if d[2]], 2) if a[1] == b[1] and cos(a[2], b[2]) >= 0.7)
    assert rows(dedup.similar_pairs(df, ["g"], "v", 0.7, tile=4).select("a", "b")) == want
    assert dedup.similar_pairs(df.limit(0), ["g"], "v", 0.7).count() == 0


def test_components_and_complete_link(spark):
    rng = random.Random(1)
    edges = [(rng.randint(1, 60), rng.randint(1, 60)) for _ in range(50)] + [(5, 5), (None, 3), (7, 8), (8, 7), (7, 8)]
    parent = {}

    def find(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for a, b in edges:
        if a and b and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    e = spark.createDataFrame(edges, "a long, b long")
    assert dict(rows(graph.components(e))) == {k: find(k) for k in parent}
    assert graph.components(e.limit(0)).count() == 0
    nodes = spark.createDataFrame([(i, 1) for i in range(1, 6)], "id long, t long")
    ok = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4), (5, 4)], "a long, b long")
    assert dict(rows(graph.complete_link(nodes, ok, "t"))) == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}


def test_reason_edges_and_election(spark):
    s = [
        (1, "r", "slow tools", "we wait for days", "x", [10]), (2, "r", "costs", "fees are high", "x", [11, 11]),
        (3, "r", "misfit", "so it is not a fit", "x", [12]), (4, "r", "late", "after that", "x", [30]), (5, "r", "other", "plain", None, None),
    ]
    df = spark.createDataFrame(s, "id long, run string, category string, advisor_quote string, rationale string, source_turn_ids array<long>")
    assert rows(dedup.reason_edges(df, ["run"], conclusion=r"\b(not a fit|misfit|incompatible|won't work)\b", link=r"\b(so|therefore)\b").select("a", "b")) == [(1, 3), (2, 3)]
    e = dedup.elect(df.withColumn("g", F.lit(1)), "g", [F.length("category")])
    assert {r.canonical_id for r in e.collect()} == {1}
    enriched = dedup.enrich(e.filter("id in (1, 2, 3)"), "g").collect()
    assert enriched[0].rationale == "x Supporting reasons: costs; misfit."


def test_ranking(spark):
    data = [(1, "a", "x", 5.0), (2, "a", "x", 5.0), (3, "a", "y", 4.0), (4, "a", "z", 3.0), (5, "b", "x", 1.0), (6, "b", None, 1.0)]
    df = spark.createDataFrame(data, "id long, g string, c string, s double")
    order = [F.desc("s"), F.asc("id")]
    chosen = ranking.top_distinct(df.filter("s >= 3"), ["g"], F.col("c"), order, 2)
    out = ranking.with_fallback(chosen, df, ["g"], order)
    assert rows(out.select("g", "rank", "id", "selection_reason")) == [("a", 1, 1, "above_threshold"), ("a", 2, 3, "above_threshold"), ("b", 1, 5, "best_grounded_fallback")]


def test_selection_valid(spark):
    c = spark.createDataFrame([(1, "r", "driver", "A"), (2, "r", "driver", "a "), (3, "r", "blocker", "B"), (4, "q", "driver", "C")], "id long, run string, item_type string, category string")
    s = "run string, signal_id long, item_type string, rank int"
    cases = {"ok": [(1, "driver", 1), (3, "blocker", 1)], "same category": [(1, "driver", 1), (2, "driver", 2)], "gap": [(1, "driver", 2)], "type": [(3, "driver", 1)], "foreign": [(4, "driver", 1)], "unknown": [(9, "driver", 1)]}
    for name, picks in cases.items():
        sel = spark.createDataFrame([("r", *p) for p in picks], s)
        assert ranking.selection_valid(sel, c, "run").first().valid is (name == "ok"), name


def test_runs(spark):
    r = spark.createDataFrame([("a", 1, "completed", 1), ("b", 1, "completed", 1), ("c", 1, "running", 9), ("d", 2, "failed", 1)], "id string, transcript_id long, status string, started_at int")
    assert rows(runs.latest_run(r)) == [(1, "c"), (2, "d")] and rows(runs.latest_run(r, True)) == [(1, "b")]
    s = spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (3, 2, None), (4, 2, "d"), (5, 1, None)], "id long, transcript_id long, analysis_run_id string")
    assert sorted(x.id for x in runs.visible(s, runs.latest_run(r, True)).collect()) == [2, 3]
    old = spark.createDataFrame([(1, None, "x"), (2, "k", "y")], "a int, b string, v string")
    new = spark.createDataFrame([(1, None, "n"), (2, "z", "n")], "a int, b string, v string")
    assert rows(runs.insert_absent(old, new, ["a", "b"])) == [(2, "z", "n")]
    assert rows(runs.replace_keys(old, new.limit(1), ["a"]).select("a", "v")) == [(1, "n"), (2, "y")]
    gone = spark.createDataFrame([(1,)], "id long")
    assert [x.id for x in runs.delete_cascade({"s": s}, gone)["s"].orderBy("id").collect()] == [3, 4]


def test_telemetry(spark):
    c = spark.createDataFrame([("s", 1, None, 1.0, 2.0), ("s", None, None, 2.0, 1.111), ("t", 3, 4, None, 0.0)], "stage string, tokens long, cached long, cost double, ms double")
    u = {r.stage: r for r in telemetry.usage_by(c, ["stage"], ["tokens", "cached"], "cost", "ms").collect()}
    assert (u["s"].tokens, u["s"].cached, u["s"].cost, u["s"].ms, u["t"].cost) == (1, None, 3.0, 3.11, None)


def test_importance(spark):
    p = spark.createDataFrame([("g", 1, 2, 1), ("g", 2, 3, 2), ("g", 1, 3, 3), ("h", 1, 2, None)], "g string, a long, b long, winner long")
    m = spark.createDataFrame([("g", 1), ("g", 2), ("g", 3), ("h", 1), ("h", 2), ("h", 4)], "g string, candidate_id long")
    assert rows(importance.pairs_complete(p, m, "g")) == [("g", 3, 3, True), ("h", 3, 1, False)]
    assert [(r.candidate_id, r.wins, r["rank"]) for r in importance.copeland(p, m, "g").filter("g = 'h'").orderBy("rank").collect()] == [(1, 0.5, 1), (2, 0.5, 2), (4, 0.0, 3)]
    w = p.filter("winner is not null").select("g", "winner", F.when(F.col("winner") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("loser"))
    assert rows(graph.three_cycles(w, "g")) == [("g", 1, 2, 3)]
    t = spark.createDataFrame([(0.8,), (0.79,), (0.1,), (None,)], "s double")
    assert [r[0] for r in t.select(importance.tier(F.col("s"))).collect()] == ["critical", "high", "peripheral", None]


def test_metrics_small(spark):
    df = spark.createDataFrame([(True, 0.95), (True, 0.75), (False, 0.7), (False, 0.1)], "y boolean, s double")
    t = metrics.at_thresholds(df, "y", "s", extra=(0.0, 0.8, 1.0))
    at = t.filter("threshold = 0.8").first()
    assert (at.precision, at.recall, at.false_positive, at.false_negative) == (1.0, 0.5, 0, 1)
    assert metrics.calibrate(t, 1.0).first().threshold == 0.75
    assert metrics.average_precision(t).first()[0] == 1.0
    labels = spark.createDataFrame([("a", "a"), ("a", None), ("b", "c")], "x string, g string")
    r = metrics.report(labels, "x", "g").first()
    assert (r["count"], round(r.accuracy, 4), round(r.missing_rate, 4), round(r.macro_recall, 4)) == (3, 0.3333, 0.3333, round((0.5 + 0 + 0) / 3, 4))


def test_rank_correlations(spark):
    rng = random.Random(2)
    data = [(g, i, rng.randint(1, 4), rng.randint(1, 4)) for g in (1, 2) for i in range(8)] + [(3, 0, 1, 1)]
    df = spark.createDataFrame(data, "g int, id int, x int, y int")
    got = {r.g: r.kendall for r in metrics.kendall(df, ["g"], "x", "y").collect()}
    for g in (1, 2):
        rows_ = [d for d in data if d[0] == g]
        s = [(a[2] - b[2]) * (a[3] - b[3]) for a, b in itertools.combinations(rows_, 2)]
        c, d = sum(v > 0 for v in s), sum(v < 0 for v in s)
        assert abs(got[g] - ((c - d) / (c + d) if c + d else 0)) < 1e-12
    rho = {r.g: r.spearman for r in metrics.spearman(df, ["g"], "x", "y").collect()}
    assert rho[3] == 0.0

    def mean_ranks(v):
        return [sum(u < a for u in v) + (sum(u == a for u in v) + 1) / 2 for a in v]

    for g in (1, 2):
        x, y = (mean_ranks([d[k] for d in data if d[0] == g]) for k in (2, 3))
        mx, my = sum(x) / len(x), sum(y) / len(y)
        want = sum((a - mx) * (b - my) for a, b in zip(x, y)) / (sum((a - mx) ** 2 for a in x) * sum((b - my) ** 2 for b in y)) ** 0.5
        assert abs(rho[g] - want) < 1e-9


def test_running_sums(spark):
    rng = random.Random(11)
    data = [(rng.choice([1, 1, 1, None]), i, rng.randint(-3, 9)) for i in range(500)]
    df = spark.createDataFrame(data, "g int, k int, v long")
    got = {(r.g, r.k): r.v_cum for r in sequence.running(df, ["g"], [F.col("k")], ["v"]).collect()}
    for g in (1, None):
        total = 0
        for _, k, v in [d for d in data if d[0] == g]:
            total += v
            assert got[g, k] == total
    assert sequence.running(df.limit(0), [], [F.col("k")], ["v"]).count() == 0


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_unique_with_hot_and_missing_keys(spark, monkeypatch, how):
    monkeypatch.setattr(skew, "HOT_LEAST", 3)
    monkeypatch.setattr(skew, "HOT_SHARE", 4)
    big = spark.createDataFrame([(1, i) for i in range(9)] + [(2, 20), (3, 30)] + [(None, 40 + i) for i in range(9)], "k int, v int")
    small = spark.createDataFrame([(1, "a"), (2, "b"), (None, "never")], "k int, s string")
    got = sorted((r.v, r.s) for r in skew.join_unique(big, small, "k", how).collect())
    want = [(i, "a") for i in range(9)] + [(20, "b")] + ([(30, None)] + [(40 + i, None) for i in range(9)] if how == "left" else [])
    assert got == want


def test_views_and_export(spark, tmp_path):
    n = spark.createDataFrame([("call_10.txt",), ("Call_9.txt",), ("b",), ("",)], "f string")
    assert [r.f for r in n.orderBy(views.natural_key("f")).collect()] == ["", "b", "Call_9.txt", "call_10.txt"]
    rows_ = spark.createDataFrame([(1, [("q", None)], 3.14159), (2, [], None)], "id int, supporting_evidence array<struct<quote:string,timestamp:string>>, business_score double")
    wide = export.widened(rows_)
    assert wide.columns[-2:] == ["supporting_quote_1", "supporting_timestamp_1"]
    export.write_csv(wide, f"{tmp_path}/csv")
    back = spark.read.option("header", True).option("escape", '"').csv(f"{tmp_path}/csv").orderBy("id").collect()
    assert back[0].business_score == "3.14" and '"timestamp":null' in back[0].supporting_evidence
    export.write_jsonl(rows_, f"{tmp_path}/jsonl")
    assert '"business_score":null' in "".join(r.value for r in spark.read.text(f"{tmp_path}/jsonl").collect())
    assert "supporting_quote_1" in export.widened(rows_.limit(0)).columns


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, data in {"a.txt": b"hello \xe2\x80\x94", "b.pdf": b"x", "c.txt": b"", "d.txt": b"\xff\xfe"}.items():
        (tmp_path / "in" / name).write_bytes(data)
    got = files.text_files(spark, str(tmp_path / "in"))
    assert {r.file_name: r.reason for r in got.collect()} == {"a.txt": None, "b.pdf": "unsupported_type", "c.txt": "empty", "d.txt": "invalid_utf8"}
    old = spark.createDataFrame([("a.txt",)], "file_name string")
    assert {r.file_name: r.outcome for r in files.import_files(got, old).collect()}["a.txt"] == "skipped_existing"
    assert {r.file_name: r.outcome for r in files.import_files(got, old, force=True).collect()}["a.txt"] == "replaced"
    assert files.schema_issues(old, {"file_name": "string", "id": "bigint"}) == ["missing id"]

"""The training-data operators against brute force, with nulls, empties, ties, repeats and hot groups."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

groups = pytest.importorskip("colloquy.llm.groups")
from colloquy.operators import skew  # noqa: E402
from colloquy.llm import darts, leakage, order, spam, speech, survivor, tokens, topn, turns  # noqa: E402


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# 1: groups


def closure(edges):
    parent = {}

    def find(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return sorted((k, find(k)) for k in parent)


@pytest.mark.parametrize("hot", [False, True])
def test_groups(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(groups, "HOT_LEAST", 5)
        monkeypatch.setattr(groups, "HOT_SHARE", 20)
    rng = random.Random(7)
    edges = [(rng.randint(-5, 200), rng.randint(-5, 200)) for _ in range(120)]
    edges += [(i, i + 1) for i in range(1000, 1060)] + [(5000, 5000 + i) for i in range(1, 90)]  # a chain and a hub
    edges += [(1, 1), (None, 2), (3, None), (None, None), (7, 9), (9, 7), (7, 9)]
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in edges], "l long, r long, u string, v int")
    assert rows(groups.connected_groups(df, "l", "r")) == closure(edges)


def test_groups_empty(spark):
    df = spark.createDataFrame([], "l long, r long")
    assert rows(groups.connected_groups(df, "l", "r")) == []
    assert rows(groups.connected_groups(spark.createDataFrame([(1, 1), (None, 4)], "l long, r long"), "l", "r")) == []


# 2: near duplicates


def brute_pairs(data, threshold):
    sets = {}
    for i, *fields in data:
        if i is not None:
            sets[i] = set(re.findall("[a-z0-9]+", " ".join(f or "" for f in fields).lower()))
    ids = sorted(sets)
    return sorted(
        (a, b) for n, a in enumerate(ids) for b in ids[n + 1 :]
        if sets[a] & sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9
    )


def near_data(n=300, seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)] + ["the", "and", "of", "to"]
    out = []
    for i in range(n):
        if i and rng.random() < 0.4:
            base = rng.choice(out)[1].split()
            for _ in range(rng.randint(0, 5)):
                base[rng.randrange(len(base))] = rng.choice(vocabulary)
            rng.shuffle(base)
        else:
            base = ["the", "and", "of"] + [rng.choice(vocabulary) for _ in range(40)]
        out.append((i, " ".join(base), None, "Cat, " if i % 2 else ""))
    return out


def found_pairs(spark, data, **kw):
    df = spark.createDataFrame([(*d, "extra", 1) for d in data], "id long, q string, r string, c string, words string, n int")
    return rows(darts.all_pairs(*darts.near_duplicates(df, "id", ["q", "r", "c"], 0.7, **kw)))


def formulaic(n, rng):
    """Nine of twelve common words and one of its own: pairs that share the nine have similarity 9/11, others at most 8/12."""
    return [(i, " ".join(rng.sample([f"common{j}" for j in range(12)], 9) + [f"own{i}"]), None, None) for i in range(n)]


def rare_edits(n, rng):
    """Pairs at exactly 0.7 that share common words and differ in rare ones."""
    out = []
    for i in range(0, 2 * n, 2):
        shared = rng.sample([f"often{j}" for j in range(60)], 35)
        out += [(i + side, " ".join(shared + [f"rare{i}x{side}x{j}" for j in range(7 + side)]), None, None) for side in (0, 1)]
    return out


@pytest.mark.parametrize("make, n", [(near_data, 300), (lambda n: formulaic(n, random.Random(1)), 700), (lambda n: rare_edits(n, random.Random(2)), 400)])
def test_near_duplicates(spark, make, n):
    data = make(n)
    odd = [(9000, None, None, None), (9001, "", "", ""), (9002, "!!", None, ""), (None, "w1 w2", None, None), (9003, "Solo", None, None), (9004, "solo!", None, None)]
    data = data + odd + data[:5]
    want = brute_pairs(data, 0.7)
    assert len(want) > 100
    assert found_pairs(spark, data, exact=True) == want
    got = found_pairs(spark, data)
    assert not set(got) - set(want) and len(got) == len(set(got)) and (9003, 9004) in got
    assert len(got) >= 0.99 * len(want)


def test_near_duplicates_large_buckets(spark, monkeypatch):
    data = formulaic(400, random.Random(5)) + near_data(100, 6)[:60]
    data = [(n, *d[1:]) for n, d in enumerate(data)]
    want = brute_pairs(data, 0.7)
    few = found_pairs(spark, data)
    monkeypatch.setattr(darts, "BUCKET", 8)  # nearly every bucket of the formulaic records is too large now
    assert len(found_pairs(spark, data)) >= max(len(few), 0.99 * len(want))
    monkeypatch.setattr(darts, "PAIRS_AT_ONCE", 3)
    assert set(found_pairs(spark, data)) <= set(want)


def test_bucket_pairs_over_batches():
    """Groups that cross batches, and one that grows beyond BUCKET, come out whole."""
    import pyarrow as pa

    rng = random.Random(3)
    size = [1, 3, 900, 2, 40, 1, 5000, 7, 4]
    p = [(k << 24) | 50 for k, n in enumerate(size) for _ in range(n)]
    ids = rng.sample(range(10**6), len(p))
    t = pa.table({"p": pa.array(p), "id": pa.array(ids), "s0": pa.array([0] * len(p)), "s1": pa.array([-1] * len(p))})
    out = pa.Table.from_batches(darts._bucket_pairs(0.7)(t.to_batches(max_chunksize=700)), pa.schema([("a", pa.int64()), ("b", pa.int64())])).to_pylist()
    at, pairs, hot = 0, set(), set()
    for n in size:
        own = sorted(ids[at : at + n])
        at += n
        if n > darts.BUCKET:
            hot = set(own)
        else:
            pairs |= {(a, b) for i, a in enumerate(own) for b in own[i + 1 :]}
    assert {(r["a"], r["b"]) for r in out if r["b"] is not None} == pairs and {r["a"] for r in out if r["b"] is None} == hot


@pytest.mark.parametrize("mean", [0.25, 40.0, 744.0, 800.0, 1200.0, 5000.0])
def test_darts_of_a_cell_have_their_mean(mean):
    steps = darts._poisson_steps(mean)
    assert abs((1 - steps).sum() - mean) < 0.01 * mean + 1e-6 and (np.diff(steps) >= 0).all() and steps[-1] <= 1


def test_bands_keep_their_recall_at_every_size():
    for n in (10, 10**5, 10**9):
        b = darts.Bands.least(n, 0.7)
        assert 1 - (1 - 0.7**b.rows) ** b.bands >= 0.995
    assert darts.Bands.least(10**9, 0.7).rows > darts.Bands.least(10**5, 0.7).rows


def test_near_duplicates_hot_copies(spark, monkeypatch):
    monkeypatch.setattr(darts, "COPIES_BROADCAST", 0)
    monkeypatch.setattr(skew, "HOT_LEAST", 50)
    data = near_data(60, 5) + [(1000 + i, "Same words in each copy %d" % 7, None, None) for i in range(400)]
    df = spark.createDataFrame(data, "id long, q string, r string, c string")
    pairs, members = darts.near_duplicates(df, "id", ["q", "r", "c"], 0.7)
    assert members.filter("class_id = 1000").count() == 400  # copies are members of one class
    assert pairs.filter("left_id >= 1000").count() == 0  # and are never compared
    assert not set(rows(pairs)) - set(brute_pairs(data[:60], 0.7))


def test_near_duplicates_empty_and_long(spark):
    df = spark.createDataFrame([], "id long, q string")
    assert rows(darts.all_pairs(*darts.near_duplicates(df, "id", ["q"], 0.7))) == []
    long = " ".join(f"v{i}" for i in range(30_000))
    df = spark.createDataFrame([(1, long), (2, long + " tail"), (3, "other")], "id long, q string")
    assert rows(darts.all_pairs(*darts.near_duplicates(df, "id", ["q"], 0.7))) == [(1, 2)]


def test_dart_agreement_estimates_weighted_similarity():
    rng = np.random.default_rng(1)
    words = rng.integers(1, 2**63, 60).astype(np.uint64)
    weight = {int(w): float(x) for w, x in zip(words, rng.uniform(0.2, 6, 60))}
    weights = lambda u: np.array([weight[int(w)] for w in u])
    a, b = words[:45], words[15:]
    sig = darts.signatures(np.concatenate([a, b]), np.array([0, 45, 90]), weights, 2000)
    want = sum(weight[int(w)] for w in words[15:45]) / sum(weight.values())
    assert abs((sig[0] == sig[1]).mean() - want) < 0.05
    assert (sig != darts._FAR).all()


def test_signature_does_not_depend_on_what_is_signed_with_it(monkeypatch):
    rng = np.random.default_rng(2)
    sets = [rng.integers(1, 2**63, n).astype(np.uint64) for n in (1, 3, 40, 40, 900, 20_000)]
    sets.append(np.zeros(0, np.uint64))
    offsets = np.cumsum([0] + [len(x) for x in sets])
    all_ = darts.signatures(np.concatenate(sets), offsets, None, 96)
    monkeypatch.setattr(darts, "TABLE", 10_000)
    for x, sig in zip(sets, all_):
        assert (darts.signatures(x, np.array([0, len(x)]), None, 96)[0] == sig).all()


# 3: speaker turns

PEOPLE = [(1, "Ann Leeman", "advisor"), (2, "Bo Rask", "optimize_rep"), (3, "Cy Leeman", "advisor")]


@pytest.mark.parametrize("label, no", [
    ("Ann Leeman", 1), ("  ann  leeman: ", 1), ("Leeman, Cy", 3), ("Rask", 2), ("Leeman", 0), ("Bo’s phone", 2), ("BR", 2), ("A. Leeman", 1), ("Cy L.", 3),
    ("SPEAKER_02", 2), ("Speaker 9", 0), ("ADVISOR_2", 3), ("Advisor", 0), ("OPTIMIZE_REP", 2), ("ADVISOR_3", 0), ("Unknown", 0), (None, 0), ("", 0), (":", 0),
    ("Anm Leeman", 1), ("Bo Rask (Optimize)", 2), ("Guest Line", 0),
])
def test_labels(label, no):
    assert speech.speaker_of(label, PEOPLE) == no


def test_labels_with_odd_people():
    odd = [(1, "", "advisor"), (2, "Cher", "optimize_rep"), (3, "  ", "")]
    assert [speech.speaker_of(x, odd) for x in ("Cher", "cher's phone", "x", ",", "Speaker 3", "Somebody Else", "C")] == [2, 2, 0, 0, 3, 0, 2]
    assert speech.speaker_of("Ann", []) == 0


def test_clean_and_times():
    assert speech.clean("Um, I — uh-huh [laughter] don’t KNOW *coughs* ♪ hold music ♪ (12:30) <noise> {beep} mm-hmm well, like 3.5%") == "i don't know well like 3 5"
    assert speech.clean("Summer hummed; umbrella, error, her") == "summer hummed umbrella error her"
    assert [speech.seconds(x) for x in ("0:05", "[00:01:02]", "1:02:03,900", "(0:00:09.5)", "", None, "x", "5")] == [5, 62, 3723, 9, None, None, None, None]


LAYOUTS = {
    "range": "Meeting ID: 1\n00:00:01 --> 00:00:02 [ADVISOR_1]: Hi there. 00:00:05 --> 00:00:06 [OPTIMIZE_REP]: um\n00:00:07 --> 00:00:09 [optimize_rep]: Yes",
    "vtt": "WEBVTT\n\n1\n00:00:01.000 --> 00:00:02.000\n<v Ann Leeman>Hi there.\n\n2\n00:00:05.000 --> 00:00:06.000\nBo Rask: um\n\n3\n00:00:07.100 --> 00:00:08.000\n<v Bo Rask>Yes\n",
    "line": "\r\n".join(["0:01 Ann Leeman: Hi there.", "[00:00:05] Rask: um", "00:00:07 BR: Yes"]),
    "paren": "(00:00:01) Ann Leeman - Hi there.\nBo Rask (0:05): um\nBo Rask (00:00:07.9): Yes",
    "header": "Ann Leeman 00:00:01\nHi\nthere.\n\nBo Rask 00:00:05\num\nBo Rask 00:00:07\nYes",
    "time": "00:00:01\nAnn Leeman: Hi there.\n\n00:00:05\nBo Rask: um\n00:00:07\nBo Rask: Yes",
}


@pytest.mark.parametrize("layout", sorted(LAYOUTS))
def test_layouts(spark, layout):
    t = spark.createDataFrame([(1, LAYOUTS[layout], "x")], "id long, raw_text string, t string")
    stored = spark.createDataFrame([], "transcript_id long, turn_index int, timestamp string, raw_speaker_label string, text string")
    people = spark.createDataFrame([(1, *p) for p in PEOPLE], "transcript_id long, speaker_no int, full_name string, role string")
    assert rows(turns.speaker_turns(t, stored, people)) == [(1, 0, 1, 1, "hi there"), (1, 1, 2, 7, "yes")]


def test_set_phrases_stay_speech():
    raw = "Ann Leeman 00:00:01\nOne thing\nTo be clear: we stay\nBo Rask:\nok"
    assert turns.segments(raw, PEOPLE) == [(1, "Ann Leeman", "\nOne thing\nTo be clear: we stay", None), (None, "Bo Rask", "\nok", None)]


def test_stored_turns(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_LEAST", 3)
    monkeypatch.setattr(skew, "HOT_SHARE", 5)
    said = [(1, i, f"00:{i:02d}:00", "Ann Leeman" if i % 5 else "Bo Rask", f"word{i}") for i in range(40)]
    said += [(1, 41, "0:07:00", "A. Leeman", "word7"), (1, 42, "00:00:30", "Bo Rask", "early"), said[3]]  # stored twice, late, delivered twice
    said += [(2, 0, None, "Bo Rask", "Right."), (2, 1, None, "Bo Rask", "Right."), (2, 2, "9:00", None, "who"), (2, 3, "1:00", "Ann Leeman", "uh"), (2, 4, None, "Ann Leeman", None)]
    said += [(3, 0, "0:01", "Ann Leeman", "not wanted"), (None, 0, None, None, "x"), (4, 0, "0:03", "Ann", "alone")]
    stored = spark.createDataFrame(said, "transcript_id long, turn_index int, timestamp string, raw_speaker_label string, text string")
    calls = spark.createDataFrame([(1, ""), (2, None), (3, "Bo Rask: raw"), (4, " "), (5, ""), (None, "x")], "id long, raw_text string")
    people = spark.createDataFrame([(t, *p) for t in (1, 2, 3) for p in PEOPLE], "transcript_id long, speaker_no int, full_name string, role string")
    got = defaultdict(list)
    for r in rows(turns.speaker_turns(calls, stored, people)):
        got[r[0]].append(r[1:])
    first = [(0, "word0 early")] + [(n, None) for n in range(1, 16)]
    assert [x[0] for x in got[1]] == list(range(len(got[1]))) == [n for n, _ in first]
    assert got[1][0] == (0, 2, 0, "word0 early") and got[1][3] == (3, 1, 360, "word6 word7 word8 word9")
    assert got[2] == [(0, 2, -1, "right right"), (1, 0, 540, "who")]
    assert got[3] == [(0, 2, -1, "raw")] and got[4] == [(0, 0, 3, "alone")] and 5 not in got


@pytest.mark.parametrize("seed", range(40))
def test_precedence_is_met_and_equals_the_sort(seed):
    rng = random.Random(seed)
    n = rng.randint(0, 30)
    places = rng.sample(range(50), n)
    timed = rng.random() < 0.5
    times = [rng.randint(0, 12) if timed or rng.random() < 0.6 else None for _ in range(n)]
    cues = [rng.randint(1, 40) if rng.random() < 0.5 else None for _ in range(n)]
    got, kept, dropped = order.precedence(times, cues, places, timed)
    assert got == sorted(range(n), key=lambda i: (times[i] if timed else 0, places[i]))
    at = {i: k for k, i in enumerate(got)}
    assert all(at[u] < at[v] for _, u, v in kept)
    assert all(at[u] > at[v] for _, u, v in dropped)  # a dropped edge contradicts what is left
    assert not any(kind == order.STRENGTH[timed][0] for kind, _, _ in dropped)


def test_conflicts_between_constraints():
    # the third segment came late; its time is trusted, its place is not
    got, kept, dropped = order.precedence([5, 9, 2], [1, 2, 3], [0, 1, 2], True)
    assert got == [2, 0, 1] and ("place", 1, 2) in dropped and ("cue", 1, 2) in dropped and ("time", 2, 0) in kept
    # one time is missing, so places are trusted and times against them are not
    got, kept, dropped = order.precedence([5, None, 2], [None] * 3, [0, 1, 2], False)
    assert got == [0, 1, 2] and dropped == [("time", 2, 0)]
    assert order.precedence([], [], [], True) == ([], [], [])


@pytest.mark.parametrize("piece", [1, 3, 20_000])
def test_pieces_of_a_long_recording(spark, monkeypatch, piece):
    monkeypatch.setattr(turns, "PIECE", piece)
    rng = random.Random(piece)
    rows_ = [(1, rng.randint(0, 9), i, None, None, i % 3, f"w{i}") for i in range(60)]
    rows_ = [(*r[:4], r[1], *r[5:]) for r in rows_] + [(2, 0, i, None, rng.choice([None, 4]), 1, f"x{i}") for i in range(7)]
    import pyarrow as pa

    def batches(data):
        data = [(t, 1 - (t == 2), p, c, s, k, w) for t, _, p, c, s, k, w in data]
        data.sort(key=lambda r: (r[0], r[4] if r[1] else 0, r[2]))
        yield pa.RecordBatch.from_pydict(dict(zip(("t", "timed", "place", "cue", "sec", "speaker", "words"), map(list, zip(*data)))))

    got = [(r[0], r[2]) for r in turns._in_order(batches(rows_))]
    assert got == [(1, p) for _, p in sorted((r[4], r[2]) for r in rows_ if r[0] == 1)] + [(2, i) for i in range(7)]


def test_text_before_the_first_mark_and_long_spans():
    raw = "Meeting ID: 7\nwe have begun already\n00:00:05 --> 00:00:06 [ADVISOR_1]: Hi."
    assert turns.segments(raw, PEOPLE) == [(None, None, "we have begun already", None), (5, "ADVISOR_1", " Hi.", None)]
    assert speech.clean("so [" + "long note " * 40 + "] yes (" + "x" * 300 + ") no") == "so yes no"
    name = "Aurelia-" + "Maximiliana" * 8 + " Lund"
    people = [(1, name.strip(), "advisor")]
    assert turns.segments(f"0:01 {name.strip()}: Hello.", people) == [(1, name.strip(), "Hello.", None)]


def test_cue_numbers():
    raw = "WEBVTT\n\n7\n00:00:01.000 --> 00:00:02.000\n<v Ann Leeman>Hi.\n\n8\n00:00:05.000 --> 00:00:06.000\nBo Rask: yes\n"
    assert [s[3] for s in turns.segments(raw, PEOPLE)] == [7, 8]


def test_turns_empty(spark):
    t = spark.createDataFrame([], "id long, raw_text string")
    s = spark.createDataFrame([], "transcript_id long, turn_index int, timestamp string, raw_speaker_label string, text string")
    p = spark.createDataFrame([], "transcript_id long, speaker_no int, full_name string, role string")
    assert rows(turns.speaker_turns(t, s, p)) == []


# 4: top n


@pytest.mark.parametrize("size", [1000, 7])
def test_top_n(spark, size):
    rng = random.Random(4)
    data = [(("hot" if rng.random() < 0.4 else f"g{rng.randint(1, 30)}"), rng.choice(["a", None]), i, rng.choice([0.0, 0.5, 0.5, 0.9, rng.random()])) for i in range(4000)]
    data += data[:50] + [("g1", "a", 9001, None), ("g1", "a", 9002, float("nan")), ("only", "a", 9003, None), ("g1", "a", None, 5.0), (None, None, 9004, 1.0)]
    df = spark.createDataFrame([(*d, 1, "x") for d in data], "g string, h string, id long, s double, score int, gkey string")
    want = defaultdict(set)
    for g, h, i, s in data:
        if s is not None and s == s and i is not None:
            want[g, h].add((-s, i))
    want = sorted(((g, h, n + 1, i, -s) for (g, h), v in want.items() for n, (s, i) in enumerate(sorted(v)[:3])), key=repr)
    got = sorted((tuple(r) for r in topn.top_n_per_group(df, ["g", "h"], "s", "id", 3, size).collect()), key=repr)
    assert got == want


def test_top_n_skips(spark):
    """Of two groups with hundreds of row groups each, only those are read that can hold one of the best."""
    df = spark.range(200_000).select((F.col("id") % 2).alias("g"), "id", (F.col("id") / 7).alias("s"))
    report = {}
    got = rows(topn.top_n_per_group(df, ["g"], "s", "id", 2, 1000, report))
    assert [(r[0], r[1], r[2]) for r in got] == [(0, 1, 199998), (0, 2, 199996), (1, 1, 199999), (1, 2, 199997)]
    assert report["row_groups"] >= 200 and report["read"] <= 12, report


def test_top_n_reads_what_may_tie(spark):
    """Row groups whose maximum equals the n-th score may hold a smaller key and are read; the lower half is skipped."""
    df = spark.range(40_000).select(F.lit("g").alias("g"), (40_000 - F.col("id")).alias("id"), F.when(F.col("id") < 20_000, 1.0).otherwise(0.5).alias("s"))
    report = {}
    got = rows(topn.top_n_per_group(df, ["g"], "s", "id", 3, 1000, report))
    assert [r[2] for r in got] == [20_001, 20_002, 20_003]
    assert 20 <= report["read"] <= 23 and report["row_groups"] >= 40, report


def test_top_n_of_small_groups_reads_each_row_group_once(spark):
    df = spark.range(20_000).select((F.col("id") % 5000).alias("g"), "id", F.rand(3).alias("s"))
    report = {}
    assert topn.top_n_per_group(df, ["g"], "s", "id", 3, 1000, report).count() == 15_000
    assert report["read"] == report["row_groups"]


def test_constant_columns_are_told_by_statistics(tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"a": ["x", "x"], "b": pa.array([None, None], pa.string()), "c": ["x", None], "d": ["x", "y"]}), tmp_path / "t.parquet")
    rg = pq.ParquetFile(tmp_path / "t.parquet").metadata.row_group(0)
    assert [topn._constant(rg.column(i)) for i in range(4)] == [True, True, False, False]


def test_top_n_empty_and_latest(spark):
    df = spark.createDataFrame([], "g string, id long, s double")
    assert topn.top_n_per_group(df, ["g"], "s", "id", 3).count() == 0
    r = spark.createDataFrame([("a", 1, 5, 0.1), ("a", 1, 9, None), ("a", 1, None, 0.7), (None, 1, 2, 0.2), (None, 1, 2, 0.3)], "g string, id long, t int, s double")
    assert sorted(map(tuple, topn.latest_per_item(r, ["g", "id"], "t", ["s"]).collect()), key=repr) == sorted([("a", 1, None), (None, 1, 0.3)], key=repr)


# 5: surviving records


def _how(**kw):
    c = F.col("c")
    trust = F.when(c.between(0.0, 1.0), c)
    return survivor.Survivorship(group="g", id="id", trust=trust, recency=F.col("at"), fields={"kind": F.nullif(F.lower(F.trim("kind")), F.lit(""))}, usable=[trust.isNotNull(), F.col("kind").isNotNull()], **kw)


RECORDS = "g string, id long, kind string, c double, at timestamp, votes string"


def test_survivor(spark):
    import datetime as dt

    day = lambda d: dt.datetime(2025, 1, d)
    data = [
        ("x", 1, "a", 0.5, day(1), None), ("x", 2, "b ", 0.9, day(1), None), ("x", 3, None, 0.95, day(1), None), ("x", 3, None, 0.95, day(1), None),
        ("tie", 5, "p", 0.5, day(2), None), ("tie", 4, "q", 0.5, day(2), None), ("none", 6, None, float("nan"), day(1), None), ("none", 7, "", 7.0, None, None),
        ("solo", 8, "a", 1.0, day(1), None), ("solo", 8, "a", 1.0, day(1), None), (None, 9, "a", 1.0, day(1), None), ("x", None, "z", 1.0, day(1), None),
        ("late", 10, "old", None, day(1), None), ("late", 11, "new", None, day(2), None),
    ]
    df = spark.createDataFrame(data, RECORDS)
    assert rows(survivor.surviving_records(df, _how())) == [("late", 11, "new"), ("none", 7, ""), ("tie", 4, "q"), ("x", 2, "b")]
    assert rows(survivor.surviving_records(df.limit(0), _how())) == []


def test_survivor_votes_sum_with_decay(spark):
    import datetime as dt

    now = dt.datetime(2025, 3, 1)
    old = dt.datetime(2025, 1, 30)  # 30 days earlier
    data = [("g", 1, "many", 0.5, now, None), ("g", 2, "many", 0.5, now, None), ("g", 3, "one", 0.9, now, None), ("g", 3, "one", 0.9, now, None), ("h", 4, "stale", 1.0, old, None), ("h", 5, "fresh", 0.6, now, None)]
    df = spark.createDataFrame(data, RECORDS)
    got = {r.g: r.kind for r in survivor.surviving_records(df, _how(half_life_days=30.0, as_of=F.lit(now))).collect()}
    assert got == {"g": "many", "h": "fresh"}


# 6: tokens


def test_encoding_round_trip(spark):
    path = f"{tokens.TOKENIZER_DIR}/byte_bpe_50k.json"
    tokenizers = pytest.importorskip("tokenizers")
    try:
        tk = tokenizers.Tokenizer.from_file(path)
    except Exception:
        pytest.skip("no vocabulary files here")
    tk.encode_special_tokens = True
    texts = [None, "", " ", "\n\n  x", "Hello world's  end<|endoftext|>", "naïve ﬁ 中文 顾问 🙂👍🏽", "tab\there nbsp em​zero", "a" * 5000, "=" * 3000, "1234 56\r\n7", "word " * 3000, "don't I'll we'd 'Tis", "\u0085 x"]
    df = spark.createDataFrame([(i, t, 1, "w") for i, t in enumerate(texts)] + [(4, texts[4], 1, "w"), (None, "x", 1, "w")], "doc_id long, text string, pos int, word string")
    got = {r.doc_id: list(r.ids) for r in tokens.encode_corpus(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i] == tk.encode(t or "", add_special_tokens=False).ids, i
    back = {r.doc_id: r.text for r in tokens.decode_corpus(tokens.encode_corpus(df)).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert tokens.encode_corpus(df.limit(0)).count() == 0


# 7: leakage


def test_leakage_exact(spark):
    rng = random.Random(6)
    pool = [f"w{i}" for i in range(50)]
    items = [(i, " ".join(rng.choice(pool) for _ in range(rng.choice([5, 13, 40])))) for i in range(30)] + [(98, None), (99, ""), (None, "x " * 20)]
    items.append((50, items[2][1] + " more"))
    docs = []
    for d in range(80):
        words = [rng.choice(pool) for _ in range(rng.randint(0, 60))]
        if d % 3 == 0:
            item = rng.choice(items[:30])[1].split()
            k = rng.randint(0, max(0, len(item) - 13))
            words[5:5] = item[k : k + rng.choice([12, 13, 20])]
        docs.append((d, ", ".join(words).title()))
    docs += [(900, None), (901, ""), docs[0], (None, docs[0][1])]
    W = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    want = set()
    for d, t in docs:
        w = W(t)
        grams = {tuple(w[i : i + 13]) for i in range(len(w) - 12)}
        want |= {(d, i) for i, u in items if d is not None and i is not None for k in range(len(W(u)) - 12) if tuple(W(u)[k : k + 13]) in grams}
    ddf = spark.createDataFrame(docs, "doc_id long, text string")
    idf = spark.createDataFrame(items, "item_id long, text string")
    assert rows(leakage.leaked_items(ddf, idf)) == sorted(want) and want
    assert rows(leakage.leaked_items(ddf.limit(0), idf)) == [] == rows(leakage.leaked_items(ddf, idf.limit(0)))


def test_leakage_blocks(spark, monkeypatch):
    monkeypatch.setattr(leakage, "BLOCK_KEYS", 20)
    monkeypatch.setattr(leakage, "INDEX_BROADCAST", 0)
    text = " ".join(f"q{i}" for i in range(60))
    items = spark.createDataFrame([(i, " ".join(f"q{j}" for j in range(i, i + 15))) for i in range(20)], "item_id long, text string")
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert len(rows(leakage.leaked_items(docs, items))) == 20


def leaks(edits, each, size, rng, first=0):
    """Items of ``size`` words and documents that hold one with edits: every kind at every place, ``each`` times, further edits at random."""
    pool = [f"t{i}" for i in range(4000)]
    items, docs = [], []
    for kind in range(3):
        for at in range(size):
            for _ in range(each):
                words = [rng.choice(pool) for _ in range(size)]
                n = first + len(items)
                items.append((n, " ".join(words)))
                places = [(kind, at)] + [(rng.randrange(3), p) for p in rng.sample([p for p in range(size) if p != at], edits - 1)]
                for k, p in sorted(places, key=lambda x: -x[1]):
                    words[p : p + (k < 2)] = [] if k == 1 else [rng.choice(pool)]
                docs.append((n, " ".join(rng.choice(pool) for _ in range(30)) + " " + " ".join(words) + " " + " ".join(rng.choice(pool) for _ in range(30)), (kind, at)))
    return items, docs


@pytest.mark.parametrize("edits, window, size", [(1, 13, 13), (2, 13, 13), (3, 13, 13), (2, None, 24)])
def test_leakage_with_edits(spark, edits, window, size):
    items, docs = leaks(edits, 20, size, random.Random(edits))
    noise = [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "short")]
    ddf = spark.createDataFrame([d[:2] for d in docs] + noise, "doc_id long, text string")
    idf = spark.createDataFrame(items + [(10**6, None), (10**6 + 1, "t1 t2")], "item_id long, text string")
    got = rows(leakage.leaked_items(ddf, idf, window, edits))
    assert all(d == i for d, i in got)  # nothing but what was planted
    found, by = {d for d, _ in got}, defaultdict(list)
    for n, _, (kind, at) in docs:
        by[kind].append(n in found)
        by[kind, at].append(n in found)
    assert len(found) >= 0.95 * len(docs)
    assert all(sum(by[kind]) >= 0.95 * len(by[kind]) for kind in range(3))
    # twenty trials a place: 0.95 may look like 0.8
    assert all(sum(v) >= 0.8 * len(v) for v in by.values()), {k: sum(v) for k, v in by.items() if sum(v) < 0.8 * len(v)}


@pytest.mark.parametrize("a, b, k, yes", [("a b c", "a b c d", 0, True), ("a b c", "a x c", 0, False), ("a b c", "a x c d", 1, True), ("a b c", "b c d", 1, True), ("a b c", "x y c", 1, False), ("a b c", "a b", 1, True), ("a", "", 0, False)])
def test_within(a, b, k, yes):
    assert leakage.within(a.split(), b.split(), k) is yes


# 8: pages

PROSE = "The advisor wants to see the fee schedule before the end of the year. We talked about it for an hour, and nobody was sure what it means. "
SPAM = {
    "links": "\n".join(f"* Bulky item{i}: https://site{i}.test/some-page?id={i}" for i in range(12)),
    "menu": " > ".join(["Home", "Login", "Next »", "Read more »", "You may also like", "Archive 2021", "Share"] * 5),
    "tags": "tags: " + ", ".join(f"best thing{i}" for i in range(40)),
    "hashtags": " ".join(f"#topic{i}" for i in range(40)),
    "stuffed": "Looking for cheap desk lamps? Our cheap desk lamps are the best cheap desk lamps for cheap desk lamps seekers. Get cheap desk lamps today because cheap desk lamps means cheap desk lamps. " * 6,
    "mostly": PROSE + "\n" + "\n".join(["lamp shop", "best lamp", "lamp prices", "top lamp"] * 15),
}
FINE = {
    "prose": PROSE * 5, "ends": PROSE * 5 + "\nhttps://a.test/x\nhttps://b.test/y\n\nTags: one, two, three",
    "agenda": "Agenda, next week\n" + "\n".join(f"{i}. Review the fee schedule with the new hires ({i} min)" for i in range(1, 9)),
    "fees": "Fees discussed on the call.\n" + "\n".join(f"branch lease\t{i * 7} per year\t{i}.5%" for i in range(1, 9)),
    "log": "Ann: Right.\nBo: Mm-hmm.\nAnn: Okay.\nBo: Yes.\nAnn: Got it.", "json": '{"items": [{"item_type": "driver", "category": "fees", "advisor_quote": "We like it."}]}',
    "again": PROSE * 30, "zh": "顾问想在春天之前换平台。团队担心合同里的限制。", "empty": "", "blank": " \n ", "null": None,
}


def test_pages(spark):
    data = [(i, t) for i, t in enumerate([*SPAM.values(), *FINE.values()])]
    df = spark.createDataFrame([(*d, "x") for d in data] + [(0, data[0][1], "x"), (None, data[0][1], "x")], "doc_id long, text string, share string")
    assert [r[0] for r in rows(spam.spam_pages(df))] == list(range(len(SPAM)))
    assert rows(spam.spam_pages(df.limit(0))) == []


def test_long_page():
    assert spam.Labeller(spam.Model.believed()).share(PROSE * 5000) < 0.05


def made_pages(kind, n, rng):
    """Pages of one kind over words of their own, so that no page repeats another."""
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 4)))
    name = lambda: word().title()
    said = lambda: f"The {word()} wants to {word()} the {word()} before {rng.choice(['it', 'she', 'he'])} is {word()} with a {word()}."
    make = {
        "links": lambda: "\n".join(f"{name()} {name()}: https://{word()}.test/{word()}" for _ in range(12)),
        "anchors": lambda: "\n".join(f'<a href="/{word()}">{name()} {word()}</a>' for _ in range(10)),
        "tags": lambda: ", ".join(f"{word()} {word()}" for _ in range(40)),
        "hashtags": lambda: " ".join(f"#{word()}" for _ in range(30)),
        "products": lambda: "\n".join((lambda w: f"best {w}, cheap {w}, {w} shop, {w} prices")(word()) for _ in range(12)),
        "stuffed": lambda: (lambda w: f"Our {w} is the {word()} {w} for {w}. Get {w} now because {w} means {w}. " * 6)(f"{word()} {word()}"),
        "menu": lambda: "\n".join(rng.choice(["Home", "Login", "Next page", "Read more", "Archive", "Contact", "Share", "Privacy", "Sitemap"]) for _ in range(30)),
        "prose": lambda: " ".join(said() for _ in range(12)),
        "notes": lambda: "\n".join(f"- {said()}" for _ in range(8)),
        "log": lambda: "\n".join(f"{name()}: {said()}" for _ in range(10)),
        "table": lambda: "\n".join(f"{word()} {word()}\t{rng.randint(1, 99)}\t{rng.randint(1, 99)}" for _ in range(12)),
        "prices": lambda: said() + "\n" + "\n".join(f"{name()} {word()}: {rng.randint(10, 900)} for {rng.randint(2, 9)} of them" for _ in range(10)),
        "record": lambda: "{" + ", ".join(f'"{word()}": "{word()} {word()}"' for _ in range(14)) + "}",
        "ends": lambda: " ".join(said() for _ in range(14)) + "\nhttps://a.test/x\nhttps://b.test/y\ntags: " + ", ".join(word() for _ in range(6)),
    }[kind]
    return [make() for _ in range(n)]


BAD_KINDS, GOOD_KINDS = ("links", "anchors", "tags", "hashtags", "products", "stuffed", "menu"), ("prose", "notes", "log", "table", "prices", "record", "ends")


def test_pages_of_kinds_the_fit_has_not_seen():
    rng = random.Random(11)
    pages = {k: made_pages(k, 40, rng) for k in BAD_KINDS + GOOD_KINDS}
    bins = {k: [np.array(spam._bins(t)[0]) for t in v] for k, v in pages.items()}
    hit = wrong = 0
    for kind, texts in pages.items():
        labeller = spam.Labeller(spam.fit([b for k, v in bins.items() if k != kind for b in v]))
        flagged = sum(labeller.share(t) > 0.5 for t in texts)
        hit += flagged * (kind in BAD_KINDS)
        wrong += flagged * (kind in GOOD_KINDS)
    assert hit >= 0.95 * 40 * len(BAD_KINDS) and wrong <= 0.05 * 40 * len(GOOD_KINDS), (hit, wrong)


def test_neighbouring_lines_change_a_label():
    """The same doubtful line is a list item between links and prose between sentences."""
    model = spam.fit([np.array(spam._bins(t)[0]) for k in BAD_KINDS + GOOD_KINDS for t in made_pages(k, 10, random.Random(3))])
    links, prose = made_pages("links", 1, random.Random(4))[0].split("\n"), made_pages("notes", 1, random.Random(4))[0].split("\n")
    doubtful = "Broad mandate for client meetings"
    label = lambda lines, l: l.labels(spam._bins("\n".join(lines))[0])
    chained, alone = spam.Labeller(model), spam.Labeller(model, chained=False)
    between_links, between_prose = links[:4] + [doubtful] + links[4:8], prose[:4] + [doubtful] + prose[4:8]
    assert label(between_links, chained)[4] != 0 and label(between_prose, chained)[4] == 0
    assert label(between_links, alone)[4] == label(between_prose, alone)[4]  # by itself it is one or the other
    # and a page's flag: half of its words stand on such lines
    page = "\n".join(x for line in links[:9] for x in (line.split(": ")[1], doubtful))
    assert (chained.share(page) > 0.5) and chained.share("\n".join(x for line in prose[:8] for x in (line, doubtful))) < 0.5


def test_fit_learns_what_follows_what():
    """States that never mix are told to stay, and a feature of one state is learnt from its lines."""
    model = spam.fit([np.array(spam._bins(t)[0]) for k in ("links", "prose") for t in made_pages(k, 300, random.Random(7))], prior=10.0)
    move = np.exp(model.move)
    assert np.allclose(move.sum(axis=1), 1) and move[0, 0] > 0.97 and move[1, 1] > 0.97
    assert np.exp(model.emit[0])[0, 0] > 0.99  # prose has no links
    empty = spam.fit([])
    assert np.allclose(empty.move, spam.Model.believed().move)


def probabilities(model):
    return np.concatenate([np.exp(x).ravel() for x in (model.start, model.move, *model.emit)])


def test_fit_takes_every_line_of_every_page(spark):
    """More pages than a sample would hold, and a page whose end is unlike its first 500 lines."""
    rng = random.Random(13)
    texts = [f"{t}\n{t}" if n % 2 else t for n, t in enumerate(t.split("\n")[0] for t in made_pages("links", 1100, rng) + made_pages("notes", 1100, rng))]
    texts.append("\n".join(made_pages("notes", 70, rng) + made_pages("table", 30, rng)))
    df = spark.createDataFrame([*enumerate(texts), (9000, None), (9001, " "), (None, texts[0])], "doc_id long, text string").repartition(3)
    want = spam.fit([np.array(spam._bins(t)[0]) for t in texts])
    assert np.allclose(probabilities(spam.fitted(df)), probabilities(want), atol=1e-9)
    texts[-1] = "\n".join(texts[-1].split("\n")[:500])
    assert not np.allclose(probabilities(spam.fit([np.array(spam._bins(t)[0]) for t in texts])), probabilities(want), atol=1e-6)
    assert np.allclose(probabilities(spam.fitted(df.limit(0))), probabilities(spam.Model.believed()))


@pytest.mark.parametrize("span", [1, 2, 3, 256])
def test_expected_counts_against_all_paths(monkeypatch, span):
    """Counts of cut and uncut pages are those over every path of states."""
    monkeypatch.setattr(spam, "SPAN", span)
    monkeypatch.setattr(spam, "GROUP_LINES", 4)
    rng, model = random.Random(17), spam.Model.believed()
    pages = [[rng.randrange(len(spam.BINS)) for _ in range(n)] for n in (5, 1, 2, 5)]
    times = [1, 3, 2, 1]
    first, moves, seen = np.zeros(4), np.zeros((4, 4)), np.zeros((len(spam.BINS), 4))
    for page, w in zip(pages, times):
        emit = model.table(np.array([spam.BINS[c] for c in page]))
        paths = np.array(list(np.ndindex(*[4] * len(page))))
        p = np.exp(model.start[paths[:, 0]] + emit[np.arange(len(page)), paths].sum(axis=1) + model.move[paths[:, :-1], paths[:, 1:]].sum(axis=1))
        p *= w / p.sum()
        np.add.at(first, paths[:, 0], p)
        for t, code in enumerate(page):
            np.add.at(seen[code], paths[:, t], p)
            if t:
                np.add.at(moves, (paths[:, t - 1], paths[:, t]), p)
    got = spam.Expected(model)
    got.add(np.concatenate(pages), np.array([*map(len, pages)]), np.array(times, float))
    assert np.allclose(got.first, first) and np.allclose(got.moves, moves) and np.allclose(got.seen, seen)


def test_beliefs_do_not_wear_away(monkeypatch):
    """A corpus repeated ten times gives the model of the corpus: its states keep their meaning at any size."""
    monkeypatch.setattr(spam, "PRIOR", 50.0)
    pages = [np.array(spam._bins(t)[0]) for k in BAD_KINDS + GOOD_KINDS for t in made_pages(k, 4, random.Random(19))]
    assert np.allclose(probabilities(spam.fit(pages)), probabilities(spam.fit(pages * 10)))

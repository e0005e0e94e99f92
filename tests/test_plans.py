"""Providers and the staged pipeline."""

from pyspark.sql import functions as F

from colloquy.plans import pipeline, providers


def test_answers_parse_all_or_nothing(spark):
    good = '{"items": [{"item_type": "driver", "advisor_quote": "q", "extraction_confidence": 0.5, "source_turn_ids": [1, 2], "extra": 1}]}'
    cases = {
        good: None, '{"items": []}': None, good.replace("0.5", "1.5"): "invalid_item", good.replace('"q"', '"  "'): "invalid_item", good[:-2]: "malformed_json",
        good + " trailing": "malformed_json", "no json": "malformed_json", "": "malformed_json", '{"items": [{"item_type": "other"}]}': "invalid_item",
    }
    df = spark.createDataFrame(list(enumerate(cases)), "id int, text string")
    got = {r.id: (r.fault, None if r["items"] is None else len(r["items"])) for r in providers.parsed(df, "text").collect()}
    for i, fault in enumerate(cases.values()):
        assert got[i][0] == fault and (got[i][1] is None) == (fault is not None), i


def test_providers(spark):
    asked = spark.createDataFrame([(1, "a"), (2, "b")], "request_id int, prompt string")
    table = providers.ResponseTable(spark.createDataFrame([(1, "yes")], "request_id int, answer string"))
    assert sorted((r.request_id, r.answer) for r in table.answer(asked).collect()) == [(1, "yes"), (2, None)]

    def shout(frames):
        for f in frames:
            yield f.assign(answer=f["prompt"].str.upper())[["request_id", "answer"]]

    made = providers.FunctionProvider(shout, "request_id int, answer string")
    assert sorted(r.answer for r in made.answer(asked).collect()) == ["A", "B"]


def test_calls_are_tried_again_after_transient_faults(spark):
    def call(prompt):
        kind, _, fails = prompt.partition(":")
        seen[prompt] = seen.get(prompt, 0) + 1
        if seen[prompt] <= int(fails or 0):
            raise (TimeoutError if kind == "slow" else ValueError)(prompt)
        return kind.upper()

    import pandas as pd

    seen, waits = {}, []
    ask = providers.retrying(call, (TimeoutError,), sleep=waits.append)
    got = next(ask(iter([pd.DataFrame({"request_id": range(5), "prompt": ["ok", "slow:1", "slow:2", "slow:9", "bad:1"]})])))
    assert got["answer"].tolist() == ["OK", "SLOW", "SLOW", None, None] and got["retry_count"].tolist() == [0, 1, 2, 2, 0]
    assert got["error_type"].tolist() == [None, None, None, "TimeoutError", "ValueError"] and waits == [0.5, 0.5, 1.0, 0.5, 1.0]
    asked = spark.createDataFrame([(1, "a")], "request_id long, prompt string")
    row = providers.FunctionProvider(providers.retrying(str.upper, (TimeoutError,)), providers.CALL).answer(asked).first()
    assert (row.answer, row.retry_count, row.success, row.error_type) == ("A", 0, True, None)


def test_embeddings_and_scores_are_checked(spark):
    texts = spark.createDataFrame([(1, "ab"), (2, None), (3, "x"), (4, "nan!")], "id long, text string").coalesce(1)

    def embed(batch):
        return [[float(len(t)), 1.0] if len(t) == 2 else [float("nan"), 0.0] if "nan" in t else [1.0] for t in batch]

    got = {r.id: (r.embedding, r.fault) for r in providers.embedded(texts, embed, 2).collect()}
    assert got == {1: ([2.0, 1.0], None), 2: (None, None), 3: (None, "invalid_vector"), 4: (None, "invalid_vector")}
    assert {r.fault for r in providers.embedded(texts, lambda b: 1 / 0, 2).collect()} == {"ZeroDivisionError"}
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (1, 5), (1, 6)], "a long, b long")
    scored = spark.createDataFrame([(1, 2, 0.5), (1, 3, 1.5), (1, 4, float("nan")), (1, 5, 0.1), (1, 5, 0.2), (8, 9, 0.3)], "a long, b long, score double")
    got = {r.b: (r.score, r.fault) for r in providers.checked_scores(pairs, scored).collect()}
    assert got == {2: (0.5, None), 3: (None, "out_of_range"), 4: (None, "not_finite"), 5: (None, "repeated"), 6: (None, "missing")}


CANDIDATE = (
    "id long, analysis_run_id string, item_type string, category string, advisor_quote string, evidence_strength string, "
    "advisor_ownership int, decision_impact int, explicitness int, urgency int, evidence_quality int, embedding array<double>"
)


def test_pipeline(spark):
    e0, e1 = [1.0, 0.0], [0.0, 1.0]
    data = [
        (1, "r", "driver", "A", "one", "explicit", 4, 4, 4, 4, 4, e0), (2, "r", "driver", "A", "one again", "explicit", 5, 5, 5, 5, 5, e0),
        (3, "r", "driver", "a ", "two", "implied", 4, 4, 4, 4, 4, e1), (4, "r", "blocker", "B", "weak", "implied", 1, 1, 1, 1, 1, e0),
        (5, "r", "blocker", "C", "", "implied", 5, 5, 5, 5, 5, e1), (6, "q", "driver", "D", "null part", "explicit", None, 5, 5, 5, 5, e1),
    ]
    df = spark.createDataFrame(data, CANDIDATE)
    hard, soft = [("blank", F.trim("advisor_quote") == "")], [("implied", F.col("evidence_strength") == "implied")]
    s = pipeline.run(df, hard, soft)
    got = sorted((r.analysis_run_id, r.item_type, r["rank"], r.id, r.selection_reason) for r in s.finals.collect())
    # 1 and 2 are one group, 3 has the category of 2, 4 is the only blocker left, 5 is rejected, 6 has no score
    assert got == [("r", "blocker", 1, 4, "best_grounded_fallback"), ("r", "driver", 1, 2, "above_threshold")]
    assert {r.analysis_run_id: (r.candidates, r["pass"], r.needs_review, r.reject) for r in s.summary.collect()} == {"r": (5, 2, 2, 1), "q": (1, 1, 0, 0)}
    assert pipeline.run(df.limit(0), hard, soft).finals.count() == 0
    plain = pipeline.run(df.drop("embedding"), hard, soft)
    assert sorted(r.id for r in plain.finals.collect()) == [2, 4]

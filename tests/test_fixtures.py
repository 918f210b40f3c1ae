"""Golden cases of FIXTURES.md §3 (values computed independently of Spark)."""

import pytest
from pyspark.sql import functions as F

from relmine.operators import consistency as SC
from relmine.operators import drift as DR
from relmine.operators import faithfulness as FG
from relmine.operators import features as QF

FG_CASES = [
    ("Harbor Ferry leaves at 9 and 17 daily. Fares cost $12.", "Harbor Ferry leaves at 9 and 17 daily. Fares cost $12.",
     1.0, 1.0, 1.0, 0.0, 0.0, 1.0, True),
    ("All trains stop at Elm Station every 20 minutes.",
     "Some trains stop at Oak Station every 45 minutes, and 3 never stop, not one.",
     0.0, 0.0, 0.536, 0.85, 0.667, 0.1908, False),
    ("the it of", "and so on", 1.0, 1.0, 0.5, 0.0, 1.0, 0.85, True),
    ("battery lasts long", "the battery lasts very long", 1.0, 1.0, 1.0, 0.0, 0.25, 1.0, True),
    ("Output rose 5% to 1,247 units.", "Output rose 5 percent to 1247 units.", 0.333, 0.333, 0.51, 0.0, 0.429, 0.5195, True),
]


def test_faithfulness_golden(spark):
    df = spark.createDataFrame([(i, c, r) for i, (c, r, *_) in enumerate(FG_CASES)], "id int, context string, response string")
    got = {r["id"]: r for r in FG.faithfulness(df).collect()}
    for i, (_, _, cov, fid, sim, con, nov, score, pred) in enumerate(FG_CASES):
        r = got[i]
        assert (r.entity_coverage, r.numeric_fidelity, r.semantic_similarity, r.contradiction_score, r.novel_word_ratio) == (
            cov, fid, sim, con, nov)
        assert r.faithfulness_score == pytest.approx(score, abs=1e-9)
        assert r.predicted_faithful is pred


def test_faithfulness_null_text(spark):
    df = spark.createDataFrame([(None, "x"), ("x", None)], "context string, response string")
    rows = FG.faithfulness(df).collect()
    assert all(r.faithfulness_score is None and r.entity_coverage is None for r in rows)


DRIFT_CASES = [
    ([0.9, 0.9, 0.9, 0.2, 0.1], 3),
    ([0.9, 0.1], None),
    ([0.8, 0.7, 0.6, 0.5], None),
    ([0.9, 0.9, 0.3, 0.9, 0.9, 0.1], 5),
    ([1.0, 1.0, 0.5, 1.0, 1.0, 0.5], 2),
    ([0.5, 0.5, 0.1, 0.9, 0.2], 2),
]


@pytest.mark.parametrize("partitions", [1, 3, 8])
def test_drift_points_golden(spark, partitions):
    rows = [(k, i, s, False) for k, (scores, _) in enumerate(DRIFT_CASES) for i, s in enumerate(scores)]
    df = spark.createDataFrame(rows, "key int, ts int, trust_score double, is_hallucination boolean")
    from relmine.operators import sequence

    out = DR.label_sequences(df, ["key"], ["ts"])
    got = {r.key: r.detected_drift_point for r in out.select("key", "detected_drift_point").distinct().collect()}
    assert got == {k: p for k, (_, p) in enumerate(DRIFT_CASES)}
    seq = sequence.ordered_sequence(df, ["key"], ["ts"], "trust_score", 2, partitions=partitions)
    for r in seq.collect():
        scores = DRIFT_CASES[r.key][0]
        assert r._pos == r.ts
        assert r._n == len(scores)
        assert r._prev == scores[max(0, r.ts - 2): r.ts]


SC_CASES = [
    (["river opened 1901", "river opened 1901"], (1, 1, 0, 1, 0, 1, 0, 1)),
    (["bridge opened 1901", "bridge opened 1911 late", "tunnel"],
     (0.147778, 0, 0.208989, 0, 5, 0.5, 0.467707, 0.26557)),
    (["it is", "so on"], (1, 1, 0, 0, 0, 1, 0, 0.8)),
    (["only one"], (None,) * 8),
]


def test_consistency_golden(spark):
    q = spark.createDataFrame([(i,) for i in range(len(SC_CASES))], "prompt_id long")
    s = spark.createDataFrame(
        [(i, j, t) for i, (texts, _) in enumerate(SC_CASES) for j, t in enumerate(texts)],
        "prompt_id long, sample_idx int, response string",
    )
    got = {r.prompt_id: r for r in SC.analyze(q, s).collect()}
    for i, (_, expected) in enumerate(SC_CASES):
        vals = [got[i][m] for m in SC.METRICS]
        for v, e in zip(vals, expected):
            if e is None:
                assert v is None
            else:
                assert v == pytest.approx(e, abs=1e-6)


def test_trust_map_golden(spark):
    rows = [
        (1, "Copper pipes carry water. Ok. Copper pipes resist heat! Lemons taste sour today.", None),
        (2, "A single sentence here.", None),
        (3, "Tiny. No.", None),
    ]
    df = spark.createDataFrame(rows, "response_id long, response string, reference string")
    out = DR.trust_map(df).orderBy("response_id", "sentence_idx").collect()
    r1 = [r for r in out if r.response_id == 1]
    assert [r.trust_score for r in r1] == [0.9, 0.366, 0.0]
    assert {r.drift_point for r in r1} == {2}
    assert [r.is_post_drift for r in r1] == [False, False, True]
    r2 = [r for r in out if r.response_id == 2]
    assert [(r.trust_score, r.drift_point) for r in r2] == [(0.8, None)]
    assert not [r for r in out if r.response_id == 3]


def test_prompt_feature_edges(spark):
    texts = [None, "", "How many ships sailed in 1999?", "In what year did it open?", "Whole grain bread", "Named after a hill"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, query string")
    got = {r.id: r for r in QF.extract(df).collect()}
    for i in (0, 1):
        r = got[i]
        assert r.query_word_count == 0 and r.length_bin is None and r.question_type == "other"
        assert r.specificity_bin == "low" and r.demands_numeric == 0 and r.asks_about_person == 0
    r = got[2]
    assert (r.question_type, r.demands_numeric, r.has_temporal_ref, r.specificity_demand_score) == ("quantity", 1, 1, 2)
    assert (r.specificity_bin, r.length_bin, r.query_word_count) == ("high", "short", 6)
    assert got[3].question_type == "temporal"
    assert got[4].question_type == "person" and got[4].asks_about_person == 0
    assert got[5].question_type == "enumeration" and got[5].asks_for_list == 0


@pytest.mark.parametrize("words,bin_", [(8, "short"), (9, "medium"), (15, "medium"), (16, "long"), (100, "long"), (101, None)])
def test_length_bins(spark, words, bin_):
    df = spark.createDataFrame([(" ".join(["w"] * words),)], "query string")
    assert QF.extract(df).first().length_bin == bin_

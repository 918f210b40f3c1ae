"""Trust maps stay inside the row of their response: no exchange, no window;
scores against plain Python, long responses included."""

import random

import pytest

from relmine.operators import drift as DR
from tests.test_tfidf_bruteforce import _text, _words, cos, tfidf

RESPONSES = "response_id long, response string, reference string"


def _expected(sents, ref):
    vecs = tfidf([ref, *sents] if ref else sents)
    if ref:
        return [0.5] * len(sents) if vecs is None else [cos(v, vecs[0]) for v in vecs[1:]]
    if len(sents) == 1:
        return [0.8]
    if vecs is None:
        return [0.5] * len(sents)
    return [0.9] + [sum(cos(vecs[i], vecs[j]) for j in range(i)) / i for i in range(1, len(sents))]


def test_scores_against_brute_force(spark):
    r = random.Random(3)
    rows = [(None, None, None), (7, None, "a reference"), (8, "", None), (9, "the of and so on. it is to be or.", None)]
    want = []
    for i, n in enumerate([1, 2, 5, 40, 150, 150]):
        words = _words(r, [5, 40, 900][i % 3])
        sents = ["shared " + _text(r, words, r.choice([3, 30])) + "." for _ in range(n)]
        for ref in (None, "", _text(r, words, 60), "the of and"):
            rows.append((i % 4, " ".join(sents), ref))  # ids repeat
            want += [(i % 4, k, s, x) for k, (s, x) in enumerate(zip(sents, _expected(sents, ref), strict=True))]
    got = DR.trust_scores(spark.createDataFrame(rows, RESPONSES)).filter("response_id < 7").collect()
    key = lambda x: (x[0], x[1], x[2], round(x[3], 6))
    got = sorted(((x.response_id, x.sentence_idx, x.sentence, x.score) for x in got), key=key)
    want = sorted(want, key=key)
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert [x[3] for x in got] == pytest.approx([x[3] for x in want], abs=1e-9)


def test_nothing_is_shuffled_or_sorted(spark):
    df = spark.createDataFrame([(1, "One sentence here. Another sentence there.", None)], RESPONSES)
    plan = DR.trust_map(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and "Sort " not in plan

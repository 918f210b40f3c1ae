"""TF-IDF relations and self-consistency of groups, in both physical forms,
against plain Python; a prompt of 20,000 samples."""

import math
import random

import pytest

from relmine.operators import consistency as SC
from relmine.operators import tfidf as TX
from tests.test_tfidf_bruteforce import _text, _words, cos, tfidf

SAMPLES = "prompt_id long, sample_idx int, response string"


def _corpus(seed):
    r = random.Random(seed)
    rows = []
    for p in range(10):
        words = _words(r, [4, 30, 700, 12, 3][p % 5])
        for s in range(r.choice([1, 2, 5, 9, 30])):
            n = r.choice([30, 40]) if p % 5 == 3 else r.choice([0, 2, 10, 300])
            # with a word that all samples share, no pair has cosine 0
            rows.append((p, s, ("same thing " if p % 5 in (3, 4) else "") + _text(r, words, n)))
    return rows


def _expected(texts):
    vecs = tfidf(texts)
    if vecs is None:
        return 1.0, 1.0, 0.0
    sims = [cos(vecs[i], vecs[j]) for i in range(len(texts)) for j in range(i)]
    m = sum(sims) / len(sims)
    return m, min(sims), math.sqrt(sum((x - m) ** 2 for x in sims) / len(sims))


@pytest.mark.parametrize("group_docs", [256, 1, 5])
def test_consistency_of_small_and_large_prompts(spark, group_docs, monkeypatch):
    monkeypatch.setattr(SC, "BLOCK_ROWS", 4)  # so that blocks are paired
    monkeypatch.setattr(SC, "OUTLIERS", 2)
    rows = _corpus(5)
    queries = spark.createDataFrame([(p,) for p in range(10)], "prompt_id long")
    prepared = SC.cut_lineage(SC.prepare_samples(queries, spark.createDataFrame(rows, SAMPLES)))
    got = {r.gid: r for r in SC.prompt_metrics(prepared, group_docs=group_docs).collect()}
    for p in range(10):
        texts = [t for q, _, t in rows if q == p]
        if len(texts) < 2:
            assert p not in got
            continue
        r = got[p]
        assert (r.semantic_consistency, r.semantic_consistency_min, r.semantic_consistency_std) == pytest.approx(_expected(texts), abs=1e-7), p


def test_a_prompt_of_20000_samples(spark):
    r = random.Random(9)
    words = [f"w{i}x" for i in range(3000)]
    rows = [(1, i, "shared " + _text(r, words, 25)) for i in range(20_000)] + [(2, i, "two words") for i in range(3)]
    samples = spark.createDataFrame(rows, SAMPLES).repartition(8)
    got = {r.prompt_id: r for r in SC.analyze(spark.createDataFrame([(1,), (2,)], "prompt_id long"), samples).collect()}
    assert got[2].semantic_consistency == 1.0
    # sums in plain Python, by the vectors' sum
    vecs = tfidf([t for p, _, t in rows if p == 1])
    total = {}
    for v in vecs:
        for t, x in v.items():
            total[t] = total.get(t, 0.0) + x
    mean = (sum(x * x for x in total.values()) - len(vecs)) / (len(vecs) * (len(vecs) - 1))
    assert got[1].semantic_consistency == pytest.approx(mean, abs=1e-9)
    # some samples have "shared" as their only kept term: no pair is below it
    assert 0 < got[1].semantic_consistency_min < mean


@pytest.mark.parametrize("group_docs,hot_rows", [(256, 100_000), (2, 100_000), (2, 3)])
def test_weights(spark, group_docs, hot_rows, monkeypatch):
    """``hot_rows`` of 3 deals nearly every term to several parts."""
    monkeypatch.setattr(TX.large_weights, "__defaults__", (TX.MAX_FEATURES, hot_rows))
    rows = [*_corpus(6), (3, 99, None), (None, 1, "no group")]
    df = spark.createDataFrame(rows, SAMPLES).repartition(4)
    got = {}
    for r in TX.tfidf_weights(df, "prompt_id", "sample_idx", "response", group_docs=group_docs).collect():
        assert (r.prompt_id, r.sample_idx, r.term) not in got
        got[r.prompt_id, r.sample_idx, r.term] = r.weight
    want = {}
    for p in range(10):
        texts = [(s, t) for q, s, t in rows if q == p and t is not None]
        for (s, _), v in zip(texts, tfidf([t for _, t in texts]) or [{}] * len(texts), strict=True):
            want.update({(p, s, t): x for t, x in v.items()})
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_cosines_of_given_pairs(spark):
    docs = spark.createDataFrame([(1, 1, "red green"), (1, 2, "red blue"), (1, 3, "black"), (1, 4, "the of"), (2, 1, "red green")], "g long, d long, t string")
    pairs = spark.createDataFrame([(1, 1, 2, "x"), (1, 2, 1, "y"), (1, 1, 3, "x"), (1, 1, 4, "x"), (1, 1, 9, "x"), (1, None, 1, "x"), (1, 1, 1, "x"), (1, 1, 2, "x")], "g long, a long, b long, rank string")
    got = TX.cosines(TX.tfidf_weights(docs, "g", "d", "t"), pairs, "g", "d", "a", "b")
    assert got.columns == ["g", "a", "b", "rank", "cosine"]
    vecs = tfidf(["red green", "red blue", "black", "the of"])
    rows = sorted(((r.a or 0, r.b, r.rank, round(r.cosine, 9)) for r in got.collect()))
    c = round(cos(vecs[0], vecs[1]), 9)
    assert rows == sorted([(1, 2, "x", c), (1, 2, "x", c), (2, 1, "y", c), (1, 3, "x", 0.0), (1, 4, "x", 0.0), (1, 9, "x", 0.0), (0, 1, "x", 0.0), (1, 1, "x", 1.0)])


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SAMPLES)
    weights = TX.tfidf_weights(empty, "prompt_id", "sample_idx", "response")
    assert weights.count() == 0
    pairs = spark.createDataFrame([(1, 2, 3)], "prompt_id long, a int, b int")
    assert TX.cosines(weights, pairs, "prompt_id", "sample_idx", "a", "b").first().cosine == 0.0
    assert SC.analyze(empty.select("prompt_id"), empty).count() == 0

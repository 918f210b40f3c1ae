"""TF-IDF operators against a brute-force Python restatement of the
reference's vectoriser semantics on random texts (vocabularies above and
below the 500-term cap, stop-word-only and empty documents)."""

import math
import random
import re
from collections import Counter

import pytest

from relmine.functions.text import STOP_WORDS
from relmine.operators import consistency as SC
from relmine.operators import faithfulness as FG

STOP = set(STOP_WORDS)


def tokens(text):
    return [t for t in re.findall(r"(?u)\b\w\w+\b", text.lower()) if t not in STOP]


def tfidf(docs, cap=500):
    counts = [Counter(tokens(d)) for d in docs]
    vocab = sorted(set().union(*counts))
    if not vocab:
        return None
    total = Counter()
    for c in counts:
        total.update(c)
    if len(vocab) > cap:
        vocab = sorted(vocab, key=lambda t: (-total[t], t))[:cap]
    n = len(docs)
    df = {t: sum(1 for c in counts if t in c) for t in vocab}
    idf = {t: math.log((1 + n) / (1 + df[t])) + 1 for t in vocab}
    vecs = []
    for c in counts:
        v = {t: c[t] * idf[t] for t in vocab if t in c}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vecs.append({t: x / norm for t, x in v.items()} if norm else {})
    return vecs


def cos(a, b):
    return sum(x * b.get(t, 0.0) for t, x in a.items())


def _words(rnd, n_vocab):
    base = [f"w{i}x" for i in range(n_vocab)]
    return base + ["the", "and", "of", "a", "it"]


def _text(rnd, words, n):
    return " ".join(rnd.choice(words) for _ in range(n))


@pytest.mark.parametrize("seed", [1, 2])
def test_pair_cosine_matches_brute_force(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(40):
        words = _words(rnd, rnd.choice([5, 50, 900]))
        a = _text(rnd, words, rnd.choice([0, 3, 40, 700]))
        b = _text(rnd, words, rnd.choice([0, 3, 40, 700]))
        rows.append((i, a, b))
    rows.append((100, "the it of", "and so on"))
    df = spark.createDataFrame(rows, "id int, context string, response string")
    got = {r.id: r.semantic_similarity for r in FG.faithfulness(df).collect()}
    for i, a, b in rows:
        vecs = tfidf([a, b])
        exp = 0.5 if vecs is None else cos(vecs[0], vecs[1])
        assert got[i] == pytest.approx(round(exp, 3), abs=1.0001e-3), i


def test_group_consistency_matches_brute_force(spark):
    rnd = random.Random(7)
    samples, prompts = [], []
    for p in range(12):
        prompts.append((p,))
        words = _words(rnd, rnd.choice([4, 30, 700]))
        for s in range(rnd.choice([1, 2, 5, 9])):
            samples.append((p, s, _text(rnd, words, rnd.choice([0, 2, 10, 300]))))
    q = spark.createDataFrame(prompts, "prompt_id long")
    s = spark.createDataFrame(samples, "prompt_id long, sample_idx int, response string")
    got = {r.prompt_id: r for r in SC.analyze(q, s).collect()}
    for (p,) in prompts:
        texts = [t for pp, _, t in samples if pp == p]
        r = got[p]
        if len(texts) < 2:
            assert r.semantic_consistency is None
            continue
        vecs = tfidf(texts)
        if vecs is None:
            exp = (1.0, 1.0, 0.0)
        else:
            sims = [cos(vecs[i], vecs[j]) for i in range(len(texts)) for j in range(len(texts)) if i != j]
            m = sum(sims) / len(sims)
            exp = (m, min(sims), math.sqrt(sum((x - m) ** 2 for x in sims) / len(sims)))
        assert (r.semantic_consistency, r.semantic_consistency_min, r.semantic_consistency_std) == pytest.approx(exp, abs=1e-9)

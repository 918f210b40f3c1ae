"""Texts of pairs are read once, and terms of one token are counted, not
weighed one by one."""

import math
import random
from collections import Counter

import pytest

from relmine.functions import text as T
from relmine.functions.tfidf import with_pair_cosine
from relmine.operators import faithfulness as FG
from relmine.sources import tables as S

W = math.log(1.5) + 1


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _cosine(a, b, cap):
    ca, cb = Counter(a), Counter(b)
    kept = sorted(ca.keys() | cb.keys(), key=lambda t: (-ca[t] - cb[t], t.encode()))[:cap]
    if not kept:
        return 0.5
    f = {t: 1.0 if ca[t] and cb[t] else W for t in kept}
    dot, na, nb = (sum(x[t] * y[t] * f[t] ** 2 for t in kept) for x, y in ((ca, cb), (ca, ca), (cb, cb)))
    return dot / math.sqrt(na * nb) if na and nb else 0.0


def test_pair_cosine_matches_brute_force(spark):
    r = random.Random(11)
    words = [f"{x}{y}" for x in ("a", "ab", "é_", "b", "ba") for y in ("", "0", "_", "z", "ü", "00", "zz")]
    pairs = [([r.choice(words[:k]) for _ in range(r.randint(0, 30))], [r.choice(words[-k:]) for _ in range(r.randint(0, 30))]) for k in range(1, 36) for _ in range(2)]
    pairs += [([], []), (["a"], []), (["a"] * 60000, ["a", "b"]), ([f"t{i}" for i in range(700)], [f"t{i}" for i in range(400, 900)] * 2)]
    df = spark.createDataFrame([(i, sorted(a), sorted(b)) for i, (a, b) in enumerate(pairs)], "i int, a array<string>, b array<string>")
    df = df.selectExpr("i", "sort_array(a) a", "sort_array(b) b")
    for cap in (3, 12, 500):
        got = {x.i: x.c for x in with_pair_cosine(df, "a", "b", "c", cap).collect()}
        for i, (a, b) in enumerate(pairs):
            assert got[i] == pytest.approx(_cosine(a, b, cap), abs=1e-12), (cap, a, b)
    none = spark.createDataFrame([(None, ["a"]), (["a"], None)], "a array<string>, b array<string>")
    assert [x.c for x in with_pair_cosine(none, "a", "b", "c").collect()] == [None, None]


def test_tokens_cut_at_spaces_are_those_of_the_patterns(spark):
    texts = ["", " ", "a", " a  b ", "a b c\x1cd\x85e\tf​g", "x--y, z_1!\n\nÉté 𝐀𝐁 ٣٤", "İx éf", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for x in df.select("t", T.ws_tokens(df.t).alias("w"), T.extract_all(df.t, T.WS_TOKEN).alias("w0"), T.word_runs(df.t).alias("r"), T.extract_all(df.t, T.WORD_RUN).alias("r0")).collect():
        assert x.w == x.w0 and x.r == x.r0 and x.w == (None if x.t is None else x.t.split())


def test_documents_are_read_once_and_scored_like_their_pairs(spark, tmp_path):
    r = random.Random(5)
    docs = [(i, None if i % 17 == 3 else " ".join(r.choice(["Paris", "not", "all", "few", "7.5%", "x", "$3,000", "ship", "Ship"]) for _ in range(r.randint(0, 40)))) for i in range(150) if i != 70]
    spark.createDataFrame([*docs, (20, "twice 1"), (None, "x")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, i % 2) for i in range(0, 150, 3)] + [(30, 1)]
    spark.createDataFrame(labels, "doc_id long, quality long").write.parquet(f"{tmp_path}/labels.parquet")
    once = S.document_pairs(spark, str(tmp_path), FG.faithfulness, FG.read)
    each = FG.faithfulness(S.document_pairs(spark, str(tmp_path)).filter("doc_id != 21"))
    assert once.columns == each.columns
    once = once.filter("doc_id != 21")  # document 20 comes twice: either may be its context
    assert once.count() == each.count() > 140 and once.exceptAll(each).isEmpty()
    assert _plan(once.select("faithfulness_score")).count("array_union(") == 1

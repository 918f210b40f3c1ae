"""Risk rules and the level-wise tree against brute force in plain Python."""

import itertools
import random

import pytest

from relmine.operators import rules as RR


def _data(n=600, seed=7):
    rnd = random.Random(seed)
    rows = []
    for _ in range(n):
        a = rnd.randint(0, 1)
        b = rnd.randint(0, 1)
        c = rnd.choice(["x", "y", "z"])
        p = 0.1 + 0.5 * a + 0.2 * b * (c == "y")
        rows.append((a, b, c, rnd.random() < p))
    return rows


def _gini(p, q):
    w = p + q
    return 0.0 if w == 0 else 1 - (p / w) ** 2 - (q / w) ** 2


def _brute_tree(X, y, names, max_depth=3):
    n = len(y)
    npos = sum(y)
    w1, w0 = n / (2 * npos), n / (2 * (n - npos))
    min_leaf = max(10, int(0.05 * n))
    imps = [0.0] * len(names)
    leaves = {}

    def grow(idx, node, depth):
        wp = sum(w1 for i in idx if y[i])
        wn = sum(w0 for i in idx if not y[i])
        imp = _gini(wp, wn)
        if depth >= max_depth or len(idx) < 2 * min_leaf or imp <= RR.EPSILON:
            leaves[node] = wp / (wp + wn)
            return
        best = None
        for f in range(len(names)):
            vals = sorted({X[i][f] for i in idx})
            for lo, hi in zip(vals, vals[1:]):
                thr = lo / 2 + hi / 2
                L = [i for i in idx if X[i][f] <= thr]
                R = [i for i in idx if X[i][f] > thr]
                if len(L) < min_leaf or len(R) < min_leaf:
                    continue
                lp = sum(w1 for i in L if y[i]); ln = sum(w0 for i in L if not y[i])
                rp = sum(w1 for i in R if y[i]); rn = sum(w0 for i in R if not y[i])
                gain = imp - (lp + ln) / (wp + wn) * _gini(lp, ln) - (rp + rn) / (wp + wn) * _gini(rp, rn)
                if best is None or gain > best[0] + 1e-12:
                    best = (gain, f, thr, L, R, (lp + ln) * _gini(lp, ln) + (rp + rn) * _gini(rp, rn))
        if best is None:
            leaves[node] = wp / (wp + wn)
            return
        _, f, thr, L, R, child = best
        imps[f] += (wp + wn) * imp - child
        grow(L, 2 * node, depth + 1)
        grow(R, 2 * node + 1, depth + 1)

    grow(list(range(n)), 1, 0)
    s = sum(imps)
    return leaves, [v / s for v in imps] if s else imps


def test_tree_matches_brute_force(spark):
    rows = _data()
    df = spark.createDataFrame(rows, "a int, b int, c string, y boolean")
    feats = ["a", "b", "c"]
    comp = RR.compress(df, feats, "y", checkpoint=False)
    tree = RR.fit_tree(comp, feats)
    assert tree.encoding.names == ["a", "b", "c_y", "c_z"]
    X = [(a, b, float(c == "y"), float(c == "z")) for a, b, c, _ in rows]
    y = [r[3] for r in rows]
    leaves, imps = _brute_tree(X, y, tree.encoding.names)
    assert tree.importances == pytest.approx(imps, abs=1e-9)
    assert sorted(tree.leaves.values()) == pytest.approx(sorted(leaves.values()), abs=1e-9)
    scored = RR.score(df, tree).collect()
    assert {round(r.predicted_risk, 9) for r in scored} <= {round(v, 9) for v in leaves.values()}


def test_mined_rules_brute_force(spark):
    rows = _data()
    df = spark.createDataFrame(rows, "a int, b int, c string, y boolean")
    feats = ["a", "b", "c"]
    got = {r.rule: (r.confidence, r.support, r.n_matches) for r in RR.mined_rules(RR.compress(df, feats, "y", False), feats, 0.05, 0.3).collect()}
    n = len(rows)
    exp = {}
    for j, f in enumerate(feats):
        for v in {r[j] for r in rows}:
            sub = [r for r in rows if r[j] == v]
            rate = sum(r[3] for r in sub) / len(sub)
            if len(sub) >= 0.05 * n and rate >= 0.3:
                exp[f"{f}={v}"] = (rate, len(sub) / n, len(sub))
    for (i, f1), (j, f2) in itertools.combinations(list(enumerate(feats))[:2], 2):
        for v1 in (0, 1):
            for v2 in (0, 1):
                sub = [r for r in rows if r[i] == v1 and r[j] == v2]
                if sub and len(sub) >= max(0.05 * n, 5) and sum(r[3] for r in sub) / len(sub) >= 0.3:
                    exp[f"{f1}={v1} & {f2}={v2}"] = (sum(r[3] for r in sub) / len(sub), len(sub) / n, len(sub))
    assert got.keys() == exp.keys()
    for k in exp:
        assert got[k] == pytest.approx(exp[k])


def test_unfitted_scores_half(spark):
    df = spark.createDataFrame([(1,)], "a int")
    assert RR.score(df, None).first().predicted_risk == 0.5


def test_root_split_agrees_with_spark_ml(spark):
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.sql import functions as F

    rows = _data(n=800, seed=3)
    df = spark.createDataFrame(rows, "a int, b int, c string, y boolean")
    feats = ["a", "b", "c"]
    tree = RR.fit_tree(RR.compress(df, feats, "y", checkpoint=False), feats, max_depth=1)
    n, npos = len(rows), sum(r[3] for r in rows)
    enc = df.select(
        *[c.alias(name) for c, name in zip(tree.encoding.columns(), tree.encoding.names)],
        F.col("y").cast("double").alias("label"),
        F.when(F.col("y"), n / (2.0 * npos)).otherwise(n / (2.0 * (n - npos))).alias("w"),
    )
    data = VectorAssembler(inputCols=tree.encoding.names, outputCol="features").transform(enc)
    model = DecisionTreeClassifier(maxDepth=1, weightCol="w", minInstancesPerNode=max(10, int(0.05 * n))).fit(data)
    assert model._java_obj.rootNode().split().featureIndex() == tree.splits[1][0]

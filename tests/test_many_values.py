"""Histograms of many groups, features of many values, wide rates."""

import random

import numpy as np
from pyspark.sql import functions as F

from relmine.operators import evaluation as EV
from relmine.operators import rules as RR
from relmine.operators import skew


def test_histogram_of_10000_groups(spark):
    df = spark.range(40_000).select((F.col("id") % 10_000).alias("g"), (F.col("id") * 7 % 97).cast("double").alias("x"))
    out = EV.histogram(df, "x", ["g"], 5)
    assert out.count() == 50_000
    got = {(r.g, r.bin): r["count"] for r in out.filter("g in (0, 1, 9999)").collect()}
    for g in (0, 1, 9999):
        counts, _ = np.histogram([i * 7 % 97 for i in range(g, 40_000, 10_000)], bins=5)
        assert [got[g, b] for b in range(5)] == counts.tolist()


def test_histogram_with_hot_and_null_groups(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 50)  # the large group is dealt to several parts
    r = random.Random(1)
    rows = [("hot", r.random()) for _ in range(900)] + [(f"g{i}", float(i)) for i in range(5)] + [(None, 1.0), ("hot", None)]
    out = EV.histogram(spark.createDataFrame(rows, "g string, x double"), "x", ["g"], 7).collect()
    counts, _ = np.histogram([x for g, x in rows if g == "hot" and x is not None], bins=7)
    assert [r["count"] for r in sorted((r for r in out if r.g == "hot"), key=lambda r: r.bin)] == counts.tolist()
    assert {r.g for r in out} == {"hot", *(f"g{i}" for i in range(5))} and sum(r["count"] for r in out) == 905


def test_histogram_without_groups(spark):
    out = EV.histogram(spark.createDataFrame([(float(i),) for i in range(10)], "x double"), "x", [], 5)
    assert out.columns == ["bin", "bin_start", "bin_end", "count"] and [r["count"] for r in out.orderBy("bin").collect()] == [2] * 5


def test_running_counts_by_ranges(spark):
    """Ranges give what one window per node and feature gives."""
    r = random.Random(2)
    rows = list({(node, f, r.randint(0, 300) / 4): (r.randint(1, 9), r.randint(0, 1)) for node in (1, 2) for f in (0, 1, 2) for _ in range(200)}.items())
    g = spark.createDataFrame([(*k, *v) for k, v in rows], "node int, f int, v double, n long, pos long")
    cols = ["node", "f", "v", "nl", "posl", "nt", "post", "v_next"]
    want = sorted(map(tuple, RR.running_counts(g).select(*cols).collect()), key=str)
    for ranges in (1, 4, 40):
        assert sorted(map(tuple, RR.running_counts(g, ranges).select(*cols).collect()), key=str) == want


def test_a_feature_of_a_million_values(spark):
    """The split is found, and no range holds more than its share."""
    df = spark.range(1_000_000).select(F.col("id").cast("double").alias("x"), (F.col("id") % 2).cast("int").alias("noise"), (F.col("id") >= 654_321).alias("y"))
    tree = RR.fit_tree(RR.compress(df, ["x", "noise"], "y"), ["x", "noise"], max_depth=1)
    assert tree.splits == {1: (0, 654_320.5)} and tree.leaves == {2: 0.0, 3: 1.0}
    g = df.select(F.lit(1).alias("node"), F.lit(0).alias("f"), F.col("x").alias("v"), F.lit(1).alias("n"), F.lit(0).alias("pos"))
    dealt = g.repartitionByRange(20, "node", "f", "v").groupBy(F.spark_partition_id()).count()
    assert dealt.agg(F.max("count")).first()[0] < 100_000


def test_rules_come_from_grouping_sets(spark):
    rows = [(a, b, "s" if a else None, bool(a and b)) for a in (0, 1) for b in (0, 1, None) for _ in range(20)]
    df = spark.createDataFrame(rows, "a int, b int, s string, y boolean")
    rules = RR.mined_rules(RR.compress(df, ["a", "b", "s"], "y"), ["a", "b", "s"], 0.05, 0.3)
    plan = rules._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" in plan and "explode" not in plan
    got = {(r.rule, round(r.confidence, 9), r.n_matches, r.kind) for r in rules.collect()}
    assert got == {("a=1", round(20 / 60, 9), 60, "single"), ("b=1", 0.5, 40, "single"), ("s=s", round(20 / 60, 9), 60, "single"), ("a=1 & b=1", 1.0, 20, "pair")}


def test_wide_rates(spark):
    rows = [(1, True), (1, False), (1, False), (0, False), (None, True), (0, None)]
    out = EV.feature_pivot(spark.createDataFrame(rows, "f int, is_hallucination boolean"), ["f"])
    assert sorted(map(tuple, out.select("feature", "value", "n_false", "n_true").collect())) == [("f", "0", 1, 0), ("f", "1", 2, 1)]

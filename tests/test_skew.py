"""A key holding most rows is spread over many chunks and still gets exact
positions, previous values and drift points."""

import random

from pyspark.sql import functions as F

from relmine.operators import drift as DR
from relmine.operators import sequence


def _rows(seed=11):
    rnd = random.Random(seed)
    rows = []
    for key, n in [(0, 6000)] + [(k, rnd.randint(1, 30)) for k in range(1, 60)]:
        for ts in range(n):
            rows.append((key, ts * 7 + key, rnd.random(), rnd.random() < 0.3))
    return rows


def test_hot_key_sequence_is_exact(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "key int, ts int, trust_score double, is_hallucination boolean")
    seq = sequence.ordered_sequence(df, ["key"], ["ts"], "trust_score", 2, partitions=16)
    by_key = {}
    for k, ts, v, _ in rows:
        by_key.setdefault(k, []).append((ts, v))
    for r in seq.select("key", "ts", "_pos", "_n", "_prev").collect():
        vals = [v for _, v in sorted(by_key[r.key])]
        pos = sorted(t for t, _ in by_key[r.key]).index(r.ts)
        assert r._pos == pos and r._n == len(vals)
        assert r._prev == vals[max(0, pos - 2): pos]


def test_hot_key_spans_many_chunks(spark):
    df = spark.createDataFrame(_rows(), "key int, ts int, trust_score double, is_hallucination boolean")
    chunked = df.repartitionByRange(16, "key", "ts").withColumn("_chunk", F.spark_partition_id())
    assert chunked.filter("key = 0").select("_chunk").distinct().count() >= 8


def test_hot_key_drift_point_matches_python(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "key int, ts int, trust_score double, is_hallucination boolean")
    got = {r.key: r.detected_drift_point for r in DR.label_sequences(df, ["key"], ["ts"]).select("key", "detected_drift_point").distinct().collect()}
    by_key = {}
    for k, ts, v, _ in rows:
        by_key.setdefault(k, []).append((ts, v))
    for k, items in by_key.items():
        s = [v for _, v in sorted(items)]
        best, point = 0.0, None
        if len(s) >= 3:
            for i in range(1, len(s)):
                prev = s[max(0, i - 2): i]
                drop = sum(prev) / len(prev) - s[i]
                if drop > best and drop > 0.3:
                    best, point = drop, i
        assert got[k] == point, k

"""Caller's indices, repeated ids, column types, files, sessions, restarts."""

import glob
import os
import subprocess
import sys
import tempfile
import textwrap

import pytest
from pyspark.sql import functions as F

from relmine import session
from relmine.operators import consistency as SC
from relmine.operators import drift as DR
from relmine.operators import faithfulness as FG
from relmine.operators import features as QF
from relmine.operators import rules as RR
from relmine.sources import schemas
from relmine.sources.tables import read
from relmine.streaming import monitor


@pytest.mark.parametrize("index, flagged", [([0, 1, 2, 3, 4], 2), ([1, 2, 3, 4, 5], 3), ([0, 2, 4, 6, 8], 3), (None, 2)])
def test_drift_uses_the_given_index(spark, index, flagged):
    rows = [("q", i, s, s < 0.5, (index or range(5))[i]) for i, s in enumerate([0.9, 0.9, 0.9, 0.2, 0.1])]
    df = spark.createDataFrame(rows, "q string, t int, trust_score double, is_hallucination boolean, sentence_idx int")
    out = DR.label_sequences(df if index else df.drop("sentence_idx"), ["q"], ["t"])
    got = out.orderBy("t").collect()
    assert [r.sentence_idx for r in got] == (index or [0, 1, 2, 3, 4])
    assert got[0].detected_drift_point == 3 and sum(r.post_drift for r in got) == flagged
    s = DR.drift_summary(out, ["q"]).first()
    assert (s.responses, s.responses_with_drift) == (1, 1)
    assert s.sentence_accuracy == sum(r.prediction_correct for r in got) / 5


def test_repeated_sample_index_counts_every_sample(spark):
    queries = spark.createDataFrame([(1,)], "prompt_id long")
    texts = ["red fox 1", "red dog 2", "red fox 3"]

    def metrics(ids):
        rows = [(1, i, t) for i, t in zip(ids, texts, strict=True)]
        return SC.analyze(queries, spark.createDataFrame(rows, "prompt_id long, sample_idx int, response string")).select(*SC.METRICS).first()

    assert tuple(metrics([0, 0, 1])) == pytest.approx(tuple(metrics([0, 1, 2])))


def test_hot_prompt_among_many(spark):
    """One prompt with a third of all samples gives what plain counting gives."""
    rows = [(0, i, f"common w{i % 7} {i % 3}") for i in range(200)] + [(p, i, f"x{p} y{i}") for p in range(1, 101) for i in range(4)]
    samples = spark.createDataFrame(rows, "prompt_id long, sample_idx int, response string")
    got = SC.analyze(samples.select("prompt_id").distinct(), samples).filter("prompt_id = 0").first()
    sets = [set(t.split()) for p, _, t in rows if p == 0]
    assert got.lexical_overlap == pytest.approx(len(set.intersection(*sets)) / len(set.union(*sets)))
    assert got.numeric_agreement == pytest.approx(67 / 200) and got.length_cv == pytest.approx(0)


def test_repeated_response_id_keeps_every_sentence(spark):
    a, b = "Water is wet. Fire is hot.", "Snow is cold. Grass is green. Sky is blue."
    rows = [(1, a, None), (1, b, None), (1, b, None), (2, b, None)]
    got = DR.trust_map(spark.createDataFrame(rows, "response_id long, response string, reference string"))
    counts = {(r.response_id, r.sentence): r["count"] for r in got.groupBy("response_id", "sentence").count().collect()}
    assert got.count() == 11 and all(n == (2 if i == 1 and "Water" not in s and "Fire" not in s else 1) for (i, s), n in counts.items())
    alone = DR.trust_map(spark.createDataFrame(rows[3:], "response_id long, response string, reference string"))
    scores = lambda df, i: sorted((r.sentence_idx, r.trust_score) for r in df.filter(F.col("response_id") == i).collect())
    assert scores(got, 2) == scores(alone, 2)


def test_pairs_take_numbers_only(spark):
    rows = [(i % 2 == 0, i % 3 == 0, i % 2, i % 3 > 0, "c" if i % 2 else "d", i % 2 == 0) for i in range(60)]
    df = spark.createDataFrame(rows, "a boolean, b boolean, p int, m boolean, s string, y boolean").withColumn("k", F.col("p") * 2)
    rules = RR.mined_rules(RR.compress(df, ["a", "b", "p", "k", "m", "s"], "y"), ["a", "b", "p", "k", "m", "s"]).collect()
    assert {r.rule for r in rules if r.kind == "pair"} == {"p=0 & k=0"}
    assert "a=True" in {r.rule for r in rules} and not any("true" in r.rule for r in rules)


def test_many_valued_features(spark):
    n = 3000
    df = spark.range(n).select(F.col("id").cast("string").alias("s"), (F.col("id") / 7).alias("x"), (F.col("id") > n // 2).alias("y"))
    with pytest.raises(ValueError, match="not categorical"):
        RR.fit_tree(RR.compress(df, ["s", "x"], "y"), ["s", "x"])
    tree = RR.fit_tree(RR.compress(df, ["x"], "y"), ["x"])
    assert tree.splits[1] == (0, pytest.approx((n // 2 + 0.5) / 7))
    assert RR.score(df, tree).filter((F.col("predicted_risk") > 0.5) != F.col("y")).count() == 0


def test_equal_gains_go_to_the_first_feature(spark):
    df = spark.range(200).select((F.col("id") % 2).alias("p"), (1 - F.col("id") % 2).alias("q"), ((F.col("id") % 2 == 1) & (F.col("id") > 9)).alias("y"))
    for parts in (1, 7):
        assert RR.fit_tree(RR.compress(df.repartition(parts), ["p", "q"], "y"), ["p", "q"]).splits[1][0] == 0


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_declared_schemas_round_trip(spark, fmt):
    rows = [(1, 'say "hi",\nthere', "a\\b"), (2, "é", "x"), (3, "two\n\nlines", "y")]
    df = spark.createDataFrame([(i, q, r, "d", i == 1, "none", "low", 0.5) for i, q, r in rows], schemas.QUERIES)
    path = f"{tempfile.mkdtemp(prefix='relmine-io-')}/queries.{fmt}"
    from relmine.sources.sinks import write_table

    write_table(df, path, fmt)
    back = read(spark, path, schemas.QUERIES)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_narrow_person_words(spark):
    df = spark.createDataFrame([("the professor", "x"), ("who is it", "x")], "query string, response string")
    wide = [r.asks_about_person_raw for r in QF.label_features(df).collect()]
    narrow = [r.asks_about_person_raw for r in QF.label_features(df, person_words=QF.PERSON_WORDS_NARROW).collect()]
    assert wide == [True, True] and narrow == [False, True]


def test_reliable_prompts_are_more_consistent(spark):
    queries = spark.createDataFrame([(1, False), (2, True)], "prompt_id long, is_hallucination boolean")
    same = ["Paris is the capital of France.", "The capital of France is Paris.", "Paris is France's capital city."]
    apart = ["It was founded in 1823 by Smith.", "Nobody knows; perhaps 1911?", "A company of 40 people began it."]
    rows = [(p, i, t) for p, texts in ((1, same), (2, apart)) for i, t in enumerate(texts)]
    gap = SC.discrimination(SC.analyze(queries, spark.createDataFrame(rows, "prompt_id long, sample_idx int, response string"))).first().gap
    assert gap > 0


def test_faithful_answers_score_higher(spark):
    context = "The Eiffel Tower in Paris is 330 metres tall and was completed in 1889."
    rows = [(context, "The Eiffel Tower is 330 metres tall and was completed in 1889.", True), (context, "The Big Ben in London is 512 metres tall and was never completed.", False)]
    scores = {r.f: r.faithfulness_score for r in FG.faithfulness(spark.createDataFrame(rows, "context string, response string, f boolean")).collect()}
    assert scores[True] > scores[False]


def test_cluster_needs_a_shared_folder(spark, monkeypatch):
    monkeypatch.setattr(session, "is_local", lambda s: False)
    monkeypatch.setattr(session, "shared_dir", lambda s: None)
    monkeypatch.setattr(type(spark.sparkContext), "getCheckpointDir", lambda self: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(spark)


def test_file_streams_need_a_stable_folder(spark):
    stream = monitor.rag_stream(spark, tempfile.mkdtemp(prefix="relmine-stream-src-"))
    with pytest.raises(ValueError, match="checkpoint folder"):
        monitor.start(stream, path=tempfile.mkdtemp(prefix="relmine-stream-out-"))


ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
RESTART = """
import sys
from relmine.session import get_session
from relmine.streaming import monitor
spark = get_session("local[2]", **{"spark.checkpoint.dir": sys.argv[1], "spark.sql.shuffle.partitions": "2"})
scored = monitor.score_stream(monitor.rag_stream(spark, sys.argv[2]))
q = monitor.start(scored, path=sys.argv[3], query_name="restart")
q.processAllAvailable()
q.stop()
spark.stop()
"""


def test_restarted_stream_writes_no_row_twice(spark):
    shared, source, out = (tempfile.mkdtemp(prefix=f"relmine-restart-{x}-") for x in ("ckpt", "src", "out"))
    for part in range(2):  # two applications, the second with one more file
        rows = [(part * 10 + i, 1, "context 5", f"response {i}") for i in range(4)]
        spark.createDataFrame(rows, monitor.RAG_SCHEMA).coalesce(1).write.mode("append").parquet(source)
        subprocess.run([sys.executable, "-c", textwrap.dedent(RESTART), shared, source, out], check=True, timeout=200, cwd=ROOT)
    assert spark.read.parquet(out).count() == spark.read.parquet(source).count() == 8
    assert glob.glob(f"{shared}/streams/restart/offsets/*")

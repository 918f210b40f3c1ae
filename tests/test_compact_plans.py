"""Plans of the text operators move texts and vectors, never a row per term;
what reads the texts runs once."""

import random

import pytest

from relmine.operators import evaluation as EV
from relmine.operators import faithfulness as FG
from relmine.operators import tfidf as TX
from tests.test_tfidf_bruteforce import _text, _words, cos, tfidf

DOCS = "g long, d long, t string"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_weights_move_texts_alone(spark):
    docs = spark.createDataFrame([(1, 1, "red green"), (1, 2, "red blue"), (2, 3, "black")], DOCS)
    plan = _plan(TX.tfidf_weights(docs, "g", "d", "t"))
    assert plan.count("Exchange hash") == 1 and "Window" not in plan, plan


def test_cosines_join_vectors(spark):
    """No join and no exchange is keyed by a term or its rank."""
    docs = spark.createDataFrame([(1, 1, "red green"), (1, 2, "red blue"), (2, 3, "black")], DOCS)
    pairs = spark.createDataFrame([(1, 1, 2)], "g long, a long, b long")
    plan = _plan(TX.cosines(TX.tfidf_weights(docs, "g", "d", "t"), pairs, "g", "d", "a", "b"))
    keyed = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x or "Join" in x]
    assert keyed and not [x for x in keyed if "rank" in x or "term" in x], keyed


def test_groups_of_many_characters_take_the_plan_of_large_ones(spark, monkeypatch):
    monkeypatch.setattr(TX, "GROUP_CHARS", 200)
    r = random.Random(4)
    texts = {(g, d): _text(r, _words(r, 60), 5 + 40 * g) for g in range(3) for d in range(4)}
    docs = spark.createDataFrame([(g, d, t) for (g, d), t in texts.items()], DOCS)
    pairs = spark.createDataFrame([(g, a, b) for g in range(3) for a in range(4) for b in range(4)], "g long, a long, b long")
    vecs = {g: tfidf([texts[g, d] for d in range(4)]) for g in range(3)}
    got = TX.cosines(TX.tfidf_weights(docs, "g", "d", "t"), pairs, "g", "d", "a", "b").collect()
    assert len(got) == 48
    for x in got:
        assert x.cosine == pytest.approx(cos(vecs[x.g][x.a], vecs[x.g][x.b]), abs=1e-9)


def test_rows_that_repeat_an_id_have_one_length(spark):
    docs = spark.createDataFrame([(1, 1, "red red"), (1, 1, "blue"), (1, None, "red"), (1, None, "red")], DOCS)
    one = [x.weight for x in TX.tfidf_weights(docs, "g", "d", "t").filter("d = 1").collect()]
    none = [x.weight for x in TX.tfidf_weights(docs, "g", "d", "t").filter("d is null").collect()]
    assert sum(x * x for x in one) == pytest.approx(1.0) and sum(x * x for x in none) == pytest.approx(1.0)


def test_histogram_reads_its_rows_once(spark):
    df = spark.createDataFrame([("In 1999 Paris had 7 ships.", "Paris had 8 ships.", True)], "context string, response string, is_faithful boolean")
    plan = _plan(EV.faithfulness_histograms(FG.faithfulness(df)))
    assert "regexp_extract_all" not in plan and "aggregate(" not in plan

"""Small prompts count their words in whole arrays, with the results of large ones."""

import random

import pytest

from relmine.operators import consistency as SC


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_small_prompts_explode_no_facts(spark):
    queries = spark.createDataFrame([(1,)], "prompt_id long")
    samples = spark.createDataFrame([(1, 0, "a b 3"), (1, 1, "b c 4")], "prompt_id long, sample_idx int, response string")
    prepared = SC.cut_lineage(SC.prepare_samples(queries, samples))
    plan = _plan(SC.prompt_metrics(prepared))
    assert plan.split("Initial Plan")[0].count("Generate explode(array(") == 0 and plan.split("Initial Plan")[0].count("Generate explode(") == 2, plan


def test_facts_of_small_and_large_prompts_agree(spark):
    r = random.Random(2)
    rows = [(p, i, " ".join(r.choice(["a", "B", "b", "7", "0.1", "0.1", "12.5", "é", "x-3"]) for _ in range(r.randint(0, 12)))) for p in range(30) for i in range(r.randint(2, 6))]
    rows += [(90, 0, ""), (90, 0, " "), (91, 0, "no number"), (91, 1, "no number"), (92, 0, "1" * 400), (92, 1, "2")]
    queries = spark.createDataFrame([(p,) for p in {x[0] for x in rows}], "prompt_id long")
    prepared = SC.cut_lineage(SC.prepare_samples(queries, spark.createDataFrame(rows, "prompt_id long, sample_idx int, response string")))
    small = {x.gid: x.asDict() for x in SC.small_facts(prepared).collect()}
    for x in SC.fact_stats(prepared).collect():
        assert {k: pytest.approx(v, abs=1e-9, nan_ok=True) for k, v in x.asDict().items()} == {k: small[x.gid][k] for k in x.asDict()}

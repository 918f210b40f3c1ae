"""Plan properties: row-local operators stay narrow; nothing runs in Python."""

import re

from pyspark.sql import functions as F

import __spark_entry__ as E
from relmine.operators import consistency as SC
from relmine.operators import faithfulness as FG
from relmine.operators import features as QF
from relmine.operators import tfidf as TX
from relmine.plans import catalog


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_row_local_operators_have_no_exchange(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    pairs = docs.select("doc_id", F.col("text").alias("context"), F.col("text").alias("response"))
    for df in (FG.faithfulness(pairs), QF.extract(docs.withColumnRenamed("text", "query"))):
        plan = _plan(df)
        assert "Exchange" not in plan
        assert "PythonUDF" not in plan and "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_no_python_in_any_query(spark, sf_dir):
    for name, fn in catalog.QUERIES.items():
        plan = _plan(fn(spark, sf_dir))
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan, name


def _exchanges(plan):
    return re.findall(r"(?<!Reused)Exchange (\w+\([^)]*\)|\w+)", re.sub(r"#\d+L?", "", plan))


def _no_broadcasts(spark, build):
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return _plan(build())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_small_prompts_travel_once_as_compact_rows(spark):
    """Terms, facts and pairs are formed behind one exchange by prompt (of
    disjoint columns for its two branches); texts are read before it."""
    queries = spark.createDataFrame([(1,)], "prompt_id long")
    samples = spark.createDataFrame([(1, 0, "a b 3"), (1, 1, "b c 4")], "prompt_id long, sample_idx int, response string")
    prepared = SC.cut_lineage(SC.prepare_samples(queries, samples))
    plan = _no_broadcasts(spark, lambda: SC.prompt_metrics(prepared))
    assert len(_exchanges(plan)) == 2 and set(_exchanges(plan)) == {"hashpartitioning(gid, 8)"}, plan
    assert "split(" not in plan and "regexp_extract_all" not in plan
    for generate in re.findall(r"\n(.*)Generate explode", plan):
        assert "Exchange" not in generate


def test_large_prompts_never_join_facts_by_prompt(spark):
    """Terms are counted before they are ranked, ranked by (prompt, bucket)
    first, and joined by (prompt, term, part)."""
    docs = spark.createDataFrame([(1, i, 2, [("a", 1), ("b", 2)]) for i in range(2)], "gid long, row long, n long, tc array<struct<term:string,tf:int>>")
    plan = _no_broadcasts(spark, lambda: TX.large_weights(docs))
    assert any(e.startswith("hashpartitioning(gid, term, _part") for e in _exchanges(plan)), _exchanges(plan)


def test_scan_prunes_columns_and_pushes_filters(spark, sf_dir):
    plan = _plan(E.queries()["faithfulness_conversations"](spark, sf_dir))
    assert "ReadSchema: struct<conv_id:bigint,turn:bigint,role:string,text:string>" in plan
    plan = _plan(E.queries()["prompt_features_conversations"](spark, sf_dir))
    assert "EqualTo(turn,0)" in plan and "ReadSchema: struct<conv_id:bigint,turn:bigint,text:string>" in plan

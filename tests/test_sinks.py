"""Tables are written once, partitioned, and taken up after an ended run."""

import os

import pytest
from pyspark.sql import functions as F

from relmine.plans import analysis
from relmine.sources import sinks


def _jobs_reading(spark, counter, df):
    """``df`` with an accumulator that counts how often its rows are made."""

    def count(batches):
        for batch in batches:
            counter.add(batch.num_rows)
            yield batch

    return df.mapInArrow(count, df.schema)


def test_summary_is_observed_while_tables_are_written(spark, sf_dir, tmp_path):
    results = analysis.full_analysis(spark, sf_dir)
    lazy = {(r.section, r.metric): r.value for r in results["summary"].collect()}
    counter = spark.sparkContext.accumulator(0)
    rag = results["rag_faithfulness"].cache()
    n = rag.count()
    results["rag_faithfulness"] = _jobs_reading(spark, counter, rag)
    paths = analysis.write(results, str(tmp_path), "parquet")
    assert counter.value == n  # one pass over the chain
    written = {(r.section, r.metric): r.value for r in spark.read.parquet(paths["summary"]).collect()}
    assert written.keys() == lazy.keys() and len(written) == 21
    for k, v in lazy.items():
        assert written[k] == pytest.approx(v, abs=1e-9), k


def test_a_run_is_taken_up_where_it_ended(spark, tmp_path):
    out = str(tmp_path)
    made = spark.sparkContext.accumulator(0)
    first = _jobs_reading(spark, made, spark.range(10).toDF("x"))
    broken = spark.range(4).select(F.raise_error(F.lit("executor lost")).cast("int").alias("y"))
    with pytest.raises(Exception, match="executor lost"):
        sinks.write_results({"a": first, "b": broken}, out, run="r1")
    assert made.value == 10
    sinks.write_results({"a": first, "b": spark.range(4).toDF("y")}, out, run="r1")
    assert made.value == 10  # "a" was complete
    assert spark.read.parquet(f"{out}/b").count() == 4
    sinks.write_results({"a": first}, out, run="r2")
    assert made.value == 20  # another run writes anew


def test_observed_values_survive_a_restart(spark, tmp_path):
    df = spark.range(10).toDF("x")
    metrics = {"rows": F.count(F.lit(1)), "none": F.max(F.when(F.col("x") > 99, 1.0))}
    first = sinks.write_observed(df, str(tmp_path), "t", metrics=metrics, run="r")
    assert first == {"rows": 10.0, "none": None}
    again = sinks.write_observed(df.filter("x < 3"), str(tmp_path), "t", metrics=metrics, run="r")
    assert again.get("rows") == 10.0 and again.get("none") is None


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_partitions_are_replaced_one_by_one(spark, tmp_path, fmt):
    path = f"{tmp_path}/t"
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "part string, x int")
    sinks.write_table(rows, path, fmt, partition_by=["part"])
    sinks.write_table(spark.createDataFrame([("b", 9)], "part string, x int"), path, fmt, partition_by=["part"])
    assert {d for d in os.listdir(path) if d.startswith("part=")} == {"part=a", "part=b"}
    back = spark.read.schema("x int, part string").options(**(sinks.CSV if fmt == "csv" else {})).format(fmt).load(path)
    assert sorted((r.part, r.x) for r in back.collect()) == [("a", 1), ("b", 9)]

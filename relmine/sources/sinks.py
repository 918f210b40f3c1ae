"""Sinks (S2, S3): write result tables.

Results are written by the executors in parallel (one file per partition,
no ``coalesce(1)``), CSV with a header like the reference or Parquet, whole or
partitioned by columns. A run that is given an id leaves a marker per table
once the table is complete; started again with that id, it writes only the
tables that are missing. What is to be reported of a table can be observed
while it is written, so a report costs no second pass over its plan.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# what CSV needs to give back quotes and microseconds as they were
CSV = {"header": True, "escape": '"', "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
MARKERS = "_complete"
MARKER = "run string, metrics map<string,double>"


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", partition_by: list[str] | None = None) -> str:
    """With ``partition_by``, a folder per value; overwriting then replaces
    the partitions that ``df`` has rows of and leaves the others."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    if fmt == "csv":
        w.options(**CSV).csv(path)
    else:
        w.format(fmt).save(path)
    return path


def _marker(out_dir: str, name: str) -> str:
    return f"{out_dir.rstrip('/')}/{MARKERS}/{name}"


def completed(spark: SparkSession, out_dir: str, name: str, run: str) -> dict[str, float] | None:
    """What was observed of a table that the run has completed, else null."""
    try:
        found = spark.read.schema(MARKER).json(_marker(out_dir, name)).filter(F.col("run") == run).first()
    except AnalysisException:  # no marker yet
        return None
    return None if found is None else dict(found["metrics"] or {})


def _for_csv(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON, which CSV cannot hold."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*[F.to_json(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in df.schema.fields])


def write_observed(
    df: DataFrame,
    out_dir: str,
    name: str,
    fmt: str = "parquet",
    metrics: dict[str, Column] | None = None,
    partition_by: list[str] | None = None,
    run: str | None = None,
) -> dict[str, float]:
    """Write one table to ``out_dir/name`` and return its ``metrics`` (plain
    aggregates, as doubles), collected by the same job. With ``run``, a table
    that this run has completed already is kept, and its metrics are read
    from the marker."""
    spark, metrics = df.sparkSession, metrics or {}
    if run is not None and (known := completed(spark, out_dir, name, run)) is not None:
        return known
    names = {m: f"m{i}" for i, m in enumerate(metrics)}
    watched = None
    if metrics:
        watched = Observation(name)
        df = df.observe(watched, *[c.cast("double").alias(names[m]) for m, c in metrics.items()])
    write_table(_for_csv(df) if fmt == "csv" else df, f"{out_dir.rstrip('/')}/{name}", fmt, partition_by=partition_by)
    got = {m: watched.get[alias] for m, alias in names.items()} if watched else {}
    if run is not None:
        done = spark.createDataFrame([(run, {m: v for m, v in got.items() if v is not None})], MARKER)
        done.coalesce(1).write.mode("overwrite").json(_marker(out_dir, name))
    return got


def write_results(
    results: dict[str, DataFrame],
    out_dir: str,
    fmt: str = "parquet",
    partition_by: dict[str, list[str]] | None = None,
    run: str | None = None,
) -> dict[str, str]:
    """S2/S3: write every result table under ``out_dir/<name>``; with ``run``
    only those that this run has not completed."""
    for name, df in results.items():
        write_observed(df, out_dir, name, fmt, partition_by=(partition_by or {}).get(name), run=run)
    return {name: f"{out_dir.rstrip('/')}/{name}" for name in results}

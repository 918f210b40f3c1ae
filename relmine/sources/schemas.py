"""Declared input schemas (FIXTURES.md §1) and column checks at operator entry.

The operators take any DataFrame that has the columns they name; these
schemas document the canonical tables and let callers read files without
schema inference (``spark.read.schema(QUERIES).parquet(path)``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

QUERIES = T.StructType(
    [
        T.StructField("prompt_id", T.LongType(), False),
        T.StructField("query", T.StringType(), True),
        T.StructField("response", T.StringType(), True),
        T.StructField("domain", T.StringType(), True),
        T.StructField("is_hallucination", T.BooleanType(), False),
        T.StructField("hallucination_type", T.StringType(), False),
        T.StructField("risk_level", T.StringType(), False),
        T.StructField("consistency_score", T.DoubleType(), True),
    ]
)

SAMPLES = T.StructType(
    [
        T.StructField("prompt_id", T.LongType(), False),
        T.StructField("sample_idx", T.IntegerType(), False),
        T.StructField("response", T.StringType(), True),
    ]
)

RAG = T.StructType(
    [
        T.StructField("row_id", T.LongType(), False),
        T.StructField("query", T.StringType(), True),
        T.StructField("context", T.StringType(), True),
        T.StructField("response", T.StringType(), True),
        T.StructField("is_faithful", T.BooleanType(), True),
        T.StructField("domain", T.StringType(), True),
    ]
)

DRIFT = T.StructType(
    [
        T.StructField("query", T.StringType(), False),
        T.StructField("sentence_idx", T.IntegerType(), False),
        T.StructField("sentence", T.StringType(), True),
        T.StructField("trust_score", T.DoubleType(), False),
        T.StructField("is_hallucination", T.BooleanType(), False),
        T.StructField("drift_point", T.IntegerType(), True),
    ]
)

RESPONSES = T.StructType(
    [
        T.StructField("response_id", T.LongType(), False),
        T.StructField("response", T.StringType(), True),
        T.StructField("reference", T.StringType(), True),
    ]
)


def require(df: DataFrame, columns, operator: str) -> None:
    """Raise a clear error when an operator's input lacks a column it names."""
    have = set(df.columns)
    missing = [c for c in columns if c not in have]
    if missing:
        raise ValueError(f"{operator}: input lacks column(s) {missing}; has {sorted(have)}")

"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relmine.session import checkpoint_dir


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``documents`` table, whole."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def text_of(column: str = "text") -> Column:
    """A document's text, null counting as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it
    back: a lineage cut that survives lost executors (and is compressed and
    columnar, unlike an RDD checkpoint)."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(taken: Iterable[str], base: str) -> str:
    """``base``, or ``base_1``, ``base_2`` ... where a column has that name already."""
    have = {c.lower() for c in taken}
    name, n = base, 0
    while name.lower() in have:
        n += 1
        name = f"{base}_{n}"
    return name

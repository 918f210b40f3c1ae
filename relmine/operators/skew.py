"""Joins whose hot keys are dealt by measurement.

One side has a row per key that also counts the other side's rows of that
key. Keys that more than ``HOT_ROWS`` rows meet are dealt to as many parts as
they need; nothing else is salted or replicated. The list of hot keys is
bounded (``MOST_HOT``) and broadcast: each key beyond it has fewer rows than
any of these.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 100_000
MOST_HOT = 10_000


def dealt_join(rows: DataFrame, unique: DataFrame, keys: list[str], count: str, by: str, hot_rows: int | None = None) -> DataFrame:
    """``rows`` joined with ``unique`` (one row per ``keys``) on ``keys``.
    ``count``: column of ``unique`` with the number of rows; ``by``: column of
    ``rows`` whose hash deals a hot key's rows. Null keys match nothing."""
    per_part = hot_rows or HOT_ROWS
    parts = F.ceil(F.col(count) / F.lit(float(per_part))).cast("int")
    hot = unique.filter(F.col(count) > per_part).orderBy(F.desc(count)).limit(MOST_HOT).select(*keys, parts.alias("_parts"))
    hot = F.broadcast(hot)
    own = F.coalesce(F.col("_parts"), F.lit(1))
    dealt = rows.join(hot, keys, "left").withColumn("_part", F.pmod(F.xxhash64(by), own).cast("int")).drop("_parts")
    each = unique.join(hot, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), own - 1))).drop("_parts")
    return dealt.join(each, [*keys, "_part"]).drop("_part")

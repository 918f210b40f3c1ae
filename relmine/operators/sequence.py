"""Skew-safe ordered sequences: position, length and previous values per key.

A plain ``Window.partitionBy(key).orderBy(ts)`` puts every row of a key in
one task; a key holding a third of the table would then be processed by a
single core. Instead:

1. ``repartitionByRange(keys, order)`` cuts the table into contiguous,
   equally sized chunks — a hot key is spread over many chunks. The range
   bounds come from a sample, so the chunk id is fixed once with a reliable
   ``checkpoint()`` into ``spark.checkpoint.dir``: every later branch (and
   any task re-run after an executor loss) sees the same chunks;
2. windows run per ``(key, chunk)`` — each bounded by the chunk size;
3. a per-chunk summary (row count and last ``lags`` values, at most
   ``lags`` rows per chunk) is combined with a window over the summary
   (one row per chunk) to get each chunk's offset and the values that
   precede it;
4. the summary is joined back on ``(key, chunk)``.

Result columns: ``_pos`` (0-based position within the key), ``_n`` (rows of
the key) and ``_prev`` (array of up to ``lags`` preceding values, oldest
first).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relmine.session import cut_lineage


def ordered_sequence(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    value: str,
    lags: int,
    partitions: int | None = None,
) -> DataFrame:
    spark = df.sparkSession
    p = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunked = df.repartitionByRange(p, *keys, *order).withColumn("_chunk", F.spark_partition_id())
    chunked = cut_lineage(chunked, spark)

    local_w = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    whole_w = Window.partitionBy(*keys, "_chunk")
    lagged = chunked.withColumn("_rn", F.row_number().over(local_w)).withColumn("_cnt", F.count(F.lit(1)).over(whole_w))
    for k in range(1, lags + 1):
        lagged = lagged.withColumn(f"_lag{k}", F.lag(F.col(value), k).over(local_w))

    tails = (
        lagged.filter(F.col("_rn") > F.col("_cnt") - lags)
        .groupBy(*keys, "_chunk")
        .agg(F.first("_cnt").alias("_ccnt"), F.sort_array(F.collect_list(F.struct("_rn", F.col(value).alias("v")))).alias("_tail"))
    )
    chunk_w = Window.partitionBy(*keys).orderBy("_chunk")
    summary = tails.select(
        *keys,
        "_chunk",
        F.coalesce(F.sum("_ccnt").over(chunk_w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"),
        F.sum("_ccnt").over(Window.partitionBy(*keys)).alias("_n"),
        F.flatten(F.collect_list(F.transform("_tail", lambda t: t["v"])).over(chunk_w.rowsBetween(-lags, -1))).alias(
            "_carry"
        ),
    )

    joined = lagged.join(summary, [*keys, "_chunk"])
    rn = F.col("_rn")
    local_prev = F.filter(
        F.array(*[F.struct((rn > k).alias("ok"), F.col(f"_lag{k}").alias("v")) for k in range(lags, 0, -1)]),
        lambda e: e["ok"],
    )
    need = F.greatest(F.lit(lags) - (rn - 1), F.lit(0))
    carry = F.col("_carry")
    carried = F.filter(carry, lambda x, i: i >= F.size(carry) - need)
    prev = F.concat(carried, F.transform(local_prev, lambda e: e["v"]))
    out = joined.withColumn("_pos", F.col("_offset") + rn - 1).withColumn("_prev", prev)
    return out.drop("_chunk", "_rn", "_cnt", "_offset", "_carry", *[f"_lag{k}" for k in range(1, lags + 1)])

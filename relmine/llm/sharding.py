"""Operator 9: sharding by histogram sort.

Documents are ordered by (hash of the text, id), so that equal texts stand
together, and cut into shards of near equal bytes. Splitters are found by
histograms: bytes below equally spaced probes are counted exactly across all
partitions; ranges that hold a splitter, or too many rows for one task, get
new probes inside their own bounds, first between hashes and then, where a
range is one text, between ids. Probing ends when each splitter is within
the tolerance or a range is one row. Then rows are exchanged once, by range;
a row's slot is its range's offset and its rank there.

The driver holds the ranges (at most a few tens of thousands), never rows.
DataFrame operations only. Defined cases: a null text has size 1 and the
checksum of the empty text; a null id sorts as -1; rows equal in text and id
stand side by side; an empty table gives an empty result; extra columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relmine.llm.common import documents, text_of, written

SHARDS = 16
TOLERANCE = 0.001  # of a shard's bytes, between a splitter and its target
FIRST_PROBES, PROBES = 1024, 64  # in the first round; in a range that is refined
RANGE_ROWS, RANGE_SHARE = 1024, 4096  # a range has at most so many rows, or this share of all


def measures() -> list[Column]:
    """``_key``, ``_ord`` (the sort order) and ``size``."""
    return [
        F.shiftrightunsigned(F.xxhash64(text_of()), 1).alias("_key"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("_ord"),
        (F.octet_length(text_of()) + F.lit(1)).cast("long").alias("size"),
    ]


def _placed(rows: DataFrame, rounds: list[list[tuple]]) -> DataFrame:
    """Rows with ``_range``: from round to round, those of a refined range
    move on to the range between their probes."""
    spark = rows.sparkSession
    rows = rows.withColumn("_range", F.lit(0).cast("long"))
    for refined in rounds:
        probes = F.broadcast(spark.createDataFrame(refined, "_range long, _by_key boolean, _low long, _step long, _base long"))
        at = F.when(F.col("_by_key"), F.col("_key")).otherwise(F.col("_ord"))
        distance = at.cast("decimal(20,0)") - F.col("_low")
        child = F.col("_base") + F.floor(distance / F.col("_step")).cast("long")
        rows = rows.join(probes, "_range", "left").withColumn("_range", F.coalesce(child, F.col("_range"))).drop("_by_key", "_low", "_step", "_base")
    return rows


def splitters(entries: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> tuple[list[list[tuple]], list[tuple]]:
    """Rounds of probes for ``_placed``, and the final ranges in order as
    (range, bytes, rows). ``entries``: ``_key``, ``_ord``, ``size``."""

    def counted(rows: DataFrame) -> dict:
        aggregates = [F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"), *(f(c).alias(f"{f.__name__}{c}") for c in ("_key", "_ord") for f in (F.min, F.max))]
        return {r["_range"]: r for r in rows.groupBy("_range").agg(*aggregates).collect()}

    ranges = list(counted(_placed(entries, [])).values())
    rounds: list[list[tuple]] = []
    if not ranges:
        return rounds, []
    total, rows = ranges[0]["bytes"], ranges[0]["rows"]
    most_rows = max(RANGE_ROWS, rows // RANGE_SHARE)
    slack, fresh = tolerance * total / shards, 1
    while True:
        refined, spans, below = [], {}, 0
        for r in ranges:
            first = below * shards // total + 1  # the first target at or above this range's start
            inside = below < first * total / shards < below + r["bytes"]
            near = min(first * total / shards - below, below + r["bytes"] - first * total / shards) <= slack and r["bytes"] < total / shards
            by_key = r["min_key"] < r["max_key"]
            low, high = (r["min_key"], r["max_key"]) if by_key else (r["min_ord"], r["max_ord"])
            below += r["bytes"]
            if low < high and (r["rows"] > most_rows or inside and not near):
                probes = PROBES if rounds else FIRST_PROBES
                refined.append((r["_range"], by_key, low, -(-(high - low + 1) // probes), fresh))
                spans[r["_range"]] = range(fresh, fresh + probes)
                fresh += probes
        if not refined:
            return rounds, [(r["_range"], r["bytes"], r["rows"]) for r in ranges]
        rounds.append(refined)
        children = counted(_placed(entries, rounds).filter(F.col("_range") >= min(s.start for s in spans.values())))
        ranges = [c for r in ranges for c in ([children[i] for i in spans[r["_range"]] if i in children] if r["_range"] in spans else [r])]


def plan_shards(ranges: list[tuple], shards: int = SHARDS) -> list[tuple]:
    """(range, shard, rows of the shard before it); a range goes to the shard
    that its middle byte falls into, so each splitter is the boundary nearest
    to its target."""
    total = sum(size for _, size, _ in ranges)
    out, below, before, last = [], 0, 0, 0
    for at, size, rows in ranges:
        shard = (2 * below + size) * shards // (2 * total)
        before = before if shard == last else 0
        out.append((at, shard, before))
        below, before, last = below + size, before + rows, shard
    return out


def shard(docs: DataFrame, shards: int = SHARDS, entries: DataFrame | None = None) -> DataFrame:
    """``docs`` with ``size``, ``shard`` and ``slot``. ``entries`` may give
    the rows' ``_key``, ``_ord`` and ``size`` where they are at hand."""
    keep = [c for c in docs.columns if c not in ("size", "shard", "slot", "_key", "_ord")]
    if entries is None:
        rows = docs.select(*[F.col(f"`{c}`") for c in keep], *measures())
        entries = written(docs.select(*measures()), "shard-entries")
    else:
        rows = docs.select(*[F.col(f"`{c}`") for c in keep], "_key", "_ord", "size")
    rounds, ranges = splitters(entries, shards)
    plan = docs.sparkSession.createDataFrame(plan_shards(ranges, shards), "_range long, shard int, _before long")
    inside = Window.partitionBy("_range").orderBy("_key", "_ord")
    placed = _placed(rows, rounds).withColumn("_rank", F.row_number().over(inside) - 1)
    # the plan has one row per range: a bounded number
    out = placed.join(F.broadcast(plan), "_range").withColumn("slot", F.col("_before") + F.col("_rank"))
    return out.select(*[F.col(f"`{c}`") for c in keep], "size", "shard", "slot")


def op9_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    crc = F.crc32(text_of().cast("binary")).alias("text_crc32")
    entries = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), crc, *measures()), "shard-entries")
    return shard(entries, SHARDS, entries).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )

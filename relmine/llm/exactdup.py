"""Operator 8: exact deduplication through an extendible-hash index.

1. Every row becomes an entry (document, 64-bit key of the normalised text,
   SHA-256), written to the shared folder; texts are not in it.
2. The directory doubles until no bucket holds more keys than its capacity:
   each doubling looks at one more leading bit of the key and splits the
   overfull buckets alone, so buckets are key ranges of different local
   depths. Counts of distinct keys by leading bits are all the driver sees.
3. Rows are aggregated by (bucket, key, text): the owner of a key chains the
   texts that collide in it and tells them apart by their bytes. Copies
   collapse before the exchange, so a text that holds a third of all rows
   travels once per input partition.
4. Owner tasks number each key's chain and write the index, by bucket.
5. Entries look up their chain element. Texts with at least one 1024th of all
   rows number at most 1024 and are broadcast; all other groups are joined by
   key and are small.

DataFrame operations only. Defined cases: null counts as empty; of equal rows
with equal ids one is kept; a null id is kept only where its group has no
other; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relmine.llm.common import documents, free_name, text_of, written
from relmine.llm.components import LARGEST_SHARE, looked_up

CAPACITY = 4096  # distinct keys in a bucket, or one 1024th of them if that is more
DOUBLINGS = 10  # leading bits counted in one pass over the keys


def normalised(text: Column) -> Column:
    """Runs of white space as one space (a lone space stays as it is)."""
    return F.regexp_replace(text, r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def directory(keys: DataFrame, capacity: int = CAPACITY) -> tuple[int, list[int]]:
    """Global depth and, for each of its 2**depth slots, the number of the
    bucket that owns it. ``keys``: distinct keys, column ``key``."""
    total = keys.count()
    capacity = max(capacity, total // LARGEST_SHARE)
    depth, buckets = 0, {(0, 0): total}  # (local depth, leading bits) -> keys
    fine: dict[int, int] = {}
    counted = 0
    while any(n > capacity for n in buckets.values()) and depth < 30:
        if depth == counted:  # count further bits, of overfull buckets only
            counted = depth + DOUBLINGS
            full = [p for (d, p), n in buckets.items() if n > capacity]
            rows = keys if depth == 0 else keys.filter(F.shiftrightunsigned("key", 64 - depth).isin(full))
            fine = {r["p"]: r["n"] for r in rows.groupBy(F.shiftrightunsigned("key", 64 - counted).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
        depth += 1
        for (d, p), n in list(buckets.items()):
            if n > capacity and d == depth - 1:
                del buckets[d, p]
                for half in (2 * p, 2 * p + 1):
                    shift = counted - depth
                    buckets[depth, half] = sum(m for q, m in fine.items() if q >> shift == half)
    order = sorted(buckets, key=lambda b: b[1] << (depth - b[0]))
    return depth, [i for i, (d, _) in enumerate(order) for _ in range(1 << (depth - d))]


def bucket_of(key: str, depth: int, slots: list[int]) -> Column:
    if depth == 0:
        return F.lit(0)
    slot = F.shiftrightunsigned(key, 64 - depth).cast("int") + 1
    return F.element_at(F.array(*map(F.lit, slots)), slot)


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``norm`` (normalised text) and ``key`` of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(text_of()).alias("norm"))
    return rows.withColumn("key", F.xxhash64("norm"))


def groups(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``keep_id``, ``group_size``,
    ``kept``, ``text_sha256`` (hex) and ``key``."""
    rows = keyed(docs)
    entries = written(rows.select("doc_id", "key", F.unhex(F.sha2("norm", 256)).alias("sha")), "exact-entries")
    depth, slots = directory(entries.select("key").distinct())

    chains = rows.withColumn("bucket", bucket_of("key", depth, slots)).groupBy("bucket", "key", "norm")
    texts = chains.agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    found = texts.select("bucket", "key", F.unhex(F.sha2("norm", 256)).alias("sha"), "keep_id", "group_size")
    owner = Window.partitionBy("bucket", "key").orderBy("sha")
    index = written(found.repartition("bucket").withColumn("chain", F.row_number().over(owner)), "exact-index")

    own = Window.partitionBy("key", "sha", "doc_id").orderBy("doc_id")
    entries = entries.withColumn("copy", F.row_number().over(own))
    every = looked_up(entries, index.select("key", "sha", "keep_id", "group_size"), ["key", "sha"], "group_size", entries.count())
    return every.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "key",
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text another row with a smaller id has;
    all columns stay."""
    one, other, copy = (free_name(docs.columns, c) for c in ("_keep", "_text_key", "_copy"))
    kept = groups(docs).filter("kept").select(F.col("doc_id").alias(one), F.col("key").alias(other))
    text = F.xxhash64(normalised(text_of()))
    joined = docs.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col(one)) & (text == F.col(other)))
    own = Window.partitionBy(one, other).orderBy(F.lit(0))
    first = joined.withColumn(copy, F.row_number().over(own)).filter(F.col(copy) == 1)
    return first.select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(documents(spark, sf_dir)).drop("key")


ORACLE = r"""
with n as (
  select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents
), g as (
  select t, min(doc_id) as keep_id, count(*) as group_size from n group by t
)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(t) as text_sha256
from n join g using (t)
"""

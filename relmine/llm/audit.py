"""Operator 12: audit of how filters interact in every order.

Five filters give each document a mask of the ones it fails. A mask decides
what each of the 120 orders does with the document at each of its 5 steps, so
it is mapped to one wide integer whose fields hold all 600 step outcomes, for
each of ``MEASURES``. The integers of a part (times the number of documents
with that mask) are summed and unpacked. A field has 64 bits; its sum is at
most the number of documents, so no field runs into the next.

Filters A to D are row-local expressions. E (a text that a smaller id has
too) needs one exchange: rows are counted by text hash, part and labels with
their smallest ids first, so a text that a third of all rows share travels as
one row per task, and the copies of its smallest id are told from the others
by counts, not by a join back. What the integers are summed over are counts
by part and mask: at most 128 rows per part.

Defined cases: null texts and parts count as empty; a row without an id has
no smaller id and is none; rows that repeat an id and its text fail E only if
a smaller id has the text; labels that repeat count as 1 if one of them is 1,
labels that are missing or null as 0; an empty table gives an empty result;
extra columns are not read.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relmine.llm.common import documents, text_of

FILTERS = "ABCDE"
# Fixed values: the limits of the filters.
LEAST_WORDS, DISTINCT_SHARE, CAPITAL_SHARE, MARKS = 100, 80, 10, r"[#$%&*|]"
SPACE = r"[\x20\x09-\x0D]+"
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(FILTERS)
FIELDS = len(ORDERS) * STEPS
FIELD_BITS = 64
OUT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def fails_alone(text: Column) -> Column:
    """The mask of filters A to D; bit i is the filter ``FILTERS[i]``."""

    def bits(words: Column) -> Column:
        n, chars = F.size(words), F.length(text)
        few = n < LEAST_WORDS
        same = 100 * F.size(F.array_distinct(words)).cast("long") < DISTINCT_SHARE * n.cast("long")
        loud = 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") > CAPITAL_SHARE * chars.cast("long")
        marked = text.rlike(MARKS)
        return sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate((few, same, loud, marked))), F.lit(0))

    words = F.array_remove(F.split(text, SPACE), "")
    return F.element_at(F.transform(F.array(words), bits), 1)  # the words are read once


def masks(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """Documents counted by ``part``, ``mask``, ``good`` and ``toxic``."""
    one = F.col(f"`{part}`").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), text_of().alias("text"), F.coalesce(one, F.lit("")).alias("part"))
    # F.sha2 reads the text's bytes, so equal hashes mean equal texts; the
    # mask is a function of the text
    rows = rows.select("id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("hash"), fails_alone(F.col("text")).alias("alone"))
    marks = labels.select(
        F.col("doc_id").cast("long").alias("id"),
        F.coalesce(F.col("quality") == 1, F.lit(False)).alias("good"),
        F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("toxic"),
    )
    marks = marks.filter("id is not null and (good or toxic)").groupBy("id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    rows = rows.groupBy("id", "hash", "part", "alone").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.join(marks, "id", "left").na.fill(False, ["good", "toxic"])
    # copies of a group's smallest id; those without an id are counted apart
    group = ["hash", "part", "alone", "good", "toxic"]
    groups = rows.groupBy(*group).agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("without"),
        F.min("id").alias("least"),
        F.min_by("n", "id").alias("n_least"),
    )
    # at most four groups of a text in each part
    first = F.col("least") == F.min("least").over(Window.partitionBy("hash"))
    passes = F.col("without") + F.when(first, F.col("n_least")).otherwise(0)
    counted = groups.withColumn("passes", passes).select(
        "part",
        "good",
        "toxic",
        F.inline(F.array(F.struct(F.col("alone").alias("mask"), F.col("passes").alias("n")), F.struct((F.col("alone") + 16).alias("mask"), (F.col("n") - F.col("passes")).alias("n")))),
    )
    return counted.filter("n > 0").groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def wide(mask: int, good: bool = False, toxic: bool = False) -> int:
    """One document's step outcomes: a field of ``FIELD_BITS`` bits for each
    measure, order and step, 1 where the outcome is the document's."""
    out = 0
    for at, order in enumerate(ORDERS):
        gone = False
        for step, name in enumerate(order):
            bit = 1 << FILTERS.index(name)
            fails = bool(mask & bit)
            removed = fails and not gone
            outcome = (not gone and not fails, removed, fails and gone, mask == bit, removed and good, removed and toxic)
            gone = gone or fails
            for m, yes in enumerate(outcome):
                if yes:
                    out |= 1 << FIELD_BITS * ((m * len(ORDERS) + at) * STEPS + step)
    return out


def unpacked(total: int) -> np.ndarray:
    """The fields of a sum of wide integers by measure, order and step."""
    data = total.to_bytes(len(MEASURES) * FIELDS * FIELD_BITS // 8, "little")
    return np.frombuffer(data, "<u8").astype(np.int64).reshape(len(MEASURES), len(ORDERS), STEPS)


def outcomes(counts: DataFrame) -> DataFrame:
    """The audit from ``masks``: a row per part, order and step."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        total = sum(r["n"] * wide(r["mask"], r["good"], r["toxic"]) for r in rows)
        by_measure = unpacked(total)
        removed = {f: sum(int(by_measure[1, at, order.index(f)]) for at, order in enumerate(ORDERS)) for f in FILTERS}
        measures = {m: pa.array(by_measure[i].ravel(), pa.int64()) for i, m in enumerate(MEASURES)}
        return pa.table(
            {
                "part": pa.array([rows[0]["part"]] * FIELDS, pa.string()),
                "filter_order": pa.array([order for order in ORDERS for _ in order], pa.string()),
                "step": pa.array([step for _ in ORDERS for step in range(1, STEPS + 1)], pa.int32()),
                **measures,
                "shapley": pa.array([removed[f] for order in ORDERS for f in order], pa.int64()),
            }
        )

    return counts.groupBy("part").applyInArrow(run, OUT)


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """Every order's step outcomes by ``part`` of ``docs``, with what
    ``labels`` (``doc_id``, ``quality``, ``toxic``) say of removed rows."""
    return outcomes(masks(docs, labels, part))


def op12_wide_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet"))


ORACLE = r"""
WITH texts AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
        regexp_extract_all(coalesce(text, ''), '[^ 	-]+') AS w
    FROM documents
),
marks AS (
    SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
    FROM labels GROUP BY doc_id
),
fails AS (
    SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, {
        'A': len(w) < 100,
        'B': 100 * len(list_distinct(w)) < 80 * len(w),
        'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t),
        'D': regexp_matches(t, '[#$%&*|]'),
        'E': coalesce(texts.doc_id > min(texts.doc_id) OVER (PARTITION BY t), false)
    } AS f
    FROM texts LEFT JOIN marks ON texts.doc_id = marks.doc_id
),
masks AS (
    SELECT part, good, toxic, f.A AS a, f.B AS b, f.C AS c, f.D AS d, f.E AS e, count(*) AS n
    FROM fails GROUP BY ALL
),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
    SELECT p.x || q.x || r.x || s.x || t.x AS filter_order
    FROM letters p, letters q, letters r, letters s, letters t
    WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5
),
steps AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM orders),
each AS (
    SELECT part, filter_order, step, n, good, toxic,
        [x FOR x IN string_split(filter_order[:step - 1], '') IF (x = 'A' AND a) OR (x = 'B' AND b) OR (x = 'C' AND c) OR (x = 'D' AND d) OR (x = 'E' AND e)] <> [] AS gone,
        CASE filter_order[step] WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END AS fails,
        a::INT + b::INT + c::INT + d::INT + e::INT AS failures
    FROM masks, steps
),
summed AS (
    SELECT part, filter_order, step,
        sum(CASE WHEN NOT gone AND NOT fails THEN n ELSE 0 END) AS kept,
        sum(CASE WHEN NOT gone AND fails THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN gone AND fails THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN fails AND failures = 1 THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN NOT gone AND fails AND good = 1 THEN n ELSE 0 END) AS good_lost,
        sum(CASE WHEN NOT gone AND fails AND toxic = 1 THEN n ELSE 0 END) AS toxic_lost
    FROM each GROUP BY ALL
)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
    unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
    (sum(removed) OVER (PARTITION BY part, filter_order[step]))::BIGINT AS shapley
FROM summed
"""

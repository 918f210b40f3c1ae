"""Operator 4, whole: repeated lines, and passages inside and across lines.

Lines are those of the paragraph operator. Besides them a text is cut by its
content, whatever its line breaks: of the ``APART`` hashes of ``UNIT`` words
in each window of 50 words the smallest is a unit. Equal windows have equal
units, so no run of 50 words that several documents have is lost. Units that
only one document has drop out; neighbouring units of a text that touch and
stand first in the same document form one passage. A passage therefore has
at least ``UNIT`` words, every one of them repeated in that order, and a run
of 50 words or more is covered but for less than ``APART`` words at either
end (``op4_repeated_runs`` gives exact ends).

The units are cut in the pass that signs the lines. Nothing is sampled.
Defined cases are those of the paragraph operator; a passage stays in the
document of smallest id that has its units, also where it recurs there.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relmine.llm.common import documents, written
from relmine.llm.components import looked_up
from relmine.llm.minhash import ODD, mixed
from relmine.llm.paragraphs import repeated, signed_lines

WORDS = 50  # a run of so many is found
UNIT = 35
APART = WORDS - UNIT + 1  # a power of two
BACK = np.uint64(pow(int(ODD), -1, 1 << 64))


def _reach(values: np.ndarray, of: np.ufunc) -> np.ndarray:
    """``of`` each ``APART`` neighbours."""
    width = 1
    while width < APART:
        values, width = of(values[:-width], values[width:]), 2 * width
    return values


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.full(n, base, dtype=np.uint64))


def units(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the units of consecutive texts, the word at which each
    begins in its text, and how many each text has. ``words`` are the word
    hashes, ``counts`` how many each text has."""
    ends = np.cumsum(counts)
    if len(words) < WORDS:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(len(counts), np.int64)
    sums = np.append(np.uint64(0), np.cumsum(mixed(words) * _powers(ODD, len(words))))
    hashes = mixed((sums[UNIT:] - sums[:-UNIT]) * _powers(BACK, len(words) - UNIT + 1))
    text = np.repeat(np.arange(len(counts)), counts)
    least = _reach(hashes, np.minimum)
    least[text[: len(least)] != text[WORDS - 1 :]] = 0  # windows over two texts
    none = np.zeros(APART - 1, np.uint64)
    at = np.flatnonzero((_reach(np.concatenate([none, least, none]), np.maximum) == hashes) & (hashes > 0))
    own = text[at]
    return hashes[at].view(np.int64), (at - (ends - counts)[own]).astype(np.int32), np.bincount(own, minlength=len(counts))


def passages(signed: DataFrame) -> DataFrame:
    """One row per passage: ``doc_id``, ``word`` (number of its first word),
    ``n_words``, ``cluster_doc_id`` (the first document that has it),
    ``cluster_size`` (how often the most frequent of its units occurs),
    ``removed``; ``signed`` are signatures with ``units``."""
    rows = signed.filter("paragraph is null").select("doc_id", F.explode(F.arrays_zip("unit", "at")).alias("u")).select("doc_id", "u.unit", "u.at")
    groups = rows.groupBy("unit").agg(F.min("doc_id").alias("cluster_doc_id"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n"))
    several = written(groups.filter("cluster_doc_id < last").drop("last"), "passage-units")
    total = signed.agg(F.coalesce(F.sum(F.size("unit").cast("long") * F.col("unit").isNotNull().cast("long")), F.lit(0))).first()[0]
    shared = looked_up(rows, several, ["unit"], "n", total)
    order = Window.partitionBy("doc_id").orderBy("at", "cluster_doc_id")
    apart = (F.col("at") - F.lag("at").over(order) > UNIT) | (F.col("cluster_doc_id") != F.lag("cluster_doc_id").over(order))
    begun = shared.withColumn("new", F.coalesce(apart, F.lit(True)).cast("int"))
    found = begun.withColumn("passage", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return found.groupBy("doc_id", "passage", "cluster_doc_id").agg(F.min("at").alias("word"), F.max("at").alias("end"), F.max("n").alias("cluster_size")).select(
        "doc_id",
        F.col("word").cast("long").alias("word"),
        (F.col("end") - F.col("word") + UNIT).cast("long").alias("n_words"),
        "cluster_doc_id",
        "cluster_size",
        (F.col("doc_id") != F.col("cluster_doc_id")).alias("removed"),
    )


def op4_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of repeated lines, and of passages wherever they stand: these
    have ``word``, and null in ``paragraph`` and ``cluster_paragraph``."""
    docs = documents(spark, sf_dir)
    signed = signed_lines(docs, units)
    lines = repeated(docs, signed).withColumn("word", F.lit(None).cast("long"))
    return lines.unionByName(passages(signed), allowMissingColumns=True)

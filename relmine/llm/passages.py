"""Operator 4, inside and across lines: runs of words that repeat.

A run is 50 or more consecutive words of a text, line breaks counting as
white space, that another document also has. It may be a part of a line or go
over many. Windows of 50 words are found without comparing pairs: of each
window's 26 hashes of 25 words the smallest is its anchor, so equal windows
have equal anchors wherever they stand. Anchors of a single document drop
out; the windows of the others are hashed whole, and those that several
documents have are repeated. The first of equal windows (smallest id, then
position) stays, the others are removals. Neighbouring windows that follow
the same first text in step form one run, which thereby reaches as far to
both sides as the texts agree. Nothing is sampled: every repeated window is
found.

Words are those of the paragraph operator: ASCII letters in lower case.
Defined cases: texts of fewer words, null and empty ones have no runs;
documents with a null id take no part and keep their text; rows that repeat
with one id count as one document; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relmine.llm.common import documents, free_name, text_of, written
from relmine.llm.components import looked_up
from relmine.llm.minhash import ODD, mixed, word_hashes
from relmine.llm.paragraphs import _place, placed

WORDS = 50  # of a window; the shortest run
HALF = WORDS // 2
FIFTH = 5  # HALF is its square
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _folded(hashes: np.ndarray, times: int, apart: int) -> np.ndarray:
    """Hashes of ``times`` hashes each that stand ``apart``."""
    n = len(hashes) - (times - 1) * apart
    out = np.full(n, times, dtype=np.uint64)
    for i in range(times):
        out = mixed(out * ODD + hashes[i * apart : i * apart + n])
    return out


def _halves(words: np.ndarray) -> np.ndarray:
    return _folded(_folded(words, FIFTH, 1), FIFTH, FIFTH)


def _anchors(halves: np.ndarray) -> np.ndarray:
    """The smallest of each ``HALF + 1`` neighbours."""
    least, width = halves, 1
    while 2 * width <= HALF + 1:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    apart = HALF + 1 - width
    return np.minimum(least[: len(least) - apart], least[apart:]).view(np.int64)


def windows(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, hash and a second, 32-bit hash of every window."""
    halves = _halves(words)
    whole, second = _folded(halves, 2, HALF), _folded(halves ^ ODD, 2, HALF) >> np.uint64(32)
    return _anchors(halves), whole.view(np.int64), second.astype(np.uint32).view(np.int32)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).filter("doc_id is not null")


def anchors(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``anchor``, each of a text once."""

    def run(batches):
        for batch in batches:
            for doc, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                words = word_hashes(text.as_py())
                if len(words) >= WORDS:
                    own = np.unique(_anchors(_halves(words)))
                    yield pa.RecordBatch.from_arrays([pa.repeat(doc, len(own)), pa.array(own)], ["doc_id", "anchor"])

    return _texts(docs).mapInArrow(run, "doc_id long, anchor long")


def wanted_windows(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``hash``, ``second``, ``doc_id`` and ``at`` of the windows whose anchor
    is among their document's in ``wanted`` (``doc_id``, ``anchors``)."""

    def run(batches):
        for batch in batches:
            for doc, text, those in zip(batch.column("doc_id"), batch.column("text"), batch.column("anchors"), strict=True):
                anchor, whole, second = windows(word_hashes(text.as_py()))
                at = np.flatnonzero(np.isin(anchor, those.values.to_numpy()))
                columns = [pa.array(whole[at]), pa.array(second[at]), pa.repeat(doc, len(at)), pa.array(at)]
                yield pa.RecordBatch.from_arrays(columns, ["hash", "second", "doc_id", "at"])

    return _texts(docs).join(wanted, "doc_id").select("doc_id", "text", "anchors").mapInArrow(run, "hash long, second int, doc_id long, at long")


def _of_several(rows: DataFrame, keys: list[str]) -> DataFrame:
    groups = rows.groupBy(*keys).agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n"))
    return groups.filter("lo < hi").select(*keys, "n")


def runs(docs: DataFrame) -> DataFrame:
    """One row per run: ``doc_id``, ``word`` (number of its first word),
    ``n_words``, ``first_doc_id`` and ``first_word`` (where the text stands
    first), ``removed``. Runs of one document that follow different first
    texts may overlap."""
    seen = written(anchors(docs), "run-anchors")
    shared = looked_up(seen, _of_several(seen, ["anchor"]), ["anchor"], "n", seen.count())
    wanted = shared.groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors"))
    found = written(wanted_windows(docs, wanted), "run-windows")
    keys = ["hash", "second"]
    groups = found.groupBy(*keys).agg(F.min(placed("doc_id", "at")).alias("first"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n"))
    rows = looked_up(found, groups.filter("lo < hi").select(*keys, "first", "n"), keys, "n", found.count())
    first_doc, first_at = _place("first")
    rows = rows.select("doc_id", "at", first_doc.alias("first_doc_id"), (first_at - F.col("at")).alias("ahead"))
    step = ["doc_id", "first_doc_id", "ahead"]
    island = F.col("at") - F.dense_rank().over(Window.partitionBy(*step).orderBy("at"))
    rows = rows.withColumn("island", island).groupBy(*step, "island").agg(F.min("at").alias("word"), F.max("at").alias("last"))
    return rows.select(
        "doc_id",
        "word",
        (F.col("last") - F.col("word") + WORDS).alias("n_words"),
        "first_doc_id",
        (F.col("word") + F.col("ahead")).alias("first_word"),
        ((F.col("doc_id") != F.col("first_doc_id")) | (F.col("ahead") != 0)).alias("removed"),
    )


def without(text: str, gone: list[tuple[int, int]]) -> str:
    """The text without the words of the ranges ``gone`` (first, number) and
    the white space inside each."""
    raw = text.encode()
    spans = [m.span() for m in WORD.finditer(raw)]
    out, at = [], 0
    for first, n in sorted(gone):
        start, end = spans[first][0], spans[first + n - 1][1]
        out.append(raw[at : max(at, start)])
        at = max(at, end)
    return b"".join([*out, raw[at:]]).decode()


def remove_runs(docs: DataFrame) -> DataFrame:
    """``docs`` without the removed runs; all rows and columns stay."""
    doc, lost = free_name(docs.columns, "_doc"), free_name(docs.columns, "_lost")
    gone = runs(docs).filter("removed").groupBy(F.col("doc_id").alias(doc)).agg(F.collect_set(F.struct("word", "n_words")).alias(lost))
    joined = docs.join(gone, F.col("doc_id").cast("long") == F.col(doc), "left").select(*[F.col(f"`{c}`") for c in docs.columns], lost)

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = [
                t if t is None or not g else without(t, [(w["word"], w["n_words"]) for w in g])
                for t, g in zip(batch.column(at).to_pylist(), batch.column(lost).to_pylist(), strict=True)
            ]
            out = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            yield out.select([i for i, c in enumerate(batch.schema.names) if c != lost])

    return joined.mapInArrow(run, docs.schema)


def op4_repeated_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(documents(spark, sf_dir))

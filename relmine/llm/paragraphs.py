"""Operator 4: repeated passages by paragraph MinHash banding.

A paragraph is a line of at least 20 words; its set has its distinct
five-word shingles. One pass gives every paragraph a digest of its set and
the keys of MinHash bands, as many as the wanted recall at the threshold
needs. Paragraphs of equal sets form a class with its first paragraph for
all; class representatives that share a band key are compared, exact Jaccard
similarity of full sets confirms, and components of the links are clusters.
Of a cluster that spans several documents the first paragraph (smallest id,
then position) stays, the others are removals.

Full sets are read again, for paragraphs in shared buckets only. A paragraph
is placed by ``doc_id * 2**32 + position``, a decimal; classes get numbers,
written with them, by which all work on pairs goes. Defined cases: null
and empty texts have no paragraphs; documents with a null id take no part and
keep their text; rows that repeat with one id count as one document; shorter
lines are never removed; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relmine.llm.common import documents, free_name, text_of, written
from relmine.llm.components import bucket_links, components, looked_up
from relmine.llm.minhash import WORDS, Banding, shingle_set, tuned

MIN_WORDS = 20
BAND_ROWS = 3
RECALL = 0.999  # that a pair at the threshold shares a bucket
SPAN = 1 << 32
WORDS_AT_ONCE = 200_000
Units = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def lines_of(text: str) -> tuple[np.ndarray, list[int]]:
    """The hashes of a text's words, and how many each line has."""
    parts = [line.split() for line in text.encode().lower().split(b"\n")]
    counts = list(map(len, parts))
    return np.fromiter(map(WORDS.__getitem__, chain.from_iterable(parts)), dtype=np.uint64, count=sum(counts)), counts


def long_lines(words: np.ndarray, counts: list[int]):
    """(line number, word hashes) of the lines that are long enough."""
    start = 0
    for at, n in enumerate(counts):
        if n >= MIN_WORDS:
            yield at, words[start : start + n]
        start += n


def paragraphs(text: str):
    """(line number, word hashes) of the lines that are long enough."""
    return long_lines(*lines_of(text))


def placed(doc: str, at: str) -> Column:
    return (F.col(doc).cast("decimal(20,0)") * F.lit(SPAN).cast("decimal(11,0)") + F.col(at)).cast("decimal(38,0)")


def _place(column: str) -> tuple[Column, Column]:
    """Document and position of a place."""
    return F.floor(F.col(column) / SPAN).cast("long"), F.pmod(column, F.lit(SPAN)).cast("long")


def signatures(docs: DataFrame, banding: Banding, units: Units | None = None) -> DataFrame:
    """``doc_id``, ``paragraph``, ``n_words``, ``digest``, ``keys`` and
    ``place`` of every paragraph; some thousands are hashed at once. With
    ``units``, which gives the hashes and places of the units of consecutive
    texts, each text that has any gets a row of its own with ``unit`` and
    ``at`` (lists), and null in the columns of paragraphs."""
    fields = "doc_id long, paragraph long, n_words long, digest binary, keys array<long>"
    fields += ", unit array<long>, at array<int>" if units else ""
    kinds = {"keys": pa.list_(pa.int64()), "unit": pa.list_(pa.int64()), "at": pa.list_(pa.int32()), "digest": pa.binary()}
    schema = pa.schema([(n, kinds.get(n, pa.int64())) for n in (f.split()[0] for f in fields.split(", "))])

    def rows(n: int, **columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def hashed(found: list[tuple], words: list[np.ndarray]) -> pa.RecordBatch:
        docs, ats, counts = zip(*found, strict=True)
        digests, keys = banding.of_many(np.concatenate(words), np.array(counts))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, keys.shape[1]), pa.int32()), pa.array(keys.ravel()))
        columns = dict(zip(("doc_id", "paragraph", "n_words"), (pa.array(c, pa.int64()) for c in (docs, ats, counts)), strict=True))
        return rows(len(docs), **columns, digest=pa.array(digests, pa.binary()), keys=lists)

    def cut(docs: list[int], words: list[np.ndarray]) -> pa.RecordBatch:
        unit, at, sizes = units(np.concatenate(words), np.array(list(map(len, words))))
        some = np.flatnonzero(sizes)
        ends = pa.array(np.append(0, np.cumsum(sizes[some])), pa.int32())
        lists = {c: pa.ListArray.from_arrays(ends, v) for c, v in (("unit", pa.array(unit, pa.int64())), ("at", pa.array(at, pa.int32())))}
        return rows(len(some), doc_id=pa.array(np.array(docs, np.int64)[some]), **lists)

    def flushed(found: list[tuple], lines: list[np.ndarray], texts: list[int], words: list[np.ndarray]):
        if found:
            yield hashed(found, lines)
        if units and texts:
            yield cut(texts, words)

    def run(batches):
        for batch in batches:
            found, lines, texts, words, total = [], [], [], [], 0
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                held, counts = lines_of(text.as_py())
                for at, line in long_lines(held, counts):
                    found.append((doc, at, len(line)))
                    lines.append(line)
                texts.append(doc)
                words.append(held)
                total += len(held)
                if total >= WORDS_AT_ONCE:
                    yield from flushed(found, lines, texts, words)
                    found, lines, texts, words, total = [], [], [], [], 0
            yield from flushed(found, lines, texts, words)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).filter("doc_id is not null")
    return texts.mapInArrow(run, fields).withColumn("place", placed("doc_id", "paragraph"))


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``id`` and ``shingles`` of the paragraphs in ``wanted`` (``id``,
    ``place``). Each document gets the list of its own."""
    doc, at = _place("place")
    lists = wanted.select(doc.alias("doc_id"), F.struct(at.alias("at"), "id").alias("one"))
    lists = lists.groupBy("doc_id").agg(F.collect_list("one").alias("wanted"))

    def run(batches):
        for batch in batches:
            ids, sets = [], []
            for text, wanted in zip(batch.column("text"), batch.column("wanted").to_pylist(), strict=True):
                those = {w["at"]: w["id"] for w in wanted}
                for at, words in paragraphs(text.as_py()):
                    if at in those:
                        ids.append(those[at])
                        sets.append(shingle_set(words).astype("<u8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], ["id", "shingles"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return texts.join(lists, "doc_id").select("text", "wanted").mapInArrow(run, "id long, shingles binary")


def signed_lines(docs: DataFrame, units: Units | None = None) -> DataFrame:
    """``signatures`` by the bands of this operator, written."""
    return written(signatures(docs, Banding(tuned(RECALL, BAND_ROWS), BAND_ROWS), units), "passage-signatures")


def repeated(docs: DataFrame, signed: DataFrame | None = None) -> DataFrame:
    """One row per paragraph of a cluster that spans several documents:
    ``doc_id``, ``paragraph`` (line number), ``n_words``, ``cluster_doc_id``
    and ``cluster_paragraph`` (the cluster's first), ``cluster_size``,
    ``removed``. ``signed``: the signatures of ``docs``, where they are known."""
    signed = (signed_lines(docs) if signed is None else signed).filter("paragraph is not null")
    classes = signed.groupBy("digest").agg(F.min("place").alias("place"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n"))
    # numbers are fixed by being written
    classes = written(classes.withColumn("id", F.monotonically_increasing_id()), "passage-classes")
    standing = signed.select("place", "digest", "keys").join(classes.select("place", "digest", "id"), ["place", "digest"])

    def sets_of(ids: DataFrame) -> DataFrame:
        return full_sets(docs, classes.select("id", "place").join(ids, "id"))

    links = bucket_links(standing.select("id", F.explode("keys").alias("key")), sets_of, "passage")
    found = components(links, "passage-components")

    groups = classes.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    clusters = groups.groupBy("component").agg(
        F.min("place").alias("cluster"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("cluster_size")
    )
    several = clusters.filter("first < last").select("component", "cluster", "cluster_size")
    groups = groups.select("digest", "component", "n").join(several, "component", "left").drop("component")
    rows = looked_up(signed.select("place", "doc_id", "paragraph", "n_words", "digest"), groups, ["digest"], "n", signed.count())
    first_doc, first_at = _place("cluster")
    return rows.filter("cluster is not null").select(
        "doc_id",
        "paragraph",
        "n_words",
        first_doc.alias("cluster_doc_id"),
        first_at.alias("cluster_paragraph"),
        "cluster_size",
        (F.col("place") != F.col("cluster")).alias("removed"),
    )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` without the removed lines; all rows and columns stay."""
    doc, lost = free_name(docs.columns, "_doc"), free_name(docs.columns, "_lost")
    gone = repeated(docs).filter("removed").groupBy(F.col("doc_id").alias(doc)).agg(F.collect_set("paragraph").alias(lost))
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.cast("long").alias("i"), x.alias("x")))
    left = F.transform(F.filter(lines, lambda s: ~F.array_contains(lost, s["i"])), lambda s: s["x"])
    text = F.when(F.col(lost).isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    joined = docs.join(gone, F.col("doc_id").cast("long") == F.col(doc), "left").withColumn("text", text)
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated(documents(spark, sf_dir))

"""Operator 7: near-duplicate documents by MinHash with odd sketches.

1. One pass over the texts gives each document its shingle set's size and
   digest, the keys of its MinHash bands, and its odd sketch: every sample,
   hashed with its number, flips one of 1024 bits, so the XOR of two sketches
   is the sketch of the samples in which they differ, and its population
   count estimates high similarities precisely.
2. Documents with the same set form a class; its smallest id stands for it.
3. Within band buckets representatives are compared as ``bucket_links`` says:
   the odd sketch filters, full sets confirm. The sketch passes every pair
   that lies within 4.3 standard deviations of the threshold.
4. Components of the confirmed links; each document gets its class's.

Full sets are computed again, for documents in shared buckets only. Defined
cases: null and empty texts and texts of white space have no set and link
with nothing; a text of fewer than five words is one shingle; documents with
a null id are kept unless a copy has an id; rows that repeat with one id are
all kept (operator 8 drops them); an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relmine.llm.common import documents, free_name, text_of, written
from relmine.llm.components import bucket_links, components, looked_up
from relmine.llm.minhash import THRESHOLD, Banding, mixed, set_digest, shared_bits, shingle_set, tuned, word_hashes

BAND_ROWS = 5
RECALL = 0.99999  # that a pair at the threshold shares a bucket
SKETCH_BITS = 1024
DEVIATIONS = 4.3  # a pair at the threshold is passed with probability 0.99999


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity, per bit, of the samples that hash to it; as 64-bit numbers."""
    at = mixed(samples + np.arange(len(samples), dtype=np.uint64)) % np.uint64(SKETCH_BITS)
    parity = np.bincount(at.astype(np.int64), minlength=SKETCH_BITS).astype(np.uint8) & 1
    return np.packbits(parity, bitorder="little").view("<i8")


def similarity(differing_bits: float, samples: int) -> float:
    """The estimate of Jaccard similarity that odd sketches give."""
    left = max(1 - 2 * differing_bits / SKETCH_BITS, 1e-9)
    return 1 + SKETCH_BITS / (4 * samples) * math.log(left)


def most_bits(samples: int, threshold: float = THRESHOLD / 100) -> int:
    """Differing bits that a pair at the threshold stays below, but for
    ``DEVIATIONS`` standard deviations. They vary with the number of samples
    that differ (binomial) and with how those fold into the bits."""
    n, flips = SKETCH_BITS, 2 * samples * (1 - threshold)
    left = math.exp(-2 * flips / n)
    sampling = 2 * left * math.sqrt(samples * threshold * (1 - threshold))
    folding = n / 4 * (1 - left * left) - flips * left * left
    return math.ceil(n / 2 * (1 - left) + DEVIATIONS * math.sqrt(sampling**2 + folding))


def signatures(docs: DataFrame, banding: Banding) -> DataFrame:
    """``id``, ``n_shingles``, ``digest``, ``sketch``, ``keys`` of every row."""

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                held = shingle_set(word_hashes(text.as_py()))
                if len(held):
                    samples = banding.samples(held)
                    rows.append((len(held), set_digest(held), odd_sketch(samples), banding.keys(samples)))
                else:
                    rows.append((0, None, None, None))
            n, digest, sketch, keys = zip(*rows, strict=True) if rows else ((), (), (), ())
            lists = pa.list_(pa.int64())
            columns = [batch.column("id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sketch, lists), pa.array(keys, lists)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_shingles", "digest", "sketch", "keys"])

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), text_of().alias("text"))
    return texts.mapInArrow(run, "id long, n_shingles long, digest binary, sketch array<long>, keys array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``id`` and ``shingles`` of the documents in ``wanted`` (``id``)."""

    def run(batches):
        for batch in batches:
            held = [shingle_set(word_hashes(t.as_py())).astype("<u8").tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(held, pa.binary())], ["id", "shingles"])

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), text_of().alias("text"))
    return texts.join(wanted, "id", "left_semi").mapInArrow(run, "id long, shingles binary")


def clustered(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``, ``kept`` of every row."""
    banding = Banding(tuned(RECALL, BAND_ROWS), BAND_ROWS)
    bits = most_bits(banding.bands * banding.rows)

    def alike(a: str, b: str) -> Column:
        return shared_bits(F.col(a), F.col(b), SKETCH_BITS // 64) <= bits

    signed = written(signatures(docs, banding), "near-signatures")
    held = signed.filter("n_shingles > 0")
    classes = written(held.groupBy("digest").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("n")), "near-classes")
    chosen = classes.filter("class_id is not null").select(F.col("class_id").alias("id"))
    standing = written(held.join(chosen, "id", "left_semi").select("id", "sketch", "keys"), "near-standing")

    keys = standing.select("id", F.explode("keys").alias("key"))
    links = bucket_links(keys, lambda ids: full_sets(docs, ids), "near", standing.select("id", "sketch"), alike)
    found = components(links, "near-components").select(F.col("id").alias("class_id"), F.col("component").alias("component_id"))

    groups = classes.join(found, "class_id", "left").withColumn("component_id", F.coalesce("component_id", "class_id"))
    total = signed.count()
    rows = looked_up(held.select("id", "n_shingles", "digest"), groups.select("digest", "component_id", "n"), ["digest"], "n", total)
    alone = signed.filter("n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component_id"))
    every = rows.select("id", "n_shingles", "component_id").unionByName(alone)
    return every.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component, the one of smallest id;
    all columns stay."""
    copy = free_name(docs.columns, "_copy")
    dropped = clustered(docs).filter("not kept").select(F.col("doc_id").alias(copy)).distinct()
    return docs.join(dropped, F.col("doc_id").cast("long").eqNullSafe(F.col(copy)), "left_anti")


def op7_odd_sketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(documents(spark, sf_dir))

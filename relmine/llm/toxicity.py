"""Operator 6: toxicity by nearest labelled examples.

Examples are a bounded sample of labelled rows outside the held-out fold:
``SAMPLE`` of them in order of a hash of their id, texts of more than
``EXAMPLE_CHARS`` code points left out. Terms are stems, a word's first four
letters (``STEMS``; a word that is shorter gives none), so that words with
different endings meet. Document frequencies are counted over all documents;
a term weighs (1 + ln tf) * min(idf ** ``POWER``, ``MOST_IDF``), vectors have
length 1, and the likeness of two texts is their cosine.

The examples' vectors form a block-max inverted index: similar examples lie
side by side in blocks of ``BLOCK``, and next to its postings each term keeps
its largest weight in each block. Terms that many examples have stand in a
dense matrix; their part of all scores comes from one product. A query adds
the maxima of its other terms to a block's best such part, which bounds the
block, scores the blocks of the highest bounds, and then only those whose
bound reaches the k-th best score; the k nearest are exact.

Their votes, weighted by distance, are calibrated by isotonic regression on
the sample, each example judged by the others (in tasks). A text without
terms gets the smoothed share of toxic examples among such texts. Stems,
power, limit and number of neighbours were chosen on training rows outside
the sample; the held-out fold had no part in it. Only texts and, for the fold
and the join with labels, ids are read; lang, source and labels of scored rows
are not.

Scoring is row-local. Defined cases: null and empty texts are texts without
terms; rows that repeat get equal results; labels without a text, or null,
are not used; an id that repeats in either table gives one example per row
within the bound; without labels every score is the smoothed prior; an empty
table gives an empty result; extra columns stay.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relmine.llm.common import documents, free_name, text_of, written

SAMPLE = 2_000  # labelled rows used to fit, at most
EXAMPLE_CHARS = 20_000  # code points of an example, at most: with SAMPLE, the bound of the index
STEMS = (4,)  # letters of a stem; several lengths give several terms
POWER, MOST_IDF = 2, 30.0
NEIGHBOURS = 15
BLOCK = 64  # examples of a block
LONG = 8  # a term of every eighth example or more has long postings
FIRST_BLOCKS = 3  # blocks that are scored before the k-th best is known
NEAR, PRIOR_WEIGHT = 0.1, 0.2  # softens the weight 1 / distance; weight of the prior
WORD = re.compile(r"[^\W\d_]+")
PUNCTUATION = ".,;:!?'\"()"  # of no word
CACHED = 300_000  # strings whose terms a task remembers


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def stems(word: str) -> list[str]:
    return [word[:n] for n in STEMS if len(word) >= n]


class Terms(dict):
    """The numbers of the terms of a string in lower case without white
    space; remembers such strings within a bound."""

    def __init__(self, terms: list[str]):
        super().__init__()
        self.number = {t: i for i, t in enumerate(terms)}

    def __missing__(self, string: str) -> tuple[int, ...]:
        if len(self) >= CACHED:
            self.clear()
        words = (string,) if string.isalpha() else WORD.findall(string)  # most strings are one word
        number = self.number
        found = tuple([number[t] for w in words for t in stems(w) if t in number])
        if len(string) < 64:
            self[string] = found
        return found

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Rising numbers of a text's terms, and how often each occurs."""
        text = text.lower()
        for mark in PUNCTUATION:
            text = text.replace(mark, " ")
        found = np.fromiter(chain.from_iterable(map(self.__getitem__, text.split())), np.int64)
        return np.unique(found, return_counts=True)


def weighted(counts: tuple[np.ndarray, np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A vector of length 1: its terms and weights."""
    terms, n = counts
    weights = (1 + np.log(n)) * idf[terms]
    return terms, weights / np.sqrt((weights * weights).sum())


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each span, one after the other."""
    before = np.cumsum(sizes) - sizes
    return np.arange(sizes.sum()) + np.repeat(starts - before, sizes)


class Index:
    """Block-max inverted index over vectors of length 1. The postings of a
    term that every ``LONG``-th example has are held densely."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int):
        held = np.bincount(np.concatenate([t for t, _ in vectors]), minlength=n_terms)
        # examples by their heaviest term of those that some others have
        heaviest = [int(t[np.argmax(w * (held[t] >= BLOCK // 8))]) for t, w in vectors]
        self.order = np.array(sorted(range(len(vectors)), key=lambda i: (heaviest[i], i)))
        self.place = np.argsort(self.order)
        self.n_blocks = -(-len(vectors) // BLOCK)
        sizes = [len(vectors[i][0]) for i in self.order]
        terms = np.concatenate([vectors[i][0] for i in self.order])
        weights = np.concatenate([vectors[i][1] for i in self.order]).astype(np.float32)
        at = np.repeat(np.arange(len(vectors)), sizes)
        by = np.argsort(terms, kind="stable")  # postings of a term by place
        terms, at, weights = terms[by], at[by], weights[by]
        long = held * LONG >= len(vectors)
        self.column = np.where(long, np.cumsum(long) - 1, -1)
        dense = long[terms]
        self.dense = np.zeros((self.n_blocks * BLOCK, int(long.sum())), np.float32)
        self.dense[at[dense], self.column[terms[dense]]] = weights[dense]
        terms, self.places, self.weights = terms[~dense], at[~dense], weights[~dense]
        # an entry for each term and block that meet, with the largest weight
        entry = np.flatnonzero(np.diff(terms, prepend=-1) | np.diff(self.places // BLOCK, prepend=-1))
        self.blocks = self.places[entry] // BLOCK
        self.most = np.maximum.reduceat(self.weights, entry) if len(entry) else self.weights
        self.entries = np.searchsorted(terms[entry], np.arange(n_terms + 1))  # entries of a term
        self.first = np.append(entry, len(terms))  # postings of an entry

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int = NEIGHBOURS, without: int = -1) -> list[tuple[float, int]]:
        """(cosine, example) of the k nearest with a term in common, ties (to
        six digits) by example; ``without`` leaves one example out."""
        column = self.column[terms]
        query = np.zeros(self.dense.shape[1], np.float32)
        query[column[column >= 0]] = weights[column >= 0]
        scores = (self.dense @ query).astype(np.float64)
        terms, weights = terms[column < 0], weights[column < 0]
        sizes = self.entries[terms + 1] - self.entries[terms]
        entry = spans(self.entries[terms], sizes)
        weight = np.repeat(weights, sizes)
        block = self.blocks[entry]
        # what the dense part gives is known; the rest is bounded by its maxima
        bound = scores.reshape(-1, BLOCK).max(axis=1) + np.bincount(block, weight * self.most[entry], self.n_blocks)

        def score(these: np.ndarray) -> None:
            mine = np.flatnonzero(these[block])
            start = self.first[entry[mine]]
            count = self.first[entry[mine] + 1] - start
            posting = spans(start, count)
            scores[:] += np.bincount(self.places[posting], np.repeat(weight[mine], count) * self.weights[posting], len(scores))
            if without >= 0:
                scores[self.place[without]] = 0

        chosen = np.zeros(self.n_blocks, bool)
        chosen[np.argsort(-bound, kind="stable")[:FIRST_BLOCKS]] = True
        score(chosen)
        known = scores[np.repeat(chosen, BLOCK)]
        least = np.partition(known, -k)[-k] if len(known) > k else 0.0
        more = (bound >= least - 1e-5) & (bound > 0) & ~chosen
        if more.any():
            score(more)
        scores[~np.repeat(chosen | more, BLOCK)] = 0
        least = max(np.partition(scores, -k)[-k] - 2e-6, 0.0) if len(scores) > k else 0.0
        near = np.flatnonzero(scores > least)
        near = near[near < len(self.order)]
        example, found = self.order[near], scores[near].round(6)
        best = np.lexsort((example, -found))[:k]
        best = best[found[best] > 0]
        return list(zip(found[best].tolist(), example[best].tolist(), strict=True))


def isotonic(votes: list[float], labels: list[int], prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the votes at which steps end, their shares."""
    pools: list[list[float]] = []  # positives, weight, last vote
    for vote, label in sorted(zip(votes, labels, strict=True)):
        if pools and pools[-1][2] == vote:
            pools[-1][0] += label
            pools[-1][1] += 1
        else:
            pools.append([label, 1, vote])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            last = pools.pop()
            pools[-1] = [pools[-1][0] + last[0], pools[-1][1] + last[1], last[2]]
    return np.array([p[2] for p in pools]), np.array([(p[0] + prior) / (p[1] + 1) for p in pools])


class Model:
    """Terms, index and calibration. It is sent to the tasks; ``SAMPLE``
    examples of ``EXAMPLE_CHARS`` bound its size."""

    def __init__(self, terms: list[str], idf: np.ndarray, sample: list[tuple[int, tuple[np.ndarray, np.ndarray], int]]):
        self.names, self.idf = terms, idf
        self.prior = (sum(y for _, _, y in sample) + 0.1) / (len(sample) + 1)
        empty = [y for _, (t, _), y in sample if not len(t)]
        self.blank = (sum(empty) + self.prior) / (len(empty) + 1)
        held = [s for s in sample if len(s[1][0])]
        self.ids, self.labels = [i for i, _, _ in held], np.array([y for _, _, y in held], np.float64)
        self.index = Index([weighted(v, idf) for _, v, _ in held], len(terms)) if held else None
        self.steps = self.shares = None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "terms"}

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        if not hasattr(self, "terms"):
            self.terms = Terms(self.names)
        return self.terms.counts(text)

    def vote(self, near: list[tuple[float, int]]) -> float:
        weights = [s / (1 - s + NEAR) for s, _ in near]
        toxic = sum(w * self.labels[at] for w, (_, at) in zip(weights, near, strict=True))
        return float((toxic + PRIOR_WEIGHT * self.prior) / (sum(weights) + PRIOR_WEIGHT))

    def judge(self, text: str) -> tuple[float, list[tuple[int, float, int]]]:
        """The score and the neighbours (id, similarity, label)."""
        if self.index is None:
            return self.prior, []
        counts = self.counts(text)
        if not len(counts[0]):
            return self.blank, []
        near = self.index.nearest(*weighted(counts, self.idf))
        vote = self.vote(near)
        share = self.shares[min(int(np.searchsorted(self.steps, vote)), len(self.shares) - 1)]
        # equal shares keep the order of their votes
        score = min(1.0, max(0.0, 0.99 * float(share) + 0.01 * vote))
        return score, [(self.ids[at], s, int(self.labels[at])) for s, at in near]


def _vocabulary(sample: DataFrame) -> list[str]:
    """Every term of the sample; its rows and their texts are bounded."""

    def run(batches):
        for batch in batches:
            words = {w for t in batch.column("text") for w in WORD.findall(t.as_py().lower())}
            yield pa.RecordBatch.from_arrays([pa.array(sorted({s for w in words for s in stems(w)}), pa.string())], ["term"])

    return sorted(sample.select("text").mapInArrow(run, "term string").distinct().toArrow()["term"].to_pylist())


def _frequencies(texts: DataFrame, terms: list[str]) -> np.ndarray:
    """Of each term the number of texts that have it, and at last the number
    of texts; a task sends one row per term that it has seen."""

    def run(batches):
        held, seen = Terms(terms), np.zeros(len(terms) + 1, np.int64)
        for batch in batches:
            for t in batch.column("text"):
                seen[held.counts(t.as_py())[0]] += 1
                seen[-1] += 1
        term = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(term, pa.int64()), pa.array(seen[term], pa.int64())], ["term", "n"])

    counted = texts.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    found = np.zeros(len(terms) + 1)
    found[counted["term"].to_numpy()] = counted["n"].to_numpy()
    return found


def _votes(sample: DataFrame, model: Model) -> list[tuple[float, int]]:
    """(vote, label) of each example that has terms, judged by the others.
    An example is known by its place in the sample."""
    sent = sample.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        for batch in batches:
            votes = []
            for at, text in zip(batch.column("at").to_pylist(), batch.column("text"), strict=True):
                vector = weighted(m.counts(text.as_py()), m.idf)
                votes.append(m.vote(m.index.nearest(*vector, without=at)))
            yield pa.RecordBatch.from_arrays([batch.column("at"), pa.array(votes, pa.float64())], ["at", "vote"])

    rows = sample.mapInArrow(run, "at long, vote double").toArrow()
    return [(v, int(model.labels[at])) for at, v in zip(rows["at"].to_pylist(), rows["vote"].to_pylist(), strict=True)]


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model of ``labels.toxic`` from the labelled rows outside the held-out
    fold; document frequencies are those of all ``docs``."""
    chosen = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("toxic"))
    chosen = chosen.filter(F.col("toxic").isin(0, 1) & F.col("_id").isNotNull() & ~held_out("_id"))
    chosen = F.broadcast(chosen.orderBy(F.xxhash64("_id"), "_id", "toxic").limit(SAMPLE))  # bounded
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), text_of().alias("text"))
    order = [F.xxhash64("_id"), F.col("_id"), F.col("toxic"), F.xxhash64("text")]
    few = texts.join(chosen, "_id").filter(F.length("text") <= EXAMPLE_CHARS).orderBy(*order).limit(SAMPLE)
    sample = written(few, "toxic-sample")
    terms = _vocabulary(sample)
    found = _frequencies(texts, terms)
    idf = np.minimum((1 + np.log((1 + found[-1]) / (1 + found[:-1]))) ** POWER, MOST_IDF)
    counter = Terms(terms)
    rows = sorted(sample.collect(), key=lambda r: (r["_id"], r["toxic"], r["text"]))  # SAMPLE texts of EXAMPLE_CHARS
    vectors = [(r["_id"], counter.counts(r["text"]), r["toxic"]) for r in rows]
    model = Model(terms, idf, vectors)
    if model.index:
        held = [(at, text) for at, text in enumerate(r["text"] for r, (_, (t, _), _) in zip(rows, vectors, strict=True) if len(t))]
        spark = docs.sparkSession
        own = spark.createDataFrame(pa.table({"at": [at for at, _ in held], "text": [text for _, text in held]}))
        votes = _votes(own.repartition(max(1, min(len(held) // 200, spark.sparkContext.defaultParallelism * 4))), model)
        model.steps, model.shares = isotonic([v for v, _ in votes], [y for _, y in votes], model.prior)
    return model


def scored(docs: DataFrame, model: Model, evidence: bool = True) -> DataFrame:
    """``docs`` with ``score`` and, with ``evidence``, the nearest examples
    (``doc_id``, ``similarity``, ``toxic``) in ``evidence``; columns of those
    names are replaced."""
    added = ["score", *["evidence"] * evidence]
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in added])
    schema = kept.withColumn("score", F.lit(0.0))
    if evidence:
        schema = schema.withColumn("evidence", F.expr("cast(array() as array<struct<doc_id:bigint,similarity:double,toxic:int>>)"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    near = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("toxic", pa.int32())]))

    def run(batches):
        judge = sent.value.judge
        for batch in batches:
            judged = [judge(t.as_py() or "") for t in batch.column(batch.schema.get_field_index("text"))]
            columns = [*batch.columns, pa.array([s for s, _ in judged], pa.float64())]
            if evidence:
                columns.append(pa.array([[{"doc_id": i, "similarity": s, "toxic": y} for i, s, y in e] for _, e in judged], near))
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, *added])

    return kept.mapInArrow(run, schema.schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """``docs`` without those that score at least ``least``."""
    model = fit(docs, labels)
    name = free_name(docs.columns, "toxicity")
    kept = [F.col(f"`{c}`") for c in docs.columns]
    own = docs.select(F.struct(*kept).alias(name), F.col("text"))  # so that no column of theirs is replaced
    score = scored(own, model, evidence=False)
    return score.filter(F.col("score") < least).select(*[F.col(f"`{name}`.`{c}`") for c in docs.columns])


def op6_toxic_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    out = scored(docs, fit(docs, labels), evidence=False)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

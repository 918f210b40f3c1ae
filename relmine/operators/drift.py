"""Semantic drift.

DR1 — drift point of a score sequence: fewer than 3 scores → none; for each
position i >= 1, drop = mean(previous <= w scores) - score_i; the answer is
the position of the largest drop strictly above the threshold (and above
0), the earliest one on ties.

Two physical forms share that rule:

* ``label_sequences`` (DR2/DR3) for long keyed sequences such as a user's
  events: positions and previous values come from the skew-safe
  ``ordered_sequence`` (no task ever holds a whole key), the arg-max is a
  partially aggregated ``groupBy``.
* ``trust_map`` (DR4–DR6) for the sentences of one response: a response is
  one text, so all of it is computed inside the response's row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relmine.functions import text as T
from relmine.functions.text import let
from relmine.functions.tfidf import by_document, kept_terms, lengths, ranked_entries, sums_before, token_entries
from relmine.operators.sequence import ordered_sequence
from relmine.sources.schemas import require

# Fixed values of the reference (drift_detection config and constructor).
DRIFT_THRESHOLD = 0.3
WINDOW_SIZE = 2
SINGLE_SENTENCE_SCORE = 0.8
FIRST_SENTENCE_SCORE = 0.9
EMPTY_VOCAB_SCORE = 0.5


def _mean(arr: Column) -> Column:
    return F.try_divide(F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x), F.size(arr))


def drop_candidate(pos: Column, prev: Column, score: Column, threshold: float) -> Column:
    """``struct(drop, -pos)`` for a position that may be a drift point, else null."""
    drop = _mean(prev) - score
    ok = (pos >= 1) & (F.size(prev) > 0) & (drop > F.lit(max(threshold, 0.0)))
    return F.when(ok, F.struct(drop.alias("drop"), (-pos).alias("neg_pos")))


def point_from_best(best: Column, n: Column) -> Column:
    return F.when((n >= 3) & best.isNotNull(), -best["neg_pos"]).cast("int")


def label_sequences(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    score: str = "trust_score",
    label: str = "is_hallucination",
    threshold: float = DRIFT_THRESHOLD,
    window: int = WINDOW_SIZE,
    actual: str | None = None,
    index: str = "sentence_idx",
) -> DataFrame:
    """DR2: per-row drift labels for keyed sequences.

    Adds ``detected_drift_point`` (a position in the sequence),
    ``actual_drift_point`` (``actual`` column of the first row, or — when the
    table carries no annotation — the first labelled position), ``post_drift``
    and ``prediction_correct``. A row is post drift by its own ``index``,
    which may start anywhere or have gaps; where the table has no such
    column, it is added as the 0-based position.
    """
    require(df, [*keys, *order, score, label] + ([actual] if actual else []), "label_sequences")
    own = index in df.columns
    seq = ordered_sequence(df, keys, order, score, window)
    seq = seq.withColumn("_cand", drop_candidate(F.col("_pos"), F.col("_prev"), F.col(score), threshold))
    first_actual = (
        F.min_by(F.col(actual), F.col("_pos")) if actual else F.min(F.when(F.col(label), F.col("_pos")))
    )
    per_key = seq.groupBy(*keys).agg(
        F.max("_cand").alias("_best"), F.first("_n").alias("_nn"), first_actual.cast("int").alias("actual_drift_point")
    )
    per_key = per_key.select(*keys, point_from_best(F.col("_best"), F.col("_nn")).alias("detected_drift_point"), "actual_drift_point")
    out = seq.join(per_key, keys)
    out = out if own else out.withColumn(index, F.col("_pos").cast("int"))
    post = F.coalesce(F.col(index) >= F.col("detected_drift_point"), F.lit(False))
    out = out.withColumn("post_drift", post).withColumn("prediction_correct", F.col("post_drift") == F.col(label))
    return out.drop("_pos", "_n", "_prev", "_cand")


def sentence_accuracy(labelled: DataFrame) -> DataFrame:
    """DR3: share of rows whose post-drift flag equals the label."""
    return labelled.agg(F.avg(F.col("prediction_correct").cast("double")).alias("accuracy"))


KEY_SALTS = 32  # parts that the rows of one key are dealt to


def order_columns(df: DataFrame, keys: list[str]) -> list[str]:
    """Columns other than the keys and the labels that are equal for a key."""
    return [c for c in df.columns if c not in {*keys, "detected_drift_point", "actual_drift_point"}]


def drift_summary(labelled: DataFrame, keys: list[str]) -> DataFrame:
    """DR7: responses, responses with a detected drift point, sentence accuracy.

    Rows are first aggregated by key and a salt, so the exchange that follows
    the join by key lets that join be split where a key is hot."""
    salted = labelled.withColumn("_salt", F.pmod(F.xxhash64(*order_columns(labelled, keys)), F.lit(KEY_SALTS)))
    parts = salted.groupBy(*keys, "_salt").agg(
        F.max(F.col("detected_drift_point").isNotNull().cast("int")).alias("_d"),
        F.count(F.lit(1)).alias("_rows"),
        F.sum(F.col("prediction_correct").cast("long")).alias("_ok"),
    )
    per_key = parts.groupBy(*keys).agg(F.max("_d").alias("_d"), F.sum("_rows").alias("_rows"), F.sum("_ok").alias("_ok"))
    return per_key.agg(
        F.count(F.lit(1)).alias("responses"),
        F.sum("_d").cast("long").alias("responses_with_drift"),
        F.try_divide(F.sum("_ok"), F.sum("_rows")).alias("sentence_accuracy"),
    )


def _reference_scores(kept: Column, n_sent: Column) -> Column:
    """DR4: cosine of each sentence (documents 1, 2, ...) to the reference (document 0)."""

    def first(t):
        return F.get(t["docs"], F.lit(0))

    def scores(lens):
        length = F.get(lens, F.lit(0))
        reference = F.transform(kept, lambda t: F.when(first(t)["doc"] == 0, first(t)["w"] / length).otherwise(F.lit(0.0)))

        def score(ref):
            return by_document(
                ranked_entries(kept), n_sent + 1, lambda g: F.aggregate(g, F.lit(0.0), lambda acc, x: acc + x["w"] * F.get(ref, x["rank"] - 1))
            )

        products = let(reference, score)
        return F.transform(F.slice(products, 2, n_sent), lambda x, i: F.coalesce(F.try_divide(x, F.get(lens, i + 1)), F.lit(0.0)))

    return let(lengths(kept, n_sent + 1), scores)


def _earlier_scores(kept: Column, n_sent: Column) -> Column:
    """DR5: mean cosine of each sentence (documents 1, 2, ...) to all earlier
    ones: a running sum of each term's weights, no sentence pairs."""

    def products(lens):
        def shared(t, r):
            weights = F.transform(t["docs"], lambda d: d["w"] / F.get(lens, d["doc"]))
            return let(
                weights,
                lambda v: F.zip_with(
                    F.transform(t["docs"], lambda d: d["doc"]),
                    F.zip_with(v, sums_before(v), lambda x, before: x * before),
                    lambda doc, x: F.struct(doc.alias("doc"), (r + 1).alias("rank"), x.alias("w")),
                ),
            )

        # a term of one sentence adds nothing
        entries = F.flatten(F.transform(F.filter(kept, lambda t: F.size(t["docs"]) > 1), shared))
        sums = by_document(entries, n_sent + 1, lambda g: F.aggregate(g, F.lit(0.0), lambda acc, x: acc + x["w"]))
        return F.transform(F.slice(sums, 2, n_sent), lambda x, i: x / F.greatest(i, F.lit(1)))

    return let(lengths(kept, n_sent + 1), products)


def sentence_scores(sents: Column, reference: Column) -> Column:
    """DR4/DR5 of one response: ``array<double>``, a score for each sentence."""
    has_ref = F.coalesce(F.length(reference) > 0, F.lit(False))
    ref = F.when(has_ref, reference).otherwise(F.lit(""))
    n = F.size(sents)
    docs = F.transform(F.concat(F.array(ref), sents), T.tfidf_tokens)
    n_docs = n + F.when(has_ref, 1).otherwise(0)

    def scores(kept):
        same = lambda x: F.transform(sents, lambda _: F.lit(x))
        earlier = F.transform(_earlier_scores(kept, n), lambda x, i: F.when(i == 0, F.lit(FIRST_SENTENCE_SCORE)).otherwise(x))
        return (
            F.when(has_ref & (F.size(kept) == 0), same(EMPTY_VOCAB_SCORE))
            .when(has_ref, _reference_scores(kept, n))
            .when(n <= 1, same(SINGLE_SENTENCE_SCORE))
            .when(F.size(kept) == 0, same(EMPTY_VOCAB_SCORE))
            .otherwise(earlier)
        )

    return let(kept_terms(token_entries(docs), n_docs), scores)


def drift_point(scores: Column, threshold: float = DRIFT_THRESHOLD, window: int = WINDOW_SIZE) -> Column:
    """DR1 of an array of scores."""

    def candidate(score, i):
        prev = F.slice(scores, F.greatest(i - window, F.lit(0)) + 1, F.least(i, F.lit(window)))
        return drop_candidate(i, prev, score, threshold)

    return let(F.array_max(F.transform(scores, candidate)), lambda best: point_from_best(best, F.size(scores)))


def trust_scores(
    responses: DataFrame,
    rid: str = "response_id",
    text: str = "response",
    reference: str = "reference",
    threshold: float = DRIFT_THRESHOLD,
    window: int = WINDOW_SIZE,
) -> DataFrame:
    """DR4/DR5: unrounded per-sentence trust scores ``rid, sentence_idx,
    sentence, score`` and the response's ``point`` (DR1 on them).

    With a reference (non-empty): cosine of each sentence to the reference in
    a TF-IDF fitted on [reference] + sentences. Without one: 0.8 for a lone
    sentence, else 0.9 for the first and the mean cosine to all earlier
    sentences (a running per-term sum, no sentence pairs). An empty
    vocabulary gives 0.5 for every sentence.

    A response is one text, so its corpus fits its row: everything is computed
    inside the row and nothing is shuffled, sorted by Spark or spilled.
    Responses that share an id each keep their own sentences.
    """
    require(responses, [rid, text, reference], "trust_scores")

    def rows(ss):
        def with_point(scores):
            return let(
                drift_point(scores, threshold, window),
                lambda point: F.transform(
                    ss,
                    lambda s, i: F.struct(i.alias("sentence_idx"), s.alias("sentence"), F.get(scores, i).alias("score"), point.alias("point")),
                ),
            )

        return let(sentence_scores(ss, F.col(reference)), with_point)

    return responses.select(F.col(rid), F.explode(let(T.sentences(F.col(text)), rows)).alias("_s")).select(rid, "_s.*")


def trust_map(
    responses: DataFrame,
    rid: str = "response_id",
    text: str = "response",
    reference: str = "reference",
    threshold: float = DRIFT_THRESHOLD,
    window: int = WINDOW_SIZE,
) -> DataFrame:
    """DR6: per-sentence trust map rows — DR1 on the unrounded scores of each
    response, then ``trust_score`` rounded to 3, ``is_post_drift`` and
    ``drift_point``. Responses without sentences produce no rows; responses
    that repeat an id each keep their own."""
    sc = trust_scores(responses, rid, text, reference, threshold, window)
    return sc.select(
        rid,
        F.col("sentence_idx").cast("int").alias("sentence_idx"),
        "sentence",
        F.round("score", 3).alias("trust_score"),
        F.coalesce(F.col("sentence_idx") >= F.col("point"), F.lit(False)).alias("is_post_drift"),
        F.col("point").alias("drift_point"),
    )

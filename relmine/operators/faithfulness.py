"""Faithfulness gap between a context and a response.

Every metric is a row-local expression: the operator is one narrow chain of
projections, no shuffle, and it runs unchanged on a streaming DataFrame.
The five metrics are rounded to 3 decimals before the composite, like the
reference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relmine.functions import text as T
from relmine.functions.tfidf import with_pair_cosine
from relmine.sources.schemas import require

# Fixed values of the reference.
NEGATION = ("not", "no", "never", "none")  # whole words
AMPLIFIER = ("all", "every", "always")
HEDGE = ("some", "few", "rarely")
FUNCTION_WORDS = ("the", "a", "an", "is", "are", "was", "were")
WEIGHTS = (0.3, 0.2, 0.3, 0.2)  # coverage, fidelity, similarity, 1 - contradiction

METRICS = ["entity_coverage", "numeric_fidelity", "semantic_similarity", "contradiction_score", "novel_word_ratio"]


READ = "_read"  # names the column that ``read`` adds


def read(df: DataFrame, text: str) -> DataFrame:
    """Add what the metrics need of a text, as one struct ``<text>_read`` (null
    for a null text): a text of several pairs is read once."""
    runs = df.withColumn("_runs", T.word_runs(F.lower(F.col(text))))
    runs = runs.withColumn("_marks", F.filter("_runs", lambda t: t.isin(*NEGATION, *AMPLIFIER, *HEDGE)))
    marks, t = F.col("_marks"), F.col(text)
    features = F.struct(
        T.entities(t).alias("e"),
        T.percent_numbers(t).alias("p"),
        F.array_distinct(T.plain_numbers(F.lower(t))).alias("f"),
        T.count_words(marks, NEGATION).alias("neg"),
        T.count_words(marks, AMPLIFIER).alias("amp"),
        T.count_words(marks, HEDGE).alias("hed"),
        F.array_distinct(T.ws_tokens(F.lower(t))).alias("w"),
        F.sort_array(T.tfidf_from_runs_sql("_runs")).alias("t"),
    )
    return runs.withColumn(f"{text}{READ}", F.when(t.isNotNull(), features)).drop("_runs", "_marks")


def _share(inter: Column, base: Column, empty_value: float) -> Column:
    return F.when(F.size(base) == 0, F.lit(empty_value)).otherwise(F.size(inter) / F.size(base))


def faithfulness(df: DataFrame, context: str = "context", response: str = "response", threshold: float = 0.5) -> DataFrame:
    """Add FG1–FG7 columns to a table of (context, response) rows. A side that
    was read before (column ``context_read`` or ``response_read``) is not read
    again.

    Null context or response yields null metrics (the reference raises).
    """
    require(df, [context, response], "faithfulness")
    read_before = [f"{c}{READ}" for c in (context, response)]
    src_cols = [c for c in df.columns if c not in read_before]
    for c in (context, response):
        if f"{c}{READ}" not in df.columns:
            df = read(df, c)
    c, r = (F.col(x) for x in read_before)
    valid = c.isNotNull() & r.isNotNull()
    w = df.select(
        *src_cols,
        *[c[x].alias(f"_{x}c") for x in ("e", "p", "f", "neg", "amp", "w", "t")],
        *[r[x].alias(f"_{x}r") for x in ("e", "p", "f", "neg", "hed", "t")],
        F.array_except(r["w"], F.array(*[F.lit(x) for x in FUNCTION_WORDS])).alias("_claims"),
        valid.alias("_valid"),
    )
    w = with_pair_cosine(w, "_tc", "_tr", "_sim")
    valid = F.col("_valid")

    coverage = _share(F.array_intersect(F.col("_ec"), F.col("_er")), F.col("_ec"), 1.0)
    fidelity = _share(F.array_intersect(F.col("_pc"), F.col("_pr")), F.col("_pc"), 1.0)
    novel_nums = F.array_except(F.col("_fr"), F.col("_fc"))
    contradiction = F.least(
        F.lit(0.0)
        + F.when(F.abs(F.col("_negc") - F.col("_negr")) > 1, F.lit(0.3)).otherwise(F.lit(0.0))
        + F.when(
            (F.size("_fc") > 0)
            & (F.size("_fr") > 0)
            & (F.size(novel_nums) > 0)
            & (F.size(novel_nums) > F.size("_fc") * F.lit(0.5)),
            F.lit(0.4),
        ).otherwise(F.lit(0.0))
        + F.when((F.col("_ampc") > 0) & (F.col("_hedr") > 0), F.lit(0.15)).otherwise(F.lit(0.0)),
        F.lit(1.0),
    )
    claims = F.col("_claims")
    novel = F.size(F.array_except(claims, F.col("_wc"))) / F.greatest(F.size(claims), F.lit(1))

    def r3(c: Column) -> Column:
        return F.when(valid, F.round(c, 3))

    out = w.select(
        *src_cols,
        r3(coverage).alias("entity_coverage"),
        r3(fidelity).alias("numeric_fidelity"),
        r3(F.col("_sim")).alias("semantic_similarity"),
        r3(contradiction).alias("contradiction_score"),
        r3(novel).alias("novel_word_ratio"),
    )
    a, b, c, d = WEIGHTS
    score = (
        F.lit(a) * F.col("entity_coverage")
        + F.lit(b) * F.col("numeric_fidelity")
        + F.lit(c) * F.col("semantic_similarity")
        + F.lit(d) * (F.lit(1.0) - F.col("contradiction_score"))
    )
    out = out.withColumn("faithfulness_score", score)
    return out.withColumn("predicted_faithful", F.col("faithfulness_score") > F.lit(threshold))


def detection_accuracy(scored: DataFrame, label: str = "is_faithful") -> DataFrame:
    """FG8: share of labelled rows where ``predicted_faithful`` equals the label."""
    lab = F.col(label).cast("boolean")
    return scored.filter(lab.isNotNull()).agg(
        F.avg((F.col("predicted_faithful") == lab).cast("double")).alias("accuracy"),
        F.count(F.lit(1)).alias("n_labelled"),
    )


def unfaithful(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """FG9: rows with score strictly below the threshold, lowest first."""
    return scored.filter(F.col("faithfulness_score") < threshold).orderBy(F.col("faithfulness_score").asc())


def summary(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """FG10: faithful (score >= threshold) / unfaithful counts, shares, mean score."""
    faithful = F.sum((F.col("faithfulness_score") >= threshold).cast("long"))
    total = F.count(F.lit(1))
    return scored.agg(
        total.alias("total"),
        faithful.alias("faithful"),
        (total - faithful).alias("unfaithful"),
        F.try_divide(faithful, total).alias("faithful_share"),
        F.avg("faithfulness_score").alias("mean_score"),
    )

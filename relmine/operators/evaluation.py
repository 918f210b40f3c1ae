"""Evaluation and chart-data aggregates.

The reference draws these as figures; here they are the numbers behind each
figure. Every operator is one or two aggregations: per-row work is a
projection, grouped work is partially aggregated, and the only table joined
back to rows is a histogram's ranges, one row per group, with hot groups dealt
by their counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relmine.operators.skew import dealt_join
from relmine.session import cut_lineage

# Fixed values of the reference's figures.
CONSISTENCY_BINS = 25
FAITHFULNESS_BINS = 15
FAITHFULNESS_HIST_METRICS = ["entity_coverage", "numeric_fidelity", "semantic_similarity"]
RATE_FEATURES = ["demands_numeric", "has_temporal_ref", "asks_about_person", "asks_for_list"]
SWEEP_POINTS = 50
TRAJECTORY_RESPONSES = 4


def histogram(df: DataFrame, value: str, groups: list[str], bins: int) -> DataFrame:
    """Equal-width histogram per group over the group's own [min, max]
    (min == max widens to +-0.5), last bin closed; every bin is listed.

    Bin assignment follows NumPy: index from the scaled offset, then one
    correction step against the exact bin edges ``first + k * step``. Any
    number of groups; rows with a null group key are left out. Without
    ``groups`` all rows are one.
    """
    x = F.col(value)
    if not groups:
        return histogram(df.withColumn("_all", F.lit(0)), value, ["_all"], bins).drop("_all")
    # ranges and counts both read the rows: what made their values runs once
    rows = cut_lineage(df.filter(x.isNotNull()).select(*groups, x.cast("double").alias("_x")).dropna(subset=groups))
    stats = rows.groupBy(*groups).agg(F.min("_x").alias("_mn"), F.max("_x").alias("_mx"), F.count(F.lit(1)).alias("_rows"))
    stats = stats.select(
        *groups,
        "_rows",
        F.when(F.col("_mn") == F.col("_mx"), F.col("_mn") - 0.5).otherwise(F.col("_mn")).alias("_lo"),
        F.when(F.col("_mn") == F.col("_mx"), F.col("_mx") + 0.5).otherwise(F.col("_mx")).alias("_hi"),
    )
    step = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))

    def edge(k: Column) -> Column:
        return F.when(k == bins, F.col("_hi")).otherwise(k.cast("double") * step + F.col("_lo"))

    j = dealt_join(rows, stats, groups, "_rows", "_x")
    f = (F.col("_x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * F.lit(float(bins))
    j = j.withColumn("_i", F.least(F.floor(f).cast("int"), F.lit(bins - 1)))
    j = j.withColumn("_i", F.when(F.col("_x") < edge(F.col("_i")), F.col("_i") - 1).otherwise(F.col("_i")))
    j = j.withColumn(
        "_i",
        F.when((F.col("_x") >= edge(F.col("_i") + 1)) & (F.col("_i") != bins - 1), F.col("_i") + 1).otherwise(F.col("_i")),
    )
    counts = j.groupBy(*groups, "_i").agg(F.count(F.lit(1)).alias("count"))
    all_bins = stats.select(*groups, "_lo", "_hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("_i"))
    out = all_bins.join(counts, [*groups, "_i"], "left")
    return out.select(
        *groups,
        F.col("_i").alias("bin"),
        edge(F.col("_i")).alias("bin_start"),
        edge(F.col("_i") + 1).alias("bin_end"),
        F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"),
    )


def consistency_histogram(enriched: DataFrame, label: str = "is_hallucination") -> DataFrame:
    """EV1: composite consistency by label, 25 bins."""
    return histogram(enriched, "composite_consistency", [label], CONSISTENCY_BINS)


def faithfulness_histograms(scored: DataFrame, label: str = "is_faithful") -> DataFrame:
    """EV2: three faithfulness metrics by label, 15 bins each."""
    long = scored.filter(F.col(label).isNotNull()).select(
        label,
        F.explode(
            F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in FAITHFULNESS_HIST_METRICS])
        ).alias("_m"),
    )
    long = long.select(label, F.col("_m.metric").alias("metric"), F.col("_m.v").alias("v"))
    return histogram(long, "v", ["metric", label], FAITHFULNESS_BINS)


def rate_by_feature(df: DataFrame, features: list[str] | None = None, label: str = "is_hallucination") -> DataFrame:
    """EV3: label rate per value of each feature; a feature is reported only
    when both label values occur among its non-null rows."""
    features = features or RATE_FEATURES
    long = df.select(
        F.col(label).alias("_y"),
        F.explode(
            F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("value")) for f in features])
        ).alias("_f"),
    ).select("_y", "_f.feature", "_f.value")
    g = long.filter(F.col("value").isNotNull() & F.col("_y").isNotNull()).groupBy("feature", "value").agg(
        F.count_if(F.col("_y")).alias("n_true"), F.count_if(~F.col("_y")).alias("n_false")
    )
    sums = g.groupBy("feature").agg(F.sum("n_true").alias("t"), F.sum("n_false").alias("f"))
    both = sums.filter("t > 0 and f > 0").select("feature")
    # one row per feature: bounded by the list
    return g.join(F.broadcast(both), "feature", "left_semi").select(
        "feature",
        "value",
        (F.col("n_true") / (F.col("n_true") + F.col("n_false"))).alias("rate"),
        (F.col("n_true") + F.col("n_false")).alias("n"),
    )


def feature_pivot(df: DataFrame, features: list[str] | None = None, label: str = "is_hallucination") -> DataFrame:
    """EV3 in wide form: rows per feature and value, with the number of rows
    of either label as columns ``n_false`` and ``n_true`` (0 where none).
    Rows without a label or value are left out."""
    features = features or RATE_FEATURES
    cells = [F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("value")) for f in features]
    long = df.select(F.col(label).alias("_y"), F.inline(F.array(*cells))).dropna()
    wide = long.groupBy("feature", "value").pivot("_y", [False, True]).count()
    return wide.na.fill(0).withColumnsRenamed({"false": "n_false", "true": "n_true"})


def threshold_sweep(df: DataFrame, score: str = "composite_consistency", label: str = "is_hallucination", points: int = SWEEP_POINTS) -> DataFrame:
    """EV4: confusion counts, TPR and FPR at ``points`` thresholds
    linspace(0, 1); predicted positive = score < t (null never predicted).

    One pass: each row is bucketed by the first threshold index at which it
    becomes predicted (``points`` = never), counts per bucket are partially
    aggregated, and cumulative sums over the ``points`` buckets give every
    confusion matrix — no rows x thresholds cross product.
    """
    step = 1.0 / (points - 1)

    def thr(k: Column) -> Column:
        return F.when(k == points - 1, F.lit(1.0)).otherwise(k.cast("double") * F.lit(step))

    s = F.col(score).cast("double")
    k0 = F.least(F.greatest(F.floor(s * F.lit(float(points - 1))).cast("int") + 1, F.lit(0)), F.lit(points))
    rows = df.select(F.col(label).alias("_y"), s.alias("_s"), k0.alias("_k"))
    # exact correction against the threshold values: smallest k with s < t_k
    rows = rows.withColumn(
        "_k", F.when((F.col("_k") > 0) & (F.col("_s") < thr(F.col("_k") - 1)), F.col("_k") - 1).otherwise(F.col("_k"))
    )
    rows = rows.withColumn(
        "_k", F.when((F.col("_k") < points) & (F.col("_s") >= thr(F.col("_k"))), F.col("_k") + 1).otherwise(F.col("_k"))
    )
    rows = rows.withColumn("_k", F.when(F.col("_s").isNull(), F.lit(points)).otherwise(F.col("_k")))
    counts = rows.groupBy("_k").agg(
        F.count_if(F.col("_y")).alias("_p"), F.count_if(~F.col("_y")).alias("_n")
    )
    # ``points`` + 1 buckets (the last one: never predicted); windows over
    # this tiny grid run in one partition by design
    grid = df.sparkSession.range(points + 1).select(F.col("id").cast("int").alias("_k"))
    cum = Window.orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.orderBy("_k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    g = grid.join(counts, "_k", "left").select(
        "_k", F.coalesce("_p", F.lit(0)).alias("_p"), F.coalesce("_n", F.lit(0)).alias("_n")
    )
    g = (
        g.withColumn("tp", F.sum("_p").over(cum))
        .withColumn("fp", F.sum("_n").over(cum))
        .withColumn("P", F.sum("_p").over(whole))
        .withColumn("N", F.sum("_n").over(whole))
        .filter(F.col("_k") < points)
    )
    tp, fp = F.col("tp"), F.col("fp")
    fn = F.col("P") - tp
    tn = F.col("N") - fp
    return g.select(
        F.col("_k").alias("k"),
        thr(F.col("_k")).alias("threshold"),
        tp.cast("long").alias("tp"),
        fp.cast("long").alias("fp"),
        fn.cast("long").alias("fn"),
        tn.cast("long").alias("tn"),
        (tp / F.greatest(tp + fn, F.lit(1))).alias("tpr"),
        (fp / F.greatest(fp + tn, F.lit(1))).alias("fpr"),
    )


def auc(sweep: DataFrame) -> DataFrame:
    """EV5: |sum(diff(fpr) * tpr[:-1])| over the sweep (left Riemann sum)."""
    w = Window.orderBy("k")  # ``points`` rows
    d = sweep.select("k", "tpr", (F.lead("fpr").over(w) - F.col("fpr")).alias("_dfpr"))
    return d.agg(F.abs(F.sum(F.col("_dfpr") * F.col("tpr"))).alias("auc"))


def trajectories(labelled: DataFrame, key: str, n: int = TRAJECTORY_RESPONSES) -> DataFrame:
    """EV6: trust-score rows of the first ``n`` responses by key order.

    The top-n keys come from a distinct + ordered limit (a bounded top-k),
    then a semi-join — no global window over all rows. Give the rows before
    they are labelled: labels of a sequence depend on its own rows alone.
    """
    first = labelled.select(key).distinct().orderBy(key).limit(n)
    return labelled.join(F.broadcast(first), key, "left_semi")


def base_rate(df: DataFrame, label: str = "is_hallucination") -> DataFrame:
    """EV7: label mean and row count."""
    return df.agg(F.avg(F.col(label).cast("double")).alias("base_rate"), F.count(F.lit(1)).alias("rows"))


def consistency_gap(enriched: DataFrame, label: str = "is_hallucination") -> DataFrame:
    """EV8: mean composite of reliable rows minus that of hallucinated rows."""
    c = F.col("composite_consistency")
    return enriched.agg(
        (F.avg(F.when(~F.col(label), c)) - F.avg(F.when(F.col(label), c))).alias("consistency_gap")
    )


def report_rows(df: DataFrame, metrics: dict[tuple[str, str], Column]) -> DataFrame:
    """EV9: ``(section, metric, value)`` rows of ``df`` from one aggregation."""
    one = df.agg(*[m.cast("double").alias(f"_{i}") for i, m in enumerate(metrics.values())])
    cells = [
        F.struct(F.lit(section).alias("section"), F.lit(metric).alias("metric"), F.col(f"_{i}").alias("value"))
        for i, (section, metric) in enumerate(metrics)
    ]
    return one.select(F.explode(F.array(*cells)).alias("_m")).select("_m.*")


def run_summary(parts: list[DataFrame]) -> DataFrame:
    """EV9: one long ``(section, metric, value)`` table."""
    return reduce(lambda a, b: a.unionByName(b), parts)

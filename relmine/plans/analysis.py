"""Full analysis (PL1) and the run summary (EV9) over the driver's tables.

``full_analysis`` returns lazy DataFrames; only the risk tree fit runs jobs
(a few small aggregations over the compressed feature table). ``write``
materialises everything through the sinks and collects the summary's values
while the tables are written, so that each chain runs once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relmine.operators import consistency as SC
from relmine.operators import drift as DR
from relmine.operators import evaluation as EV
from relmine.operators import faithfulness as FG
from relmine.operators import features as QF
from relmine.operators import rules as RR
from relmine.sources import sinks
from relmine.sources import tables as S

SUMMARY_FEATURES = RR.FEATURE_COLUMNS


def full_analysis(
    spark: SparkSession,
    sf_dir: str,
    min_support: float = RR.MIN_SUPPORT,
    min_confidence: float = RR.MIN_CONFIDENCE,
    drift_threshold: float = DR.DRIFT_THRESHOLD,
) -> dict[str, DataFrame]:
    """Features → consistency → rules → risk scores on the conversation
    prompts; faithfulness on document pairs; drift on event sequences."""
    queries = QF.extract(S.conversation_prompts(spark, sf_dir))
    # rules need the prompt features alone: fitted before the metrics are joined
    rules, tree = RR.fit(queries, SUMMARY_FEATURES, "is_hallucination", min_support, min_confidence)
    queries = RR.score(SC.analyze(queries, S.conversation_samples(spark, sf_dir)), tree)
    rag = S.document_pairs(spark, sf_dir, FG.faithfulness, FG.read)
    drift = DR.label_sequences(S.event_sequences(spark, sf_dir), ["user_id"], ["ts", "event_id"], threshold=drift_threshold)
    results = {
        "query_analysis": queries,
        "risk_rules": rules.select("rule", "confidence", "support", "n_matches"),
        "rag_faithfulness": rag,
        "drift_analysis": drift,
    }
    return {**results, "summary": summary(results)}


def report() -> dict[str, dict[tuple[str, str], Column]]:
    """EV9: the values of the run report, as plain aggregates of each result
    table, by (section, metric)."""
    label, comp = F.col("is_hallucination"), F.col("composite_consistency")
    lo, hi = SC.BANDS
    total = F.count(F.lit(1))
    band = {"high": comp >= hi, "medium": (comp >= lo) & (comp < hi), "low": comp < lo}
    prompts = {
        ("dataset", "queries"): total,
        ("dataset", "hallucination_rate"): F.avg(label.cast("double")),
        **{("consistency", b): F.count_if(c) for b, c in band.items()},
        **{("consistency", f"{b}_share"): F.try_divide(F.count_if(c), total) for b, c in band.items()},
        ("consistency_gap", "consistency_gap"): F.avg(F.when(~label, comp)) - F.avg(F.when(label, comp)),
    }
    faithful = F.count_if(F.col("faithfulness_score") >= 0.5)
    known = F.col("is_faithful").cast("boolean")
    pairs = {
        ("faithfulness", "total"): total,
        ("faithfulness", "faithful"): faithful,
        ("faithfulness", "unfaithful"): total - faithful,
        ("faithfulness", "faithful_share"): F.try_divide(faithful, total),
        ("faithfulness", "mean_score"): F.avg("faithfulness_score"),
        ("faithfulness_accuracy", "accuracy"): F.avg((F.col("predicted_faithful") == known).cast("double")),
        ("faithfulness_accuracy", "n_labelled"): F.count(known),
    }
    first = F.col("sentence_idx") == 0  # one row of each sequence
    turns = {
        ("drift", "responses"): F.count_if(first),
        ("drift", "responses_with_drift"): F.count_if(first & F.col("detected_drift_point").isNotNull()),
        ("drift", "sentence_accuracy"): F.avg(F.col("prediction_correct").cast("double")),
    }
    rules = {("rules", "n_rules"): total, ("rules", "best_confidence"): F.max("confidence")}
    return {"query_analysis": prompts, "risk_rules": rules, "rag_faithfulness": pairs, "drift_analysis": turns}


def summary(results: dict[str, DataFrame]) -> DataFrame:
    """EV9: the run report as ``(section, metric, value)`` rows; each result
    table is aggregated once."""
    return EV.run_summary([EV.report_rows(results[name], metrics) for name, metrics in report().items()])


def write(results: dict[str, DataFrame], out_dir: str, fmt: str = "csv", run: str | None = None) -> dict[str, str]:
    """S2 + S3: write every table (CSV with header by default, like the
    reference). The summary is made of what is observed meanwhile. With a
    ``run`` id, a run that was ended is taken up where it was left."""
    spark = results["query_analysis"].sparkSession
    rows: list[tuple[str, str, float | None]] = []
    for name, metrics in report().items():
        seen = sinks.write_observed(results[name], out_dir, name, fmt, {".".join(m): c for m, c in metrics.items()}, run=run)
        rows += [(section, metric, seen.get(f"{section}.{metric}")) for section, metric in metrics]
    said = spark.createDataFrame(rows, "section string, metric string, value double")
    sinks.write_observed(said.coalesce(1), out_dir, "summary", fmt, run=run)
    return {name: f"{out_dir.rstrip('/')}/{name}" for name in [*report(), "summary"]}


def main(argv: list[str] | None = None) -> None:
    """``python -m relmine.plans.analysis SF_DIR OUT_DIR [--format csv|parquet] [--run ID]``

    Runs the full analysis on the tables in SF_DIR, writes every result table
    under OUT_DIR (a shared folder on a cluster) and prints the run summary.
    """
    import argparse

    from relmine.session import get_session

    ap = argparse.ArgumentParser(prog="relmine.plans.analysis")
    ap.add_argument("sf_dir")
    ap.add_argument("out_dir")
    ap.add_argument("--format", default="csv", choices=["csv", "parquet"])
    ap.add_argument("--run", help="id of the run; given again, only missing tables are written")
    ap.add_argument("--min-support", type=float, default=RR.MIN_SUPPORT)
    ap.add_argument("--min-confidence", type=float, default=RR.MIN_CONFIDENCE)
    ap.add_argument("--drift-threshold", type=float, default=DR.DRIFT_THRESHOLD)
    args = ap.parse_args(argv)
    spark = get_session()
    results = full_analysis(spark, args.sf_dir, args.min_support, args.min_confidence, args.drift_threshold)
    paths = write(results, args.out_dir, args.format, args.run)
    for row in spark.read.format(args.format).option("header", True).load(paths["summary"]).collect():
        print(f"{row['section']:>22}  {row['metric']:<22} {row['value']}")


if __name__ == "__main__":
    main()

"""PL1 end to end: every result table is produced and written (S2/S3)."""

import tempfile

from relmine.plans import analysis
from relmine.sources.tables import read


def test_full_analysis_writes_all_tables(spark, sf_dir):
    results = analysis.full_analysis(spark, sf_dir)
    assert set(results) == {"query_analysis", "risk_rules", "rag_faithfulness", "drift_analysis", "summary"}
    qa = results["query_analysis"]
    for col in ("question_type", "composite_consistency", "predicted_risk"):
        assert col in qa.columns
    summary = {(r.section, r.metric): r.value for r in results["summary"].collect()}
    assert ("dataset", "queries") in summary and ("rules", "n_rules") in summary and ("drift", "responses") in summary
    assert summary[("dataset", "queries")] == qa.count()
    out = tempfile.mkdtemp(prefix="relmine-results-")
    for fmt in ("csv", "parquet"):
        paths = analysis.write(results, f"{out}/{fmt}", fmt=fmt)
        for name, path in paths.items():
            back = read(spark, path, results[name].schema, fmt)
            assert back.count() == results[name].count(), name
            assert content(back) == content(results[name]), (name, fmt)


def content(df):
    """Rows as a multiset, doubles to 9 digits; CSV cannot tell an empty text
    from a null one."""
    from collections import Counter

    return Counter(tuple(f"{v:.9g}" if isinstance(v, float) else v or None if isinstance(v, str) else v for v in r) for r in df.collect())

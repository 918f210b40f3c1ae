"""Write PLANS.md: per registered query, the physical operators that matter
at scale (shuffles, scans, broadcasts, windows, Python), from the executed
plan on sf0.01 with AQE disabled (so the static plan is shown).

    python tests/plan_report.py [sf_dir]
"""

from __future__ import annotations

import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def main(argv):
    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    from relmine.session import get_session

    spark = get_session("local[8]", **{"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "8"})
    from relmine import session
    from relmine.operators import consistency, rules, sequence, tfidf
    from relmine.plans import catalog

    # plans of what is checkpointed on the way belong to the query
    before: list[str] = []

    def kept(df, spark=None):
        before.append(df._jdf.queryExecution().executedPlan().toString())
        return session.cut_lineage(df, spark)

    for module in (consistency, rules, sequence, tfidf):
        module.cut_lineage = kept

    lines = [
        "# Physical plans of the registered queries",
        "",
        "Generated by `tests/plan_report.py` on sf0.01 with AQE off (the static plan; AQE may",
        "further coalesce partitions, split skewed joins and turn measured-small joins into",
        "broadcasts). `hash/range shuffles` count Exchange nodes that move rows, `reused` those",
        "served from an earlier identical exchange; `scans` counts parquet scans. Plans that a query",
        "checkpoints on the way are counted with it.",
        "",
        "| query | hash/range shuffles | reused | broadcasts | scans | windows | joins | python |",
        "|---|---|---|---|---|---|---|---|",
    ]
    for name, fn in catalog.QUERIES.items():
        before.clear()
        plan = "\n".join([fn(spark, sf)._jdf.queryExecution().executedPlan().toString(), *before])
        shuffles = len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition)", plan))
        reused = plan.count("ReusedExchange")
        bcast = plan.count("BroadcastExchange")
        scans = plan.count("FileScan parquet")
        windows = len(re.findall(r"\bWindow \[", plan))
        joins = len(re.findall(r"(SortMergeJoin|BroadcastHashJoin|ShuffledHashJoin)", plan))
        py = "yes" if ("BatchEvalPython" in plan or "ArrowEvalPython" in plan) else "no"
        lines.append(f"| `{name}` | {shuffles} | {reused} | {bcast} | {scans} | {windows} | {joins} | {py} |")
        print(lines[-1], flush=True)
    with open(os.path.join(ROOT, "PLANS.md"), "w") as f:
        f.write("\n".join(lines) + "\n")


if __name__ == "__main__":
    main(sys.argv)

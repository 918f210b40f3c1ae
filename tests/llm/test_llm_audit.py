"""The audit of filters against plain counting, document by document."""

import random
import re
from itertools import permutations

import __spark_entry__ as E
from relmine.llm import audit
from tests.llm.helpers import as_rows, awkward, clashing, words
from tests.oracle_harness import compare, duck_connect

LABELS = "doc_id long, quality int, toxic int"


def failures(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {
        "A": len(w) < 100,
        "B": 100 * len(set(w)) < 80 * len(w),
        "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
        "D": any(c in "#$%&*|" for c in text),
    }


def by_force(rows, labels):
    """rows: (doc_id, text, part)."""
    good = {i for i, q, _ in labels if q == 1} - {None}
    toxic = {i for i, _, t in labels if t == 1} - {None}
    docs = []
    for i, text, part in rows:
        f = failures(text or "")
        f["E"] = i is not None and any(j is not None and j < i and (u or "") == (text or "") for j, u, _ in rows)
        docs.append((part or "", {k for k, v in f.items() if v}, i in good, i in toxic))
    out = []
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        lines, removed = [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, name in enumerate(order, 1):
                lost = [d for d in left if name in d[1]]
                earlier = [d for d in mine if name in d[1]]
                left = [d for d in left if name not in d[1]]
                removed[name] += len(lost)
                lines.append([part, "".join(order), step, len(left), len(lost), len(earlier) - len(lost), sum(d[1] == {name} for d in mine), sum(d[2] for d in lost), sum(d[3] for d in lost), name])
        out += [(*line[:-1], removed[line[-1]]) for line in lines]
    return sorted(out)


def found(df):
    names = ["part", "filter_order", "step", *audit.MEASURES, "shapley"]
    return sorted(tuple(r[n] for n in names) for r in as_rows(df))


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)


def cases():
    r = random.Random(3)
    rows = [(i, t, r.choice(["en", "de", None, ""])) for i, t in awkward()]
    texts = [words(120, 1), words(110, 2) + " #", "ABC " * 30, words(100, 3).upper(), "x " * 150, ""]
    rows += [(100 + i, r.choice(texts), r.choice(["en", "de", None])) for i in range(60)]
    rows += [(100, texts[0], "en"), (None, texts[0], "en"), (None, texts[0], "de"), (0, awkward()[0][1], "de")]
    labels = [(r.choice([None, *range(20), *range(100, 160)]), r.choice([None, 0, 1]), r.choice([None, 0, 1])) for _ in range(60)]
    return rows, labels


def test_against_plain_counting(spark):
    rows, labels = cases()
    got = audit.audit(clashing(documents(spark, rows)), spark.createDataFrame(labels, LABELS).withColumn("text", audit.F.lit("x")))
    assert found(got) == by_force(rows, labels)


def test_a_text_that_most_rows_share(spark):
    rows = [(i, "same words" if i % 3 else words(100, i), "en") for i in range(1500)]
    got = found(audit.audit(documents(spark, rows), spark.createDataFrame([], LABELS)))
    line = next(r for r in got if r[1] == "EABCD" and r[2] == 1)
    assert line[3:5] == (501, 999)


def test_wide_integers_hold_large_counts():
    """Fields of the largest counts do not run into each other."""
    most = (1 << 62) // 3
    total = sum(most * audit.wide(m, True, True) for m in (3, 9, 31))
    one = sum(audit.unpacked(audit.wide(m, True, True)) for m in (3, 9, 31))
    assert (audit.unpacked(total) == most * one).all()


def test_missing_rows(spark):
    none, labels = spark.createDataFrame([], "doc_id long, text string, lang string"), spark.createDataFrame([], LABELS)
    assert found(audit.audit(none, labels)) == []
    got = found(audit.audit(documents(spark, [(1, None, None)]), labels))
    assert len(got) == 600 and got[0][0] == ""


def test_query_matches_sql(spark, sf_dir):
    r = compare(spark, duck_connect(sf_dir), "op12_wide_counters", audit.op12_wide_counters, E.oracle_sql()["op12_wide_counters"], sf_dir)
    assert r["ok"] and not r["type_diff"], r


def test_only_counts_reach_python(spark, sf_dir):
    plan = audit.op12_wide_counters(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 1 and "MapInArrow" not in plan.replace("FlatMapGroupsInArrow", "")

"""Repeated runs of words by brute force."""

from collections import defaultdict

from relmine.llm import passages, queries
from tests.llm.helpers import as_rows, awkward, clashing, saved, table, words


def split(text):
    return (text or "").encode().lower().split()


def plain(rows, n=50):
    """Every repeated window and its first place."""
    held = defaultdict(set)
    for i, t in rows:
        if i is not None:
            w = split(t)
            for at in range(len(w) - n + 1):
                held[tuple(w[at : at + n])].add((i, at))
    return {p: min(g) for g in held.values() if len({i for i, _ in g}) > 1 for p in g}


def covered(got):
    return {(r["doc_id"], r["word"] + k): (r["first_doc_id"], r["first_word"] + k) for r in got for k in range(r["n_words"] - 49)}


def embedded():
    """One passage of 50 words inside long lines, across short ones, and in a
    line where it reaches further."""
    p = words(50, 7).split()
    short = "\n".join(" ".join(p[k : k + 6]) for k in range(0, 50, 6))
    return [
        (20, f"{words(40, 21)} {' '.join(p)} {words(41, 22)}"),
        (21, f"{words(30, 23)} {' '.join(p)} {words(60, 24)}"),
        (22, f"{words(9, 25)}\n{short} {words(3, 26)}"),
        (23, f"{words(60, 23)}\n{' '.join(p[:49])} x"),
        (24, f"{words(10, 27)} {' '.join(p)} {words(60, 24)}"),
    ]


def test_embedded_passages(spark, tmp_path):
    rows = embedded()
    got = as_rows(queries.QUERIES["op4_repeated_runs"](spark, saved(spark, tmp_path, rows)))
    assert {(r["doc_id"], r["word"], r["n_words"]) for r in got if r["removed"]} >= {(21, 30, 50), (22, 9, 50), (24, 10, 50)}
    assert covered(got) == plain(rows) and {r["doc_id"] for r in got} == {20, 21, 22, 24}
    # 24 and 21 agree beyond the passage that 20 has
    assert any(r["doc_id"] == 24 and r["first_doc_id"] == 21 and r["word"] + r["n_words"] == 120 for r in got)


def test_awkward_rows(spark, tmp_path):
    rows = awkward() + [(50, "of " * 60), (51, words(3000, 2)[1000:9000]), (51, words(3000, 2)[1000:9000]), (-7, words(120, 1))]
    got = as_rows(passages.op4_repeated_runs(spark, saved(spark, tmp_path, rows)))
    assert covered(got) == plain(rows)


def test_whole_table(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in as_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"))]
    assert covered(as_rows(passages.op4_repeated_runs(spark, sf_dir))) == plain(rows)


def test_remove_runs(spark):
    rows = [*embedded(), (30, None), (None, words(50, 7)), (31, "")]
    left = {r["doc_id"]: r["text"] for r in as_rows(passages.remove_runs(clashing(table(spark, rows))))}
    assert {i: left[i] for i in (20, 23, 30, None, 31)} == {i: t for i, t in rows if i in (20, 23, 30, None, 31)}
    assert left[21] == f"{words(30, 23)}  {words(60, 24)}" and left[22] == f"{words(9, 25)}\n {words(3, 26)}" and left[24] == f"{words(10, 27)} "
    assert passages.runs(table(spark, [])).count() == 0

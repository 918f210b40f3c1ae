"""Runs of words against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np

from relmine.llm import periodic
from tests.llm.helpers import as_rows, awkward, clashing, saved, table


def lyndon_by_force(w):
    def is_lyndon(u):
        return all(u < u[k:] for k in range(1, len(u)))

    return [max(j - i for j in range(i + 1, len(w) + 1) if is_lyndon(w[i:j])) for i in range(len(w))]


def runs_by_force(w, exponent=4, least=6):
    out, n = set(), len(w)
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            length = j - i + p
            smallest = not any(all(w[k] == w[k + q] for k in range(i, i + length - q)) for q in range(1, p))
            if length >= max(least, exponent * p) and smallest:
                out.add((i, length, p))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def sequences(r, count):
    for _ in range(count):
        if r.random() < 0.4:
            yield [r.randint(0, r.choice([1, 2, 3])) for _ in range(r.randint(0, 50))]
        else:
            w = []
            while len(w) < r.randint(5, 70):
                w += [r.randint(0, 2) for _ in range(r.randint(1, 6))] * r.randint(1, 7)
            yield w


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def expected(doc_id, text):
    w = words_of(text)
    if doc_id is not None and w and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    runs = runs_by_force(w)
    dropped = {i for s, n, p in runs for i in range(s + p, s + n)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    return {
        "doc_id": doc_id,
        "n_runs": len(runs),
        "start": best[0],
        "length": best[1],
        "period": best[2],
        "exponent_milli": best[2] and 1000 * best[1] // best[2],
        "runs_sha256": hashlib.sha256("".join("%d,%d,%d\n" % r for r in runs).encode()).hexdigest(),
        "collapsed_sha256": hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in dropped).encode()).hexdigest(),
    }


def test_lyndon_arrays():
    r = random.Random(1)
    for _ in range(600):
        w = [r.randint(0, r.choice([1, 2, 3])) for _ in range(r.randint(0, 22))]
        assert periodic.lyndon_array(w) == lyndon_by_force(w), w


def test_runs():
    r = random.Random(2)
    for w in sequences(r, 2500):
        for exponent, least in ((4, 6), (2, 2), (3, 5)):
            assert periodic.runs_of(np.array(w, np.int64), exponent, least) == runs_by_force(w, exponent, least), w


def test_documents_of_a_slice_are_kept_apart(monkeypatch):
    r = random.Random(3)
    cases = [[str(x).encode() for x in w] for w in sequences(r, 1500)]
    for words in (1 << 18, 100):
        monkeypatch.setattr(periodic, "SLICE_WORDS", words)
        got = list(periodic.runs_of_documents(cases))
        assert [t for t, _ in got] == cases
        assert [found for _, found in got] == [runs_by_force(w) for w in cases]


def test_long_sequences():
    for w, runs in ((["a"] * 300_000, [(0, 300_000, 1)]), (["of", "the"] * 100_000, [(0, 200_000, 2)])):
        assert [found for _, found in periodic.runs_of_documents([[x.encode() for x in w]])] == [runs]


def awkward_runs():
    """Ids whose words are rewritten, with few and many words."""
    r = random.Random(4)
    chosen = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 10 == 0][:60]
    rows = [(i, " ".join(r.choice(["a", "b", "c", "dd"]) for _ in range(r.randint(0, 60)))) for i in chosen]
    return rows + [(9001, "x " * 6), (9002, "x " * 5), (9003, "a b " * 4), (9004, "a b " * 3 + "a"), (9005, "\x1ca \x85b " * 5), (9005, "\x1ca \x85b " * 5)]


def test_query(spark, tmp_path):
    rows = awkward() + awkward_runs()
    got = as_rows(periodic.op11_lyndon_runs(spark, saved(spark, tmp_path, rows)))
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["collapsed_sha256"])
    assert sorted(got, key=key) == sorted((expected(i, t) for i, t in rows), key=key)


def test_query_on_the_whole_table(spark, sf_dir):
    got = {r["doc_id"]: r for r in as_rows(periodic.op11_lyndon_runs(spark, sf_dir))}
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        if len(words_of(r["text"])) <= 1200:  # brute force is quadratic
            assert got[r["doc_id"]] == expected(r["doc_id"], r["text"])


def test_general_form(spark):
    got = as_rows(periodic.with_runs(clashing(table(spark, [(1, "go a b a b a b stop"), (2, None), (3, "")])), exponent=3, least=2))
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[1]["runs"] == [{"start": 1, "length": 6, "period": 2}]
    assert by_id[1]["collapsed"] == "go a b stop" and by_id[1]["start"] == "x"
    assert by_id[2]["runs"] == by_id[3]["runs"] == [] and by_id[2]["collapsed"] == ""


def test_empty_table(spark, tmp_path):
    table(spark).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert as_rows(periodic.op11_lyndon_runs(spark, str(tmp_path))) == []
    assert as_rows(periodic.with_runs(table(spark).limit(0))) == []

"""Passages inside and across lines, in the registered query, by brute force."""

from collections import defaultdict

import numpy as np

from relmine.llm import minhash, queries, repeats
from tests.llm.helpers import as_rows, awkward, saved, words
from tests.llm.test_llm_passages import embedded, plain, split


def found(spark, folder):
    got = as_rows(queries.QUERIES["op4_repeated_passages"](spark, folder))
    return [r for r in got if r["word"] is None], [r for r in got if r["word"] is not None]


def holds(rows, got):
    """Passages are repeated word for word in their first document, and every
    repeated window of 50 words is covered but for its ends."""
    texts = defaultdict(list)
    for i, t in rows:
        texts[i].append(split(t))
    covered = defaultdict(set)
    for r in got:
        covered[r["doc_id"]].update(range(r["word"], r["word"] + r["n_words"]))
        units = {tuple(w[at : at + repeats.UNIT]) for w in texts[r["cluster_doc_id"]] for at in range(len(w))}
        own = [w[r["word"] : r["word"] + repeats.UNIT] for w in texts[r["doc_id"]]]
        assert any(tuple(w) in units for w in own) and r["n_words"] >= repeats.UNIT and r["removed"] == (r["doc_id"] != r["cluster_doc_id"])
    for i, at in plain(rows):
        assert len(covered[i] & set(range(at, at + repeats.WORDS))) >= repeats.UNIT, (i, at)


def test_embedded_passages(spark, tmp_path):
    lines, got = found(spark, saved(spark, tmp_path, embedded()))
    assert {r["doc_id"] for r in got} >= {20, 21, 22, 24} and all(r["paragraph"] is None for r in got)
    assert {r["doc_id"] for r in got if r["removed"]} >= {21, 22, 24}
    assert {r["doc_id"] for r in lines} <= {23, 24}
    holds(embedded(), got)


def test_awkward_rows(spark, tmp_path):
    rows = awkward() + [(50, "of " * 60), (51, words(3000, 2)[1000:9000]), (51, words(3000, 2)[1000:9000]), (-7, words(120, 1))]
    holds(rows, found(spark, saved(spark, tmp_path, rows))[1])


def test_whole_table(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in as_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"))]
    lines, got = found(spark, sf_dir)
    holds(rows, got)
    assert {i for i, _ in plain(rows)} <= {r["doc_id"] for r in got} and lines


def test_units_do_not_depend_on_neighbours():
    texts = [minhash.word_hashes(words(n, n)) for n in (0, 400, 49, 50, 3, 51, 120)]
    unit, at, sizes = repeats.units(np.concatenate(texts), np.array(list(map(len, texts))))
    alone = [repeats.units(t, np.array([len(t)])) for t in texts]
    assert unit.tolist() == [u for a in alone for u in a[0].tolist()] and at.tolist() == [p for a in alone for p in a[1].tolist()]
    assert sizes.tolist() == [len(a[0]) for a in alone] and sizes[3] == 1 and not sizes[[0, 2, 4]].any()

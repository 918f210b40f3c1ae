"""Encoding and decoding against the sentencepiece library."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from relmine.llm import piecebpe
from tests.llm.helpers import as_rows, awkward, clashing, saved, table

LETTERS = [*"ab \n\tsterhing12.", "the ", "  ", "中", "国", "é", "😀", "▁", "\x00", "\x85", "!!", "==", "aaaa", "    ", "р", "र", "्", "<s>", "</s>", "<0x41>", "ﬁ"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=piecebpe.model_path())


@pytest.fixture(scope="module")
def encoder():
    return piecebpe.Encoder(piecebpe.Vocabulary(piecebpe.model_path()))


def flat(encoder, texts):
    return [[i for ids, _, _ in words for i in ids] for words in encoder.encode(texts)]


def texts():
    r = random.Random(5)
    out = ["".join(r.choice(LETTERS) for _ in range(r.randint(0, 80))) for _ in range(4000)]
    out += ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(1, 400))) for _ in range(300)]
    out += ["".join(chr(r.choice([r.randint(32, 0x2FFF), r.randint(0x4E00, 0x9FFF), r.randint(0x1F300, 0x1F9FF)])) for _ in range(60)) for _ in range(200)]
    return out + ["a" * n for n in range(70)] + [" " * n for n in range(70)]


def test_same_ids_and_texts_as_the_library(library, encoder):
    cases = texts()
    for text, ids in zip(cases, flat(encoder, cases), strict=True):
        assert ids == library.encode(text), repr(text)
        assert encoder.decode(ids) == library.decode(ids), repr(text)


def test_any_ids_decode_as_in_the_library(library, encoder):
    r = random.Random(6)
    for _ in range(4000):
        ids = [r.choice([r.randrange(32000), r.randrange(261), r.randrange(3, 259), 28705, 259]) for _ in range(r.randint(0, 12))]
        assert encoder.decode(ids) == library.decode(ids), ids


def test_very_long_words(library, encoder):
    r = random.Random(7)
    cases = ["a" * 70_000, " " * 30_000, "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789+/XYZ") for _ in range(40_000)), "中国人民" * 5000]
    for text, ids in zip(cases, flat(encoder, cases), strict=True):
        assert ids == library.encode(text)


def test_rounds_equal_one_merge_at_a_time(encoder, monkeypatch):
    """Also with every word short enough for rounds, and with slices of few
    characters and no memory of earlier words."""
    r = random.Random(8)
    words = ["".join(r.choice("thesing") for _ in range(r.randint(1, 60))) for _ in range(400)]
    v = encoder.vocabulary
    alone = [piecebpe.merge_one_by_one(v, v.of_char[np.frombuffer(w.encode("utf-32-le"), np.uint32)].tolist()) for w in words]
    assert [list(i) for i in encoder.encode_words(words)] == alone
    monkeypatch.setattr(piecebpe, "SLICE_CHARS", 50)
    monkeypatch.setattr(piecebpe, "KEPT_WORDS", 3)
    small = piecebpe.Encoder(v)
    assert [list(i) for i in small.encode_words(words)] == alone
    assert flat(small, words * 2) == flat(encoder, words * 2)


def test_documents(spark, library):
    rows = awkward() + [(5, "five again"), (5, "five again")]
    got = as_rows(piecebpe.decode_documents(piecebpe.encode_documents(clashing(table(spark, rows)))))
    assert len(got) == len(rows)
    for row in got:
        assert row["ids"] == library.encode(row["text"] or "")
        assert row["decoded"] == library.decode(row["ids"]) and row["key"] == "x"


def test_query(spark, tmp_path, library):
    sf = saved(spark, tmp_path, awkward())
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in as_rows(piecebpe.op13_merge_rounds(spark, sf)))
    want = []
    for i, t in awkward():
        ids = library.encode(t or "")
        want.append((i is None, i or 0, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert got == sorted(want)


def test_query_on_the_whole_table(spark, sf_dir, library):
    got = {r["doc_id"]: r for r in as_rows(piecebpe.op13_merge_rounds(spark, sf_dir))}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode(r["text"] or "")
        assert got[r["doc_id"]]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[r["doc_id"]]["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_empty_table(spark, tmp_path):
    table(spark).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert as_rows(piecebpe.op13_merge_rounds(spark, str(tmp_path))) == []
    assert as_rows(piecebpe.decode_documents(piecebpe.encode_documents(table(spark).limit(0)))) == []

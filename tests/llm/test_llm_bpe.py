"""Encoding and decoding against the tokenizers library."""

import hashlib
import random

import pytest
from tokenizers import Tokenizer

from relmine.llm import bpe
from tests.llm.helpers import as_rows, awkward, clashing, saved, table


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(bpe.tokenizer_path())
    t.no_padding()
    t.no_truncation()
    return t


@pytest.fixture(scope="module")
def merges():
    return bpe.Merges(bpe.tokenizer_path())


def flat(encoder, text):
    return [i for part in encoder.encode(text) for i in part]


def test_random_strings(library, merges):
    r = random.Random(7)
    letters = list("ab  \n\t'sretd1 2.,é中😀\x1c\x85 \xa0ñ²½Ⅷ​\x00~^") + ["<|endoftext|>", "'ll"]
    encoder = bpe.Encoder(merges)
    for _ in range(1500):
        text = "".join(r.choice(letters) for _ in range(r.randint(0, 40)))
        assert flat(encoder, text) == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_long_pieces_in_small_chunks(library, merges, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK_CHARS", 64)
    r = random.Random(8)
    run = "".join(r.choice("thinger") for _ in range(3000))
    for text in ("a" * 5000, " " * 900 + "x", "\n \n" * 300, run, "ab " * 500, "é" * 1000, "!?" * 700, "x  y" * 300):
        assert flat(bpe.Encoder(merges), text) == library.encode(text, add_special_tokens=False).ids


def test_lookahead_suffices(merges):
    """No continuation changes a token that ends that far back."""
    r = random.Random(9)
    for _ in range(60):
        text = bytes(r.choice(b"thinged") for _ in range(merges.lookahead + 60))
        ends = []
        for tail in (b"", b"th", b"inging", bytes(r.choice(b"thinged") for _ in range(40))):
            at, out = 0, []
            for i in merges.merge(text + tail):
                at += len(merges.bytes_of[i])
                out.append(at)
            ends.append([e for e in out if e <= len(text) - merges.lookahead])
        assert all(e == ends[0] for e in ends)


def test_decoding_is_incremental(library, merges):
    r = random.Random(10)
    for _ in range(150):
        ids = [r.randrange(50257) for _ in range(30)]
        machine, step = bpe.TextMachine(merges), r.randint(1, 4)
        text = "".join([machine.feed(ids[i : i + step]) for i in range(0, 30, step)]) + machine.close()
        assert text == library.decode(ids, skip_special_tokens=False)


def test_query_on_awkward_rows(spark, library, tmp_path):
    rows = awkward()
    got = as_rows(bpe.op1_bpe_round_trip(spark, saved(spark, tmp_path, rows)))
    want = []
    for doc, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        back = library.decode(ids, skip_special_tokens=False)
        want.append((doc, len(ids), digest, hashlib.sha256(back.encode()).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted([tuple(r.values()) for r in got], key=key) == sorted(want, key=key)


def test_round_trip_keeps_columns(spark):
    docs = clashing(table(spark))
    back = bpe.decode_documents(bpe.encode_documents(docs))
    assert all(r["decoded"] == (r["text"] or "") for r in as_rows(back))
    assert bpe.encode_documents(table(spark, [])).count() == 0

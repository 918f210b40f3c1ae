"""Packing: every id once, sequences full, offsets gapless."""

import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from relmine.llm import bpe, packing
from tests.llm.helpers import as_rows, awkward, clashing, saved, table, words


def test_balance_fills_and_balances():
    r = np.random.default_rng(3)
    lengths = np.sort(r.integers(1, 2048, 500))[::-1]
    out = packing.balance(lengths)
    held, cost = defaultdict(int), defaultdict(float)
    for _, _, take, at, offset in sorted(out, key=lambda x: (x[3], x[4])):
        assert offset == held[at]
        held[at] += take
        cost[at] += take + take * take / 2048
    assert sum(held.values()) == lengths.sum() and max(held.values()) <= 2048
    assert sum(2048 - n for n in held.values()) < 2048
    assert np.std(list(cost.values())) < 0.5 * np.mean(list(cost.values()))


def check(rows, texts):
    library = Tokenizer.from_file(bpe.tokenizer_path())
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for doc, text in texts:
        ids, at = [*library.encode(text or "", add_special_tokens=False).ids, 1], 0
        for r in sorted(by_doc[doc], key=lambda r: r["start"]):
            part = np.array(ids[at : at + r["length"]], dtype="<u4")
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(part.tobytes()))
            at += r["length"]
        assert at == len(ids)
    for held in by_sequence.values():
        at = 0
        for r in sorted(held, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    return by_sequence


def test_query_on_awkward_rows(spark, tmp_path):
    rows = [(i, t) for i, t in awkward() if i is not None]
    check(as_rows(packing.op3_pack_sequences(spark, saved(spark, tmp_path, rows))), rows)


def test_query_whole_table(spark, sf_dir):
    docs = as_rows(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    sequences = check(as_rows(packing.op3_pack_sequences(spark, sf_dir)), [(r["doc_id"], r["text"]) for r in docs])
    assert sum(2048 - sum(r["length"] for r in s) for s in sequences.values()) < 2048  # one cell


def test_ids_nulls_repeats_empty(spark):
    rows = [(1, "same"), (1, "same"), (None, "x"), (None, None), (3, "word " * 5000)]
    got = as_rows(packing.pack(clashing(table(spark, rows))))
    assert all(zlib.crc32(np.frombuffer(r["ids"], "<u2").astype("<u4").tobytes()) == r["ids_crc32"] for r in got)
    assert sum(r["doc_id"] == 1 for r in got) == 2 and sum(r["doc_id"] is None for r in got) == 2
    assert packing.pack(table(spark, [])).count() == 0


def test_hot_ids_spread_over_cells(spark, monkeypatch):
    """Most rows have no id or one id; some of them are equal."""
    monkeypatch.setattr(packing, "CELL_PIECES", 16)
    rows = [(None, words(3 + i % 9, i)) for i in range(300)] + [(7, words(5, i)) for i in range(300)]
    rows += [(None, None)] * 120 + [(i, "x y") for i in range(100, 180)]
    got = as_rows(packing.pack(table(spark, rows, parts=12)))
    assert sum(r["length"] for r in got) == sum(r["doc_tokens"] for r in got if r["start"] == 0)
    assert sum(r["doc_id"] is None and r["doc_tokens"] == 1 for r in got) == 120
    cells = defaultdict(int)
    for r in got:
        cells[r["sequence_id"] >> 32] += 1
    assert len(cells) > 30 and max(cells.values()) <= 64

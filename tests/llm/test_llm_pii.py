"""Personal data against plain regular expressions."""

import hashlib
import random
import re
import time

from relmine.llm import pii
from tests.llm.helpers import as_rows, clashing, saved, table


def luhn_plain(x):
    return sum((2 * int(c) - 9 * (int(c) > 4)) if i % 2 else int(c) for i, c in enumerate(reversed(x))) % 10 == 0


def base_plain(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, "ip", m.end()))
    for kind, order, pattern, low, high in (("card", 2, r"[0-9]([\x20-]?[0-9])+", 14, 19), ("phone", 3, r"\+[0-9][\x20().0-9-]+[0-9]", 10, 15)):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if low <= len(digits) <= high and (kind == "phone" or luhn_plain(digits)):
                out.append((m.start(), order, kind, m.end()))
    return [(k, s, e) for s, _, k, e in sorted(out)]


def base_mine(text):
    return [(k, s, e) for k, s, e, _ in pii.find_spans(text) if k in pii.BASE_KINDS]


def test_random_strings():
    r = random.Random(5)
    parts = ["a@b.co", "@", ".", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "+1 (555) 123-4567", " ", "-", "é", "0", "12", "+", "x@y", "..", "a.b@c-d.e.f", "5500-0000-0000-0004", "٣", "\n"]
    for _ in range(4000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        assert base_mine(text) == base_plain(text), repr(text)


def test_iban_and_context():
    spans = pii.find_spans("my bank: GB82 WEST 1234 5698 7654 32 and GB82 WEST 1234 5698 7654 33")
    assert [(k, round(s, 2)) for k, _, _, s in spans] == [("iban", 0.9)]
    far, near = pii.find_spans("x 10.0.0.1")[0], pii.find_spans("the server is 10.0.0.1")[0]
    assert near[3] > far[3]


def test_long_runs_are_linear():
    began = time.time()
    for text in ("a" * 300_000, "1" * 300_000, "a." * 150_000 + "@", "1." * 150_000, "+1" + " " * 300_000, "A1" * 150_000, "GB82" * 80_000):
        pii.find_spans(text)
    assert time.time() - began < 20


def test_query_and_mask(spark, tmp_path):
    text = "call +1 555 123 4567 now, ip 10.1.2.3, Émile e@x.org"
    rows = [(0, text), (1, None), (2, ""), (3, "clean"), (3, "clean"), (None, text)]
    got = as_rows(pii.op5_personal_data(spark, saved(spark, tmp_path, rows)))
    assert len(got) == 6
    want = ",".join(f"{k}:{s}:{e}" for k, s, e in base_plain(text))
    for r in got:
        own = want if r["doc_id"] in (0, None) else ""
        assert r["base_sha256"] == hashlib.sha256(own.encode()).hexdigest() == pii.base_digest(pii.find_spans(text if own else ""))
        assert r["spans"] == own and r["n_phone"] == r["n_ip"] == r["n_email"] == int(bool(own))
    masked = {r["doc_id"]: r["text"] for r in as_rows(pii.mask(clashing(table(spark, rows))))}
    assert masked[0] == "call <PHONE> now, ip <IP>, Émile <EMAIL>" and masked[1] is None and masked[3] == "clean"
    found = as_rows(pii.detect(clashing(table(spark, rows))))
    assert [s["kind"] for r in found if r["doc_id"] == 0 for s in r["pii"]] == ["phone", "ip", "email"]
    assert pii.digests(table(spark, [])).count() == 0


def test_whole_table(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in as_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"))}
    for r in as_rows(pii.op5_personal_data(spark, sf_dir)):
        want = ",".join(f"{k}:{s}:{e}" for k, s, e in base_plain(texts[r["doc_id"]]))
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()


def test_account_numbers_end_where_their_country_says():
    for follows in ("", " now", " NOW", " NOW AND", ".", " 12"):
        text = "to ES91 2100 0418 4502 0005 1332" + follows
        assert [s[:3] for s in pii.find_spans(text) if s[0] == "iban"] == [("iban", 3, 32)], follows
    assert not pii.find_spans("ES91 2100 0418 4502 0005 1333") and not pii.find_spans("ES91210004184502000513321")
    both = "DE89370400440532013000 GB82 WEST 1234 5698 7654 32"
    assert [both[s:e] for k, s, e, _ in pii.find_spans(both) if k == "iban"] == ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"]


def test_context_decides_what_is_masked(spark):
    texts = ["server 10.0.0.1 up", "since version 10.0.0.1 of it", "see 10.0.0.1 there", "server version 10.0.0.1"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def result(**options):
        return [r["text"] for r in sorted(as_rows(pii.mask(df, **options)), key=lambda r: r["doc_id"])]

    assert result() == ["server <IP> up", texts[1], "see <IP> there", "server version <IP>"]
    assert result(least_score=0.7) == ["server <IP> up", texts[1], texts[2], "server version <IP>"]
    assert result(least_score=0.2) == ["server <IP> up", "since version <IP> of it", "see <IP> there", "server version <IP>"]
    scores = {r["doc_id"]: r["scores"] for r in as_rows(pii.digests(df))}
    assert scores == {0: [0.8], 1: [0.3], 2: [0.6], 3: [0.8]}

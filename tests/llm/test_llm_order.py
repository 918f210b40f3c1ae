"""Fingerprints and shards."""

import hashlib
import random
import zlib
from collections import defaultdict

from relmine.llm import omh, sharding
from tests.llm.helpers import as_rows, awkward, clashing, saved, table, words


def test_fingerprints(spark, tmp_path):
    rows = [(i, t) for i, t in awkward() if i is not None] + [(1000 + i, words(40 + i, i)) for i in range(30)]
    got = {r["doc_id"]: r for r in as_rows(omh.op2_order_minhash(spark, saved(spark, tmp_path, rows)))}
    rows.sort()
    by_text = defaultdict(set)
    for n, (doc, text) in enumerate(rows):
        text, following = text or "", rows[(n + 1) % len(rows)][1] or ""
        quarter = len(text) // 4
        changed = text[: len(text) - quarter] + following[:quarter]
        r = got[doc]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        by_text[text].add(r["fingerprint"])
        if changed == text:
            assert r["near_edited"] == 1 and r["fingerprint"] == r["edited_fingerprint"]
    assert all(len(f) == 1 for f in by_text.values())
    assert got[16]["near_edited"] > 0.2  # one word five hundred times
    assert all(got[i]["near_edited"] > 0.1 > got[i]["near_next"] for i in range(1000, 1029))


def test_order_matters(spark):
    a, b = words(60, 1), words(60, 2)
    df = spark.createDataFrame([(f"{a} {b}", f"{b} {a}")], "x string, y string")
    df = omh.fingerprinted(omh.fingerprinted(df, "x", "fx"), "y", "fy")
    moved = df.select(omh.likeness("fx", "fy")).first()[0]
    assert 0.2 < moved < 0.95


def test_next_rows_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(omh, "RANGE_ROWS", 7)
    ids = [i * i - 500 for i in range(300)]
    df = spark.createDataFrame([(i, str(i)) for i in ids], "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["next_text"] for r in omh.with_next(df, ["text"]).collect()}
    assert got == {i: str(ids[(n + 1) % 300]) for n, i in enumerate(ids)}


def test_next_rows_of_hot_ids(spark, monkeypatch):
    """A third of all rows has one id, a sixth has none."""
    monkeypatch.setattr(omh, "RANGE_ROWS", 10)
    rows = [(7, f"hot {i}") for i in range(200)] + [(None, f"none {i}") for i in range(100)] + [(i, str(i)) for i in range(100, 400)]
    df = table(spark, rows).select("doc_id", "text")
    got = [(r["doc_id"], r["text"], r["next_doc_id"], r["next_text"]) for r in omh.with_next(df, ["doc_id", "text"]).collect()]
    assert sorted((i or -1, t) for i, t, *_ in got) == sorted((i or -1, t) for i, t in rows)
    after = {t: (j, u) for _, t, j, u in got}
    seen, at = [], (399, "399")
    for _ in rows:
        at = after[at[1]]
        seen.append(at)
    assert len(set(seen)) == len(rows) and [i or -1 for i, _ in seen] == sorted(i or -1 for i, _ in rows)
    held = omh.dealt(df).groupBy("_range").count().collect()
    assert max(r["count"] for r in held) <= 40


def test_fingerprints_of_odd_tables(spark, tmp_path):
    def run(rows, name):
        return as_rows(omh.op2_order_minhash(spark, saved(spark, tmp_path / name, rows)))

    assert run([], "none") == []
    alone = run([(5, "abcd efgh")], "one")
    assert alone[0]["near_next"] == 1 and alone[0]["edited_sha256"] == hashlib.sha256(b"abcd efab").hexdigest()
    assert len(run([(1, "x y z"), (1, "x y z"), (None, "q"), (None, None)], "repeats")) == 4


def check_shards(rows, got, shards=16):
    texts = defaultdict(list)
    for i, t in rows:
        texts[i].append((t or "").encode())
    by_shard = defaultdict(list)
    assert len(got) == len(rows)
    for r in got:
        by_shard[r["shard"]].append(r)
        assert (r["size"] - 1, r.get("text_crc32")) in [(len(t), zlib.crc32(t)) for t in texts[r["doc_id"]]]
    for held in by_shard.values():
        assert sorted(r["slot"] for r in held) == list(range(len(held)))
    total, largest = sum(r["size"] for r in got), max(r["size"] for r in got)
    for s in range(shards):
        assert abs(sum(r["size"] for r in by_shard[s]) - total / shards) <= largest + 0.01 * total / shards


def test_shards(spark, tmp_path):
    hot = [(5000 + i, "the same text") for i in range(900)]
    rows = [(i, words(5 + i % 40, i)) for i in range(1500)] + hot + [(i, t) for i, t in awkward() if i is None or i < 9]
    rows = [(i, t) for i, t in rows]
    check_shards(rows, as_rows(sharding.op9_histogram_shards(spark, saved(spark, tmp_path, rows))))


def test_ranges_split_one_text_by_id(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RANGE_ROWS", 20)
    rows = [(i * 3, "same") for i in range(700)]
    docs = table(spark, rows)
    got = as_rows(sharding.shard(docs, 4))
    assert [sum(r["shard"] == s for r in got) for s in range(4)] == [175] * 4
    entries = docs.select(*sharding.measures())
    rounds, ranges = sharding.splitters(entries, 4)
    assert max(n for _, _, n in ranges) <= 20
    order = sorted(got, key=lambda r: r["doc_id"])
    assert [(r["shard"], r["slot"]) for r in order] == sorted((r["shard"], r["slot"]) for r in got)


def test_shards_of_odd_tables(spark):
    assert sharding.shard(table(spark, [])).count() == 0
    rows = [(None, "a"), (None, "a"), (1, None), (1, None)]
    got = as_rows(sharding.shard(clashing(table(spark, rows)), 2))
    assert len(got) == 4 and {"key", "id", "cell"} <= set(got[0])


def test_whole_table(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in as_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"))]
    check_shards(rows, as_rows(sharding.op9_histogram_shards(spark, sf_dir)))


def test_every_character_counts(spark):
    """Characters 9 to 12 of a unit and the white space behind it differ; one
    character stands in front of a text without spaces."""
    r = random.Random(8)
    head = [words(1, i)[:8].ljust(8, "x") for i in range(60)]
    tails = ["\n".join(h + "abcd" for h in head), " ".join(h + "wxyz" for h in head)]
    run = "".join(r.choice("的一是不了人我在有他这中大来上国") for _ in range(3000))
    rows = [(0, *tails), (1, run, "x" + run)]
    df = omh.fingerprinted(omh.fingerprinted(spark.createDataFrame(rows, "i long, x string, y string"), "x", "fx"), "y", "fy")
    tail, shifted = [row[0] for row in df.orderBy("i").select(omh.likeness("fx", "fy")).collect()]
    assert tail < 0.9 and shifted > 0.9


def test_low_ranks_are_enough(spark, monkeypatch):
    rows = [(i, words(n, i) + " again and again" * (i % 3)) for i, n in enumerate((2, 90, 400, 1500))]
    df = spark.createDataFrame(rows, "i long, x string")
    some = {r["i"]: r["f"] for r in omh.fingerprinted(df, "x", "f").collect()}
    monkeypatch.setattr(omh, "ENOUGH", 1 << 40)
    assert some == {r["i"]: r["f"] for r in omh.fingerprinted(df, "x", "f").collect()}


def fingerprint_by_force(text):
    """A fingerprint in plain Python: every k-mer ranked, bin by bin."""
    import xxhash

    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    def hashed(*parts, seed=42):
        for p in parts:
            data = p if isinstance(p, bytes) else p[0].to_bytes(p[1], "little", signed=True)
            seed = xxhash.xxh64_intdigest(data, seed=seed)
        return signed(seed)

    seen, ranked = {}, []
    for i in range(len(text)):
        high = hashed(text[i : i + 8].encode()) >> 32
        n = seen[high] = seen.get(high, 0) + 1
        if n > 1:  # further occurrences are hashed anew with their number
            ranked.append((hashed((high, 8), (n - 1, 4)) >> 32, i))
        else:
            ranked.append((high, i))
    bins = {}
    for high, i in sorted(ranked):
        bins.setdefault((high >> 26) & 63, []).append((high, i))
    out = []
    for b, held in bins.items():  # in the order of signed numbers
        pair = sorted(held[:2], key=lambda x: x[1])
        out.append("%08x" % (b << 26 | hashed(*[(h, 8) for h, _ in pair]) & ((1 << 26) - 1)))
    return "".join(out)


def test_fingerprints_by_force(spark):
    r = random.Random(12)
    texts = ["", "a", "abc" * 4, "of " * 500, "é中😀 ñ" * 30, words(30, 1), words(900, 2), "x" * 5000, "".join(r.choice("ab\n") for _ in range(2000))]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, x string")
    got = {row["i"]: row["f"] for row in omh.fingerprinted(df, "x", "t").select("i", omh.as_text("t").alias("f")).collect()}
    for i, text in enumerate(texts):
        assert got[i] == fingerprint_by_force(text), i


def test_whole_table_by_force(spark, sf_dir):
    rows = sorted((r["doc_id"], r["text"] or "") for r in as_rows(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    got = {r["doc_id"]: r for r in as_rows(omh.op2_order_minhash(spark, sf_dir))}
    for n, (i, text) in enumerate(rows):
        following = rows[(n + 1) % len(rows)][1]
        quarter = len(text) // 4
        own, changed = fingerprint_by_force(text), fingerprint_by_force(text[: len(text) - quarter] + following[:quarter])
        assert (got[i]["fingerprint"], got[i]["edited_fingerprint"]) == (own, changed)
        a, b = ({f[k : k + 8] for k in range(0, len(f), 8)} for f in (own, changed))
        filled = {int(x, 16) >> 26 for x in a | b}
        assert got[i]["near_edited"] == (len(a & b) / len(filled) if filled else 1.0)


def test_text_and_edited_text_share_their_kmers(spark):
    """Repeats inside what is kept, across its end, and only in what is new,
    held against the fingerprints of both texts by themselves; the k-mers of
    what is kept are read and sorted once."""
    r = random.Random(5)
    new = ["zebra " * 200, words(300, 9), "", "ab", "x" * 3000]
    texts = ["", "abc", "abcdefghij", "of " * 400, words(200, 3) + " again and again" * 60, words(900, 2), "x" * 4000]
    texts += ["".join(r.choice("ab ") for _ in range(n)) for n in (31, 800, 2500)]
    rows = [(i, t, n) for i, (t, n) in enumerate((t, n) for t in texts for n in [*new, t])]
    df = spark.createDataFrame(rows, "i long, x string, n string")
    df = df.withColumn("y", omh.edited(df["x"], df["n"]))
    both = omh.with_kmers_of_both(df, "x", "y", "k")
    both = both.withColumn("t", omh.tuples(both["k"], (omh.FRESH, omh.OLD)))
    both = both.select("i", "y", "k", both["t"][0].alias("own"), both["t"][1].alias("changed"))
    both = both.select("i", "y", "k", omh.as_text("own").alias("a"), omh.as_text("changed").alias("b"))
    for row, (i, text, _) in zip(both.orderBy("i").collect(), rows):
        assert (row["a"], row["b"]) == (fingerprint_by_force(text), fingerprint_by_force(row["y"])), i
        kept = max(len(text) - len(text) // 4 - 7, 0)
        assert len(row["k"]) == len(text) + len(row["y"]) - kept and row["k"] == sorted(row["k"])

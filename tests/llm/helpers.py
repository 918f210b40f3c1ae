"""Small tables with the awkward cases, and plain restatements in Python."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SPACE = r"[\x20\x09-\x0D]+"


def words(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


def awkward() -> list[tuple[int | None, str | None]]:
    """Nulls, empty, white space, long, ties, repeats, other scripts."""
    base = words(120, 1)
    edited = base.replace(base.split()[60], "zzz", 1)
    return [
        (0, base),
        (1, None),
        (2, ""),
        (3, " \t\n "),
        (4, "one"),
        (5, "one two three four"),
        (6, base.upper()),
        (7, "  ".join(base.split())),
        (8, edited),
        (9, words(3000, 2)),
        (10, "é中😀 ñ<|endoftext|>\x1c\x85 it's 123 \r\n\r\n  x"),
        (11, "a" * 70_000),
        (12, base),
        (13, words(40, 3) + "\n" + words(60, 4)),
        (14, "other\n" + words(60, 4) + "\nlast"),
        (15, "one"),
        (16, "of " * 500),
        (None, words(30, 5)),
        (None, None),
    ]


def table(spark, rows=None, parts: int = 3):
    rows = awkward() if rows is None else rows
    full = [(i, t, "en", "src0" if (i or 0) % 3 else "src1", None if t is None else len(t)) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


def clashing(df):
    """Columns with the names that operators use themselves."""
    names = ("key", "id", "ids", "norm", "size", "shard", "slot", "cell", "start", "score", "bucket", "_id", "_key", "n", "component_id", "pii")
    return df.select("*", *[F.lit("x").alias(c) for c in names])


def as_rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def saved(spark, tmp_path, rows, name="documents"):
    """A folder like the driver's, with one table."""
    table(spark, rows).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def normalised(text: str | None) -> str:
    return re.sub(SPACE, " ", text or "")


def shingles(text: str | None) -> frozenset:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def clusters(sets: dict, threshold: int = 75) -> dict:
    """Smallest id reachable by pairs of similar sets, by trying all pairs."""
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= threshold * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


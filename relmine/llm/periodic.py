"""Operator 11: runs of words that repeat with a period.

The maximal periodic stretches of a word sequence are found from Lyndon
arrays. The first phase of Baier's suffix sorter groups suffixes by their
longest Lyndon prefix: groups begin as the suffixes of one first word, the
highest group is taken next, and each suffix next to the left of the group's
members that lies in a lower group moves on to a new group right above its
own, whose prefix is longer by the group's prefix as often as members lead to
it. The length of a group's prefix when it is taken is the Lyndon array. It is
computed under the order of the words and under its reverse; every run with
period p holds, under one of the two, a place at which the longest Lyndon word
has length p (a Lyndon root). Roots are extended to both sides by the longest
common extension (LCE) of the sequence with itself p words on.

A run here is at least ``exponent`` times as long as its period. All of its
words occur that often in it, so a word that occurs less often among its
neighbours lies in no run and cuts the sequence; counting again inside the
parts until nothing changes leaves the parts that can hold one. Words are
numbered as they come, which is the order used.

Documents are worked on one slice of texts at a time, with no shuffle; the
parts of all documents of a slice are cut together. Defined cases: null,
empty and blank texts have no words and no runs; a null id is not rewritten
by ``repeating``; rows that repeat get equal results; an empty table gives an
empty result; columns of clashing names are replaced.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relmine.llm.common import documents, text_of

EXPONENT, LEAST = 4, 6  # length of a run: in periods, in words
SLICE_WORDS = 1 << 18  # words of the documents that are worked on together
STEP = 64  # words that an extension compares at first

Run = tuple[int, int, int]  # start, length, period


def lyndon_array(ranks: list[int]) -> list[int]:
    """Length of the longest Lyndon word that begins at each place, by the
    first phase of Baier's suffix sorter."""
    n = len(ranks)
    # places that are not in a taken group, as a list linked both ways; the
    # last entries stand for the ends
    left, right = list(range(-1, n)), list(range(1, n + 2))
    members: list[list[int]] = []
    size: list[int] = []  # members that are still in the group
    length: list[int] = []
    below: list[int] = []
    above: list[int] = []
    at = [0] * n
    number: dict[int, int] = {}
    for r in sorted(set(ranks)):
        number[r] = g = len(members)
        members.append([])
        length.append(1)
        below.append(g - 1)
        above.append(g + 1)
    for i, r in enumerate(ranks):
        at[i] = g = number[r]
        members[g].append(i)
    size = list(map(len, members))
    out = [0] * n
    g = len(members) - 1
    if g >= 0:
        above[g] = -1
    while g >= 0:
        grown = length[g]
        own = [i for i in members[g] if at[i] == g] if size[g] != len(members[g]) else members[g]
        if len(own) == 1:
            i = own[0]
            out[i] = grown
            j, k = left[i], right[i]
            right[j], left[k] = k, j
            moved = {1: [j]} if j >= 0 else {}
        else:
            own = sorted(own)
            times: dict[int, int] = {}
            lead: dict[int, int] = {}
            for i in own:
                out[i] = grown
                j = left[i]
                j = lead.get(j, j)
                lead[i] = j
                if j >= 0:
                    times[j] = times.get(j, 0) + 1
            for i in own:
                j, k = left[i], right[i]
                right[j], left[k] = k, j
            moved = {}
            for j, t in times.items():
                moved.setdefault(t, []).append(j)
        for t in sorted(moved, reverse=True):
            longer = t * grown
            groups: dict[int, list[int]] = {}
            for j in moved[t]:
                groups.setdefault(at[j], []).append(j)
            for old, some in groups.items():
                if size[old] == len(some):  # the whole group grows where it is
                    length[old] += longer
                    continue
                new = len(members)
                members.append(some)
                size.append(len(some))
                size[old] -= len(some)
                length.append(length[old] + longer)
                up = above[old]
                below.append(old)
                above.append(up)
                above[old] = new
                below[up] = new  # the group just taken, if no other
                for j in some:
                    at[j] = new
        g = below[g]
    return out


def _extension(w: np.ndarray, i: int, j: int) -> int:
    """Words from ``i`` and from ``j`` > ``i`` on that agree."""
    size, step, most = 0, STEP, len(w) - j
    while size < most:
        differ = w[i + size : i + size + min(step, most - size)] != w[j + size : j + size + step]
        if differ.any():
            return size + int(differ.argmax())
        size += len(differ)
        step *= 2
    return size


def runs_of(w: np.ndarray, exponent: int = EXPONENT, least: int = LEAST) -> list[Run]:
    """The runs of a sequence of numbers, by start and period; ``exponent``
    is 2 at least."""
    n = len(w)
    found: set[Run] = set()
    if n < least:
        return []
    back = w[::-1]
    for ranks in (w, -w):
        lyndon = np.array(lyndon_array(ranks.tolist()))
        starts = np.arange(n)
        fits = starts + 2 * lyndon <= n if exponent > 2 else starts + lyndon <= n
        if exponent > 2:
            # two roots of a run follow each other
            fits &= lyndon[np.minimum(starts + lyndon, n - 1)] == lyndon
        reached: dict[int, int] = {}  # last place of a root by period, whose stretch is known
        for i in np.flatnonzero(fits).tolist():
            p = int(lyndon[i])
            if i <= reached.get(p, -1):
                continue
            ahead = _extension(w, i, i + p)
            behind = _extension(back, n - i - p, n - i)
            reached[p] = i + ahead
            length = p + ahead + behind
            if length >= max(least, exponent * p):
                found.add((i - behind, length, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def parts_with_runs(words: np.ndarray, owner: np.ndarray, exponent: int = EXPONENT, least: int = LEAST) -> list[np.ndarray]:
    """Places of the parts of sequences that can hold a run: stretches in
    which each word occurs ``exponent`` times. ``words`` are the numbered
    words of all sequences, ``owner`` the rising number of each one's."""
    at = np.arange(len(words))
    part = owner
    while len(at):
        key = part * (int(words.max()) + 1) + words[at]
        _, which, counts = np.unique(key, return_inverse=True, return_counts=True)
        stays = counts[which] >= exponent
        at, part = at[stays], part[stays]
        new = np.cumsum(np.concatenate([[False], (np.diff(at) != 1) | (np.diff(part) != 0)])) if len(at) else at
        enough = (np.bincount(new) >= least)[new] if len(at) else np.zeros(0, bool)
        at, new = at[enough], new[enough]
        done = bool(stays.all() and enough.all())
        part = new
        if done:
            break
    return np.split(at, np.flatnonzero(np.diff(part)) + 1) if len(at) else []


def kept_words(n: int, runs: Iterable[Run]) -> np.ndarray:
    """Which of ``n`` words lie in no run behind its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


def split_words(text: str) -> list[bytes]:
    """Words between white space of ASCII, in UTF-8."""
    return text.encode().split()


def repeating(words: list, doc_id: int | None) -> list:
    """The words of every tenth document (by a hash of its id) with a part
    of them repeated to the end; those of others as they are."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def runs_of_documents(texts: Iterable[list[bytes]], exponent: int = EXPONENT, least: int = LEAST) -> Iterator[tuple[list[bytes], list[Run]]]:
    """The runs of each word list, slice by slice."""
    held: list[list[bytes]] = []
    size = 0

    def slice_() -> Iterator[tuple[list[bytes], list[Run]]]:
        number: dict[bytes, int] = {}
        words = np.fromiter((number.setdefault(w, len(number)) for t in held for w in t), np.int64, size)
        sizes = np.fromiter(map(len, held), np.int64, len(held))
        firsts = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(held)), sizes)
        found: dict[int, list[Run]] = {}
        for part in parts_with_runs(words, owner, exponent, least):
            doc = int(owner[part[0]])
            start = int(part[0] - firsts[doc])
            found.setdefault(doc, []).extend((start + s, length, p) for s, length, p in runs_of(words[part], exponent, least))
        for i, t in enumerate(held):
            yield t, found.get(i, [])

    for t in texts:
        held.append(t)
        size += len(t)
        if size >= SLICE_WORDS:
            yield from slice_()
            held, size = [], 0
    yield from slice_()


def with_runs(docs: DataFrame, exponent: int = EXPONENT, least: int = LEAST, text: str = "text") -> DataFrame:
    """``docs`` with ``runs`` (array of start, length, period in words) and
    ``collapsed``, the text of which each run keeps its first period, words
    joined by one space."""
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("runs", "collapsed")])
    shape = "cast(array() as array<struct<start:bigint,length:bigint,period:bigint>>)"
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        for batch in batches:
            texts = (split_words(t.as_py() or "") for t in batch.column(batch.schema.get_field_index(text)))
            runs, collapsed = [], []
            for words, found in runs_of_documents(texts, exponent, least):
                runs.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                collapsed.append(_collapsed(words, found).decode())
            columns = [*batch.columns, pa.array(runs, kind), pa.array(collapsed, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "runs", "collapsed"])

    return kept.mapInArrow(run, kept.withColumn("runs", F.expr(shape)).withColumn("collapsed", F.lit("")).schema)


def _collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    if not runs:
        return b" ".join(words)
    return b" ".join([words[i] for i in np.flatnonzero(kept_words(len(words), runs)).tolist()])


def most_repeated(runs: list[Run]) -> Run | tuple[None, None, None]:
    """The run of greatest length over period, of equal ones the first."""
    best = None
    for run in runs:
        s, n, p = run
        if best is None or n * best[2] > best[1] * p or (n * best[2] == best[1] * p and (s, p) < (best[0], best[2])):
            best = run
    return best or (None, None, None)


def run_digests(docs: DataFrame, repeat: bool = True) -> DataFrame:
    """Per document its number of runs, the most repeated one, and SHA-256 of
    all runs (``start,length,period`` and a line feed each) and of the
    collapsed text. ``repeat`` rewrites words by ``repeating`` first."""
    schema = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    names = [part.split(" ")[0] for part in schema.split(", ")]

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            words = (split_words(t.as_py()) for t in batch.column("text"))
            if repeat:
                words = (repeating(w, i) for w, i in zip(words, ids, strict=True))
            rows = []
            for t, runs in runs_of_documents(words):
                start, length, period = most_repeated(runs)
                milli = None if period is None else 1000 * length // period
                said = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
                rows.append((len(runs), start, length, period, milli, hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(_collapsed(t, runs)).hexdigest()))
            columns = zip(*rows, strict=True) if rows else [()] * 7
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, schema)


def op11_lyndon_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(documents(spark, sf_dir))

"""Operator 2: document fingerprints by order MinHash.

A k-mer of 8 code points is read at every code point of a text, so every
character lies in k-mers and what is put in front of a text shifts none of
them. A k-mer's hash deals it to one of 64 bins and ranks it there; equal k-mers are numbered by
occurrence. In each bin the two minimal occurrence-numbered k-mers are taken,
kept in text order, and hashed as a tuple: moving a passage changes the order
within tuples, replacing one changes the tuples it wins or loses. A
fingerprint lists the tuples of the bins that have any.

The likeness of two fingerprints is the share of bins, among those filled in
either, whose tuples agree; two empty texts have likeness 1.

The hash stands in the high 32 bits and the position in the low 32 bits of
one number, so a single sort of numbers brings each bin together, ranks it,
and has the occurrences of a k-mer in text order. DataFrame operations only.

``dealt`` and ``following`` pair each document with the one of the next id:
rows are dealt by ranges of ids, and the first row of each range is also sent
to the range before it. Texts cross the network once; k-mers are read behind
that exchange, those inside what the edited text keeps once for both texts.
Defined cases: null counts as empty; a null id sorts first; rows of equal id
follow each other by a hash of their text, by which an id of many rows is
dealt to many ranges; a single row is its own next; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relmine.functions.text import let
from relmine.llm.common import documents, text_of

BIN_BITS = 6  # 64 bins
HASH_BITS = 26  # of a tuple's hash
KMER = 8
KMERS = rf"(?s)(?=(.{{1,{KMER}}}))."  # at every code point; the last ones are shorter
WHOLE_KMERS = rf"(?s)(?=(.{{{KMER}}}))."  # without those
ENOUGH = 12 << BIN_BITS  # k-mers of lowest rank that are looked at first
RANGE_ROWS, MOST_RANGES = 1000, 16384
FIRST_ID = -(1 << 63)


HIGH, LOW = -1 << 32, (1 << 32) - 1
OLD, FRESH = 1 << 30, 1 << 31  # marks in the low half: of what is replaced, of what replaces it


def placed_kmers(text: Column, offset: Column | None = None, pattern: str = KMERS) -> Column:
    """Numbers in text order: high half the k-mer's hash, low half its
    position, counted from ``offset``."""
    kmers = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    at = lambda i: i if offset is None else i + offset
    return F.transform(kmers, lambda x, i: F.xxhash64(x).bitwiseAND(F.lit(HIGH)) + at(i))


def _hash(v: Column) -> Column:
    return F.shiftright(v, 32)


def _bin(v: Column) -> Column:
    return F.shiftrightunsigned(v, 64 - BIN_BITS)


def _new(s: Column, v: Column, i: Column) -> Column:
    """Whether ``v``, at ``i`` of the sorted ``s``, is the first of its hash."""
    return F.coalesce(F.get(s, i - 1) < v.bitwiseAND(F.lit(HIGH)), F.lit(True))


def _steps(a: Column, z: Column) -> Column:
    return F.sequence(a, z, F.lit(1))


def _repeated(s: Column) -> Column:
    """Of the sorted ``s`` the numbers whose hash another one has, sorted."""

    def of(at: Column) -> Column:
        first = F.filter(at, lambda i, j: F.coalesce(F.get(at, j - 1) != i - 1, F.lit(True)))
        return F.sort_array(F.concat(F.transform(first, lambda i: F.get(s, i - 1)), F.transform(at, lambda i: F.get(s, i))))

    # counted from 1, the number before the one at i (from 0) stands at i
    places = F.when(F.size(s) > 1, _steps(F.lit(1), F.size(s) - 1)).otherwise(F.array().cast("array<int>"))
    return let(F.filter(places, lambda i: F.element_at(s, i) >= F.get(s, i).bitwiseAND(F.lit(HIGH))), of)


def _numbered(repeated: Column) -> Column:
    """Of the sorted ``repeated`` all but the first of each hash, hashed anew
    with their number."""

    def occurrence(v: Column, n: Column) -> Column:
        return F.xxhash64(_hash(v), n).bitwiseAND(F.lit(HIGH)).bitwiseOR(v.bitwiseAND(F.lit(LOW)))

    def runs(s: Column) -> Column:
        starts = F.filter(_steps(F.lit(0), F.size(s) - 1), lambda j: _new(s, F.get(s, j), j))
        last = lambda r, t: F.coalesce(F.get(t, r + 1), F.size(s)) - 1
        run = lambda a, z: F.transform(_steps(a, z), lambda j: occurrence(F.get(s, j), j - a + 2))
        return let(starts, lambda t: F.flatten(F.transform(t, lambda a, r: run(a, last(r, t)))))

    # most k-mers that occur again do so once
    again = F.filter(repeated, lambda v, i: ~_new(repeated, v, i))

    def numbered(m: Column) -> Column:
        second = F.transform(F.filter(m, lambda v, i: _new(m, v, i)), lambda v: occurrence(v, F.lit(1)))
        third = F.filter(m, lambda v, i: ~_new(m, v, i))
        return let(third, lambda s: F.when(F.size(s) > 0, F.concat(second, runs(s))).otherwise(second))

    return let(again, numbered)


def _least_two(sorted_: Column, numbered: Column) -> Column:
    """Of the sorted k-mers and the occurrence-numbered further ones the two
    least of each bin, sorted."""
    high = F.lit(-1 << (64 - BIN_BITS))
    ranked = F.sort_array(F.concat(F.filter(sorted_, lambda v, i: _new(sorted_, v, i)), numbered))
    return let(ranked, lambda r: F.filter(r, lambda v, i: F.coalesce(F.get(r, i - 2) < v.bitwiseAND(high), F.lit(True))))


def _hashed(least: Column) -> Column:
    """One number per filled bin: the bin and the hash of its two minimal
    k-mers in text order."""
    low, bits = F.lit(LOW), F.lit((1 << HASH_BITS) - 1)

    def of(v: Column, hashed: Column) -> Column:
        return F.shiftleft(_bin(v), HASH_BITS).bitwiseOR(hashed.bitwiseAND(bits))

    def pair(v: Column, w: Column) -> Column:
        in_order = v.bitwiseAND(low) < w.bitwiseAND(low)
        return F.when(in_order, F.xxhash64(_hash(v), _hash(w))).otherwise(F.xxhash64(_hash(w), _hash(v)))

    def any_bin(v: Column, i: Column) -> Column:
        w = F.get(least, i + 1)
        own = F.when(_bin(v) == _bin(w), pair(v, w)).otherwise(F.xxhash64(_hash(v)))
        return F.when(F.coalesce(_bin(v) != _bin(F.get(least, i - 1)), F.lit(True)), of(v, own))

    def full_bin(i: Column) -> Column:
        return of(F.get(least, i), pair(F.get(least, i), F.get(least, i + 1)))

    some = F.filter(F.transform(least, any_bin), lambda v: v.isNotNull())
    places = F.array(*[F.lit(i) for i in range(0, 2 << BIN_BITS, 2)])
    return F.when(F.size(least) == 2 << BIN_BITS, F.transform(places, full_bin)).otherwise(some)


def tuples(placed: Column, foreign: tuple[int | None, ...] = (None,)) -> Column:
    """The tuples of the sorted k-mers ``placed``, as an array of one array
    per text. Of several texts, those that have bit ``foreign`` of a text set
    are not its own.

    Repeated k-mers and those of low rank are found once for all texts. Of
    many the ones of low rank are looked at; where they leave a bin without
    two, all are. Every step is bound inside one expression, so no step's
    numbers are stored."""
    n, whole = F.size(placed), 1 << (64 - BIN_BITS)
    first_looks = ENOUGH if len(foreign) == 1 else ENOUGH * 6 // 5  # some are of one text alone
    most = F.when(n > first_looks, F.floor(F.lit(float(whole * first_looks)) / n)).otherwise(F.lit(whole))
    low = F.lit(whole - 1)

    def own(s: Column, mark: int | None) -> Column:
        return s if mark is None else F.filter(s, lambda v: v.bitwiseAND(F.lit(mark)) == 0)

    def of(s: Column, few: Column, again: Column, most: Column, mark: int | None) -> Column:
        below = lambda m: F.filter(m, lambda v: v.bitwiseAND(low) < most)
        some = lambda m: let(own(few, mark), lambda k: _least_two(k, below(m)))
        every = lambda m: let(own(s, mark), lambda k: _least_two(k, m))
        enough = lambda r: (most == whole) | (F.size(r) == 2 << BIN_BITS)
        chosen = lambda m: let(some(m), lambda r: F.when(enough(r), r).otherwise(every(m)))
        return let(let(let(own(again, mark), _numbered), chosen), _hashed)

    def each(s: Column, most: Column) -> Column:
        few = F.filter(s, lambda v: v.bitwiseAND(low) < most)
        return let(few, lambda f: let(_repeated(s), lambda g: F.array(*[of(s, f, g, most, m) for m in foreign])))

    # read again and again, an array is quicker as a lambda's result than as a stored column
    return let(F.transform(placed, lambda v: v), lambda s: let(most, lambda t: each(s, t)))


def fingerprinted(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with the array ``out`` of tuples of column ``text``."""
    return df.withColumn(out, F.get(tuples(F.sort_array(placed_kmers(F.col(text)))), F.lit(0)))


def as_text(tuples: str) -> Column:
    return F.array_join(F.transform(tuples, lambda v: F.lpad(F.lower(F.hex(v)), 8, "0")), "")


def likeness(a: str, b: str) -> Column:
    bins = F.size(F.array_union(F.transform(a, lambda v: F.shiftright(v, HASH_BITS)), F.transform(b, lambda v: F.shiftright(v, HASH_BITS))))
    return F.when(bins == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / bins)


def _count(cuts: list[int], order: Column, inclusive: bool) -> Column:
    """How many cuts are below ``order`` (or equal it, if ``inclusive``):
    counted among every 128th, then among the 128 that follow."""
    if not cuts:
        return F.lit(0)
    coarse, groups = cuts[::128], [cuts[i : i + 128] for i in range(0, len(cuts), 128)]

    def count(held: Column) -> Column:
        return F.size(F.filter(held, lambda c: c <= order if inclusive else c < order))

    at = count(F.array(*map(F.lit, coarse)))
    fine = F.array(*[F.array(*map(F.lit, g)) for g in groups])
    return F.when(at == 0, F.lit(0)).otherwise((at - 1) * 128 + count(F.element_at(fine, F.greatest(at, F.lit(1)))))


def dealt(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` (``doc_id``, ``text``, ...) with ``_range``, ``_order``
    and ``_hash``, by the last two of which they follow each other. The first
    row of each range is also ``_sent`` to the range before it, that of the
    first to the last. Rows of an id that several cuts fall on are dealt to
    as many ranges by the hash of their text."""
    rows = docs.withColumn("_order", F.coalesce(F.col("doc_id"), F.lit(FIRST_ID))).withColumn("_hash", F.xxhash64("text"))
    n = docs.count()
    ranges = max(1, min(MOST_RANGES, -(-n // RANGE_ROWS)))
    marks = [i / ranges for i in range(1, ranges)]
    cuts = sorted(rows.agg(F.percentile_approx("_order", marks, 10 * ranges)).first()[0]) if marks else []
    below, upto = _count(cuts, F.col("_order"), False), _count(cuts, F.col("_order"), True)
    part = (F.shiftright("_hash", 33) + (1 << 30)) / (1 << 31)  # of all hashes those below, 0 to 1
    own = rows.withColumn("_range", F.when(below == upto, upto).otherwise(below + 1 + F.floor(part * (upto - below))).cast("int"))
    firsts = own.groupBy("_range").agg(F.min(F.struct("_order", "_hash")).alias("f"))
    # at most MOST_RANGES rows
    before = F.coalesce(F.lag("_range").over(Window.orderBy("_range")), F.max("_range").over(Window.partitionBy()))
    sends = firsts.select("f.*", before.alias("_range"))
    sent = rows.join(F.broadcast(sends), ["_order", "_hash"])
    sent = sent.groupBy("_range", "_order", "_hash").agg(*[F.first(c).alias(c) for c in docs.columns])
    return own.withColumn("_sent", F.lit(False)).unionByName(sent.withColumn("_sent", F.lit(True)))


def following(dealt: DataFrame, carried: list[str]) -> DataFrame:
    """``dealt`` rows with ``next_<c>`` of the columns ``carried``."""
    w = Window.partitionBy("_range").orderBy("_sent", "_order", "_hash")
    return dealt.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in carried])


def with_next(docs: DataFrame, carried: list[str]) -> DataFrame:
    """Rows of ``docs`` (``doc_id``, ``text``, ...) with ``next_<c>`` of the
    columns ``carried``, from the row of the next id; the last row is
    followed by the first."""
    return following(dealt(docs), carried).filter("not _sent").drop("_range", "_order", "_hash", "_sent")


def edited(text: Column, following: Column) -> Column:
    """The last quarter of the code points replaced by the first as many (or
    all) of the following text."""
    quarter = F.floor(F.length(text) / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - quarter), F.substring(following, F.lit(1), quarter))


def with_kmers_of_both(df: DataFrame, text: str, edited: str, out: str) -> DataFrame:
    """``df`` with the array ``out`` of the k-mers of a text and its edited
    text, sorted: those inside what it keeps once, the others with the bit
    ``OLD`` or ``FRESH`` set."""
    n = F.length(text)
    kept = F.greatest(n - F.floor(n / 4).cast("int") - (KMER - 1), F.lit(0))
    df = df.withColumn("_kept", kept).withColumn("_old", F.col("_kept") + F.lit(OLD).cast("long")).withColumn("_fresh", F.col("_kept") + F.lit(FRESH))
    head = placed_kmers(F.substring(text, F.lit(1), F.col("_kept") + (KMER - 1)), pattern=WHOLE_KMERS)
    rest = lambda t, at: placed_kmers(F.substring(t, F.col("_kept") + 1, F.length(t)), F.col(at))
    return df.withColumn(out, F.sort_array(F.concat(head, rest(text, "_old"), rest(edited, "_fresh")))).drop("_kept", "_old", "_fresh")


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    pairs = following(dealt(docs), ["text"]).withColumn("edited", edited(F.col("text"), F.coalesce("next_text", F.lit(""))))
    both = with_kmers_of_both(pairs.drop("next_text"), "text", "edited", "_kmers")
    both = both.withColumn("two", tuples(F.col("_kmers"), (FRESH, OLD)))
    both = both.select(
        "_range",
        "_sent",
        "_order",
        "_hash",
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        F.get("two", F.lit(0)).alias("tuples"),
        F.get("two", F.lit(1)).alias("edited_tuples"),
    )
    return following(both, ["tuples"]).filter("not _sent").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text("tuples").alias("fingerprint"),
        as_text("edited_tuples").alias("edited_fingerprint"),
        likeness("tuples", "edited_tuples").alias("near_edited"),
        likeness("tuples", "next_tuples").alias("near_next"),
    )

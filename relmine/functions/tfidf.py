"""Per-group TF-IDF (TX7) and cosine (TX8).

The reference fits one vectoriser per small corpus (the samples of a prompt,
the sentences of a response, a context/response pair) with: raw term counts,
smooth idf ``ln((1+n)/(1+df)) + 1``, L2 normalisation, and a vocabulary cap
of the ``max_features`` terms with the highest total count in that corpus.
Equal counts at the cap are ordered by term (ascending) — the reference's
library leaves that order unspecified.

Physical forms:

* ``with_pair_cosine`` (here) — a two-document corpus per row. With n = 2 the
  idf takes only two values, so the whole computation is a row-local
  projection (no shuffle), linear in the sorted tokens; only terms of more
  than one token are handled one by one.
* ``kept_terms`` and ``vectors`` — a corpus of bounded size held in one row
  (the sentences of a response, the documents of a small group): terms are
  sorted, counted, capped and weighed inside the row, O(t log t), so no row
  per term is ever shuffled, sorted by Spark or spilled.
* corpora of any size are built in ``operators.tfidf`` (partially aggregated
  per ``(group, term)``, so a hot group is pre-aggregated map-side).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relmine.functions.text import let, runs

MAX_FEATURES = 500  # fixed value: vectoriser vocabulary cap of the reference
SCAN_BLOCK = 64  # values of a running sum that are taken one by one


def idf(n_docs: Column, df: Column) -> Column:
    return F.log((n_docs + F.lit(1.0)) / (df + F.lit(1.0))) + F.lit(1.0)


def token_entries(docs: Column) -> Column:
    """From the documents' token arrays: ``array<struct<term, doc, tf>>``,
    sorted; ``doc`` is the position of the document."""
    pairs = F.flatten(F.transform(docs, lambda d, i: F.transform(d, lambda t: F.struct(t.alias("term"), i.alias("doc")))))
    return F.transform(
        runs(F.sort_array(pairs)), lambda r: F.struct(r["v"]["term"].alias("term"), r["v"]["doc"].alias("doc"), r["cnt"].alias("tf"))
    )


def kept_terms(entries: Column, n_docs: Column, max_features: int = MAX_FEATURES) -> Column:
    """The vocabulary of a corpus in one row, in the order of rank (total count
    descending, then term): ``array<struct<neg_total, term, idf, docs>>`` with
    ``docs`` = ``array<struct<doc, w>>`` by ``doc``, w = tf * idf."""

    def grouped(e):
        n = F.size(e)
        starts = F.filter(F.sequence(F.lit(0), n), lambda i: (i == 0) | (i == n) | (F.get(e, i)["term"] != F.get(e, i - 1)["term"]))

        def terms(st):
            def term(s, k):
                return let(
                    F.slice(e, s + 1, F.get(st, k + 1) - s),
                    lambda g: F.struct(
                        F.aggregate(g, F.lit(0).cast("long"), lambda acc, x: acc - x["tf"]).alias("neg_total"),
                        F.get(g, F.lit(0))["term"].alias("term"),
                        g.alias("in"),
                    ),
                )

            return F.transform(F.slice(st, 1, F.size(st) - 1), term)

        return let(starts, terms)

    def weighed(t):
        return let(
            idf(n_docs, F.size(t["in"])),
            lambda f: F.struct(
                t["neg_total"].alias("neg_total"),
                t["term"].alias("term"),
                f.alias("idf"),
                F.transform(t["in"], lambda d: F.struct(d["doc"].alias("doc"), (d["tf"] * f).alias("w"))).alias("docs"),
            ),
        )

    return F.transform(F.slice(F.sort_array(let(entries, grouped)), 1, max_features), weighed)


def by_document(entries: Column, n_docs: Column, body) -> Column:
    """``body(array<struct<doc, rank, w>>)`` for each of the documents 0 to
    ``n_docs`` - 1, in order; entries of a document by rank."""
    none = F.filter(F.sequence(F.lit(0), n_docs), lambda i: i < n_docs)
    marked = F.concat(entries, F.transform(none, lambda i: F.struct(i.alias("doc"), F.lit(0).alias("rank"), F.lit(0.0).alias("w"))))

    def cut(e):
        n = F.size(e)
        starts = F.filter(F.sequence(F.lit(0), n), lambda i: (i == n) | (F.get(e, i)["rank"] == 0))

        def each(st):
            return F.transform(
                F.slice(st, 1, F.size(st) - 1), lambda s, k: let(F.slice(e, s + 2, F.get(st, k + 1) - s - 1), body)
            )

        return let(starts, each)

    return let(F.sort_array(marked), cut)


def ranked_entries(kept: Column) -> Column:
    """``array<struct<doc, rank, w>>`` of all kept terms; ranks are 1, 2, ..."""
    return F.flatten(
        F.transform(kept, lambda t, r: F.transform(t["docs"], lambda d: F.struct(d["doc"].alias("doc"), (r + 1).alias("rank"), d["w"].alias("w"))))
    )


def _length(g: Column) -> Column:
    return F.sqrt(F.aggregate(g, F.lit(0.0), lambda acc, x: acc + x["w"] * x["w"]))


def vectors(kept: Column, n_docs: Column) -> Column:
    """Each document's terms, not scaled: ``array<array<struct<doc, rank, w>>>``."""
    return by_document(ranked_entries(kept), n_docs, lambda g: g)


def lengths(kept: Column, n_docs: Column) -> Column:
    """The length of each document's vector."""
    return by_document(ranked_entries(kept), n_docs, _length)


def sums_before(values: Column) -> Column:
    """Per value of an array of doubles the sum of those before it. Long arrays
    are taken in blocks, so the cost stays near linear."""

    def scan(arr, start):
        zero = F.struct(start.alias("sum"), F.array().cast("array<double>").alias("out"))
        step = lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["out"], F.array(acc["sum"])).alias("out"))
        return F.aggregate(arr, zero, step, lambda acc: acc["out"])

    def in_blocks(v):
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / SCAN_BLOCK).cast("int")), lambda b: F.slice(v, b * SCAN_BLOCK + 1, SCAN_BLOCK))

        def joined(bs):
            totals = F.transform(bs, lambda b: F.aggregate(b, F.lit(0.0), lambda acc, x: acc + x))
            return F.flatten(F.zip_with(bs, scan(totals, F.lit(0.0)), scan))

        return let(blocks, joined)

    return let(values, lambda v: F.when(F.size(v) <= SCAN_BLOCK, scan(v, F.lit(0.0))).otherwise(in_blocks(v)))


# In a text of sorted tokens, each after a space and those of the second side
# before a "!", all tokens of a term that occurs more than once. The loop is
# possessive: a term of any number of tokens needs no stack.
REPEATED = r" ([^ !]++)!?(?: \1!?(?![^ ]))++"


def _occurrences(text: Column, mark: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))).cast("double")


def with_pair_cosine(df: DataFrame, tok_a: str, tok_b: str, out: str, max_features: int = MAX_FEATURES) -> DataFrame:
    """Add ``out`` = TF-IDF cosine of two token arrays fitted on the pair.
    Tokens are made of word characters, each array is sorted.

    Empty vocabulary (no tokens on either side) gives 0.5 like the
    reference's fallback; a side without kept terms is a zero vector (0.0).
    Null token arrays give null.

    Terms of more than one token are found by a pattern in the merged tokens
    and weighed one by one. The others only add their squared weight to one
    side, so it is enough to count those within the cap.
    """
    a, b = F.col(tok_a), F.col(tok_b)
    marked = F.filter(F.split(F.concat(F.array_join(b, "! "), F.lit("!")), " "), lambda t: t != "!")
    merged = F.concat(F.lit(" "), F.array_join(F.sort_array(F.concat(a, marked)), " "))
    # terms of more than one token stand in lines of their own, at odd positions
    found = df.withColumn("_m", F.split(F.regexp_replace(merged, REPEATED, "\n$0\n"), "\n"))
    found = found.withColumn("_rep", F.filter("_m", lambda _, i: i % 2 == 1))

    def counts(m):
        return let(_occurrences(m, "!"), lambda y: F.struct((_occurrences(m, " ") - y).alias("a"), y.alias("b")))

    found = found.withColumn("_rep", F.transform("_rep", counts))

    def capped(vocab):
        # top ``max_features`` terms by total count, ties by term (the array
        # is term-sorted): the cut-off count comes from a native int sort
        def cut(kth):
            above = F.filter(vocab, lambda v: (v["a"] + v["b"]) > kth)
            at = F.filter(vocab, lambda v: (v["a"] + v["b"]) == kth)
            return let(above, lambda ab: F.concat(ab, F.slice(at, 1, F.lit(max_features) - F.size(ab))))

        totals = F.transform(vocab, lambda v: v["a"] + v["b"])
        big = let(F.element_at(F.sort_array(totals, asc=False), max_features), cut)
        return F.when(F.size(vocab) > max_features, big).otherwise(vocab)

    w = math.log(3.0 / 2.0) + 1.0  # ln((1+n)/(1+df)) + 1 with n = 2, df = 1 (df = 2 gives 1)

    def step(acc, v):
        f = F.when((v["a"] > 0) & (v["b"] > 0), F.lit(1.0)).otherwise(F.lit(w * w))
        return F.struct(
            (acc["dot"] + v["a"] * v["b"]).alias("dot"), (acc["na"] + v["a"] * v["a"] * f).alias("na"), (acc["nb"] + v["b"] * v["b"] * f).alias("nb")
        )

    zero = F.struct(F.lit(0.0).alias("dot"), F.lit(0.0).alias("na"), F.lit(0.0).alias("nb"))
    # terms of one token on side a and b, how many terms the cap leaves them, and how many of those are on side b
    ones_a = F.size(a) - F.aggregate("_rep", F.lit(0.0), lambda acc, v: acc + v["a"])
    ones_b = F.size(b) - F.aggregate("_rep", F.lit(0.0), lambda acc, v: acc + v["b"])
    found = found.withColumns({"_ones_a": ones_a, "_ones_b": ones_b, "_room": F.greatest(F.lit(max_features) - F.size("_rep"), F.lit(0))})
    first = F.call_function("substring_index", F.array_join(F.filter("_m", lambda _, i: i % 2 == 0), ""), F.lit(" "), F.col("_room") + 1)
    over = F.col("_ones_a") + F.col("_ones_b") > F.col("_room")
    found = found.withColumn("_kept_b", F.when(over, _occurrences(first, "!")).otherwise(F.col("_ones_b")))
    kept_a = F.when(over, F.col("_room") - F.col("_kept_b")).otherwise(F.col("_ones_a"))

    def finish(st):
        na, nb = st["na"] + kept_a * F.lit(w * w), st["nb"] + F.col("_kept_b") * F.lit(w * w)
        return (
            F.when(F.size(a) + F.size(b) == 0, F.lit(0.5))
            .when((na == 0) | (nb == 0), F.lit(0.0))
            .otherwise(st["dot"] / (F.sqrt(na) * F.sqrt(nb)))
        )

    cosine = let(F.aggregate(let(F.col("_rep"), capped), zero, step), finish)
    found = found.withColumn(out, F.when(a.isNotNull() & b.isNotNull(), cosine))
    return found.drop("_m", "_rep", "_ones_a", "_ones_b", "_room", "_kept_b")

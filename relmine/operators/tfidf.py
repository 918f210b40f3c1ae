"""Per-group TF-IDF (TX7) and cosines of given pairs (TX8).

A group is a small corpus of its own (the samples of a prompt, the sentences
of a response): raw term counts, smooth idf ``ln((1+n)/(1+df)) + 1``, vectors
of length 1, and of each group's terms the ``max_features`` of the highest
total count (ties by term).

Two physical forms give the same weights:

* groups of at most ``GROUP_DOCS`` documents and ``GROUP_CHARS`` characters:
  documents travel once, by group, and are gathered into one row; terms are
  counted, ranked and weighed inside that row (``functions.tfidf``), so no term
  row is shuffled, sorted or spilled;
* larger groups: terms are counted with partial aggregation, ranked in two
  stages, and joined to the documents' terms by (group, term). Those counts
  say how many rows meet at each key, so hot keys are dealt to as many parts
  as they need and no other row is salted or replicated.

Whether there are larger groups at all is looked up first (one row), so that
their plan is only built where it is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relmine.functions import text as T
from relmine.functions.text import let
from relmine.functions.tfidf import MAX_FEATURES, idf, kept_terms, token_entries, vectors
from relmine.operators.skew import dealt_join
from relmine.session import cut_lineage
from relmine.sources.schemas import require

GROUP_DOCS = 256  # documents of a group that is gathered as a whole, at most
GROUP_CHARS = 4_000_000  # characters of such a group, at most
CAP_BUCKETS = 64  # first stage of the vocabulary cap


def ranked_terms(terms: DataFrame, group: str, n_docs: Column, max_features: int = MAX_FEATURES) -> DataFrame:
    """Adds ``rank`` and ``idf`` to rows of one term each (``term``, ``total``,
    ``_in``: its documents) and applies the vocabulary cap. Rows without a
    term are no terms and stay. One window per group: for bounded groups."""
    by = Window.partitionBy(group).orderBy(F.col("total").desc(), F.col("term").asc_nulls_last())
    is_term = F.col("term").isNotNull()
    ranked = terms.withColumn("rank", F.dense_rank().over(by)).filter(~is_term | (F.col("rank") <= max_features))
    return ranked.withColumn("idf", F.when(is_term, idf(n_docs, F.size("_in"))))


def top_terms(terms: DataFrame, k: int, buckets: int = CAP_BUCKETS) -> DataFrame:
    """Exact top-``k`` terms per ``gid`` by total count (ties: term ascending),
    with their ``rank``.

    Two stages so a group with a huge vocabulary is never ranked in one
    task: the top ``k`` of every (group, hash bucket of the term) after an
    exchange on both, then the top ``k`` of those survivors (at most
    ``buckets * k`` rows per group).
    """
    order = [F.col("total").desc(), F.col("term").asc()]
    b = terms.withColumn("_b", F.pmod(F.xxhash64("term"), F.lit(buckets))).repartition("gid", "_b")
    first = b.withColumn("_r", F.row_number().over(Window.partitionBy("gid", "_b").orderBy(*order))).filter(F.col("_r") <= k)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("gid").orderBy(*order))).filter(F.col("rank") <= k)
    return ranked.drop("_b", "_r")


def counted(docs: DataFrame, gid: str, doc: str, text: str) -> DataFrame:
    """``gid, row, n, tc``: each document's terms with counts and the number
    of documents in its group; rows with a null text or group are left out."""
    require(docs, [gid, doc, text], "tfidf")
    d = docs.filter(F.col(text).isNotNull()).select(F.col(gid).alias("gid"), F.col(doc).alias("row"), F.col(text).alias("_text"))
    n = d.groupBy("gid").agg(F.count(F.lit(1)).alias("n"))
    return d.join(n, "gid").select("gid", "row", "n", T.term_counts(T.tfidf_tokens_sql("_text")).alias("tc"))


def small_groups(docs: DataFrame, group_docs: int = GROUP_DOCS) -> DataFrame:
    """Documents of the groups that are gathered, dealt by group. The number of
    parts is given, so that they are not put together by their bytes: the work
    behind this exchange is in the terms."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return docs.filter(~is_large(group_docs)).repartition(parts, "gid")


def group_terms(dealt: DataFrame, max_features: int = MAX_FEATURES) -> DataFrame:
    """From documents dealt by group (``row`` tells them apart): a row per kept
    term with its rank, idf and documents (``_in``: row, tf). No exchange. A
    term's rows are brought together by their hash, so that the sort hardly
    ever compares terms; a hash aggregate would hold few lists of documents."""
    terms = dealt.select("gid", "n", "row", F.explode("tc").alias("_t")).select("gid", "n", "row", "_t.term", "_t.tf")
    of_term = Window.partitionBy("_h", "gid", "n", "term")
    terms = terms.withColumn("_h", F.xxhash64("gid", "term")).select(
        "gid",
        "n",
        "term",
        F.collect_list(F.struct("row", "tf")).over(of_term).alias("_in"),
        F.sum("tf").over(of_term).alias("total"),
        (F.col("row") == F.min("row").over(of_term)).alias("_first"),
    )
    return ranked_terms(terms.filter("_first").drop("_first"), "gid", F.col("n"), max_features)


def gathered(docs: DataFrame, by: list[str], *columns: str) -> DataFrame:
    """One row per group (``by``) with its documents' ``columns`` as the array
    ``docs``, for groups of bounded size."""
    return docs.groupBy(*by).agg(F.collect_list(F.struct(*columns)).alias("docs"))


def small_weights(docs: DataFrame, max_features: int = MAX_FEATURES) -> DataFrame:
    """``gid, row, term, rank, w`` of small groups' documents (``gid, row,
    text``): the only exchange is that of the texts."""
    tokens = F.transform("docs", lambda d: T.tfidf_tokens(d["text"]))
    n = F.size("docs")

    def of_document(kept, row, vec, length):
        return F.transform(
            vec, lambda x: F.struct(row.alias("row"), F.get(kept, x["rank"] - 1)["term"].alias("term"), x["rank"].alias("rank"), (x["w"] / length).alias("w"))
        )

    def rows(kept):
        def of_vectors(vecs):
            squares = F.transform(vecs, lambda v: F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x["w"] * x["w"]))
            own = F.arrays_zip(F.col("docs.row").alias("row"), squares.alias("sq"))
            # rows that repeat an id have one length
            def of_all(o):
                def length(row):
                    return F.sqrt(F.aggregate(o, F.lit(0.0), lambda acc, x: acc + F.when(x["row"].eqNullSafe(row), x["sq"]).otherwise(F.lit(0.0))))

                return F.flatten(F.zip_with(F.col("docs.row"), vecs, lambda row, v: let(length(row), lambda ln: of_document(kept, row, v, ln))))

            return let(own, of_all)

        return let(vectors(kept, n), of_vectors)

    weights = let(kept_terms(token_entries(tokens), n, max_features), rows)
    return gathered(docs, ["gid"], "row", "text").select("gid", F.explode(weights).alias("_w")).select("gid", "_w.*")


def normalised(weights: DataFrame) -> DataFrame:
    """Vectors of length 1; a document has ``max_features`` terms at most."""
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("gid", "row")))
    return weights.withColumn("w", F.col("w") / length)


def large_weights(docs: DataFrame, max_features: int = MAX_FEATURES, hot_rows: int | None = None) -> DataFrame:
    """``gid, n, row, term, rank, w`` of documents of larger groups."""
    terms = docs.select("gid", "n", "row", F.explode("tc").alias("_t")).select("gid", "n", "row", "_t.term", "_t.tf")
    counts = terms.groupBy("gid", "n", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))
    kept = cut_lineage(top_terms(counts, max_features))  # at most max_features rows for more than GROUP_DOCS documents
    each = kept.select("gid", "n", "term", "rank", "df", idf(F.col("n"), F.col("df")).alias("idf"))
    joined = dealt_join(terms.drop("n"), each, ["gid", "term"], "df", "row", hot_rows)
    return normalised(joined.select("gid", "n", "row", "term", "rank", (F.col("tf") * F.col("idf")).alias("w")))


def has_large(docs: DataFrame, group_docs: int = GROUP_DOCS) -> bool:
    return not docs.filter(is_large(group_docs)).select("n").isEmpty()


def is_large(group_docs: int = GROUP_DOCS) -> Column:
    """Whether a group is too large for one row, by its ``n`` and ``chars``."""
    return (F.col("n") > group_docs) | (F.col("chars") > GROUP_CHARS)


def tfidf_weights(
    docs: DataFrame, gid: str, doc: str, text: str, max_features: int = MAX_FEATURES, group_docs: int = GROUP_DOCS
) -> DataFrame:
    """TX7: ``gid, doc, term, rank, weight`` — the TF-IDF vector of every
    document in its group; ``rank`` numbers a group's terms.

    Null texts are no documents, texts without terms have no rows. Rows that
    repeat an id within a group add up to one vector only if their texts are
    joined before; give each document one row.
    """
    require(docs, [gid, doc, text], "tfidf")
    texts = docs.filter(F.col(text).isNotNull()).select(F.col(gid).alias("gid"), F.col(doc).alias("row"), F.col(text).alias("text"))
    texts = texts.filter(F.col("gid").isNotNull())
    sizes = texts.groupBy("gid").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
    large = sizes.filter(is_large(group_docs)).select("gid")
    if large.isEmpty():
        out = small_weights(texts, max_features)
    else:
        large = cut_lineage(large)
        out = small_weights(texts.join(large, "gid", "left_anti"), max_features)
        c = counted(texts.join(large, "gid", "left_semi"), "gid", "row", "text")
        out = out.unionByName(large_weights(c, max_features).drop("n"))
    return out.select(F.col("gid").alias(gid), F.col("row").alias(doc), "term", "rank", F.col("w").alias("weight"))


def cosines(weights: DataFrame, pairs: DataFrame, gid: str, doc: str, a: str, b: str, out: str = "cosine") -> DataFrame:
    """TX8: ``pairs`` (``gid``, ``a``, ``b`` and any other columns) with the
    cosine of the two documents' vectors (``tfidf_weights``).

    Each document's vector is one row and each pair meets two of them, so the
    work grows with the pairs given and no row per term is shuffled. Documents
    without terms, or unknown, give 0.0; a pair with a null id gives 0.0 too;
    rows that repeat stay. In both joins the vectors have one row per key: a
    document of many pairs is hot on the other side alone, which a skew join
    can split.
    """
    entry = F.struct("rank", F.col("weight").alias("w"))
    vecs = weights.groupBy(F.col(gid).alias("_g"), F.col(doc).alias("_d")).agg(F.sort_array(F.collect_list(entry)).alias("_e"))
    # two plain arrays are a third of the size of an array of pairs
    vecs = vecs.select("_g", "_d", F.col("_e.rank").alias("_r"), F.col("_e.w").alias("_w"))
    asked = pairs.select(F.col(gid).alias("_g"), F.col(a).alias("_a"), F.col(b).alias("_b")).distinct()
    left = vecs.select("_g", F.col("_d").alias("_a"), F.col("_r").alias("_ra"), F.col("_w").alias("_wa"))
    right = vecs.select("_g", F.col("_d").alias("_b"), F.col("_r").alias("_rb"), F.col("_w").alias("_wb"))
    dots = asked.join(left, ["_g", "_a"]).join(right, ["_g", "_b"]).select("_g", "_a", "_b", _dot("_ra", "_wa", "_rb", "_wb").alias("_dot"))
    found = pairs.join(dots, (pairs[gid] == dots["_g"]) & (pairs[a] == dots["_a"]) & (pairs[b] == dots["_b"]), "left")
    return found.select(*[pairs[c] for c in pairs.columns if c != out], F.coalesce("_dot", F.lit(0.0)).alias(out))


def _dot(ra: str, wa: str, rb: str, wb: str) -> Column:
    """Product of two sparse vectors, given as ranks and weights in the order
    of rank: a term of both is where entries of equal rank meet; entries of one
    vector that repeat a rank add up."""

    def side(r, w, k):
        return F.zip_with(F.col(r), F.col(w), lambda x, y: F.struct(x.alias("r"), F.when(F.lit(k == 0), y).otherwise(0.0).alias("a"), F.when(F.lit(k == 1), y).otherwise(0.0).alias("b")))

    def step(acc, x):
        same = acc["r"] == x["r"]
        return F.struct(
            x["r"].alias("r"),
            (F.when(same, acc["a"]).otherwise(F.lit(0.0)) + x["a"]).alias("a"),
            (F.when(same, acc["b"]).otherwise(F.lit(0.0)) + x["b"]).alias("b"),
            (acc["dot"] + F.when(same, F.lit(0.0)).otherwise(acc["a"] * acc["b"])).alias("dot"),
        )

    zero = F.struct(F.lit(0).alias("r"), F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("dot"))
    both = F.sort_array(F.concat(side(ra, wa, 0), side(rb, wb, 1)))
    return F.aggregate(both, zero, step, lambda acc: acc["dot"] + acc["a"] * acc["b"])

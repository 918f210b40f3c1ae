"""Self-consistency across sampled responses.

Plan shape:

* per sample (row-local, evaluated once and fixed by a reliable checkpoint):
  term counts, distinct lower-cased words, numbers, token count, the number of
  samples of its prompt, and a row number of its own, so that samples which
  repeat an index stay apart;
* prompts of at most ``GROUP_DOCS`` samples and ``GROUP_CHARS`` characters travel
  once, by prompt, as these compact rows. Facts (the sample itself, each number,
  each distinct word) are gathered in one row, terms ranked and the few sample
  pairs formed behind that exchange;
* larger prompts (a plan that is only built where there are any): facts and
  terms are counted with partial aggregation, and semantic consistency comes
  from sums alone. With unit vectors v, the cosines of a prompt add up to
  (|Σv|² - Σ|v|²) / 2, term by term, and their squares to
  (|VᵀV|² - Σ|v|⁴) / 2, where VᵀV has at most ``MAX_FEATURES`` squared entries.
  The minimum is bounded from above by the samples that are least like the
  rest, each compared with all; it is 0 as soon as one shares no term with one
  of them. Where it is not, samples are paired in blocks as far as two bounds
  from below allow less (``least_cosine``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relmine.functions import text as T
from relmine.functions.tfidf import MAX_FEATURES
from relmine.operators import tfidf
from relmine.operators.tfidf import GROUP_DOCS
from relmine.session import cut_lineage
from relmine.sources.schemas import require

# Fixed values of the reference.
COMPOSITE_WEIGHTS = (0.4, 0.2, 0.2, 0.2)  # semantic, lexical, numeric agreement, 1 - min(cv, 1)
UNRELIABLE_THRESHOLD = 0.6
BANDS = (0.5, 0.8)
# Not fixed values of the reference:
OUTLIERS = 8  # samples of a large prompt that are compared with all others
OUTLIER_BUCKETS = 64  # first stage of finding them
BLOCK_ROWS = 512  # samples of a block that is paired with another

METRICS = [
    "semantic_consistency",
    "semantic_consistency_min",
    "semantic_consistency_std",
    "lexical_overlap",
    "numeric_variance",
    "numeric_agreement",
    "length_cv",
    "composite_consistency",
]


def prepare_samples(queries: DataFrame, samples: DataFrame, pid: str = "prompt_id", sid: str = "sample_idx", text: str = "response") -> DataFrame:
    """SC1: samples of the queried prompts (orphans ignored, null text is not a
    sample), with their row-local features: term counts, distinct lower-cased
    words, numbers, token count; ``n`` and ``chars`` are the number of samples of
    the prompt and of their characters.
    ``row`` tells apart samples that share a ``sample_idx``; it is fixed by the
    checkpoint that ``analyze`` sets."""
    require(queries, [pid], "consistency queries")
    require(samples, [pid, sid, text], "consistency samples")
    s = samples.filter(F.col(text).isNotNull())
    sizes = s.groupBy(pid).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.length(text)).alias("_chars"))
    asked = sizes.join(queries.select(pid).distinct(), pid, "left_semi")
    # a text and its lower-cased form have as many words
    s = s.select(pid, text).join(asked, pid).withColumn("_words", T.ws_tokens(F.lower(F.col(text))))
    return s.select(
        F.col(pid).alias("gid"),
        F.monotonically_increasing_id().alias("row"),
        F.col("_n").alias("n"),
        F.col("_chars").alias("chars"),
        T.term_counts(T.tfidf_tokens_sql(f"`{text}`")).alias("tc"),
        F.array_distinct("_words").alias("words"),
        T.plain_numbers(F.col(text)).alias("nums"),
        F.size("_words").cast("long").alias("ntok"),
    )


def fact_stats(prepared: DataFrame) -> DataFrame:
    """Per prompt the counts behind SC3–SC6, from one row per fact of a sample:
    S (the sample: token count, first number), N (each number), W (each
    distinct word). Facts are counted by key, then by count; nothing is joined
    or ranked by prompt. Rows dealt by prompt need no exchange."""

    def fact(kind, key=None, x=None, ntok=None):
        return F.struct(
            F.lit(kind).alias("kind"),
            (key if key is not None else F.lit(None).cast("string")).alias("key"),
            (x if x is not None else F.lit(None).cast("double")).alias("x"),
            (ntok if ntok is not None else F.lit(None).cast("bigint")).alias("ntok"),
        )

    first = F.try_element_at(F.col("nums"), F.lit(1))  # null when the sample has no number
    sample = F.array(fact("S", key=first.cast("string"), ntok=F.col("ntok")))
    facts = F.concat(sample, F.transform("nums", lambda v: fact("N", x=v)), F.transform("words", lambda w: fact("W", key=w)))
    g = prepared.select("gid", "n", F.explode(facts).alias("f")).select("gid", "n", "f.*").groupBy("gid", "n", "kind", "key").agg(
        F.count(F.lit(1)).alias("c"),
        F.sum("ntok").alias("s1"),
        F.sum(F.col("ntok") * F.col("ntok")).alias("s2"),
        F.stddev_pop("x").alias("sx"),
    )
    # per (prompt, kind, count): how many keys have that count
    h = g.groupBy("gid", "n", "kind", F.col("key").isNull().alias("nokey"), "c").agg(
        F.count(F.lit(1)).alias("k"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"), F.max("sx").alias("sx")
    )
    firsts = (F.col("kind") == "S") & ~F.col("nokey")
    words = F.col("kind") == "W"
    return h.groupBy("gid", "n").agg(
        F.sum("s1").alias("s1"),
        F.sum("s2").alias("s2"),
        F.max(F.when(firsts, F.col("c"))).alias("fmax"),
        F.sum(F.when(firsts, F.col("c") * F.col("k"))).alias("fsum"),
        F.max(F.when(F.col("kind") == "N", F.col("sx"))).alias("num_std"),
        F.coalesce(F.sum(F.when(words, F.col("k"))), F.lit(0)).alias("n_union"),
        # words of count n are common to all samples
        F.coalesce(F.sum(F.when(words & (F.col("c") == F.col("n")), F.col("k"))), F.lit(0)).alias("n_inter"),
    )


def small_facts(dealt: DataFrame) -> DataFrame:
    """The same counts for prompts of bounded size dealt by prompt: their
    samples are gathered in one row, and their words met as whole arrays."""
    first = F.try_element_at(F.col("nums"), F.lit(1)).cast("string")  # null when the sample has no number
    g = dealt.groupBy("gid", "n").agg(
        F.sum("ntok").alias("s1"),
        F.sum(F.col("ntok") * F.col("ntok")).alias("s2"),
        F.collect_list(first).alias("_firsts"),
        F.flatten(F.collect_list("nums")).alias("_nums"),
        F.collect_list("words").alias("_words"),
    )
    # spread of all numbers, by running mean
    def step(acc, x):
        off = x - acc["mean"]
        return T.let(
            F.struct((acc["k"] + 1).alias("k"), (acc["mean"] + off / (acc["k"] + 1)).alias("mean")),
            lambda now: F.struct(now["k"].alias("k"), now["mean"].alias("mean"), (acc["m2"] + off * (x - now["mean"])).alias("m2")),
        )

    zero = F.struct(F.lit(0.0).alias("k"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    spread = F.aggregate("_nums", zero, step, lambda acc: F.sqrt(F.try_divide(acc["m2"], acc["k"])))
    words = F.col("_words")
    return g.select(
        "gid",
        "n",
        "s1",
        "s2",
        F.array_max(F.transform(T.runs(F.sort_array("_firsts")), lambda r: r["cnt"])).cast("long").alias("fmax"),
        F.when(F.size("_firsts") > 0, F.size("_firsts").cast("long")).alias("fsum"),
        spread.alias("num_std"),
        F.size(F.array_distinct(F.flatten(words))).cast("long").alias("n_union"),
        F.size(F.aggregate(words, F.get(words, F.lit(0)), F.array_intersect)).cast("long").alias("n_inter"),
    )


SEMANTIC = ["gid", "sem_sum", "sem_sum2", "sem_min"]


def small_semantics(dealt: DataFrame, max_features: int = MAX_FEATURES) -> DataFrame:
    """Sum, sum of squares and minimum of the cosines of all sample pairs, for
    prompts dealt by prompt that have a vocabulary. A term gives the pairs of
    its samples (i <= j; i = j is a squared length); no exchange."""
    d = F.col("_in")
    pairs = F.flatten(
        F.transform(
            d,
            lambda a: F.transform(
                F.filter(d, lambda b: b["row"] >= a["row"]),
                lambda b: F.struct(a["row"].alias("i"), b["row"].alias("j"), (a["tf"] * b["tf"]).alias("tf")),
            ),
        )
    )
    terms = tfidf.group_terms(dealt, max_features).select("gid", "n", (F.col("idf") * F.col("idf")).alias("_s"), F.explode(pairs).alias("p"))
    dots = terms.groupBy("gid", "n", "p.i", "p.j").agg(F.sum(F.col("p.tf") * F.col("_s")).alias("dot"))
    for k in ("i", "j"):
        own = F.max(F.when(F.col("i") == F.col("j"), F.col("dot"))).over(Window.partitionBy("gid", k))
        dots = dots.withColumn(f"len_{k}", own)
    cos = F.when(F.col("i") < F.col("j"), F.col("dot") / F.sqrt(F.col("len_i") * F.col("len_j")))
    sums = dots.withColumn("c", cos).groupBy("gid", "n").agg(
        F.coalesce(F.sum("c"), F.lit(0.0)).alias("sem_sum"),
        F.coalesce(F.sum(F.col("c") * F.col("c")), F.lit(0.0)).alias("sem_sum2"),
        F.count("c").alias("npos"),
        F.min("c").alias("cmin"),
    )
    # a pair without a common term has no row, and cosine 0
    low = F.when(F.col("npos") < F.col("n") * (F.col("n") - 1) / 2, F.lit(0.0)).otherwise(F.col("cmin"))
    return sums.withColumn("sem_min", low).select(*SEMANTIC)


def _dot(vec: Column, dense: Column) -> Column:
    """Of a vector (array of rank, w) and an array by rank."""
    return F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + x["w"] * F.coalesce(F.get(dense, x["rank"] - 1), F.lit(0.0)))


def large_semantics(prepared: DataFrame, max_features: int = MAX_FEATURES) -> DataFrame:
    """The same for prompts of any size, without pairing samples for the sums."""
    weights = tfidf.large_weights(prepared, max_features).select("gid", "n", "row", "rank", "w")
    vectors = weights.groupBy("gid", "n", "row").agg(F.collect_list(F.struct("rank", "w")).alias("vec"))
    vectors = cut_lineage(vectors)
    entries = vectors.select("gid", "n", F.explode("vec").alias("e")).select("gid", "n", "e.rank", "e.w")
    terms = entries.groupBy("gid", "n", "rank").agg(
        F.sum("w").alias("s"), F.sum(F.col("w") * F.col("w")).alias("q"), F.count(F.lit(1)).alias("c"), F.min("w").alias("low")
    )
    # a term of one sample adds nothing, exactly
    shared = F.when(F.col("c") > 1, (F.col("s") * F.col("s") - F.col("q")) / 2).otherwise(F.lit(0.0))
    centre = terms.groupBy("gid").agg(
        F.sum(shared).alias("sem_sum"),
        F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("length"),
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "s"))), lambda x: x["s"]).alias("centre"),  # ranks are 1, 2, ...
        # of the terms that all samples have, the one of the largest least weight
        F.max(F.when(F.col("c") == F.col("n"), F.struct("low", "rank")))["rank"].alias("common"),
    )
    v = F.col("vec")
    products = F.flatten(
        F.transform(
            v,
            lambda a: F.transform(
                F.filter(v, lambda b: b["rank"] >= a["rank"]),
                lambda b: F.struct(a["rank"].alias("t"), b["rank"].alias("u"), (a["w"] * b["w"]).alias("x")),
            ),
        )
    )
    gram = vectors.select("gid", F.explode(products).alias("p")).groupBy("gid", "p.t", "p.u").agg(F.sum("p.x").alias("g"))
    squares = gram.groupBy("gid").agg(F.sum(F.when(F.col("t") == F.col("u"), 1.0).otherwise(2.0) * F.col("g") * F.col("g")).alias("g2"))
    length = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x["w"] * x["w"])
    rows = vectors.groupBy("gid", "n").agg(F.count(F.lit(1)).alias("m"), F.sum(length * length).alias("l4"))
    sums = rows.join(squares, "gid").join(centre.select("gid", "sem_sum"), "gid")
    sums = sums.withColumn("sem_sum2", F.greatest((F.col("g2") - F.col("l4")) / 2, F.lit(0.0)))
    least = least_cosine(vectors, centre)
    # a sample without a kept term has cosine 0 to all
    low = F.when(F.col("m") < F.col("n"), F.lit(0.0)).otherwise(F.coalesce("least", F.lit(0.0)))
    return sums.join(least, "gid", "left").withColumn("sem_min", low).select(*SEMANTIC)


def least_cosine(vectors: DataFrame, centre: DataFrame) -> DataFrame:
    """``gid, least``: the exact minimum over all pairs of a prompt's vectors.

    Two bounds hold for a pair: its angle is at most the sum of its angles to
    the centre, and its cosine at least the product of its weights of a term
    that all samples have. The samples that are extreme by either are compared
    with all; the others are paired where both bounds allow less than that."""
    near = vectors.join(centre.select("gid", "centre", "length", "common"), "gid")
    weight = F.try_element_at(F.filter("vec", lambda x: x["rank"] == F.col("common")), F.lit(1))["w"]
    near = near.select(
        "gid",
        "row",
        "vec",
        F.size("centre").alias("width"),
        (_dot(F.col("vec"), F.col("centre")) / F.col("length")).alias("near"),
        F.coalesce(weight, F.lit(0.0)).alias("has"),
    )
    near = cut_lineage(near.withColumn("_b", F.pmod(F.xxhash64("row"), F.lit(OUTLIER_BUCKETS))))

    def lowest(by: str) -> DataFrame:
        order = [F.col(by).asc(), F.col("row").asc()]
        few = near.withColumn("_r", F.row_number().over(Window.partitionBy("gid", "_b").orderBy(*order))).filter(F.col("_r") <= OUTLIERS)
        return few.withColumn("_r", F.row_number().over(Window.partitionBy("gid").orderBy(*order))).filter(F.col("_r") <= OUTLIERS)

    by_rank = F.map_from_entries("vec")
    dense = F.transform(F.sequence(F.lit(1), F.col("width")), lambda r: F.coalesce(F.try_element_at(by_rank, r), F.lit(0.0)))
    extreme = lowest("near").unionByName(lowest("has"))
    outliers = extreme.groupBy("gid").agg(
        F.collect_list(F.struct("row", dense.alias("dense"))).alias("_out"), F.min("near").alias("farthest"), F.min("has").alias("has_least")
    )
    others = F.filter("_out", lambda o: o["row"] != F.col("row"))
    least = F.array_min(F.transform(others, lambda o: _dot(F.col("vec"), o["dense"])))
    bound = near.join(outliers, "gid").groupBy("gid", "farthest", "has_least").agg(F.min(least).alias("bound"))
    bound = cut_lineage(bound)
    open_ = bound.filter(F.col("bound") > 0)
    if open_.isEmpty():
        return bound.select("gid", F.col("bound").alias("least"))
    angle = lambda c: F.acos(F.least(F.greatest(c, F.lit(-1.0)), F.lit(1.0)))
    left = near.join(open_, "gid").filter(
        (angle(F.col("near")) + angle(F.col("farthest")) > angle(F.col("bound")) - F.lit(1e-9))
        & (F.col("has") * F.col("has_least") < F.col("bound") + F.lit(1e-12))
    )
    sizes = left.groupBy("gid").agg(F.count(F.lit(1)).alias("a"))
    left = left.select("gid", "row", "vec", "has", "bound").join(sizes, "gid")
    blocks = F.ceil(F.col("a") / F.lit(float(BLOCK_ROWS))).cast("int")
    left = left.select("gid", "a", "row", "vec", "has", "bound", blocks.alias("k"), F.pmod(F.xxhash64("row"), blocks).cast("int").alias("b"))
    cells = F.transform(
        F.sequence(F.lit(0), F.col("k") - 1), lambda o: F.struct(F.least(F.col("b"), o).alias("x"), F.greatest(F.col("b"), o).alias("y"))
    )
    placed = left.select("gid", "a", "row", "vec", "has", "bound", "b", F.explode(cells).alias("cell"))
    placed = placed.select("gid", "a", "row", "has", "bound", "b", "cell", F.explode("vec").alias("e"))
    placed = placed.select("gid", "a", "row", "has", "bound", "b", "cell", "e.rank", "e.w")
    first = placed.filter(F.col("b") == F.col("cell.x"))
    second = placed.filter(F.col("b") == F.col("cell.y"))
    second = second.select("gid", "cell", "rank", F.col("row").alias("j"), F.col("w").alias("wj"), F.col("has").alias("hasj"))
    inside = F.col("cell.x") == F.col("cell.y")
    can = F.col("has") * F.col("hasj") < F.col("bound") + F.lit(1e-12)
    pairs = first.join(second, ["gid", "cell", "rank"]).filter((~inside | (F.col("row") < F.col("j"))) & can)
    pairs = pairs.groupBy("gid", "a", "cell", "row", "j", "has").agg(F.sum(F.col("w") * F.col("wj")).alias("c"))
    found = pairs.groupBy("gid", "a").agg(F.min("c").alias("cmin"), F.count(F.lit(1)).alias("npos"), F.max("has").alias("has"))
    # without a term common to all, a pair that has no row has cosine 0
    none = (F.col("has") == 0) & (F.col("npos") < F.col("a") * (F.col("a") - 1) / 2)
    found = found.select("gid", F.when(none, F.lit(0.0)).otherwise(F.col("cmin")).alias("cmin"))
    return bound.join(found, "gid", "left").select("gid", F.least("bound", "cmin").alias("least"))


def prompt_metrics(prepared: DataFrame, max_features: int = MAX_FEATURES, group_docs: int = GROUP_DOCS) -> DataFrame:
    """SC2–SC7 per prompt with at least 2 samples: ``gid`` + METRICS, from
    checkpointed samples (``prepare_samples``)."""
    few = prepared.filter(F.col("n") >= 2)
    dealt = tfidf.small_groups(few, group_docs)
    m = small_facts(dealt).join(small_semantics(dealt, max_features), "gid", "left")
    if tfidf.has_large(few, group_docs):
        many = few.filter(tfidf.is_large(group_docs))
        m = m.unionByName(fact_stats(many).join(large_semantics(many, max_features), "gid", "left"))
    n = F.col("n")
    pairs = n * (n - 1) / 2.0
    vocab = F.col("sem_sum").isNotNull()
    mean = F.col("sem_sum") / pairs
    var = F.greatest(F.col("sem_sum2") / pairs - mean * mean, F.lit(0.0))
    overlap = F.col("n_inter") / F.greatest(F.col("n_union"), F.lit(1))
    # token-count spread from exact integer sums: n*S2 - S1^2 in decimal
    dec = "decimal(38,0)"
    num = n.cast(dec) * F.col("s2").cast(dec) - F.col("s1").cast(dec) * F.col("s1").cast(dec)
    len_std = F.sqrt(num.cast("double")) / n
    cv = len_std / F.greatest(F.col("s1") / n, F.lit(1.0))
    out = m.select(
        "gid",
        F.when(vocab, mean).otherwise(F.lit(1.0)).alias("semantic_consistency"),
        F.when(vocab, F.col("sem_min")).otherwise(F.lit(1.0)).alias("semantic_consistency_min"),
        F.when(vocab, F.sqrt(var)).otherwise(F.lit(0.0)).alias("semantic_consistency_std"),
        overlap.cast("double").alias("lexical_overlap"),
        F.coalesce(F.col("num_std"), F.lit(0.0)).alias("numeric_variance"),
        F.coalesce(F.col("fmax") / F.col("fsum"), F.lit(1.0)).alias("numeric_agreement"),
        cv.alias("length_cv"),
    )
    return out.withColumn("composite_consistency", composite(out))


def composite(df: DataFrame) -> Column:
    """SC7."""
    a, b, c, d = COMPOSITE_WEIGHTS
    return (
        F.lit(a) * F.col("semantic_consistency")
        + F.lit(b) * F.col("lexical_overlap")
        + F.lit(c) * F.col("numeric_agreement")
        + F.lit(d) * (F.lit(1.0) - F.least(F.col("length_cv"), F.lit(1.0)))
    )


def analyze(queries: DataFrame, samples: DataFrame, pid: str = "prompt_id", sid: str = "sample_idx", text: str = "response") -> DataFrame:
    """SC1–SC7: queries enriched with the consistency metrics (null when < 2 samples)."""
    prepared = cut_lineage(prepare_samples(queries, samples, pid, sid, text))
    metrics = prompt_metrics(prepared).withColumnRenamed("gid", pid)
    return queries.join(metrics, pid, "left")


def discrimination(enriched: DataFrame, label: str = "is_hallucination") -> DataFrame:
    """SC8: mean and sample std of the composite per label and the gap
    (reliable - hallucinated); one row, only when both label values occur."""
    lab = F.col(label)
    comp = F.col("composite_consistency")
    stats = enriched.agg(
        F.sum(lab.cast("int")).alias("_nh"),
        F.sum((~lab).cast("int")).alias("_nr"),
        F.avg(F.when(lab, comp)).alias("hallucinated_mean"),
        F.stddev_samp(F.when(lab, comp)).alias("hallucinated_std"),
        F.avg(F.when(~lab, comp)).alias("reliable_mean"),
        F.stddev_samp(F.when(~lab, comp)).alias("reliable_std"),
    )
    return stats.filter((F.col("_nh") > 0) & (F.col("_nr") > 0)).select(
        "hallucinated_mean",
        "hallucinated_std",
        "reliable_mean",
        "reliable_std",
        (F.col("reliable_mean") - F.col("hallucinated_mean")).alias("gap"),
    )


def unreliable(enriched: DataFrame, threshold: float = UNRELIABLE_THRESHOLD) -> DataFrame:
    """SC9: composite below the threshold, lowest first."""
    return enriched.filter(F.col("composite_consistency") < threshold).orderBy(F.col("composite_consistency").asc())


def bands(enriched: DataFrame) -> DataFrame:
    """SC10: low (< 0.5), medium [0.5, 0.8), high (>= 0.8) counts and shares;
    null scores count only in the total."""
    lo, hi = BANDS
    c = F.col("composite_consistency")
    total = F.count(F.lit(1))
    low = F.count_if(c < lo)
    med = F.count_if((c >= lo) & (c < hi))
    high = F.count_if(c >= hi)
    return enriched.agg(
        total.alias("total"),
        high.alias("high"),
        med.alias("medium"),
        low.alias("low"),
        F.try_divide(high, total).alias("high_share"),
        F.try_divide(med, total).alias("medium_share"),
        F.try_divide(low, total).alias("low_share"),
    )

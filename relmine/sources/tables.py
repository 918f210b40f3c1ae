"""Sources (S1): read the driver's parquet tables and bind them to the roles
the miners expect (SURVEY §5.3).

Readers name only the columns they use, so the parquet scan reads those
columns (``ReadSchema``) and pushes the filters (``PushedFilters``).
Bindings are plain DataFrame transformations of the given tables; their work
grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relmine.sources.sinks import CSV

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def read(spark: SparkSession, path: str, schema: T.StructType, fmt: str | None = None) -> DataFrame:
    """A canonical table (``relmine.sources.schemas``) from CSV or Parquet,
    read with its declared schema. The format follows from the path's ending
    unless given; CSV has a header, quoted line breaks and doubled quotes."""
    fmt = fmt or ("csv" if path.rstrip("/").lower().endswith((".csv", ".csv.gz")) else "parquet")
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.options(**CSV, multiLine=True, enforceSchema=False)
    return reader.format(fmt).load(path)


TEXT_TABLES = ("documents", "conversations")
SPREAD_BYTES = 256 << 20  # a smaller table of texts may be a single row group, which is one task


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver's. Small tables of texts are dealt evenly to all
    cores, since the work on them is in reading the texts; larger ones are
    read in as many tasks as they have splits, without an exchange."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    if name in TEXT_TABLES and _stored_bytes(df) < SPREAD_BYTES:
        return df.repartition(spark.sparkContext.defaultParallelism)
    return df


def _stored_bytes(df: DataFrame) -> int:
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


# ---------------------------------------------------------------- rag pairs


PAIR_BUCKET = 64  # rows per bucket when pairing each row with its predecessor


def adjacent_pairs(
    df: DataFrame, keys: list[str], pos: str, value: str, prev_value: str, bucket: int = PAIR_BUCKET, read=None
) -> DataFrame:
    """Rows of ``df`` that have a predecessor (same ``keys``, ``pos - 1``),
    with the predecessor's ``value`` as ``prev_value``.

    Instead of a self-join (which shuffles every text twice), rows are
    bucketed by ``pos div bucket``; only the last row of each bucket is
    copied into the next bucket, and ``lag`` inside a bucket finds the
    predecessor. One shuffle of ~(1 + 1/bucket) x the rows; a bucket holds
    at most ``bucket + 1`` rows, so long sequences spread over many tasks.

    ``read(rows, value)`` adds a column ``<value>_read`` made of the value. It
    runs behind that shuffle, once per row, and the predecessor's is found
    like its value (``<prev_value>_read``).
    """
    b = F.floor(F.col(pos) / F.lit(bucket))
    own = df.select(*keys, pos, value, b.alias("_b"), F.lit(False).alias("_carry"))
    carried = df.filter(((F.col(pos) + 1) % bucket) == 0).select(
        *keys, pos, value, (b + 1).alias("_b"), F.lit(True).alias("_carry")
    )
    w = Window.partitionBy(*keys, "_b").orderBy(pos)
    both = own.unionByName(carried)
    found = {value: prev_value}
    if read is not None:
        # a given number of parts is not reduced by their bytes: the work is in reading
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        both = read(both.repartition(parts, *keys, "_b").sortWithinPartitions(*keys, "_b", pos), value)
        found[f"{value}_read"] = f"{prev_value}_read"
    paired = both.select(
        *keys, pos, *found, "_carry", F.lag(pos).over(w).alias("_ppos"), *[F.lag(c).over(w).alias(p) for c, p in found.items()]
    )
    return paired.filter(~F.col("_carry") & (F.col("_ppos") == F.col(pos) - 1)).drop("_carry", "_ppos")


def conversation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rag rows: response = an assistant turn, context = the turn before it."""
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    pairs = adjacent_pairs(conv.withColumn("_r", F.struct("role", "text")), ["conv_id"], "turn", "_r", "_prev")
    return pairs.filter(F.col("_r.role") == "assistant").select(
        "conv_id", "turn", F.col("_prev.text").alias("context"), F.col("_r.text").alias("response")
    )


def document_pairs(spark: SparkSession, sf_dir: str, score=None, read=None) -> DataFrame:
    """rag rows over documents: context = doc d, response = doc d+1,
    ``is_faithful`` = quality label of the response document (null if unlabelled).

    ``score(pairs)`` adds columns before labels are joined, so that a label
    table too large to be broadcast moves no texts; ``read`` as in
    ``adjacent_pairs``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("is_faithful"))
    pairs = adjacent_pairs(docs, [], "doc_id", "text", "context", read=read)
    pairs = pairs.withColumnsRenamed({"text": "response", "text_read": "response_read"})
    scored = pairs if score is None else score(pairs)
    added = [c for c in scored.columns if c not in ("doc_id", "context", "response")]
    return scored.join(labels, "doc_id", "left").select("doc_id", "context", "response", "is_faithful", *added)


# ------------------------------------------------------------ prompt tables


def conversation_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """queries table: one prompt per conversation (its turn 0), label
    ``is_hallucination`` = conv_id % 3 == 0 (the tables carry no such label)."""
    conv = table(spark, sf_dir, "conversations")
    return conv.filter(F.col("turn") == 0).select(
        F.col("conv_id").alias("prompt_id"),
        F.col("text").alias("query"),
        ((F.col("conv_id") % 3) == 0).alias("is_hallucination"),
    )


def conversation_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """samples table: every assistant turn is one sampled response of its conversation's prompt."""
    conv = table(spark, sf_dir, "conversations")
    return conv.filter(F.col("role") == "assistant").select(
        F.col("conv_id").alias("prompt_id"), F.col("turn").cast("int").alias("sample_idx"), F.col("text").alias("response")
    )


def document_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as prompts, labelled by ``labels.quality == 0`` (low quality = risky)."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("prompt_id"), F.col("text").alias("query"))
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("prompt_id"), (F.col("quality") == 0).alias("is_hallucination")
    )
    return docs.join(labels, "prompt_id")


# ------------------------------------------------------------ drift tables


def event_sequences(spark: SparkSession, sf_dir: str, scale: float = 500.0) -> DataFrame:
    """drift rows: one scored sequence per user ordered by ts;
    trust_score = value / scale, is_hallucination = event_type == 'error'."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        "user_id",
        "ts",
        "event_id",
        (F.col("value") / F.lit(scale)).alias("trust_score"),
        (F.col("event_type") == "error").alias("is_hallucination"),
    )


def document_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """responses table for trust maps: every document is a response; its
    reference is the benchmark item ``doc_id % n_items``."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("response_id"), F.col("text").alias("response"))
    bench = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("reference"))
    n_items = bench.select(F.count(F.lit(1))).scalar()  # scalar subquery, evaluated once
    keyed = docs.withColumn("item_id", F.col("response_id") % n_items)
    return keyed.join(bench, "item_id", "left").select("response_id", "response", "reference")


# ------------------------------------------------------------- rule tables

LINEITEM_FEATURES = ["l_linestatus", "is_first_line", "is_late_line", "high_tax", "quantity_bin", "discount_bin"]
LINEITEM_ORDERED = {"quantity_bin": ["small", "medium", "large"], "discount_bin": ["low", "mid", "high"]}


def lineitem_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled feature rows over lineitem: label = returned (l_returnflag 'R'),
    features = line status, 0/1 flags from line number and tax, and binned
    quantity and discount (binned columns are ordered categoricals)."""
    li = table(spark, sf_dir, "lineitem")
    q, d = F.col("l_quantity"), F.col("l_discount")
    return li.select(
        "l_orderkey",
        "l_linenumber",
        "l_linestatus",
        (F.col("l_linenumber") == 1).cast("int").alias("is_first_line"),
        (F.col("l_linenumber") >= 5).cast("int").alias("is_late_line"),
        (F.col("l_tax") > 0.04).cast("int").alias("high_tax"),
        F.when(q <= 10, "small").when(q <= 30, "medium").otherwise("large").alias("quantity_bin"),
        F.when(d < 0.03, "low").when(d < 0.07, "mid").otherwise("high").alias("discount_bin"),
        (F.col("l_returnflag") == "R").alias("is_returned"),
    )

"""Operator 10: preference formatting of chosen and rejected conversations.

The turns of both conversations of a pair are compared turn by turn; the
longest common prefix is rendered once, as the prompt, and each side's
remaining turns as its completion. A rendered turn carries the range of code
points that training counts: what an assistant says in a completion, with
the end mark. Everything else is masked.

A pair is not gathered into one row: one aggregation by (pair, turn, role,
text) tells which sides have a turn, one by pair finds the first turn that
they do not share, and rows look it up (pairs with a large share of all rows
by broadcast), so a conversation of any length spreads over tasks.

Defined cases: null role and text count as empty, a null turn comes before
the first; equal rows count once; rows of one turn that differ stand in
order of role and text and are common if both sides have the same ones;
identical conversations give a prompt alone; a conversation without a
partner, or with a null id, forms no pair; an empty table gives an empty
result; extra columns are not used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relmine.llm.components import looked_up

# The template of a turn.
OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"


def format_pairs(turns: DataFrame) -> DataFrame:
    """``turns``: ``pair_id``, ``is_chosen``, ``turn``, ``role``, ``text``.

    Returns one row per rendered turn: ``pair_id``, ``section`` (prompt,
    chosen, rejected), ``turn``, ``role``, ``rendered``, ``train_from`` and
    ``train_to`` (code points; equal where all is masked)."""
    clean = turns.filter("pair_id is not null").select(
        "pair_id",
        F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        "is_chosen",
    )
    sides = clean.groupBy("pair_id", "turn", "role", "text").agg(F.max("is_chosen").alias("chosen"), F.max(~F.col("is_chosen")).alias("rejected"))
    apart = F.when(F.col("chosen") != F.col("rejected"), F.col("turn"))
    pairs = sides.groupBy("pair_id").agg(F.min(apart).alias("first"), F.count(F.lit(1)).alias("n"), F.max("chosen").alias("c"), F.max("rejected").alias("r"))
    total = clean.count()
    rows = looked_up(sides, pairs, ["pair_id"], "n", total).filter("c and r")

    common = F.col("first").isNull() | (F.col("turn") < F.col("first"))
    own = F.array_compact(F.array(F.when(F.col("chosen"), "chosen"), F.when(F.col("rejected"), "rejected")))
    rows = rows.withColumn("section", F.explode(F.when(common, F.array(F.lit("prompt"))).otherwise(own)))
    head = F.concat(F.lit(OPEN), "role", F.lit(CLOSE))
    counted = (F.col("section") != "prompt") & (F.col("role") == "assistant")
    start = F.length(head).cast("long")
    return rows.select(
        "pair_id",
        "section",
        "turn",
        "role",
        F.concat(head, "text", F.lit(END)).alias("rendered"),
        F.when(counted, start).otherwise(F.lit(0)).cast("long").alias("train_from"),
        F.when(counted, start + F.length("text") + len(END)).otherwise(F.lit(0)).cast("long").alias("train_to"),
    )


def last_answer_pairs(turns: DataFrame) -> DataFrame:
    """Pairs for ``format_pairs`` from ``conv_id``, ``turn``, ``role``, ``text``:
    a conversation up to its last assistant turn is chosen; rejected is the
    same conversation with the partner's last assistant turn in that place.
    Conversations 2i and 2i + 1 are partners; one whose partner is missing, or
    either of which has no assistant turn, forms no pair. Of several
    assistant rows of the last turn, the one with the greatest text counts as
    the answer. Grows with the turns: each earlier turn is on both sides once.
    """
    clean = turns.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("pair_id"),
        F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    answer = F.max(F.when(F.col("role") == "assistant", F.struct("turn", "text")))
    ends = clean.groupBy("pair_id").agg(answer.alias("end"), F.count(F.lit(1)).alias("n")).filter("end is not null")
    partner = ends.select(F.col("pair_id").bitwiseXOR(F.lit(1)).alias("pair_id"), F.col("end.text").alias("other"))
    ends = ends.join(partner, "pair_id")
    rows = looked_up(clean, ends.select("pair_id", "end", "n"), ["pair_id"], "n", clean.count())
    is_answer = (F.col("turn") == F.col("end.turn")) & (F.col("role") == "assistant")
    rows = rows.filter((F.col("turn") <= F.col("end.turn")) & (~is_answer | (F.col("text") == F.col("end.text"))))
    sides = F.when(is_answer, F.array(F.lit(True))).otherwise(F.array(F.lit(True), F.lit(False)))
    chosen = rows.select("pair_id", F.explode(sides).alias("is_chosen"), "turn", "role", "text")
    rejected = ends.select("pair_id", F.lit(False).alias("is_chosen"), F.col("end.turn").alias("turn"), F.lit("assistant").alias("role"), F.col("other").alias("text"))
    return chosen.unionByName(rejected)


def op10_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation with its last answer against its partner's."""
    return format_pairs(last_answer_pairs(spark.read.parquet(f"{sf_dir.rstrip('/')}/conversations.parquet")))


ORACLE = r"""
with clean as (
  select conv_id as pair_id, coalesce(turn, -1) as turn, coalesce(role, '') as role, coalesce(text, '') as text
  from conversations where conv_id is not null
), answers as (
  select pair_id, turn, text from clean where role = 'assistant'
  qualify row_number() over (partition by pair_id order by turn desc, text desc) = 1
), ends as (
  select a.*, b.text as other from answers a join answers b on b.pair_id = xor(a.pair_id, 1)
), both_sides as (
  select c.*, not (c.turn = e.turn and c.role = 'assistant') as shared
  from clean c join ends e using (pair_id)
  where c.turn <= e.turn and (c.turn < e.turn or c.role <> 'assistant' or c.text = e.text)
), sides as (
  select pair_id, turn, role, text, bool_or(chosen) as chosen, bool_or(rejected) as rejected from (
    select pair_id, turn, role, text, true as chosen, shared as rejected from both_sides
    union all select pair_id, turn, 'assistant', other, false, true from ends
  ) group by all
), pairs as (
  select pair_id, min(case when chosen <> rejected then turn end) as first from sides
  group by pair_id having bool_or(chosen) and bool_or(rejected)
), placed as (
  select sides.*, (first is null or turn < first) as common from sides join pairs using (pair_id)
), sections as (
  select *, 'prompt' as section from placed where common
  union all select *, 'chosen' from placed where not common and chosen
  union all select *, 'rejected' from placed where not common and rejected
)
select pair_id, section, turn, role, concat('<|', role, '|>', chr(10), text, '<|end|>', chr(10)) as rendered,
       case when section <> 'prompt' and role = 'assistant' then length(role) + 5 else 0 end as train_from,
       case when section <> 'prompt' and role = 'assistant' then length(role) + 5 + length(text) + 8 else 0 end as train_to
from sections
"""

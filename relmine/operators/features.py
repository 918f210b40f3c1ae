"""Prompt feature projection and label-side row
features (§2.4 LF1–LF5).

One narrow ``select`` of built-in expressions: no shuffle, no Python, and it
works unchanged on a streaming DataFrame. Regex flags are case-insensitive
*searches* returning 0/1 ints, like the reference.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relmine.functions import text as T
from relmine.sources.schemas import require

# The reference's pattern lists (Python regex syntax, which
# Java accepts unchanged for these patterns).
NUMERIC_PATTERNS = [r"how many", r"exactly \d+", r"what (percentage|number|count)", r"list \d+", r"name \d+", r"give me \d+"]
TEMPORAL_PATTERNS = [r"in \d{4}", r"last (year|month|week)", r"recent", r"this year", r"current", r"latest", r"20\d\d"]
SPECIFICITY_PATTERNS = [r"exactly", r"precisely", r"specific", r"particular"]
PERSON_PATTERNS = [r"\bwho\b", r"\bdr\.?\b", r"\bprofessor\b", r"\bartist\b", r"\bauthor\b", r"\bceo\b", r"\bfounder\b"]
LIST_PATTERN = r"\blist\b|\bname\b|\benumerate\b"
ACADEMIC_PATTERN = r"paper|publish|research|study|professor"
FINANCE_PATTERN = r"gdp|revenue|stock|market|economy|price"
MEDICAL_PATTERN = r"symptom|treatment|disease|patient|medication"
# question type: first matching rule wins (prefixes of the lower-cased, stripped text)
QUESTION_TYPES = [
    ("quantity", ["how many", "what number"], []),
    ("person", ["who"], []),
    ("temporal", ["when"], ["what year"]),
    ("enumeration", ["list", "name"], []),
    ("definition", ["what is", "what are"], []),
    ("process", ["how"], []),
    ("explanation", ["why"], []),
]
# pandas.cut bins of the reference (right-closed)
LENGTH_BINS = [(0, 8, "short"), (8, 15, "medium"), (15, 100, "long")]
SPECIFICITY_BINS = [(-1, 0, "low"), (0, 1, "medium"), (1, 10, "high")]
# label-side generator rules
SPECIFIC_COUNT_PATTERN = r"how many|exactly \d+|list \d+"
NUMERIC_CLAIM_PATTERN = r"\d+"
NAMED_ENTITY_PATTERN = r"[A-Z][a-z]+(?:\s[A-Z][a-z]+)*"
PERSON_WORDS = ["who", "professor", "dr.", "artist"]
PERSON_WORDS_NARROW = ["who"]
LIST_WORDS = ["list", "name", "enumerate"]

FEATURE_COLUMNS = [
    "query_word_count", "query_char_count", "has_question_mark", "question_type",
    "demands_numeric", "has_temporal_ref", "demands_specificity", "asks_about_person", "asks_for_list",
    "domain_academic", "domain_finance", "domain_medical", "specificity_demand_score", "length_bin", "specificity_bin",
]


def _search(text: Column, pattern: str) -> Column:
    """Case-insensitive search with Unicode case folding, 0/1 int; the
    pattern's classes keep Python's meaning (``py_regex``)."""
    return text.rlike("(?iu)" + T.py_regex(pattern)).cast("int")


def _cut(x: Column, bins) -> Column:
    expr = None
    for lo, hi, label in bins:
        cond = (x > lo) & (x <= hi)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


def question_type(text: Column) -> Column:
    t = T.py_strip(F.lower(text))
    expr = None
    for label, prefixes, contains in QUESTION_TYPES:
        cond = None
        for p in prefixes:
            c = t.startswith(p)
            cond = c if cond is None else cond | c
        for s in contains:
            cond = cond | t.contains(s)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit("other"))


def extract(df: DataFrame, text_column: str = "query") -> DataFrame:
    """QF1–QF15: add the prompt feature columns (existing ones are replaced)."""
    require(df, [text_column], "extract")
    text = F.coalesce(F.col(text_column), F.lit(""))
    base = [c for c in df.columns if c not in FEATURE_COLUMNS]
    numeric = _search(text, "|".join(NUMERIC_PATTERNS))
    temporal = _search(text, "|".join(TEMPORAL_PATTERNS))
    specific = _search(text, "|".join(SPECIFICITY_PATTERNS))
    listing = _search(text, LIST_PATTERN)
    words = F.size(T.ws_tokens(text))
    score = numeric + specific + listing + temporal
    return df.select(
        *base,
        words.alias("query_word_count"),
        F.length(text).alias("query_char_count"),
        text.contains("?").cast("int").alias("has_question_mark"),
        question_type(text).alias("question_type"),
        numeric.alias("demands_numeric"),
        temporal.alias("has_temporal_ref"),
        specific.alias("demands_specificity"),
        _search(text, "|".join(PERSON_PATTERNS)).alias("asks_about_person"),
        listing.alias("asks_for_list"),
        _search(text, ACADEMIC_PATTERN).alias("domain_academic"),
        _search(text, FINANCE_PATTERN).alias("domain_finance"),
        _search(text, MEDICAL_PATTERN).alias("domain_medical"),
        score.alias("specificity_demand_score"),
        _cut(words, LENGTH_BINS).alias("length_bin"),
        _cut(score, SPECIFICITY_BINS).alias("specificity_bin"),
    )


def label_features(df: DataFrame, query: str = "query", response: str = "response", person_words=PERSON_WORDS) -> DataFrame:
    """LF1–LF5: the generator's derived columns as a projection over any
    (query, response) table. LF5 keeps the substring form under ``_raw``
    names (QF8/QF9 are the word-boundary forms); ``PERSON_WORDS_NARROW`` gives
    the form that low-risk rows have."""
    require(df, [query, response], "label_features")
    q = F.lower(F.coalesce(F.col(query), F.lit("")))
    r = F.coalesce(F.col(response), F.lit(""))

    def any_sub(words):
        cond = None
        for w in words:
            c = q.contains(w)
            cond = c if cond is None else cond | c
        return cond

    return df.select(
        "*",
        r.rlike(T.py_regex(NUMERIC_CLAIM_PATTERN)).alias("has_numeric_claim"),
        r.rlike(T.py_regex(NAMED_ENTITY_PATTERN)).alias("has_named_entity"),
        any_sub(person_words).alias("asks_about_person_raw"),
        any_sub(LIST_WORDS).alias("asks_for_list_raw"),
        q.rlike(T.py_regex(SPECIFIC_COUNT_PATTERN)).alias("asks_specific_count"),
        F.size(T.ws_tokens(F.coalesce(F.col(query), F.lit("")))).alias("query_length"),
        F.size(T.ws_tokens(r)).alias("response_length"),
    )

"""Text primitives shared by every miner.

All functions return Spark ``Column`` expressions built from built-in
functions, so they run inside the JVM (no Python UDF) and work unchanged on
streaming DataFrames.

Regex dialect: the reference uses Python's ``re`` whose ``\\b \\w \\d \\s`` are
Unicode-aware. Patterns are kept in the reference's Python syntax and
translated by ``py_regex`` into explicit Java classes with Python's meaning
(Java's own ``(?U)`` classes differ, e.g. on combining marks).

A note on higher-order functions: an intermediate array that is used more
than once is bound to a lambda variable with ``let`` (a one-element
``transform``). Lambda bodies then refer to variables, never to array
expressions, so neither a collapsed projection nor a pushed-down predicate
can re-evaluate an O(n log n) step per element or grow the plan.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's behaviour).
# English stop list of the public scikit-learn ``ENGLISH_STOP_WORDS`` (318
# words), used by the TF-IDF tokeniser (TX2). Spark's StopWordsRemover list
# is a different list and must not be substituted.
STOP_WORDS = tuple(
    """
a about above across after afterwards again against all almost alone along already also although always am among amongst amoungst amount an and
another any anyhow anyone anything anyway anywhere are around as at back be became because become becomes becoming been before beforehand behind
being below beside besides between beyond bill both bottom but by call can cannot cant co con could couldnt cry de describe detail do done down due
during each eg eight either eleven else elsewhere empty enough etc even ever every everyone everything everywhere except few fifteen fifty fill find
fire first five for former formerly forty found four from front full further get give go had has hasnt have he hence her here hereafter hereby herein
hereupon hers herself him himself his how however hundred i ie if in inc indeed interest into is it its itself keep last latter latterly least less
ltd made many may me meanwhile might mill mine more moreover most mostly move much must my myself name namely neither never nevertheless next nine no
nobody none noone nor not nothing now nowhere of off often on once one only onto or other others otherwise our ours ourselves out over own part per
perhaps please put rather re same see seem seemed seeming seems serious several she should show side since sincere six sixty so some somehow someone
something sometime sometimes somewhere still such system take ten than that the their them themselves then thence there thereafter thereby therefore
therein thereupon these they thick thin third this those though three through throughout thru thus to together too top toward towards twelve twenty
two un under until up upon us very via was we well were what whatever when whence whenever where whereafter whereas whereby wherein whereupon
wherever whether which while whither who whoever whole whom whose why will with within without would yet you your yours yourself yourselves
""".split()
)

# Python's regex classes for str patterns, written out for Java: a word
# character is a letter, number or underscore (not a combining mark), \b is
# a position with a word character on exactly one side, \d a decimal digit,
# \s any character for which str.isspace() is true.
PY_WORD = r"[\p{L}\p{N}_]"
PY_CLASSES = {
    r"\b": rf"(?:(?<={PY_WORD})(?!{PY_WORD})|(?<!{PY_WORD})(?={PY_WORD}))",
    r"\d": r"\p{Nd}",
    r"\s": r"[\t\n\x0B\f\r\x1C-\x1F\x85\p{Z}]",
    r"\w": PY_WORD,
}


_WORD_TOKEN_END = re.compile(r"(?:[A-Za-z0-9_]|\\d|\[(?:a-z|A-Z|0-9)\])\+?$")
_WORD_TOKEN_START = re.compile(r"^(?:[A-Za-z0-9_]|\\d|\[(?:a-z|A-Z|0-9)\])(?![?*]|\{0)")


_CLASS_START = re.compile(r"\\d|\[(?:A-Z|0-9)\]")


def _ends_in_word(prefix: str) -> bool:
    """True when every match of ``prefix`` (a pattern fragment) ends with a word character."""
    if prefix.endswith("\\") or prefix.endswith("\\.") or prefix == "":
        return False
    if prefix.endswith(")?") or prefix.endswith(")*"):
        depth, i = 0, len(prefix) - 2
        while i >= 0:  # find the group's opening parenthesis
            depth += prefix[i] == ")"
            depth -= prefix[i] == "("
            if depth == 0:
                break
            i -= 1
        body = prefix[i + 1 : -2].removeprefix("?:")
        return "|" not in body and _ends_in_word(body) and _ends_in_word(prefix[:i])
    m = _WORD_TOKEN_END.search(prefix)
    return bool(m) and not prefix[: m.start()].endswith("\\")


def _top_level_alternatives(pattern: str) -> list[str]:
    parts, depth, start, i = [], 0, 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 2
            continue
        if c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == "|" and depth == 0:
            parts.append(pattern[start:i])
            start = i + 1
        i += 1
    return parts + [pattern[start:]]


def py_regex(pattern: str) -> str:
    """Translate a Python ``re`` pattern to Java (see ``_translate``); when
    every alternative starts at a word start (``\\bword``), that check is
    hoisted out of the alternation so it runs once per position."""
    alts = _top_level_alternatives(pattern)
    if len(alts) > 1 and all(a.startswith("\\b") and _WORD_TOKEN_START.match(a[2:]) for a in alts):
        return rf"(?<!{PY_WORD})(?:" + "|".join(_translate(a[2:]) for a in alts) + ")"
    return _translate(pattern)


def _translate(pattern: str) -> str:
    r"""Translate a Python ``re`` pattern (as the reference writes it) to Java
    with the same meaning of ``\b \d \s \w`` on any text.

    ``\b`` next to a pattern token that always matches a word character is a
    one-sided check (fails fast, like a native boundary); elsewhere it is the
    full "word character on exactly one side" test.
    """
    out, i, alt_start = [], 0, 0
    while i < len(pattern):
        if pattern[i] == "\\" and i + 1 < len(pattern):
            tok = pattern[i : i + 2]
            if tok == r"\b":
                before, after = pattern[alt_start:i], pattern[i + 2 :]
                if _WORD_TOKEN_START.match(after):
                    # a class that fails at most positions is looked at first
                    first = _CLASS_START.match(after)
                    out.append(f"(?={PY_CLASSES.get(first[0], first[0])})" if first else "")
                    out.append(rf"(?<!{PY_WORD})")
                elif _ends_in_word(before):
                    out.append(rf"(?!{PY_WORD})")
                else:
                    out.append(PY_CLASSES[tok])
            else:
                out.append(PY_CLASSES.get(tok, tok))
            i += 2
            continue
        if pattern[i] == "|":
            alt_start = i + 1
        out.append(pattern[i])
        i += 1
    return "".join(out)


# Regex patterns of the reference (fixed values), Python syntax.
PLAIN_NUMBER_PY = r"\b\d+(?:\.\d+)?\b"
NUMBER_PCT_PY = r"\b\d+(?:\.\d+)?%?\b"
CAPITALISED_RUN_PY = r"\b[A-Z][a-z]+(?:\s[A-Z][a-z]+)*\b"
MONEY_NUMBER_PY = r"\$?[\d,]+(?:\.\d+)?%?"
SENTENCE_BREAK_PY = r"(?<=[.!?])\s+"

WS_TOKEN = r"[^\t\n\x0B\f\r\x1C-\x1F\x85\p{Z}]+"  # Python str.split(): runs of non-whitespace
TFIDF_TOKEN = r"[\p{L}\p{N}_]{2,}"  # sklearn default token pattern (?u)\b\w\w+\b
WORD_RUN = r"[\p{L}\p{N}_]+"  # maximal runs of Python word characters
OTHER_SPACE = r"[\t\n\x0B\f\r\x1C-\x1F\x85\p{Z}&&[^ ]]+"  # Python whitespace but the plain space
NO_WORD = r"[^ \p{L}\p{N}_]+"  # what parts word runs, but the plain space
PLAIN_NUMBER = py_regex(PLAIN_NUMBER_PY)
NUMBER_PCT = py_regex(NUMBER_PCT_PY)
CAPITALISED_RUN = py_regex(CAPITALISED_RUN_PY)
MONEY_NUMBER = py_regex(MONEY_NUMBER_PY)
SENTENCE_BREAK = py_regex(SENTENCE_BREAK_PY)
EDGE_SPACE = py_regex(r"^\s+|\s+$")


def _lit(p: str) -> Column:
    return F.lit(p)


def extract_all(text: Column, pattern: str) -> Column:
    """All non-overlapping matches (``re.findall`` without groups)."""
    return F.regexp_extract_all(text, _lit(pattern), F.lit(0))


def _spaced(text: Column, gap: str) -> Column:
    """What stands between gaps and plain spaces. Most gaps are plain spaces, so
    that only the others need the pattern and the rest is cut at a character."""
    return F.array_remove(F.split(F.regexp_replace(text, gap, " "), " "), "")


def py_strip(text: Column) -> Column:
    """Python ``str.strip()``: remove leading/trailing whitespace of any kind."""
    return F.regexp_replace(text, _lit(EDGE_SPACE), F.lit(""))


def ws_tokens(text: Column) -> Column:
    """TX1: Python ``split()`` tokens (no empty tokens)."""
    return _spaced(text, OTHER_SPACE)


def word_runs(text: Column) -> Column:
    """Maximal runs of word characters. A ``\\bw\\b`` match is exactly a run
    equal to ``w``, and TF-IDF tokens are the runs of length >= 2, so one
    extraction serves both."""
    return _spaced(text, NO_WORD)


def count_words(runs_lower: Column, words) -> Column:
    """Number of whole-word occurrences of any of ``words``."""
    return F.size(F.filter(runs_lower, lambda t: t.isin(*words)))


_STOP_SQL = ", ".join(f"'{w}'" for w in STOP_WORDS)


def tfidf_tokens_sql(text_sql: str) -> Column:
    """TX2 of a SQL expression (e.g. a column name): lower-cased word tokens of
    length >= 2 minus the English stop list, duplicates kept (they are term
    counts). One SQL string is a single call instead of one per stop word when
    the plan is constructed; ``NOT IN`` becomes a hash-set lookup per token."""
    return tfidf_from_runs_sql(f"split(regexp_replace(lower({text_sql}), r'{NO_WORD}', ' '), ' ')")


def tfidf_tokens(text: Column) -> Column:
    """TX2 of a column expression, e.g. inside a lambda: the same tokens."""
    return F.filter(extract_all(F.lower(text), TFIDF_TOKEN), lambda t: ~t.isin(*STOP_WORDS))


def tfidf_from_runs_sql(runs_sql: str) -> Column:
    """TX2 of a SQL expression naming an array of word runs: the same tokens."""
    return F.expr(f"filter({runs_sql}, t -> length(t) >= 2 AND NOT t IN ({_STOP_SQL}))")


def plain_numbers(text: Column) -> Column:
    """TX3: plain numbers as doubles (``1,247`` gives 1 and 247)."""
    return F.transform(extract_all(text, PLAIN_NUMBER), lambda x: x.cast("double"))


def percent_numbers(text: Column) -> Column:
    """TX4: distinct number strings with an optional percent sign."""
    return F.array_distinct(extract_all(text, NUMBER_PCT))


def entities(text: Column) -> Column:
    """TX5: distinct capitalised runs and money/number strings."""
    return F.array_union(extract_all(text, CAPITALISED_RUN), extract_all(text, MONEY_NUMBER))


def sentences(text: Column, min_len: int = 10) -> Column:
    """TX6: strip, split after ``.!?`` + whitespace, keep stripped pieces longer than ``min_len``."""
    pieces = F.split(py_strip(text), SENTENCE_BREAK, -1)
    stripped = F.transform(pieces, py_strip)
    return F.filter(stripped, lambda s: F.length(s) > min_len)


def let(value: Column, body) -> Column:
    """Bind ``value`` once to a lambda variable and evaluate ``body(var)``.

    Referencing the variable several times inside ``body`` costs nothing,
    and if Catalyst inlines the expression elsewhere (predicate pushdown,
    collapsed projections) its size stays linear.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def runs(sorted_arr: Column, value: str = "v", count: str = "cnt") -> Column:
    """Run-length encode a sorted array: ``array<struct<v, cnt:int>>``.

    Linear after the sort: run starts are the positions whose element
    differs from its predecessor (plain int positions, with the array length
    as end sentinel); the distance to the next start is the run length. The
    array is a ``let``-bound variable, so indexed access is O(1).
    """

    def body(s):
        n = F.size(s)
        starts = F.filter(
            F.sequence(F.lit(0), n),
            lambda i: (i == 0) | (i == n) | (F.get(s, i) != F.get(s, i - 1)),
        )

        def counted(st):
            return F.transform(
                F.slice(st, 1, F.greatest(F.size(st) - 1, F.lit(0))),
                lambda p, k: F.struct(F.get(s, p).alias(value), (F.get(st, k + 1) - p).alias(count)),
            )

        return let(starts, counted)

    return let(sorted_arr, body)


def term_counts(tokens: Column) -> Column:
    """Distinct terms with raw counts, ``array<struct<term, tf>>`` sorted by term."""
    return runs(F.sort_array(tokens), "term", "tf")

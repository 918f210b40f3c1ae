"""The translated patterns against Python's ``re`` on random strings built to
stress word boundaries, digits and whitespace (one Spark job for all)."""

import random
import re

from pyspark.sql import functions as F

from relmine.functions import text as T
from relmine.operators import features as QF

ALPHABET = list("abcdeWhoListAZ012789%$,._-?! ") + [
    "é", "É", "ç", "ü", "ß", "́", "̈", "٣", "²", " ", " ", "\x1c", "\t", "\n", "　", "K", "ſ",
]
WORDS = ["who", "Who", "dr.", "Dr", "list", "name", "professor", "12%", "3.5", "$1,200", "Harbor Ferry", "exactly 5"]


def _strings(n=2000, seed=5):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        parts = [rnd.choice(WORDS) if rnd.random() < 0.3 else rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 25))]
        out.append("".join(parts))
    return out


def test_translated_patterns_match_python_re(spark):
    texts = _strings()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    cases = {
        "plain": T.PLAIN_NUMBER_PY,
        "pct": T.NUMBER_PCT_PY,
        "caps": T.CAPITALISED_RUN_PY,
        "money": T.MONEY_NUMBER_PY,
    }
    cols = [F.regexp_extract_all("t", F.lit(T.py_regex(p)), F.lit(0)).alias(k) for k, p in cases.items()]
    flags = {
        "person": "|".join(QF.PERSON_PATTERNS),
        "listing": QF.LIST_PATTERN,
        "temporal": "|".join(QF.TEMPORAL_PATTERNS),
        "numeric": "|".join(QF.NUMERIC_PATTERNS),
    }
    cols += [F.col("t").rlike("(?iu)" + T.py_regex(p)).alias(k) for k, p in flags.items()]
    cols += [T.ws_tokens(F.col("t")).alias("ws"), T.sentences(F.col("t")).alias("sent")]
    got = {r.id: r for r in df.select("id", *cols).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        for k, p in cases.items():
            assert r[k] == re.findall(p, t), (k, repr(t))
        for k, p in flags.items():
            assert r[k] == bool(re.search(p, t, re.IGNORECASE)), (k, repr(t))
        assert r["ws"] == t.split(), repr(t)
        sents = [s.strip() for s in re.split(r"(?<=[.!?])\s+", t.strip()) if len(s.strip()) > 10]
        assert r["sent"] == sents, repr(t)

"""Operator 5: personal data by pattern, checksum and context.

Regular expressions propose spans; a validator of each kind confirms or drops
them (value ranges, digit counts, Luhn, a country's length and ISO 7064 mod 97); a
span's score is its kind's prior, raised where a word that announces such data
stands shortly before it, and lowered where one does that tells of other
numbers (a version, a serial number) and none announces it. Masking leaves
spans below its threshold as they are. Offsets are code points, end exclusive. Every pattern is matched
in time linear in the text: runs are taken possessively and an address is
found from its ``@``.

Row-local, no shuffle. Null counts as empty and has no spans; repeated rows
give repeated results; other columns of the input stay.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relmine.llm.common import documents, free_name

# Kinds in the order of the digest, the proposing patterns,
# priors, and words that announce a kind.
KINDS = ("email", "ip", "card", "phone", "iban")
BASE_KINDS = KINDS[:4]
LOCAL_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])([A-Z]{2})[0-9]{2}(?=\x20?[A-Z0-9])")  # how it begins
# Characters of an account number by country (ISO 13616).
IBAN_CHARS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22,
    "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22,
    "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30,
    "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31,
    "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24,
    "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
IBAN_REST = {n: re.compile(rf"(?:\x20?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])") for n in {*IBAN_CHARS.values()}}
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.8}
CONTEXT = {
    "email": ("mail", "contact", "write", "reach"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "call", "tel", "mobile"),
    "iban": ("iban", "account", "bank", "transfer"),
}
CONTRARY = {
    "email": ("example", "placeholder"),
    "ip": ("version", "release", "section"),
    "card": ("serial", "isbn", "invoice"),
    "phone": ("formula", "equation", "serial"),
    "iban": ("serial", "part number"),
}
CONTEXT_CHARS = 40  # how far before a span such a word may stand
CONTEXT_SHARE = 0.5  # of the way from the prior to certainty, or down to nothing
NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(account: str) -> bool:
    """ISO 7064: the first four characters moved to the end, letters as
    10 to 35, leaves 1."""
    turned = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _emails(text: str):
    at, floor = text.find("@"), 0
    while at >= 0:
        found = DOMAIN.match(text, at)
        if found:
            start = floor + len(text[floor:at].rstrip(LOCAL_CHARS))
            if start < at:
                yield start, found.end()
                floor = found.end()
        floor = max(floor, at + 1)
        at = text.find("@", floor)


def _ibans(text: str):
    """Account numbers as long as their country says, what follows left out."""
    floor = 0
    for found in IBAN.finditer(text):
        if found.start() >= floor and (n := IBAN_CHARS.get(found[1])) and (rest := IBAN_REST[n].match(text, found.end())):
            if mod97(text[found.start() : rest.end()].replace(" ", "")):
                yield found.start(), rest.end()
                floor = rest.end()


def _valid(kind: str, value: str) -> bool:
    if kind == "ip":
        return all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in value.split("."))
    digits = NOT_DIGIT.sub("", value)
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 10 <= len(digits) <= 15
    return True  # addresses and account numbers are proposed when they are valid


def span_score(kind: str, before: str) -> float:
    """The prior, adjusted by the words of the text before a span."""
    before, prior = before.lower(), PRIOR[kind]
    if any(w in before for w in CONTEXT[kind]):
        return round(prior + (1 - prior) * CONTEXT_SHARE, 4)
    if any(w in before for w in CONTRARY[kind]):
        return round(prior * CONTEXT_SHARE, 4)
    return prior


def find_spans(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by start, then kind as listed."""
    out = []
    for order, kind in enumerate(KINDS):
        find = {"email": _emails, "iban": _ibans}.get(kind)
        proposed = find(text) if find else (m.span() for m in {"ip": IP, "card": CARD, "phone": PHONE}[kind].finditer(text))
        for start, end in proposed:
            if _valid(kind, text[start:end]):
                out.append((start, order, kind, end, span_score(kind, text[max(0, start - CONTEXT_CHARS) : start])))
    return [(kind, start, end, score) for start, _, kind, end, score in sorted(out)]


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])


def detect(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """``docs`` with an array of spans (kind, start, end, score) in ``out``,
    which replaces a column of that name."""
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != out])
    schema = kept.withColumn(out, F.expr("cast(array() as array<struct<kind:string,start:bigint,end:bigint,score:double>>)")).schema

    def run(batches):
        for batch in batches:
            spans = [
                [dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in find_spans(t.as_py() or "")]
                for t in batch.column(batch.schema.get_field_index(text))
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, pa.list_(SPAN))], [*batch.schema.names, out])

    return kept.mapInArrow(run, schema)


def masked(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """The text with each span replaced by its kind in angle brackets;
    spans that begin inside an earlier one are covered by it."""
    out, at = [], 0
    for kind, start, end, _ in spans:
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, text: str = "text", least_score: float = 0.5) -> DataFrame:
    """``docs`` with personal data of at least ``least_score`` masked in
    ``text``. All rows and columns stay; a null text stays null."""

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text)
            texts = []
            for t in batch.column(at):
                t = t.as_py()
                texts.append(t and masked(t, [s for s in find_spans(t) if s[3] >= least_score]))
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def digests(docs: DataFrame) -> DataFrame:
    """Per document: counts of the base kinds, SHA-256 of the base spans and
    all spans, written ``kind:start:end`` and joined by commas, and the
    spans' scores in the same order (array)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spans = free_name(docs.columns, "pii")
    found = detect(docs, out=spans)

    def joined(base: bool):
        held = F.filter(spans, lambda s: s["kind"].isin(*BASE_KINDS)) if base else F.col(spans)
        return F.array_join(F.transform(held, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, BASE_KINDS), F.sha2(joined(True), 256).alias("base_sha256"), joined(False).alias("spans"), F.col(f"{spans}.score").alias("scores"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))


def base_digest(spans: list[tuple[str, int, int, float]]) -> str:
    """The digest of ``digests`` for one document's spans."""
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e, _ in spans if k in BASE_KINDS).encode()).hexdigest()

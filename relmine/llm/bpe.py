"""Operator 1: byte-level BPE encoding and decoding as a streaming transducer.

``Merges`` holds a tokenizer's merge list and computes its *sufficient
lookahead*: the number of bytes after which no continuation of the text can
change a token any more. ``Encoder`` feeds on a text in chunks, emits tokens
once they are stable and keeps only the unstable tail, so its memory does not
grow with the text; ``TextMachine`` turns ids back into text incrementally.

Lookahead. Merges are applied in order of rank. Compare the segmentations of
one prefix under two continuations. At first they agree up to the prefix's
end. They can drift apart only where a merge (a, b) takes the last agreeing
token ``a`` across that point under one continuation and not under the other;
the point of agreement then moves left by ``len(a)``. The next such merge has
a higher rank, and its right side starts with the former ``a``, since tokens
only grow. So the distance is at most the largest sum of ``len(a)`` over
chains of merges of rising rank in which each left side is a prefix of the
next merge's right side: a dynamic program over the merge list.

A token that ends at least that many bytes before the end of what has been
read is final, and BPE of the rest may restart at its end, because no merge
ever crosses a boundary of the final segmentation.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relmine.llm.common import documents, text_of

VOCABULARY = "byte_bpe_50k.json"
CHUNK_CHARS = 1 << 16  # code points that the encoder takes at a time
CACHE_UNITS = 250_000  # units remembered per generation, two generations

# Fixed value: the pre-tokenisation pattern of byte-level BPE vocabularies.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def tokenizer_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies:
    visible Latin-1 characters stand for themselves, the others are
    numbered from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Merges:
    """A byte-level BPE vocabulary with its merges in rank order."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        to_byte = {c: b for b, c in enumerate(byte_letters())}
        vocab: dict[str, int] = model["vocab"]
        size = 1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])])
        self.bytes_of: list[bytes] = [b""] * size
        for word, i in vocab.items():
            self.bytes_of[i] = bytes(to_byte[c] for c in word)
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for word, i in self.special.items():
            self.bytes_of[i] = word.encode()
        self.byte_id = [vocab[c] for c in byte_letters()]
        self.rank: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for pair in model["merges"]:
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.rank.setdefault((vocab[left], vocab[right]), len(self.made))
            self.made.append(vocab[left + right])
        self.lookahead = self._sufficient_lookahead()

    def _sufficient_lookahead(self) -> int:
        farthest: dict[bytes, int] = {}  # left side -> longest chain that ends with it
        most = 0
        for left, right in sorted(self.rank, key=self.rank.__getitem__):
            a, b = self.bytes_of[left], self.bytes_of[right]
            chain = len(a) + max((farthest.get(b[:n], 0) for n in range(1, len(b) + 1)), default=0)
            farthest[a] = max(chain, farthest.get(a, 0))
            most = max(most, chain)
        return most

    def merge(self, data: bytes) -> list[int]:
        """BPE of one piece that is held whole: the pair of lowest rank is
        merged, leftmost first, until none is left."""
        ids = [self.byte_id[b] for b in data]
        rank, none = self.rank.get, len(self.made)
        ranks = [rank(p, none) for p in zip(ids, ids[1:], strict=False)]
        while ranks and (best := min(ranks)) != none:
            i = ranks.index(best)
            ids[i] = self.made[best]
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank((ids[i], ids[i + 1]), none)
            if i:
                ranks[i - 1] = rank((ids[i - 1], ids[i]), none)
        return ids


class Run:
    """BPE of one piece that arrives in parts and may be of any length:
    tokens leave once they lie ``lookahead`` bytes behind."""

    def __init__(self, merges: Merges):
        self.merges, self.held = merges, b""
        self.window = max(512, 4 * merges.lookahead)

    def feed(self, data: bytes) -> list[int]:
        out: list[int] = []
        for start in range(0, len(data), self.window):
            self.held += data[start : start + self.window]
            if len(self.held) < self.window:
                continue
            end, stable = 0, len(self.held) - self.merges.lookahead
            for token in self.merges.merge(self.held):
                if end + len(self.merges.bytes_of[token]) > stable:
                    break
                end += len(self.merges.bytes_of[token])
                out.append(token)
            self.held = self.held[end:]
        return out

    def close(self) -> list[int]:
        out, self.held = self.merges.merge(self.held), b""
        return out


class _Units(dict):
    """Ids of units (texts that begin with at most one space and are cut
    where no piece can cross). Two generations bound its size; what is in
    use survives."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.old = encode, {}

    def __missing__(self, unit: str) -> tuple[int, ...]:
        if len(self) >= CACHE_UNITS:
            self.old = dict(self)
            self.clear()
        ids = self.old.get(unit)
        if ids is None:
            ids = self.encode(unit)
        if len(unit) < 64:
            self[unit] = ids
        return ids


class Encoder:
    """Text to ids, as the tokenizer's own library does without added
    special tokens. One encoder serves many texts in turn."""

    def __init__(self, merges: Merges, piece: Callable[[str], Sequence[int]] | None = None):
        """``piece`` encodes one piece that is held whole (default: ``Run``)."""
        self.merges, self.piece = merges, piece or self._piece
        self.pieces = regex.compile(PIECES)
        self.specials = regex.compile("|".join(map(regex.escape, sorted(merges.special, key=len, reverse=True))) or r"(?!)")
        # a space that does not begin a piece: more white space or nothing follows
        self.odd_space = regex.compile(r" (?:\s|\Z)")
        self.cut = regex.compile(r" (?=\S)")
        self.units = _Units(self._unit)

    def _unit(self, unit: str) -> tuple[int, ...]:
        word = unit[1:] if unit[0] == " " else unit
        if word.isalpha():  # one piece
            return tuple(self.piece(unit))
        if word[-1:] in ",.;:!?" and word[-2:-1].isalnum():  # a piece ends between the two
            return self.units[unit[:-1]] + self.units[unit[-1]]
        return tuple([i for piece in self.pieces.findall(unit) for i in self.piece(piece)])

    def _piece(self, piece: str) -> list[int]:
        run = Run(self.merges)
        return run.feed(piece.encode()) + run.close()

    def encode(self, text: str) -> Iterator[list[int]]:
        """Lists of ids, one after the other; their memory is bounded by the
        chunk, whatever the text's length."""
        start = 0
        for found in self.specials.finditer(text):
            yield from self._ordinary(text, start, found.start())
            yield [self.merges.special[found.group()]]
            start = found.end()
        yield from self._ordinary(text, start, len(text))

    def _ordinary(self, text: str, start: int, end: int) -> Iterator[list[int]]:
        while end - start > CHUNK_CHARS:
            # cut before the last space in the chunk that surely begins a piece
            at = start + CHUNK_CHARS
            while at > start and not (text[at] == " " and at + 1 < end and not text[at + 1].isspace()):
                at = text.rfind(" ", start, at)
            if at <= start:
                start = yield from self._long(text, start, end)
            else:
                yield self._chunk(text[start:at])
                start = at
        if start < end:
            yield self._chunk(text[start:end])

    def _long(self, text: str, start: int, end: int):
        """One piece after another without a cut in sight; a piece longer
        than a chunk goes through ``Run``. Returns where it stopped."""
        limit = start + CHUNK_CHARS
        while start < min(limit, end):
            found = self.pieces.match(text, start, end)
            stop = found.end()
            if stop - start <= CHUNK_CHARS:
                yield list(self.piece(text[start:stop]))
            else:
                run = Run(self.merges)
                for i in range(start, stop, CHUNK_CHARS):
                    yield run.feed(text[i : min(i + CHUNK_CHARS, stop)].encode())
                yield run.close()
            start = stop
        return start

    def _chunk(self, chunk: str) -> list[int]:
        if self.odd_space.search(chunk) is None:
            words = chunk.split(" ")
        else:
            words = self.cut.split(chunk)
        out = list(self.units[words[0]]) if words[0] else []
        units = self.units
        for ids in [units[" " + w] for w in words[1:]]:
            out += ids
        return out


class TextMachine:
    """Ids to text, incrementally: holds back the bytes of a character that
    is not complete yet; malformed bytes become U+FFFD as they are found."""

    def __init__(self, merges: Merges):
        self.bytes_of, self.pending = merges.bytes_of, b""

    def feed(self, ids: Iterable[int]) -> str:
        data = self.pending + b"".join(map(self.bytes_of.__getitem__, ids))
        hold = self._unfinished(data)
        self.pending = data[len(data) - hold :]
        return data[: len(data) - hold].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.pending = self.pending, b""
        return rest.decode("utf-8", "replace")

    @staticmethod
    def _unfinished(data: bytes) -> int:
        """Bytes at the end that may begin a character: a lead byte of which
        fewer continuation bytes follow than it announces."""
        for back in range(1, min(3, len(data)) + 1):
            b = data[-back]
            if b >= 0xC0:
                need = 2 if b < 0xE0 else 3 if b < 0xF0 else 4
                return back if need > back else 0
            if b < 0x80:
                return 0
        return 0


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary; read once per Python worker."""
    return Encoder(Merges(path))


def encode_documents(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (array<int>), null text counting as empty.

    Row-local: no shuffle; columns of the input stay, an existing ``ids``
    column is replaced."""
    at = path or tokenizer_path()
    keep = [c for c in docs.columns if c != "ids"]
    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).withColumn("ids", F.array(F.lit(0))).schema

    def run(batches):
        enc = encoder(at)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            ids = pa.array([[i for part in enc.encode(t.as_py() or "") for i in part] for t in column], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], [*batch.schema.names, "ids"])

    return docs.select(*[F.col(f"`{c}`") for c in keep]).mapInArrow(run, schema)


def decode_documents(docs: DataFrame, path: str | None = None, ids: str = "ids") -> DataFrame:
    """``docs`` with ``decoded`` (string), the text of the array ``ids``;
    null ids give an empty text."""
    at = path or tokenizer_path()
    keep = [c for c in docs.columns if c != "decoded"]
    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).withColumn("decoded", F.lit("")).schema

    def run(batches):
        merges = encoder(at).merges
        for batch in batches:
            texts = []
            for row in batch.column(batch.schema.get_field_index(ids)):
                machine, numbers = TextMachine(merges), row.as_py() or []
                parts = [machine.feed(numbers[i : i + CHUNK_CHARS]) for i in range(0, len(numbers), CHUNK_CHARS)]
                texts.append("".join([*parts, machine.close()]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return docs.select(*[F.col(f"`{c}`") for c in keep]).mapInArrow(run, schema)


def encoding_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per document: ``doc_id``, ``n_tokens``, SHA-256 of its decimal ids
    joined by commas and of the text decoded from them.

    Encoder, both digests and the decoder advance chunk by chunk, so a
    worker holds one chunk's ids at a time. Null and empty texts give no
    ids. Repeated rows stay repeated rows."""
    at = path or tokenizer_path()
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches):
        enc = encoder(at)
        decimal = [str(i) for i in range(len(enc.merges.bytes_of))]
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                machine, ids_sum, text_sum, n = TextMachine(enc.merges), hashlib.sha256(), hashlib.sha256(), 0
                for ids in enc.encode(text.as_py()):
                    if ids:
                        ids_sum.update((("," if n else "") + ",".join(map(decimal.__getitem__, ids))).encode())
                        text_sum.update(machine.feed(ids).encode())
                        n += len(ids)
                text_sum.update(machine.close().encode())
                rows.append((n, ids_sum.hexdigest(), text_sum.hexdigest()))
            n, ids_hex, text_hex = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, schema)


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_digests(documents(spark, sf_dir))

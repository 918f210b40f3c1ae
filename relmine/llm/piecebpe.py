"""Operator 13: SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text is normalised (one leading space where the model asks for it, spaces
as U+2581) and cut into words where no piece of the vocabulary can cross:
before a run of U+2581 that follows another character, and around line feeds
if no piece holds one. All distinct words of a slice of documents are encoded
together. Their symbols lie in one flat array; each round

1. finds the minimum rank of the pairs of each word (a segmented minimum),
2. merges every pair of that rank at once, of overlapping ones the leftmost
   and then every second,
3. compacts the array and ranks the pairs beside a merge anew; words without
   a pair leave it,

until no pair remains. Merging all pairs of one rank at once is the same as
merging them one after the other unless a piece that begins or ends with the
merged piece ranks no worse than it: the new pair would then come first. The
ranks for which the vocabulary has such a piece are known beforehand; a word
that holds two pairs of one, and a word of more than ``LONG`` symbols, is
merged one pair at a time from a heap, which takes n log n steps.

What is left becomes ids; a character without an id becomes its bytes.
Encoding is row-local: no shuffle, and a worker holds one slice of texts, its
distinct words and a bounded memory of earlier words.

Defined cases: null and empty texts have no ids; texts of any length are one
row each; rows that repeat stay repeated; an empty table gives an empty
result; columns of clashing names are replaced by the ones added.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relmine.llm.common import documents, text_of

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
SLICE_CHARS = 1 << 21  # of the texts, or words, that are encoded together
LONG = 1024  # symbols of a word from which on it is merged from a heap
KEPT_WORDS, KEPT_CHARS = 500_000, 1 << 25  # words remembered, and their characters
NO_RANK = np.iinfo(np.int32).max
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # fixed values: kinds of pieces in model files


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _message(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a serialised protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or number()
        yield key >> 3, data[at : at + size]
        at += size


Word = tuple[tuple[int, ...], str, str]  # ids, the same in decimal joined by commas, decoded text


class Vocabulary:
    """Pieces, merges and normalisation of a SentencePiece BPE model file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            fields = list(_message(f.read()))
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        for piece in (dict(_message(v)) for k, v in fields if k == 1):
            self.pieces.append(piece.get(1, b"").decode())
            scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
            self.kinds.append(piece.get(3, NORMAL))
        trainer = dict(_message(next((v for k, v in fields if k == 2), b"")))
        normalizer = dict(_message(next((v for k, v in fields if k == 3), b"")))
        if trainer.get(3) != 2 or normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1) or trainer.get(24):
            raise ValueError("a BPE model is needed that keeps white space, changes no character and puts spaces first")
        if {USER_DEFINED, UNUSED} & set(self.kinds):
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.prefix = SPACE if normalizer.get(3, 1) else ""
        self.unknown = self.kinds.index(UNKNOWN)
        self.byte_ids = [0] * 256
        for i, kind in enumerate(self.kinds):
            if kind == BYTE:
                self.byte_ids[int(self.pieces[i][3:5], 16)] = i
        self.has_bytes = BYTE in self.kinds
        self._rank(scores)

    def _rank(self, scores: list[float]) -> None:
        """Symbols are the normal pieces (by id) and then the characters that
        only occur inside pieces; pairs get the rank and symbol they make."""
        normal = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == NORMAL}
        if any(SPACE in p.lstrip(SPACE) for p in normal):
            raise ValueError("a piece has a space behind another character")
        self.symbol = dict(normal)
        for c in sorted({c for p in normal for c in p} - set(normal)):
            self.symbol[c] = len(self.pieces) + len(self.symbol) - len(normal)
        self.others = len(self.pieces) + len(self.symbol) - len(normal)  # symbols from here on: characters in no piece
        order = {s: r for r, s in enumerate(sorted({scores[i] for i in normal.values()}, reverse=True))}
        rank = {p: order[scores[i]] for p, i in normal.items()}
        made: dict[tuple[int, int], tuple[int, int]] = {}
        before_others = set()
        for p, i in normal.items():
            for cut in range(1, len(p)):
                left, right = self.symbol.get(p[:cut]), self.symbol.get(p[cut:])
                if left is None or right is None:
                    continue
                made[left, right] = (rank[p], i)
                for part in (p[:cut], p[cut:]):
                    if part in rank and len(part) > 1 and rank[p] <= rank[part]:
                        before_others.add(rank[part])
        self.made = made
        self.one_by_one = np.zeros(len(order) + 1, bool)
        self.one_by_one[list(before_others)] = True
        keys = np.array([a * self.others + b for a, b in made], np.int64)
        by = np.argsort(keys)
        self.pair_keys = keys[by]
        self.pair_ranks = np.array([r for r, _ in made.values()], np.int32)[by]
        self.pair_makes = np.array([i for _, i in made.values()], np.int32)[by]
        self.of_char = np.full(0x110000, -1, np.int32)
        for c, i in self.symbol.items():
            if len(c) == 1:
                self.of_char[ord(c)] = i
        # two characters that no piece has side by side are never merged
        couples = {ord(a) << 21 | ord(b) for p in normal for a, b in zip(p, p[1:], strict=False)}
        self.couples = np.array(sorted(couples), np.int64)
        ends = "" if any("\n" in p for p in normal) else "\n"
        self.word = re.compile(f"{SPACE}+[^{SPACE}{ends}]*|[^{SPACE}{ends}]+" + (f"|{ends}+" if ends else ""))

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of symbol pairs (``NO_RANK`` where none) and what they make."""
        keys = left.astype(np.int64) * self.others + right
        keys[(left >= self.others) | (right >= self.others)] = -1
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        found = self.pair_keys[at] == keys
        return np.where(found, self.pair_ranks[at], NO_RANK), self.pair_makes[at]

    def ids_of(self, symbol: int) -> tuple[int, ...]:
        if symbol < len(self.pieces):
            return (symbol,)
        if not self.has_bytes:
            return (self.unknown,)
        char = chr(symbol - self.others) if symbol >= self.others else next(c for c, i in self.symbol.items() if i == symbol)
        return tuple(self.byte_ids[b] for b in char.encode())


def merge_one_by_one(vocabulary: Vocabulary, symbols: list[int]) -> list[int]:
    """BPE of one word from a heap: best rank first, leftmost first."""
    n, made = len(symbols), vocabulary.made
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(*made[p], i, p) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)) if p in made]
    heap = [(rank, i, pair, new) for rank, new, i, pair in heap]
    heapq.heapify(heap)
    symbols = [*symbols, -1]
    while heap:
        _, i, pair, new = heapq.heappop(heap)
        j = after[i]
        if j >= n or symbols[i] != pair[0] or symbols[j] != pair[1]:
            continue
        symbols[i], symbols[j] = new, -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if found := made.get(p := (new, symbols[k])):
                heapq.heappush(heap, (found[0], i, p, found[1]))
        if (h := before[i]) >= 0 and (found := made.get(p := (symbols[h], new))):
            heapq.heappush(heap, (found[0], h, p, found[1]))
    return [s for s in symbols if s >= 0]


def merge_rounds(vocabulary: Vocabulary, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """BPE of many words at once. ``symbols``: those of all words, one word
    after the other; ``word``: the rising number of each symbol's word.
    Returns both for the merged words, in order."""
    done: list[tuple[np.ndarray, np.ndarray]] = []
    ranks, makes = np.full(len(symbols), NO_RANK, np.int32), np.zeros(len(symbols), np.int32)

    def rank_anew(at: np.ndarray) -> None:
        """Pairs that begin at ``at``."""
        at = at[(at >= 0) & (at < len(symbols))]
        inside = at[at + 1 < len(symbols)]
        inside = inside[word[inside] == word[inside + 1]]
        ranks[at] = NO_RANK
        ranks[inside], makes[inside] = vocabulary.pairs(symbols[inside], symbols[inside + 1])

    def single(gone: np.ndarray) -> None:
        """Words (given by a flag for each symbol) that are merged alone."""
        at = np.flatnonzero(gone)
        for part in np.split(at, np.flatnonzero(np.diff(word[at])) + 1):
            merged = merge_one_by_one(vocabulary, symbols[part].tolist())
            done.append((np.array(merged, np.int32), np.full(len(merged), word[part[0]])))

    rank_anew(np.arange(len(symbols)))
    while len(symbols):
        starts = np.flatnonzero(np.diff(word, prepend=word[0] - 1))
        sizes = np.diff(starts, append=len(word))
        least = np.minimum.reduceat(ranks, starts)
        finished = np.repeat(least == NO_RANK, sizes)
        best = (ranks == np.repeat(least, sizes)) & ~finished
        alone = (sizes > LONG) & (least != NO_RANK)
        risky = vocabulary.one_by_one[np.where(least == NO_RANK, 0, least)] & (least != NO_RANK)
        alone |= risky & (np.add.reduceat(best.astype(np.int32), starts) > 1)
        if finished.any():
            done.append((symbols[finished], word[finished]))
        stays = ~finished
        if alone.any():
            apart = np.repeat(alone, sizes)
            single(apart)
            stays &= ~apart
        if not stays.all():
            symbols, word, ranks, makes, best = symbols[stays], word[stays], ranks[stays], makes[stays], best[stays]
        at = np.flatnonzero(best)
        if not len(at):
            continue
        # of pairs that overlap in a row, the first, the third ...
        first = np.flatnonzero(np.diff(at, prepend=-2) != 1)
        place = np.arange(len(at)) - np.repeat(first, np.diff(first, append=len(at)))
        at = at[place % 2 == 0]
        symbols[at] = makes[at]
        stays = np.ones(len(symbols), bool)
        stays[at + 1] = False
        at = at - np.arange(len(at))  # where they are after the compaction
        symbols, word, ranks, makes = symbols[stays], word[stays], ranks[stays], makes[stays]
        rank_anew(np.concatenate([at - 1, at]))
    if not done:
        return symbols, word
    symbols, word = np.concatenate([s for s, _ in done]), np.concatenate([w for _, w in done])
    by = np.argsort(word, kind="stable")
    return symbols[by], word[by]


class Encoder:
    """Texts to ids and back, as the model's own library does without begin
    and end ids. One encoder serves many slices of texts."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.known: dict[str, Word] = {}
        self.kept_chars = 0
        v = vocabulary
        self.shown = [p.replace(SPACE, " ") if k == NORMAL else "" for p, k in zip(v.pieces, v.kinds, strict=True)]
        self.shown[v.unknown] = " ⁇ "  # fixed value: what stands for the unknown piece
        self.byte_at = {i: b for b, i in enumerate(v.byte_ids)} if v.has_bytes else {}
        self.byte_pieces = frozenset(self.byte_at)
        self.decimal = [str(i) for i in range(len(v.pieces))]

    def words(self, text: str) -> list[str]:
        """The words of a text after normalisation."""
        return self.vocabulary.word.findall(self.vocabulary.prefix + text.replace(" ", SPACE)) if text else []

    def encode_words(self, words: list[str]) -> list[tuple[int, ...]]:
        """Ids of words that no piece crosses."""
        v, out = self.vocabulary, []
        for group in _by_size(words, SLICE_CHARS):
            chars = np.frombuffer("".join(group).encode("utf-32-le"), np.uint32).astype(np.int64)
            sizes = np.fromiter(map(len, group), np.int64, len(group))
            owner = np.repeat(np.arange(len(group)), sizes)
            joined = (chars[:-1] << 21) | chars[1:]
            at = np.minimum(np.searchsorted(v.couples, joined), len(v.couples) - 1)
            cut = (v.couples[at] != joined) | (owner[:-1] != owner[1:])
            word = np.concatenate([[0], np.cumsum(cut)])
            symbols = v.of_char[chars]
            symbols = np.where(symbols < 0, v.others + chars, symbols).astype(np.int32)
            of_word = owner[np.flatnonzero(np.diff(word, prepend=-1))]
            symbols, word = merge_rounds(v, symbols, word)
            bounds = np.searchsorted(of_word[word], np.arange(len(group) + 1)).tolist()
            symbols = symbols.tolist()
            out += [self._ids(symbols[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
        return out

    def _ids(self, symbols: list[int]) -> tuple[int, ...]:
        if max(symbols) < len(self.vocabulary.pieces):
            return tuple(symbols)
        return tuple(i for s in symbols for i in self.vocabulary.ids_of(s))

    def encode(self, texts: Iterable[str]) -> Iterator[list[Word]]:
        """For each text its words, encoded, one after the other."""
        for some in _by_size(texts, SLICE_CHARS):
            cut = [self.words(t) for t in some]
            if len(self.known) > KEPT_WORDS or self.kept_chars > KEPT_CHARS:
                self.known.clear()
                self.kept_chars = 0
            new = list(set().union(*cut).difference(self.known))
            self.known.update(zip(new, self._encoded(self.encode_words(new)), strict=True))
            self.kept_chars += sum(map(len, new))
            for words in cut:
                yield list(map(self.known.__getitem__, words))

    def _encoded(self, words: list[tuple[int, ...]]) -> Iterator[Word]:
        """Words end where characters end, so their texts can be joined."""
        byte_pieces, shown, decimal = self.byte_pieces, self.shown, self.decimal
        for ids in words:
            if byte_pieces.isdisjoint(ids):
                text = "".join([shown[i] for i in ids])
            else:
                # behind another piece, so that no leading space is taken off
                start = self.vocabulary.unknown
                text = self.decode((start, *ids))[len(shown[start]) :]
            yield ids, ",".join([decimal[i] for i in ids]), text

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: a leading space that normalisation put there goes,
        byte pieces join to characters, malformed ones become U+FFFD each."""
        out: list[str] = []
        held = bytearray()
        first = bool(self.vocabulary.prefix)
        for i in ids:
            if i in self.byte_pieces:
                held.append(self.byte_at[i])
                continue
            if held:
                out.append(_characters(bytes(held)))
                held.clear()
                first = False
            text = self.shown[i]
            if first and text:
                first = False
                if text[0] == " " and self.vocabulary.kinds[i] == NORMAL:
                    text = text[1:]
            out.append(text)
        out.append(_characters(bytes(held)))
        return "".join(out)


def _by_size(texts: Iterable[str], most: int) -> Iterator[list[str]]:
    """Consecutive texts of about ``most`` characters together."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t) + 1
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _characters(data: bytes) -> str:
    """UTF-8 to text; each byte that is part of no character is a U+FFFD."""
    out, at = [], 0
    while at < len(data):
        try:
            out.append(data[at:].decode())
            break
        except UnicodeDecodeError as e:
            out.append(data[at : at + e.start].decode() + "�")
            at += e.start + 1
    return "".join(out)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The worker's encoder for a model; read once per Python worker."""
    return Encoder(Vocabulary(path))


def _others(docs: DataFrame, name: str) -> DataFrame:
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != name])


def encode_documents(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (array<int>); null and empty texts have none."""
    at, kept = path or model_path(), _others(docs, "ids")

    def run(batches):
        enc = encoder(at)
        for batch in batches:
            texts = (t.as_py() or "" for t in batch.column(batch.schema.get_field_index(text)))
            ids = pa.array([[i for ids, _, _ in words for i in ids] for words in enc.encode(texts)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], [*batch.schema.names, "ids"])

    return kept.mapInArrow(run, kept.withColumn("ids", F.array(F.lit(0))).schema)


def decode_documents(docs: DataFrame, path: str | None = None, ids: str = "ids") -> DataFrame:
    """``docs`` with ``decoded``, the text of the array ``ids`` (null: empty)."""
    at, kept = path or model_path(), _others(docs, "decoded")

    def run(batches):
        enc = encoder(at)
        for batch in batches:
            texts = [enc.decode(row.as_py() or ()) for row in batch.column(batch.schema.get_field_index(ids))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return kept.mapInArrow(run, kept.withColumn("decoded", F.lit("")).schema)


def encoding_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per document: ``doc_id``, ``n_tokens``, SHA-256 of its decimal ids
    joined by commas and of the text decoded from them."""
    at = path or model_path()
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches):
        enc = encoder(at)
        skipped = len(enc.vocabulary.prefix)
        for batch in batches:
            rows = []
            for words in enc.encode(t.as_py() for t in batch.column("text")):
                ids = ",".join([decimal for _, decimal, _ in words])
                text = "".join([decoded for _, _, decoded in words])[skipped:]
                rows.append((ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
            n, ids_hex, text_hex = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, schema)


def op13_merge_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_digests(documents(spark, sf_dir))

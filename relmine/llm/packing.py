"""Operator 3: cost-balanced packing of documents into training sequences.

Every document is tokenised once. Its whole runs of ``capacity`` ids are
sequences by themselves; what is left (fewer ids than a sequence holds) goes
to a *cell*, a random share of all pieces of bounded size. In a cell the
pieces are taken in descending length; each goes to the sequence of lowest
attention cost (``linear * n + quadratic * n * n`` summed over its pieces)
among those that still have room for it. When none has room, the piece is cut
and fills the roomiest one. A cell has as many sequences as its tokens need,
so the padding of all its sequences together is less than one sequence.

One shuffle, of the pieces; full pieces travel as their checksum alone unless
the ids are asked for. Cells are dealt by a hash of the whole piece and of the
partition it is read in, so neither a long document nor a frequent source or
id gathers in a task, and equal rows gather only as far as one task reads them.

Defined cases: null text counts as empty, an empty text is its end id alone;
rows that repeat are packed as often as they occur; an empty table gives no
pieces; other columns of the input are not used.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relmine.llm.common import documents, text_of

CAPACITY = 2048
END_ID = 1  # closes every document
CELL_PIECES = 4096  # pieces that a cell holds on average
LINEAR, QUADRATIC = 1.0, 1.0 / CAPACITY
RANKS = "byte_bpe_50k.tiktoken"
ORDINARY = "<|endoftext|>"  # fixed value: the vocabulary's special text
SPECIAL_ID = 50256  # fixed value: its id


def ranks_path(name: str = RANKS) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def _encoding(path: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={ORDINARY: SPECIAL_ID})


def token_ids(text: str, path: str) -> np.ndarray:
    """Ids of a text and its end id; the special text stands for its own id."""
    ids = _encoding(path).encode(text, allowed_special="all")
    ids.append(END_ID)
    return np.array(ids, dtype="<u2")


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def balance(lengths: np.ndarray, capacity: int = CAPACITY, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """Assign pieces, given in descending length, to sequences.

    Returns (piece, start within it, length, sequence, offset). Sequences
    number ``ceil(sum / capacity)``."""
    count = -(-int(lengths.sum()) // capacity)
    cost, room = np.zeros(count), np.full(count, capacity, dtype=np.int64)
    out = []
    for piece, length in enumerate(lengths.tolist()):
        start = 0
        while start < length:
            rest = length - start
            fits = np.flatnonzero(room >= rest)
            if fits.size:
                at, take = int(fits[cost[fits].argmin()]), rest
            else:
                at = int(room.argmax())
                take = int(room[at])
            out.append((piece, start, take, at, capacity - int(room[at])))
            cost[at] += linear * take + quadratic * take * take
            room[at] -= take
            start += take
    return out


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """Pieces of all documents: ``doc_id``, ``start``, ``length``,
    ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset`` and, with
    ``with_ids``, ``ids`` (little-endian unsigned 16-bit)."""
    at = path or ranks_path()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    rows, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    cells = max(1, -(-(rows + size // capacity) // CELL_PIECES))

    def cut(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = token_ids(text.as_py(), at)
                for start in range(0, len(ids), capacity):
                    part = ids[start : start + capacity]
                    carried = part.tobytes() if with_ids or len(part) < capacity else None
                    rows.append((doc, start, _crc(part) if len(part) == capacity else 0, len(ids), len(part), carried))
                if len(rows) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    pieces = docs.mapInArrow(cut, "doc_id long, start long, ids_crc32 long, doc_tokens long, length long, ids binary")
    piece = F.xxhash64("doc_id", "start", "ids_crc32", "doc_tokens", "length", "ids", F.spark_partition_id())
    pieces = pieces.withColumn("cell", F.pmod(piece, F.lit(cells)))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    types = [pa.int64()] * 7 + [pa.binary()] * with_ids

    def fill(table: pa.Table) -> pa.Table:
        col = {c: table.column(c).to_pylist() for c in ("doc_id", "start", "ids_crc32", "doc_tokens", "length", "ids")}
        none = -(1 << 63)
        order = sorted(range(table.num_rows), key=lambda i: (-col["length"][i], none if col["doc_id"][i] is None else col["doc_id"][i], col["start"][i], col["ids"][i] or b""))
        base = table.column("cell")[0].as_py() << 32
        whole = [i for i in order if col["length"][i] == capacity]
        out = [(col["doc_id"][i], col["start"][i], capacity, col["ids_crc32"][i], col["doc_tokens"][i], base + n, 0, col["ids"][i]) for n, i in enumerate(whole)]
        rest = order[len(whole) :]
        for piece, start, length, sequence, offset in balance(np.array([col["length"][i] for i in rest], dtype=np.int64), capacity):
            i = rest[piece]
            ids = np.frombuffer(col["ids"][i], dtype="<u2")[start : start + length]
            out.append((col["doc_id"][i], col["start"][i] + start, length, _crc(ids), col["doc_tokens"][i], base + len(whole) + sequence, offset, ids.tobytes()))
        columns = list(zip(*out, strict=True))[: len(types)]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names + ["ids"] * with_ids)

    shape = ", ".join(f"{n} long" for n in names) + ", ids binary" * with_ids
    return pieces.groupBy("cell").applyInArrow(fill, shape)


def op3_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), with_ids=False)

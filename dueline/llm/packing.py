"""Cost-balanced packing of documents into token sequences.

The cost of a piece of n tokens is ``linear * n + quadratic * n * n`` (attention stays inside a piece).
Documents, dearest first, go to the cheapest sequence that has room for them; where none has, the
cheapest with any room is filled and the rest of the document goes on. Room and tokens are equal: of T
tokens, T // capacity sequences are full, and the rest makes sequences of 2**k tokens by its binary
digits, which need no padding either. So nothing is padded.

Packing works on windows of a partition, one after the other: no shuffle, and memory for one window.
Documents are read row by row; null ids and repeated ids are packed like any other row, an empty text
is its end token. ``sequence_id`` is the partition's number in the upper bits, then a count.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dueline.llm.shared import map_batches, text_or_empty
from dueline.llm.tokens import documents_of, word_tokens

#: Tokens of a window, at least: 512 sequences of 4096.
WINDOW_TOKENS = 1 << 21


def capacities(total: int, capacity: int) -> list[int]:
    """Lengths of sequences that hold exactly so many tokens."""
    rest = total % capacity
    return [capacity] * (total // capacity) + [1 << k for k in reversed(range(rest.bit_length())) if rest >> k & 1]


def assign(lengths: list[int], capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents of these lengths."""
    room = np.array(capacities(sum(lengths), capacity), dtype=np.int64)
    size, cost = room.copy(), np.zeros(len(room))
    pieces = []

    def put(doc: int, start: int, n: int, seq: int) -> None:
        pieces.append((doc, start, n, seq, int(size[seq] - room[seq])))
        room[seq] -= n
        cost[seq] += linear * n + quadratic * n * n

    parts, full = [], 0
    for doc, n in enumerate(lengths):
        for start in range(0, n - n % capacity, capacity):
            put(doc, start, capacity, full)  # a whole sequence; sequences of this length come first
            full += 1
        if n % capacity:
            parts.append((n % capacity, doc, n - n % capacity))
    parts.sort(key=lambda p: (-p[0], p[1]))
    for n, doc, start in parts:
        while n:
            fits = np.where(room >= n, cost, np.inf)
            seq = int(fits.argmin())
            if room[seq] < n:
                seq = int(np.where(room > 0, cost, np.inf).argmin())
            part = min(n, int(room[seq]))
            put(doc, start, part, seq)
            n, start = n - part, start + part
    return pieces


def pack(
    docs: DataFrame,
    vocabulary: str,
    end_id: int,
    capacity: int = 4096,
    linear: float = 1.0,
    quadratic: float = 1 / 4096,
    id_column: str = "doc_id",
    text_column: str = "text",
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked
    for, ids. ``vocabulary`` is a tokenizers file whose tokens never cross white space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 33
        doc_ids, ids, tokens = [], [], 0

        def window() -> pa.RecordBatch:
            nonlocal first
            pieces = assign([len(x) for x in ids], capacity, linear, quadratic)
            cuts = [ids[d][s : s + n] for d, s, n, _, _ in pieces]
            long = pa.int64()
            out = [
                pa.array([doc_ids[p[0]] for p in pieces], doc_type),
                pa.array([p[1] for p in pieces], long),
                pa.array([p[2] for p in pieces], long),
                pa.array([zlib.crc32(c.astype("<u4").tobytes()) for c in cuts], long),
                pa.array([len(ids[p[0]]) for p in pieces], long),
                pa.array([first + p[3] for p in pieces], long),
                pa.array([p[4] for p in pieces], long),
            ]
            if with_ids:
                out.append(pa.array(cuts, pa.list_(pa.int32())))
            first += len(capacities(tokens, capacity))
            return pa.RecordBatch.from_arrays(out, names=names)

        for batch in batches:
            doc_type = batch.schema.field("doc_id").type
            for doc_id, own in documents_of(batch, lambda texts: word_tokens(texts, vocabulary), end_id):
                doc_ids.append(doc_id)
                ids.append(own)
                tokens += len(own)
                if tokens >= WINDOW_TOKENS:
                    yield window()
                    doc_ids, ids, tokens = [], [], 0
        if ids:
            yield window()

    columns = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    names = ["doc_id", *columns, *["ids"] * with_ids]
    texts = docs.select(F.col(id_column).alias("doc_id"), text_or_empty(F.col(text_column)).alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"`{c}` bigint" for c in columns) + ", ids array<int>" * with_ids
    return map_batches(texts, run, schema)

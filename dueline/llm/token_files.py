"""Token ids in binary files, in ascending document order.

    file:   magic | blocks (frame_of_reference) | document ids i64 | null flags u8 | token counts u64
            | block starts u64 | documents u64, tokens u64, blocks u64, table offset u64 | magic

``write_files`` range-partitions by id, so each task writes the files of one stretch of ids; a file is
closed after FILE_TOKENS, which bounds its size and the memory of a task. A task names its files anew
each time it runs and reports them when it is done; only the reported ones are in the manifest, so a
task that is lost and run again leaves nothing twice. The folder must be one that all executors share
and that pyarrow can write (a local mount, HDFS or an object store).

Null texts are empty: such a document has its end id only. Null ids come first and stay null. Documents
with one id are ordered by a hash of their text, so a much repeated id is spread over tasks too.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dueline.llm.frame_of_reference import BLOCK, decode, encode
from dueline.llm.shared import text_or_empty
from dueline.llm.tokens import bounds, documents_of, word_tokens

MAGIC = b"PFORTOK1"
TAIL = struct.Struct("<QQQQ8s")
#: Tokens after which a file is closed, and values that are encoded or decoded at a time.
FILE_TOKENS, CHUNK = 1 << 24, 256 * BLOCK


class FileWriter:
    """Writes one file; add documents in order, then close."""

    def __init__(self, sink) -> None:
        self.sink, self.at, self.tokens = sink, len(MAGIC), 0
        self.doc_ids: list[int | None] = []
        self.lengths: list[int] = []
        self.starts: list[int] = []
        self.waiting: list[np.ndarray] = []
        self.n_waiting = 0
        sink.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids))
        self.tokens += len(ids)
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= CHUNK:
            self._put(self.n_waiting - self.n_waiting % BLOCK)

    def _put(self, n: int) -> None:
        values = np.concatenate(self.waiting) if self.waiting else np.empty(0, np.int32)
        for at in range(0, n, CHUNK):
            for block in encode(values[at : min(n, at + CHUNK)]):
                self.starts.append(self.at)
                self.at += self.sink.write(block)
        self.waiting, self.n_waiting = [values[n:]], len(values) - n

    def close(self) -> None:
        self._put(self.n_waiting)
        table = (
            np.array([0 if i is None else i for i in self.doc_ids], "<i8"),
            np.array([i is None for i in self.doc_ids], "u1"),
            np.array(self.lengths, "<u8"),
            np.array(self.starts, "<u8"),
        )
        for column in table:
            self.sink.write(column.tobytes())
        self.sink.write(TAIL.pack(len(self.doc_ids), self.tokens, len(self.starts), self.at, MAGIC))
        self.sink.close()


class FileReader:
    """Reads one file; only the blocks that are asked for are read and decoded."""

    def __init__(self, source) -> None:
        self.source = source
        source.seek(0, io.SEEK_END)
        size = source.tell()
        n_docs, self.tokens, n_blocks, at, magic = TAIL.unpack(self._bytes(size - TAIL.size, TAIL.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        table = self._bytes(at, size - TAIL.size - at)
        self.doc_ids = np.frombuffer(table, "<i8", n_docs)
        self.null = np.frombuffer(table, "u1", n_docs, 8 * n_docs).astype(bool)
        self.lengths = np.frombuffer(table, "<u8", n_docs, 9 * n_docs).astype(np.int64)
        self.starts = np.frombuffer(table, "<u8", n_blocks, 17 * n_docs).astype(np.int64)
        self.blocks_end = at

    def _bytes(self, start: int, n: int) -> bytes:
        self.source.seek(start)
        return self.source.read(n)

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids number start to end of the file."""
        if end <= start:
            return np.empty(0, np.uint32)
        first, last = start // BLOCK, -(-end // BLOCK)
        from_byte = self.starts[first]
        to_byte = self.starts[last] if last < len(self.starts) else self.blocks_end
        data = self._bytes(int(from_byte), int(to_byte - from_byte))
        values = decode(data, self.starts[first:last] - from_byte)
        return values[start - first * BLOCK : end - first * BLOCK]

    def document(self, place: int) -> np.ndarray:
        """The ids of one document, by its place in the file."""
        at = bounds(self.lengths[: place + 1])
        return self.ids(int(at[place]), int(at[place + 1]))

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """All documents in order, a chunk of blocks at a time."""
        at, have, held = 0, 0, np.empty(0, np.uint32)
        for doc_id, null, n in zip(self.doc_ids.tolist(), self.null.tolist(), self.lengths.tolist()):
            parts = [held]
            size = len(held)
            while size < n:
                parts.append(self.ids(have, min(self.tokens, have + CHUNK)))
                have += len(parts[-1])
                size += len(parts[-1])
            held = np.concatenate(parts) if len(parts) > 1 else held
            yield None if null else doc_id, held[:n]
            held = held[n:]
            at += n


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def write_files(
    docs: DataFrame,
    folder: str,
    vocabulary: str,
    end_id: int,
    partitions: int | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> list[tuple[str, int, int]]:
    """Writes the files below the folder. Returns (path, documents, tokens) of each in document order;
    a row of this manifest stands for up to FILE_TOKENS tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, writer, name, done = TaskContext.get().partitionId(), None, "", []
        store, base = opened(folder)
        store.create_dir(base, recursive=True)
        for batch in batches:
            for doc_id, ids in documents_of(batch, lambda texts: word_tokens(texts, vocabulary), end_id):
                if writer is None:
                    name = f"{part:07d}-{len(done):05d}-{uuid.uuid4().hex}.tokens"
                    writer = FileWriter(store.open_output_stream(f"{base}/{name}"))
                writer.add(doc_id, ids)
                if writer.tokens >= FILE_TOKENS:
                    writer.close()
                    done.append((name, len(writer.doc_ids), writer.tokens))
                    writer = None
        if writer is not None:
            writer.close()
            done.append((name, len(writer.doc_ids), writer.tokens))
        columns = list(zip(*done)) or [(), (), ()]
        types = (pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["name", "docs", "tokens"])

    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tie = F.xxhash64("text")
    texts = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), text_or_empty(F.col(text_column)).alias("text"))
    ordered = texts.repartitionByRange(n, "doc_id", tie).sortWithinPartitions("doc_id", tie)
    rows = ordered.mapInArrow(run, "name string, docs bigint, tokens bigint").collect()
    return [(f"{folder}/{r.name}", r.docs, r.tokens) for r in sorted(rows)]


def read_files(spark: SparkSession, manifest: list[tuple[str, int, int]], with_ids: bool = True) -> DataFrame:
    """One row per document of the files: doc_id, start (ids of all documents before it), n_tokens,
    ids_crc32 and, if asked for, ids. Each file is read by one task, chunk by chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, name = opened(path)
                rows, size = [], 0
                with store.open_input_file(name) as source:
                    for doc_id, ids in FileReader(source).documents():
                        rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), ids if with_ids else None))
                        start += len(ids)
                        size += len(ids) * with_ids + 1
                        if size >= CHUNK:
                            yield record(rows)
                            rows, size = [], 0
                yield record(rows)

    names = ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids]
    types = [pa.int64()] * 4 + [pa.list_(pa.int64())] * with_ids

    def record(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    starts = bounds(np.array([m[2] for m in manifest], np.int64)).tolist()
    files = [(m[0], s) for m, s in zip(manifest, starts)]
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids
    table = spark.createDataFrame(files, "path string, start bigint")
    return table.repartition(max(1, len(files))).mapInArrow(run, schema)

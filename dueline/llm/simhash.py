"""Near-duplicates by SimHash fingerprints.

A fingerprint has 64 bits. Words are what stands between ASCII white space, A-Z in lower case; shingles
are SHINGLE words joined by a space, repeats included (fewer words: the whole sequence); each has an
XXH64 with seed 42, and a bit is 1 if it is set in over half of them. No words: zero. Null texts are
empty. Documents link at MAX_BITS or fewer differing bits; linked ones are a component.

1. Fingerprints, and one row for each distinct one: copies, even a third of all rows, go no further.
2. Two fingerprints that differ in at most 3 bits agree in 3 of 6 bit blocks. So each is dealt to 20
   buckets, one for each choice of 3 blocks, by their 32 or more bits. No linked pair is missed.
3. In a bucket, a table holds each fingerprint's Hamming distances to REFERENCES fixed fingerprints. By
   the triangle inequality no coordinate of a linked pair differs by more than 3 bits: the table is
   sorted by its first coordinate, only rows within 3 there are looked at, pairs with a larger difference
   anywhere are discarded, and survivors are verified by their own bits. Each fingerprint is compared
   only with those its search hasn't reached yet, and a bucket returns the links of a spanning forest,
   never all pairs.
4. Components of these links, as Spark joins.

The reference table can't find pairs by itself: random distances differ by 3 or less in nearly half of
all cases, so joining on a coordinate would compare almost everything. Hence step 2.

A bucket of more than BUCKET fingerprints is dealt again by the same argument: its pairs differ in at
most 3 of the bits the bucket leaves open, so they agree in 3 of 6 parts of these. Its fingerprints go to
20 buckets that agree in 46 bits or more, so none holds more than 2^18, however many documents there are.

Null ids have fingerprints and link like others, but name a component only if it has no other id: then
its id is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from dueline.llm.components import components
from dueline.llm.shared import fresh, map_batches, text_or_empty, written

SHINGLE, SEED, MAX_BITS = 3, 42, 3
BLOCK_WIDTHS = (11, 11, 11, 11, 10, 10)
#: Fingerprints up to which a bucket is searched as it is.
BUCKET = 4096
REFERENCES = np.array([xxhash.xxh64_intdigest(b"reference %d" % i, SEED) for i in range(16)], np.uint64)
#: Texts whose shingles are counted at a time: up to so many texts, and shingles before the last text.
TEXTS, SHINGLES = 128, 100_000

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_POWERS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def shingle_hashes(text: str, size: int = SHINGLE) -> list[int]:
    words = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    cut = map(slice, starts[: len(words) - size + 1].tolist(), (ends[size - 1 :] - 1).tolist())
    return list(map(xxhash.xxh64_intdigest, map(joined.__getitem__, cut), repeat(SEED)))


def fingerprints_of(texts: list[str], size: int = SHINGLE) -> np.ndarray:
    """The fingerprints of some texts."""
    out = np.zeros(len(texts), np.uint64)
    hashes: list[np.ndarray] = []
    first, held = 0, 0
    for i, text in enumerate(texts):
        hashes.append(np.array(shingle_hashes(text, size), np.uint64))
        held += len(hashes[-1])
        if len(hashes) == TEXTS or held >= SHINGLES or i == len(texts) - 1:
            out[first : i + 1] = _majority(hashes)
            hashes, first, held = [], i + 1, 0
    return out


def _majority(hashes: list[np.ndarray]) -> np.ndarray:
    n = np.array([len(h) for h in hashes], np.int64)
    each = np.concatenate(hashes).astype("<u8").view(np.uint8).reshape(-1, 8)
    row = np.repeat(np.arange(len(n)) * 256, n)
    # How often each byte occurs at each of the 8 places, then how often each bit is set.
    set_bits = [np.bincount(row + each[:, k], minlength=256 * len(n)).reshape(-1, 256) @ _BITS for k in range(8)]
    return ((2 * np.concatenate(set_bits, axis=1) > n[:, None]) * _POWERS).sum(axis=1, dtype=np.uint64)


def with_fingerprint(docs: DataFrame, name: str, text_column: str = "text", size: int = SHINGLE) -> DataFrame:
    """The rows with their fingerprint, as a signed long."""
    text, names = fresh(docs, "simhash_text"), [*docs.columns, name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = fingerprints_of(batch.column(batch.num_columns - 1).to_pylist(), size)
            columns = [*batch.columns[:-1], pa.array(own.view(np.int64), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = StructType([*docs.schema.fields, StructField(name, LongType())])
    return map_batches(docs.withColumn(text, text_or_empty(F.col(text_column))), run, schema)


def forest(prints: np.ndarray) -> list[tuple[int, int]]:
    """Links of a spanning forest of distinct fingerprints."""
    distances = np.bitwise_count(prints[:, None] ^ REFERENCES).astype(np.int8)
    order = np.argsort(distances[:, 0], kind="stable")
    prints, distances = prints[order], distances[order]
    first = distances[:, 0].copy()
    alive = np.ones(len(prints), bool)
    links = []
    for seed in range(len(prints)):
        if not alive[seed]:
            continue
        alive[seed] = False
        reached = [seed]
        while reached:
            i = reached.pop()
            low, high = np.searchsorted(first, [first[i] - MAX_BITS, first[i] + MAX_BITS + 1])
            near = low + np.flatnonzero(alive[low:high])
            near = near[(np.abs(distances[near] - distances[i]) <= MAX_BITS).all(axis=1)]
            near = near[np.bitwise_count(prints[near] ^ prints[i]) <= MAX_BITS]
            alive[near] = False
            reached += near.tolist()
            links += [(int(prints[i]), int(prints[j])) for j in near.tolist()]
    return links


def blocks() -> list[int]:
    """The bits of each of the 6 blocks."""
    edges = np.concatenate([[0], np.cumsum(BLOCK_WIDTHS)]).tolist()
    return [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]


def masks(parts: list[int] | None = None) -> list[int]:
    """The bits of each choice of 3 of 6 parts, by default the blocks."""
    parts = parts or blocks()
    return [sum(chosen) for chosen in combinations(parts, len(parts) - MAX_BITS)]


def finer_masks() -> list[list[int]]:
    """For each choice of blocks the masks of its second dealing: its own bits and 3 of 6 parts of the rest."""
    finer = []
    for mask in masks():
        halves = []
        for block in blocks():
            if not block & mask:
                low = block & -block
                cut = low << (block.bit_count() // 2)
                halves += [cut - low, block - (cut - low)]
        finer.append([mask | chosen for chosen in masks(halves)])
    return finer


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def buckets(prints: DataFrame, most: int = BUCKET) -> DataFrame:
    """choice, bits, fp: distinct fingerprints (column fp) in their buckets; one of more than ``most`` is
    dealt again, to choices from 20 on. Buckets are counted with partial sums before any is gathered."""
    fp = F.col("fp")
    dealt = F.array(*(F.struct(F.lit(c).alias("choice"), fp.bitwiseAND(F.lit(signed(m))).alias("bits")) for c, m in enumerate(masks())))
    rows = prints.select(F.explode(dealt).alias("to"), "fp").select("to.choice", "to.bits", "fp")
    sizes = rows.groupBy("choice", "bits").agg(F.count(F.lit(1)).alias("size"))
    large = written(sizes.where(F.col("size") > most).select("choice", "bits"), "large-buckets")
    finer = finer_masks()
    table = F.array(*(F.array(*(F.lit(signed(m)) for m in own)) for own in finer))
    to = F.transform(
        F.get(table, F.col("choice")),
        lambda m, i: F.struct((F.lit(len(finer)) * (F.col("choice") + 1) + i).alias("choice"), fp.bitwiseAND(m).alias("bits")),
    )
    again = rows.join(large, ["choice", "bits"], "left_semi").select(F.explode(to).alias("to"), "fp")
    return rows.join(large, ["choice", "bits"], "left_anti").union(again.select("to.choice", "to.bits", "fp"))


def link_buckets(prints: DataFrame, most: int = BUCKET) -> DataFrame:
    """Links a, b between distinct fingerprints (column fp) that hold each component together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # the last bucket so far; it may go on in the next batch
        key = None
        for batch in batches:
            choice, bits, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if not len(fp):
                continue
            cut = np.flatnonzero((np.diff(choice) != 0) | (np.diff(bits) != 0)) + 1
            starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(fp)]])
            links = []
            for start, end in zip(starts.tolist(), ends.tolist()):
                if start == 0 and key == (choice[0], bits[0]):
                    held.append(fp[:end])
                else:
                    links += closed(held)
                    held = [fp[start:end]]
            key = (choice[-1], bits[-1])
            yield record(links)
        yield record(closed(held))

    def closed(parts: list[np.ndarray]) -> list[tuple[int, int]]:
        n = sum(map(len, parts))
        return forest(np.concatenate(parts).view(np.uint64)) if n > 1 else []

    def record(links: list[tuple[int, int]]) -> pa.RecordBatch:
        pairs = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    rows = buckets(prints, most)
    return map_batches(rows.repartition("choice", "bits").sortWithinPartitions("choice", "bits"), run, "a bigint, b bigint")


def rooted(prints: DataFrame) -> DataFrame:
    """fp, first_id (its smallest document), root (a fingerprint that names the component) for each
    distinct fingerprint of a table of doc_id, fp."""
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fingerprints")
    roots = components(link_buckets(classes.select("fp"))).withColumnRenamed("node", "fp")
    return classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (the smallest id reachable)."""
    narrow = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    prints = written(with_fingerprint(narrow, "fp").select("doc_id", "fp"), "document-fingerprints")
    classes = rooted(prints)
    least = classes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    found = classes.join(least, "root").select("fp", "component_id")
    return prints.join(found, "fp").select("doc_id", hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def drop_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows that stay, with all their columns: of each component the document with the smallest id.

    Rows that repeat that id and fingerprint are one document. A component without ids keeps one row for
    its smallest fingerprint.
    """
    fp = fresh(docs, "simhash_fp")
    marked = written(with_fingerprint(docs, fp, text_column), "fingerprinted")
    prints = marked.select(F.col(id_column).alias("doc_id"), F.col(fp).alias("fp"))
    # By component: the smallest id (null is the last), and of its fingerprints the smallest.
    best = F.min(F.struct(F.col("first_id").isNull().alias("none"), "first_id", "fp"))
    own_id, own_fp = fresh(docs, "simhash_keep"), fresh(docs, "simhash_keep_fp")
    stay = rooted(prints).groupBy("root").agg(best.alias("best"))
    stay = stay.select(F.col("best.first_id").alias(own_id), F.col("best.fp").alias(own_fp))
    same = F.col(id_column).eqNullSafe(F.col(own_id)) & (F.col(fp) == F.col(own_fp))
    return marked.join(stay, same, "left_semi").dropDuplicates([id_column, fp]).drop(fp)

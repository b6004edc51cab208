"""Near copies by the Jaccard similarity of their word shingles.

Words and shingles are those of ``simhash``: a text's set holds the XXH64 of every ``size`` words in a
row. Two documents link if their sets' Jaccard similarity is ``similarity`` or more; linked ones are a
component. SimHash can't find such pairs: at five words and 0.8 fingerprints differ in about ten bits of
64, for which no few exact keys are left. So:

1. One class for all texts with the same words (copies, even a third of all rows, go no further), with
   BANDS keys of ROWS min-hashes each.
2. Classes with a common key belong to one group: stars to each key's smallest class, then components.
   A pair of similarity s has no common key with probability (1 - s^6)^32: 0.00006 at 0.8. Groups may
   hold many documents that aren't similar; they only bound where links are looked for.
3. In a group of one block, links are found by the sets themselves through an inverted index: exact, and
   without further loss. Each set is compared only with those not reached yet, and the links are a spanning
   forest, never all pairs.
4. A larger group is dealt into blocks. First each block's members are compared with the group's centre, its
   smallest class; those that link to it are connected by that, however many there are. What is left must
   still be compared, but only with texts that it has a key in common with: by key, members of keys with such
   a rest form groups of their own (keys with the same members once), and one of these that is too large is
   dealt into pairs of a block of the rest and a block of all. So a text is copied once for its centre, and
   else at most once for each of its keys and block of a key's rest; chains of groups that share a boilerplate
   are cut at their keys and not compared as a whole.
5. With ``simhash``, classes within 3 bits by the operator of ``simhash`` are linked as well: texts that mostly
   repeat themselves have few shingles in common and yet nearly the same fingerprint.
6. Components of all these links, as Spark joins.

Defined results: null texts are empty; texts without words are one class. A very long text is a set like
others, held whole by one task. Columns with the names that are used here are kept as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from dueline.llm.components import components
from dueline.llm.shared import fresh, map_batches, text_or_empty, written
from dueline.llm.simhash import fingerprints_of, rooted, shingle_hashes

BANDS, ROWS = 32, 6
#: Documents and shingles of a block of a group, on average.
BLOCK_ROWS, BLOCK_SHINGLES = 256, 500_000
#: Shingles that are hashed, and texts that are looked at, at a time.
CHUNK, TEXTS = 2048, 1024

_random = np.random.Generator(np.random.PCG64(42))
_FACTORS = _random.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)
_ADDED = _random.integers(0, 1 << 64, BANDS * ROWS, np.uint64)
_MIX = _random.integers(0, 1 << 64, (BANDS, ROWS), np.uint64) | np.uint64(1)


def shingle_set(text: str, size: int) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, size), np.uint64))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """BANDS keys of a set; none if it is empty."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), CHUNK):
        np.minimum(least, (hashes[i : i + CHUNK, None] * _FACTORS + _ADDED).min(axis=0), out=least)
    own = least.reshape(BANDS, ROWS)
    return (((own ^ (own >> np.uint64(29))) * _MIX).sum(axis=1, dtype=np.uint64)).view(np.int64)


def with_bands(docs: DataFrame, words: str, n: str, bands: str, text_column: str, size: int, fp: str, simhash: bool) -> DataFrame:
    """The rows with a hash of their words, the size of their set, its keys and, with ``simhash``, their fingerprint.

    All of it is made in one pass: two would keep two Python workers for each task, each with the texts."""
    text, names = fresh(docs, "similar_text"), [*docs.columns, fp, words, n, bands]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, TEXTS) for b in batches for at in range(0, b.num_rows, TEXTS)):
            digests, counts, keys = [], [], []
            texts = batch.column(batch.num_columns - 1).to_pylist()
            prints = pa.array(fingerprints_of(texts).view(np.int64)) if simhash else pa.nulls(len(texts), pa.int64())
            for t in texts:
                hashes = shingle_set(t, size)
                digests.append(hashlib.md5(b" ".join(t.encode("utf-8", "surrogatepass").lower().split())).hexdigest())
                counts.append(len(hashes))
                keys.append(band_keys(hashes))
            added = [prints, pa.array(digests, pa.string()), pa.array(counts, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *added], names=names)

    new = [StructField(fp, LongType()), StructField(words, StringType()), StructField(n, LongType()), StructField(bands, ArrayType(LongType()))]
    return map_batches(docs.withColumn(text, text_or_empty(F.col(text_column))), run, StructType([*docs.schema.fields, *new]))


def forest(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links of a spanning forest of sorted sets, as their numbers."""
    sizes = np.array([len(s) for s in sets], np.int64)
    alive = np.ones(len(sets), bool)
    left = len(sets)

    def index() -> tuple[np.ndarray, np.ndarray, int]:
        own = np.flatnonzero(alive)
        values = np.concatenate([sets[i] for i in own.tolist()])
        order = np.argsort(values, kind="stable")
        return values[order], np.repeat(own, sizes[own])[order], len(own)

    links: list[tuple[int, int]] = []
    values, owners, indexed = index()
    for seed in range(len(sets)):
        if not alive[seed]:
            continue
        alive[seed], left, reached = False, left - 1, [seed]
        while reached and left:
            if 2 * left < indexed:
                values, owners, indexed = index()
            i = reached.pop()
            low, high = np.searchsorted(values, sets[i], "left"), np.searchsorted(values, sets[i], "right")
            n = high - low
            at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
            near, shared = np.unique(owners[at], return_counts=True)
            near = near[alive[near] & (shared / (sizes[near] + sizes[i] - shared) >= similarity)]
            alive[near] = False
            left -= len(near)
            reached += near.tolist()
            links += [(i, j) for j in near.tolist()]
    return links


def groups(classes: DataFrame) -> DataFrame:
    """node, root for all classes (columns node, bands) that have a key in common with another one."""
    keys = classes.select("node", F.explode(F.array_distinct("bands")).alias("key"))
    least = keys.groupBy("key").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stars = keys.join(least, "key").where("node != least")
    return components(stars.select(F.col("node").alias("a"), F.col("least").alias("b")))


def blocks_of(rows: Column, shingles: Column, block_rows: int, block_shingles: int) -> Column:
    """How many blocks so many rows and shingles make; none for no rows."""
    return F.ceil(F.greatest(rows / block_rows, shingles / block_shingles)).cast("bigint")


def by_cell(rows: DataFrame, cell: list[str], links_of) -> DataFrame:
    """Links a, b that ``links_of`` finds among the nodes and sets of each cell. Rows are node, text, and what
    sorts them within their cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, texts = None, [], []
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(len(cell) + 2)]
            links: list[tuple[int, int]] = []
            for own, x, t in zip(zip(*columns[: len(cell)]), columns[-2], columns[-1]):
                if own != key:
                    links += links_of(nodes, texts)
                    key, nodes, texts = own, [], []
                nodes.append(x)
                texts.append(t)
            yield record(links)
        yield record(links_of(nodes, texts))

    def record(links: list[tuple[int, int]]) -> pa.RecordBatch:
        pairs = np.array(links, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    # Nodes are numbered, so the smallest of a cell comes first.
    dealt = rows.select(*cell, "node", "text").repartition(*cell).sortWithinPartitions(*cell, "node")
    return map_batches(dealt, run, "a bigint, b bigint")


def forest_links(size: int, similarity: float):
    def links_of(nodes: list[int], texts: list[str]) -> list[tuple[int, int]]:
        if len(nodes) < 2:
            return []
        return [(nodes[i], nodes[j]) for i, j in forest([shingle_set(t, size) for t in texts], similarity)]

    return links_of


def centre_links(size: int, similarity: float):
    """Of a cell whose smallest node is the centre: links to it."""

    def links_of(nodes: list[int], texts: list[str]) -> list[tuple[int, int]]:
        if len(nodes) < 2:
            return []
        centre, links = shingle_set(texts[0], size), []
        for node, text in zip(nodes[1:], texts[1:]):
            own = shingle_set(text, size)
            shared = len(np.intersect1d(centre, own, assume_unique=True))
            if shared / (len(own) + len(centre) - shared) >= similarity:
                links.append((nodes[0], node))
        return links

    return links_of


def link_groups(members: DataFrame, size: int, similarity: float, block_rows: int, block_shingles: int) -> DataFrame:
    """Links a, b that hold together each component of the members (node, root, n, bands, text); texts are
    compared with those they have a key in common with."""
    sizes = members.groupBy("root").agg(blocks_of(F.count(F.lit(1)), F.sum("n"), block_rows, block_shingles).alias("blocks"), F.min("node").alias("centre"))
    sized = members.join(sizes, "root")
    links = by_cell(sized.where("blocks <= 1"), ["root"], forest_links(size, similarity))

    large = sized.where("blocks > 1")
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    every = F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)
    blocks = F.when(F.col("node") == F.col("centre"), every).otherwise(F.array(own))
    to_centre = written(by_cell(large.withColumn("block", F.explode(blocks)), ["root", "block"], centre_links(size, similarity)), "centre-links")

    linked = to_centre.select(F.col("b").alias("node"), F.lit(False).alias("rest"))
    left = large.join(linked, "node", "left").withColumn("rest", F.coalesce("rest", F.col("node") != F.col("centre")))
    keys = left.select("node", "n", "rest", F.explode(F.array_distinct("bands")).alias("key"))
    rest_n, rest_shingles = F.count_if("rest"), F.sum(F.when(F.col("rest"), F.col("n")).otherwise(0))
    by_key = keys.groupBy("key").agg(
        F.count(F.lit(1)).alias("all_rows"),
        rest_n.alias("rest_rows"),
        blocks_of(F.count(F.lit(1)), F.sum("n"), block_rows, block_shingles).alias("all_blocks"),
        blocks_of(rest_n, rest_shingles, block_rows, block_shingles).alias("rest_blocks"),
        F.bit_xor(F.xxhash64("node")).alias("x"),
        F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"),
    )
    by_key = by_key.where("all_rows > 1 and rest_rows > 0")
    by_key = by_key.groupBy("all_rows", "rest_rows", "all_blocks", "rest_blocks", "x", "y").agg(F.min("key").alias("key"))
    dealt = keys.select("node", "rest", "key").join(by_key.select("key", "all_blocks", "rest_blocks"), "key")
    row, column = (F.pmod(F.xxhash64("node", F.lit(s)), F.col(c)) for s, c in ((2, "rest_blocks"), (3, "all_blocks")))
    rows, columns = (F.sequence(F.lit(0).cast("bigint"), F.col(c) - 1) for c in ("rest_blocks", "all_blocks"))
    as_any = F.transform(rows, lambda r: F.struct(r.alias("r"), column.alias("c")))
    as_rest = F.when(F.col("rest"), F.transform(columns, lambda c: F.struct(row.alias("r"), c.alias("c")))).otherwise(F.array().cast("array<struct<r: bigint, c: bigint>>"))
    dealt = dealt.select("node", "key", F.explode(F.array_distinct(F.concat(as_any, as_rest))).alias("cell")).select("node", "key", "cell.r", "cell.c")
    among = by_cell(dealt.join(large.select("node", "text"), "node"), ["key", "r", "c"], forest_links(size, similarity))
    return links.unionByName(to_centre).unionByName(among)


def fingerprint_links(classes: DataFrame) -> DataFrame:
    """Links a, b that hold together the classes (node, fp) whose fingerprints are in one component."""
    found = rooted(classes.select(F.col("node").alias("doc_id"), "fp"))
    # first_id is the smallest node with a fingerprint; least the smallest of its component.
    least = found.groupBy("root").agg(F.min("first_id").alias("least"))
    stars = classes.select("node", "fp").join(found.join(least, "root").select("fp", "least"), "fp")
    return stars.where("node != least").select(F.col("node").alias("a"), F.col("least").alias("b"))


def drop_similar(
    docs: DataFrame,
    size: int = 5,
    similarity: float = 0.8,
    id_column: str = "doc_id",
    text_column: str = "text",
    block_rows: int = BLOCK_ROWS,
    block_shingles: int = BLOCK_SHINGLES,
    simhash: bool = False,
) -> DataFrame:
    """The rows that stay, with all their columns: of each component the document with the smallest id.
    With ``simhash``, fingerprints link as well as sets.

    Rows that repeat that id and its words are one document. A component without ids keeps one row for
    its smallest hash of words.
    """
    words, n, bands, fp = (fresh(docs, f"similar_{x}") for x in ("words", "n", "bands", "fp"))
    marked = written(with_bands(docs, words, n, bands, text_column, size, fp, simhash), "banded")
    narrow = marked.select(F.col(words).alias("words"), F.col(id_column).alias("doc_id"), *[F.col(c).alias(a) for c, a in ((n, "n"), (bands, "bands"), (fp, "fp"))])
    classes = narrow.groupBy("words").agg(F.min("doc_id").alias("first_id"), *[F.first(c).alias(c) for c in ("n", "bands", "fp")])
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    found = written(classes.join(groups(classes.select("node", "bands")), "node").select("words", "node", "n", "bands", "root"), "groups")
    texts = marked.select(F.col(words).alias("words"), text_or_empty(F.col(text_column)).alias("text"))
    texts = texts.join(found.select("words"), "words", "left_semi").groupBy("words").agg(F.first("text").alias("text"))
    members = written(found.join(texts, "words").select("node", "root", "n", "bands", "text"), "members")
    links = link_groups(members, size, similarity, block_rows, block_shingles)
    if simhash:
        links = links.unionByName(fingerprint_links(classes))
    roots = components(links).withColumnRenamed("root", "component")
    # By component: the smallest id (null is the last), and of its classes the smallest.
    best = F.min(F.struct(F.col("first_id").isNull().alias("none"), "first_id", "words"))
    named = classes.select("node", "first_id", "words").join(roots, "node", "left")
    stay = named.groupBy(F.coalesce("component", "node")).agg(best.alias("best"))
    own_id, own_words = fresh(docs, "similar_keep"), fresh(docs, "similar_keep_words")
    stay = stay.select(F.col("best.first_id").alias(own_id), F.col("best.words").alias(own_words))
    same = F.col(id_column).eqNullSafe(F.col(own_id)) & (F.col(words) == F.col(own_words))
    return marked.join(stay, same, "left_semi").dropDuplicates([id_column, words]).drop(words, n, bands, fp)

"""Quality scores by nearest-neighbour voting in a latent-semantic space.

Features of a text: shapes of its words (letters and digits by class, runs as one, signs as they are),
pairs of neighbouring shapes, words said twice in a row, and hashed words. Their shares are rooted,
weighted by inverse document frequency and projected to DIMENSIONS by a singular value decomposition of
a sample of labelled documents, at most SAMPLE of them, chosen by a hash of their id. The sample's
vectors (SAMPLE x DIMENSIONS) and the projection (FEATURES x DIMENSIONS) are all that is broadcast; the
bound holds whatever the corpus's size is. Every document is then compared with every sample vector by
blocked matrix products, and its K nearest neighbours vote with weights that grow with their cosine.

The score is the share of label 1 in the votes: 0 to 1, higher is better. Labels, language, source and
id are no features. Null and empty texts, and texts whose vector is zero, get the sample's share of
label 1, and so does every text if there is no labelled document. Labels other than 0 and 1 are left
out; an id with contradicting labels counts by their mean, 0.5 as 1. Rows are scored one by one.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from dueline.llm.shared import fresh, map_batches, text_or_empty
from dueline.llm.tokens import blocks, bounds, listed

#: Most labelled documents that the space and the votes are made of.
SAMPLE = 3000
SHAPES, PAIRS, WORDS = 1024, 1024, 4096
FEATURES = SHAPES + PAIRS + WORDS
#: Weights of the three groups of features.
WEIGHTS = (1.0, 1.0, 0.3)
DIMENSIONS, K, SHARPNESS = 48, 25, 8
#: Texts whose words are looked at together, and rows of counts that are made at a time: a row of counts
#: has FEATURES numbers, so a task holds few of them.
TEXTS, ROWS = 1024, 64
#: Features and counts on their way to the driver: as bytes, which sort as the numbers do.
PLACE, TIMES = np.dtype(">u2"), np.dtype(">u4")


class _Classes(dict):
    """Letters and digits by class; other characters stay."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = kind = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        return kind


_CLASSES = _Classes()
_RUNS = re.compile(r"(.)\1+", re.DOTALL)


def shape(word: str) -> str:
    return _RUNS.sub(r"\1", word.translate(_CLASSES))


def counts(texts: pa.Array) -> Iterator[np.ndarray]:
    """Feature counts, a row per text, in blocks of ROWS texts."""
    n = len(texts)
    lists = pc.ascii_split_whitespace(texts)
    words = lists.flatten().dictionary_encode()
    distinct, codes = listed(words.dictionary), words.indices.to_numpy(zero_copy_only=False)
    at = bounds(lists.value_lengths().to_numpy(zero_copy_only=False))
    row = np.repeat(np.arange(n), np.diff(at))
    empty = np.array([not w for w in distinct], bool)
    shape_of = np.array([zlib.crc32(shape(w).encode("utf-8", "surrogatepass")) % (SHAPES - 1) for w in distinct], np.int64)
    word_of = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) % WORDS for w in distinct], np.int64)
    shapes, real = shape_of[codes], ~empty[codes]
    follows = np.zeros(len(codes), bool)
    follows[1:] = (row[1:] == row[:-1]) & real[1:] & real[:-1]
    same = follows.copy()
    same[1:] &= codes[1:] == codes[:-1]
    pairs = np.zeros(len(codes), np.int64)
    pairs[1:] = (shapes[:-1] * 1_000_003 + shapes[1:] * 7919) % PAIRS
    found = [
        row[real] * FEATURES + shapes[real],
        row[same] * FEATURES + SHAPES - 1,
        row[follows] * FEATURES + SHAPES + pairs[follows],
        row[real] * FEATURES + SHAPES + PAIRS + word_of[codes][real],
    ]
    # Each part is in the order of the texts, so a block of them is a slice of it.
    ends = [np.searchsorted(row[kept], np.arange(0, n + ROWS, ROWS)) for kept in (real, same, follows, real)]
    for k, at in enumerate(range(0, n, ROWS)):
        own = np.concatenate([part[end[k] : end[k + 1]] for part, end in zip(found, ends)]) - at * FEATURES
        rows = min(ROWS, n - at)
        yield np.bincount(own, minlength=rows * FEATURES).reshape(rows, FEATURES)


def weighted(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rooted shares times idf, each group of length WEIGHTS."""
    out = np.sqrt(found, dtype=np.float32) * idf
    ends = np.cumsum([SHAPES, PAIRS, WORDS])
    for start, end, weight in zip([0, *ends], ends, WEIGHTS):
        part = out[:, start:end]
        length = np.sqrt((part * part).sum(axis=1, keepdims=True))
        part *= weight / np.where(length > 0, length, 1)
    return out


@dataclass
class Model:
    idf: np.ndarray
    mean: np.ndarray
    axes: np.ndarray  # FEATURES x DIMENSIONS
    vectors: np.ndarray  # sample x DIMENSIONS, of length 1
    labels: np.ndarray
    prior: float

    def project(self, found: np.ndarray) -> np.ndarray:
        return self.placed(weighted(found, self.idf), found.any(axis=1, keepdims=True))

    def placed(self, matrix: np.ndarray, any_found: np.ndarray) -> np.ndarray:
        """Vectors of weighted rows; any_found is a column that says which texts have any feature."""
        latent = matrix @ self.axes - self.mean
        length = np.linalg.norm(latent, axis=1, keepdims=True)
        known = any_found & (length > 1e-9)
        return np.where(known, latent / np.where(known, length, 1), 0).astype(np.float32)

    def vote(self, vectors: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(vectors), self.prior)
        near = vectors @ self.vectors.T
        k = min(K, near.shape[1])
        best = np.argpartition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k :]
        weight = np.maximum(np.take_along_axis(near, best, axis=1), 0).astype(np.float64) ** SHARPNESS
        total = weight.sum(axis=1)
        share = (weight * self.labels[best]).sum(axis=1) / np.where(total > 0, total, 1)
        return np.clip(np.where(total > 0, share, self.prior), 0, 1)

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = [np.empty(0)]
        for block in blocks(texts):
            for at in range(0, len(block), TEXTS):
                out += [self.vote(self.project(found)) for found in counts(block.slice(at, TEXTS))]
        return np.concatenate(out)


def fit(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    """The space and the votes of a sample, whose rows of counts are given as (features, counts)."""
    often = np.bincount(np.concatenate([np.zeros(0, np.int64), *(features for features, _ in rows)]), minlength=FEATURES)
    idf = (np.log((1 + len(rows)) / (1 + often)) + 1).astype(np.float32)
    # This is made on the driver: rows are weighted a block at a time, so there is one dense matrix and no copy of it.
    matrix = np.empty((len(rows), FEATURES), np.float32)
    for at in range(0, len(rows), ROWS):
        found = np.zeros((min(ROWS, len(rows) - at), FEATURES), np.float32)
        for out, (features, n) in zip(found, rows[at : at + ROWS]):
            out[features] = n
        matrix[at : at + ROWS] = weighted(found, idf)
    # Randomised range finding with two power iterations; the seed is fixed.
    start = np.random.default_rng(42).standard_normal((FEATURES, DIMENSIONS + 16)).astype(np.float32)
    basis = np.linalg.qr(matrix @ start)[0]
    for _ in range(2):
        basis = np.linalg.qr(matrix @ (matrix.T @ basis))[0]
    axes = np.linalg.svd(basis.T @ matrix, full_matrices=False)[2][:DIMENSIONS].T
    model = Model(idf, np.float32(0), np.ascontiguousarray(axes), np.empty(0), labels, float(labels.mean()) if len(labels) else 0.5)
    if len(labels):
        model.mean = (matrix @ axes).mean(axis=0)
    model.vectors = model.placed(matrix, np.array([len(features) > 0 for features, _ in rows], bool)[:, None])
    return model


def sample(docs: DataFrame, labels: DataFrame, usable: Column, id_column: str, text_column: str, label_column: str) -> Model:
    """A model of at most SAMPLE labelled documents for whose id ``usable`` holds."""
    chosen = (
        labels.select(F.col(id_column).alias("id"), F.col(label_column).alias("label"))
        .where(F.col("id").isNotNull() & F.col("label").isin(0, 1))
        .where(usable)
        .groupBy("id")
        .agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    )
    # Labels may name documents that the corpus doesn't have (any more), so both meet before the limit.
    ids = docs.select(F.col(id_column).alias("id")).join(chosen, "id").distinct()
    ids = ids.orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    texts = docs.select(F.col(id_column).alias("id"), text_or_empty(F.col(text_column)).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for block in blocks(batch.column(2)):
                for start in range(0, len(block), TEXTS):
                    for found in counts(block.slice(start, TEXTS)):
                        rows = [np.flatnonzero(r) for r in found]
                        columns = [
                            batch.column(0).slice(at, len(found)),
                            batch.column(1).slice(at, len(found)),
                            pa.array([i.astype(PLACE).tobytes() for i in rows], pa.binary()),
                            pa.array([r[i].astype(TIMES).tobytes() for r, i in zip(found, rows)], pa.binary()),
                        ]
                        at += len(found)
                        yield pa.RecordBatch.from_arrays(columns, names=["id", "label", "features", "counts"])

    # At most SAMPLE rows of two numbers are broadcast.
    labelled = texts.join(F.broadcast(ids), "id").select("id", "label", "text")
    kind = labelled.schema["id"].dataType.simpleString()
    rows = map_batches(labelled, run, f"id {kind}, label int, features binary, counts binary")
    # Repeated ids: one row each, so the bound holds.
    rows = rows.groupBy("id").agg(F.min(F.struct("features", "counts", "label")).alias("row")).orderBy("id")
    rows = [r.row for r in rows.collect()]
    found = [(np.frombuffer(r.features, PLACE).astype(np.int64), np.frombuffer(r.counts, TIMES).astype(np.int64)) for r in rows]
    return fit(found, np.array([r.label for r in rows], np.float64))


def held_out(id_column: Column) -> Column:
    """Rows that nothing is learned from; null ids are among the others."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score(
    docs: DataFrame,
    labels: DataFrame,
    threshold: float = 0.3,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "quality",
) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 if score >= threshold)."""
    model = docs.sparkSession.sparkContext.broadcast(sample(docs, labels, ~held_out(F.col("id")), id_column, text_column, label_column))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array(model.value.scores(batch.column(2)), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], names=["doc_id", "held_out", "score"])

    texts = docs.select(F.col(id_column).alias("doc_id"), held_out(F.col(id_column)).alias("held_out"), text_or_empty(F.col(text_column)).alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    scores = map_batches(texts, run, f"doc_id {kind}, held_out boolean, score double")
    return scores.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(
    docs: DataFrame,
    labels: DataFrame,
    threshold: float = 0.3,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "quality",
) -> DataFrame:
    """The documents that are not rejected, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(sample(docs, labels, ~held_out(F.col("id")), id_column, text_column, label_column))
    text, names = fresh(docs, "quality_text"), docs.columns
    # Only a null in a column of strings becomes another text, so the column itself is read; others are cast.
    own = next((i for i, f in enumerate(docs.schema.fields) if f.name == text_column and f.dataType == StringType()), None)
    given = docs.withColumn(text, text_or_empty(F.col(text_column))) if own is None else docs
    place = len(names) if own is None else own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = model.value.scores(pc.fill_null(batch.column(place), "")) >= threshold
            yield pa.RecordBatch.from_arrays(batch.columns[: len(names)], names=names).filter(pa.array(good, pa.bool_()))

    return map_batches(given, run, docs.schema)

"""Exact top-k by inner product with an impact-ordered index, a score at a time.

Vectors become integers, floor(scale * x), and are dealt into blocks of at most about VECTORS_PER_BLOCK by a
hash of their id. Queries are copied to the blocks; a block's vectors arrive first and become its one index,
then the queries stream by, so a task holds one block and one batch whatever the ids or values are.

A posting is one component of one vector; its impact is its size, quantised to LEVELS levels by quantiles of
the block. Level by level, the largest first, the postings of all dimensions are added to the scores of a
handful of queries at once (a matrix product with the level's postings). What the levels below can still add
to a vector is at most the query's length times the length of the vector's postings there, by Cauchy and
Schwarz, which the index has for every vector and level. So after each level a vector whose sum and rest
don't reach the query's bound is proven out. A query stops when few vectors are left; these are scored
exactly. Nothing else stops it, and after the last level the sums themselves are exact.

The bound travels with the query: every PILOT-th block answers first, and the k-th best score there is a
proven lower bound for all other blocks. Blocks' results are merged by a window whose limit Spark applies
before the shuffle too.

Defined results: rows with a null id, a null vector, or null or non-finite components take no part;
vectors are compared only with vectors of the same length. A query's own row is any with its id. Rows
repeated with one id and vector are one query but several candidates. Ties go to the smaller id. Sums
beyond 64 bits are held at the limits of a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dueline.llm.shared import written

VECTORS_PER_BLOCK, PILOT = 32768, 8
#: The least number of blocks that work is spread over, if there are so many vectors.
LEAST_BLOCKS = 24
LEVELS = 4
#: Queries that go through the levels together, and the share of vectors that may be left for exact scores.
TOGETHER, FEW = 32, 0.05
#: Below this, inner products of up to 2**11 components are exact in doubles.
SAFE = 1 << 20
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


class Index:
    """Postings of a block by level of impact, and the length of what lies below each level."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.values = self.vectors.astype(np.float64)
        size = np.abs(self.values)
        self.safe = size.max(initial=0.0) < SAFE and vectors.shape[1] <= 1 << 11
        edges = np.quantile(size, np.arange(1, LEVELS) / LEVELS)[::-1] if size.size else np.zeros(LEVELS - 1)
        level = (size[:, :, None] < edges).sum(axis=2)  # 0 is the largest impact
        self.postings = [np.where(level == n, self.values, 0.0).T.copy() for n in range(LEVELS)]
        below = [np.where(level > n, self.values, 0.0) for n in range(LEVELS)]
        self.rest = [np.sqrt((b * b).sum(axis=1)) * (1 + 1e-9) for b in below]

    def best(self, ids: np.ndarray, queries: np.ndarray, bounds: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query, its k best of the block that reach its bound: (number, ids, scores)."""
        if not self.safe or np.abs(queries).max(initial=0) >= SAFE:
            for q, query in enumerate(queries):
                yield self._top(q, np.arange(len(self.ids)), exact_scores(self.vectors, query), ids[q], bounds[q], k)
            return
        for start in range(0, len(ids), TOGETHER):
            left = np.arange(start, min(start + TOGETHER, len(ids)))
            asked = queries[left].astype(np.float64)
            sums, lengths = np.zeros((len(left), len(self.ids))), np.sqrt((asked**2).sum(axis=1))
            for n in range(LEVELS):
                sums += asked @ self.postings[n]
                # Half a point less: scores are integers, and sums of doubles below 2**53 are exact.
                needed = bounds[left].astype(np.float64)[:, None] - 0.5
                possible = sums + lengths[:, None] * self.rest[n] >= needed
                done = possible.sum(axis=1) <= FEW * len(self.ids) if n < LEVELS - 1 else np.ones(len(left), bool)
                for row in np.flatnonzero(done).tolist():
                    places = np.flatnonzero(possible[row])
                    scores = (self.values[places] @ asked[row]).astype(np.int64) if n < LEVELS - 1 else sums[row, places].astype(np.int64)
                    yield self._top(int(left[row]), places, scores, ids[left[row]], bounds[left[row]], k)
                if done.all():
                    break
                left, asked, sums, lengths = left[~done], asked[~done], sums[~done], lengths[~done]

    def _top(self, q: int, places: np.ndarray, scores: np.ndarray, own: int, bound: int, k: int) -> tuple[int, np.ndarray, np.ndarray]:
        fit = np.flatnonzero((self.ids[places] != own) & (scores >= bound))
        if len(fit) > 4 * k:
            least = np.partition(scores[fit], len(fit) - k)[len(fit) - k]
            fit = fit[scores[fit] >= least]
        top = fit[np.lexsort((places[fit], ~scores[fit]))][:k]  # ~ reverses the order; places are in order of ids
        return q, self.ids[places[top]], scores[top]


def exact_scores(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products of any integers, held at the limits of a long."""
    sums = (vectors.astype(object) * query.astype(object)).sum(axis=1) if vectors.shape[1] else [0] * len(vectors)
    return np.array([min(max(int(s), LOWEST), HIGHEST) for s in sums], np.int64)


def answered(own: DataFrame, asked: DataFrame, sizes: list[tuple[int, int]], k: int, pilot: bool) -> DataFrame:
    """query_id, hash, vec_id, score: what the pilot blocks, or the others, have for the queries."""
    chosen = (F.col("block") % PILOT == 0) == F.lit(pilot)
    # By vector size, how many blocks it has.
    blocks = F.coalesce(*[F.when(F.col("size") == size, F.lit(n)) for size, n in sizes], F.lit(0)) if sizes else F.lit(0)
    copies = asked.where(blocks > 0).withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).where(chosen)
    vectors = own.where(chosen).select("size", "block", F.lit(0).alias("kind"), "id", "hash", "vector", F.lit(LOWEST).alias("bound"))
    rows = vectors.unionByName(copies.select("size", "block", F.lit(1).alias("kind"), "id", "hash", "vector", "bound"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, index = None, [], None
        for batch in batches:
            size, block, kind, ids, hashes, bounds = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 3, 4, 6))
            cuts = np.flatnonzero((np.diff(size) != 0) | (np.diff(block) != 0) | (np.diff(kind) != 0)) + 1
            for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(block)]):
                if start == end:
                    continue
                part = slice(start, end)
                found = np.asarray(batch.column(5).slice(start, end - start).flatten(), np.int64).reshape(end - start, int(size[start]))
                if (size[start], block[start]) != key:
                    key, held, index = (size[start], block[start]), [], None
                if kind[start] == 0:
                    held.append((ids[part], found))
                    continue
                if held:
                    index, held = Index(*(np.concatenate(x) for x in zip(*held))), []
                if index is not None:
                    yield from record(ids[part], hashes[part], list(index.best(ids[part], found, bounds[part], k)))

    def record(ids: np.ndarray, hashes: np.ndarray, answers: list[tuple]) -> Iterator[pa.RecordBatch]:
        numbers, n = [a[0] for a in answers], [len(a[1]) for a in answers]
        if sum(n):
            columns = [np.repeat(ids[numbers], n), np.repeat(hashes[numbers], n), *(np.concatenate([a[i] for a in answers]) for i in (1, 2))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "hash", "vec_id", "score"])

    dealt = rows.repartition("size", "block").sortWithinPartitions("size", "block", "kind")
    return dealt.mapInArrow(run, "query_id bigint, hash bigint, vec_id bigint, score bigint")


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    scale: float = 64.0,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """The k highest scores of each query row among all vectors but its own: query_id, rank, vec_id, score."""
    own = quantised(vectors, scale, id_column, vector_column)
    asked = quantised(queries, scale, id_column, vector_column).dropDuplicates(["id", "hash"]).withColumn("bound", F.lit(LOWEST))
    # One row for each vector size fixes how many blocks there are.
    counts = [(r["size"], r.n) for r in own.groupBy("size").agg(F.count(F.lit(1)).alias("n")).orderBy("size").collect()]
    each = max(1, min(VECTORS_PER_BLOCK, -(-sum(n for _, n in counts) // LEAST_BLOCKS)))
    sizes = [(size, -(-n // each)) for size, n in counts]
    blocks = F.coalesce(*[F.when(F.col("size") == size, F.lit(n)) for size, n in sizes]) if sizes else F.lit(1)
    own = own.withColumn("block", F.pmod(F.xxhash64("id", "hash"), blocks).cast("int"))
    by_query = Window.partitionBy("query_id", "hash").orderBy(F.desc("score"), "vec_id")

    def ranked(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)

    first = written(ranked(answered(own, asked, sizes, k, pilot=True)), "pilot")
    # A query that has k answers needs only vectors that reach the last of them.
    last = first.where(F.col("rank") == k).select(F.col("query_id").alias("id"), "hash", F.col("score").alias("reached"))
    raised = asked.join(last, ["id", "hash"], "left").withColumn("bound", F.coalesce("reached", "bound")).drop("reached")
    rest = answered(own, raised, sizes, k, pilot=False)
    return ranked(first.drop("rank").unionByName(rest)).select("query_id", "rank", "vec_id", "score")


def quantised(vectors: DataFrame, scale: float, id_column: str, vector_column: str) -> DataFrame:
    """id, vector of longs, its length and hash, of the rows that take part."""
    values = F.transform(F.col(vector_column), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_column).cast("bigint").alias("id"), values.alias("values"))
    rows = rows.where(F.col("id").isNotNull() & F.col("values").isNotNull()).where(
        F.forall("values", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    )
    vector = F.transform("values", lambda x: F.floor(x * scale).cast("bigint"))
    return rows.select("id", vector.alias("vector"), F.size("values").alias("size")).withColumn("hash", F.xxhash64("vector"))

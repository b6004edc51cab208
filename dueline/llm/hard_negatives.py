"""Hard negatives by inner product, with coordinate pruning in buckets of similar length.

Vectors become integers, floor(scale * x). They are dealt into buckets: classes of similar length (by
quantiles of it), each cut by a hash into parts of about VECTORS_PER_BUCKET, so that neither one common
length nor one common vector makes a large one. A request asks, for an anchor, for the ``k`` best rows of
its own label or of other labels whose score lies in given bounds. Requests are copied to the buckets whose
longest vector can reach their lower bound at all; vectors are shuffled once. A bucket's rows arrive first
and become an index, then its requests stream by, so a task holds one bucket and one batch.

The index has, for each coordinate, the bucket's directions (vectors of length one) sorted by it. A lower
bound on the score is one on the cosine: at least t = bound / (anchor's length * longest length). An angle
of at most acos(t) to the anchor leaves coordinate f of a direction between cos(a + acos t) and
cos(a - acos t), where cos a is the anchor's own coordinate. For the anchor's FOCUS largest coordinates
these ranges are looked up in the sorted lists, and the sets of rows they give are intersected; what is left
is scored exactly, by itself if it is little, else together with other requests as a matrix product.

A search runs twice: over every PILOT-th bucket first, whose k-th best score is a proven lower bound of each
request, and then over the rest with these bounds. Positives are a search without bounds, negatives a
search with the bounds that each positive's score sets.

Defined results: rows with a null id, label or vector, or null or non-finite components, take no part;
vectors are compared only with vectors of the same length. Rows with an anchor's id are its own and never
its partners. Rows that repeat an anchor's id, label and vector are one anchor, but several partners. Ties
go to the smaller id. Scores beyond 64 bits are held at the limits of a long, also when they are compared.
Anchors without a positive, and positives without a negative in bounds, give no rows; empty tables none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dueline.llm.shared import written

VECTORS_PER_BUCKET, LENGTH_CLASSES, PILOT = 16384, 16, 8
#: The least number of buckets that work is spread over, if there are so many vectors.
LEAST_BUCKETS = 24
FOCUS = 3
#: Requests whose scores are computed together, and the share of a bucket from which that is cheaper.
TOGETHER, DENSE = 64, 0.25
#: Below this, inner products of up to 2**11 components are exact in doubles.
SAFE = 1 << 20
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1
#: Bounds are widened by this much, for rounding.
SLACK = 1e-9


def exact_scores(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products of any integers, held at the limits of a long."""
    sums = (vectors.astype(object) * query.astype(object)).sum(axis=1) if vectors.shape[1] else [0] * len(vectors)
    return np.array([min(max(int(s), LOWEST), HIGHEST) for s in sums], np.int64)


class Bucket:
    """Vectors of similar length by id, with a sorted list of directions for each coordinate."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels, self.vectors = ids[order], labels[order], vectors[order]
        self.values = self.vectors.astype(np.float64)
        largest = float(np.abs(self.values).max(initial=0.0))
        self.safe = largest < SAFE and vectors.shape[1] <= 1 << 11
        lengths = np.sqrt((self.values**2).sum(axis=1))
        self.longest = lengths.max(initial=0.0) * (1 + SLACK)
        directions = (self.values / np.where(lengths > 0, lengths, 1.0)[:, None]).T
        self.order = np.argsort(directions, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(directions, self.order, axis=1)
        self.rank = np.empty_like(self.order)
        np.put_along_axis(self.rank, self.order, np.arange(len(ids), dtype=np.int32)[None, :], axis=1)

    def candidates(self, query: np.ndarray, least: int) -> np.ndarray | None:
        """Places of all rows that may score ``least`` or more; None for every row."""
        length = float(np.sqrt((query**2).sum()))
        if least <= 0 or not length:
            return None if least <= 0 else np.zeros(0, np.int64)
        cosine = least / (length * self.longest) - SLACK if self.longest else 2.0
        if cosine > 1:
            return np.zeros(0, np.int64)
        reach = np.arccos(cosine)
        focus = np.argsort(-np.abs(query), kind="stable")[:FOCUS]
        own = np.arccos(np.clip(query[focus] / length, -1, 1))
        low, high = np.cos(np.minimum(own + reach, np.pi)) - SLACK, np.cos(np.maximum(own - reach, 0.0)) + SLACK
        ranges = [(int(f), int(self.sorted[f].searchsorted(a)), int(self.sorted[f].searchsorted(b, "right"))) for f, a, b in zip(focus, low, high)]
        ranges.sort(key=lambda r: r[2] - r[1])
        first, start, end = ranges[0]
        if end - start == len(self.ids):
            return None
        places = self.order[first, start:end]
        for f, start, end in ranges[1:]:
            if end - start < len(self.ids):
                rank = self.rank[f, places]
                places = places[(rank >= start) & (rank < end)]
        return places.astype(np.int64)


def best_places(scores: np.ndarray, places: np.ndarray, k: int) -> np.ndarray:
    """The k best by score, ties to the smaller place, as numbers into ``places``."""
    if len(places) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        few = np.flatnonzero(scores >= least)
    else:
        few = np.arange(len(places))
    return few[np.lexsort((places[few], ~scores[few]))][:k]  # ~ reverses the order of integers


def answer(bucket: Bucket, ids: np.ndarray, labels: np.ndarray, queries: np.ndarray, asks: list[list[tuple[int, int, int]]], same: bool, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each request (number of the anchor, ask, ids, scores): its k best in the bucket."""
    safe = bucket.safe and (np.abs(queries).max(initial=0) < SAFE)
    everything = np.arange(len(bucket.ids))
    chosen: dict[int, np.ndarray] = {}
    for at in range(0, len(ids), TOGETHER):
        part = range(at, min(at + TOGETHER, len(ids)))
        sets = {}
        for q in part:
            found = bucket.candidates(queries[q].astype(np.float64), min(low for _, low, _ in asks[q])) if safe else None
            sets[q] = everything if found is None else found
            if same:
                label = int(labels[q])
                if label not in chosen:
                    chosen[label] = np.flatnonzero(bucket.labels == label)
                sets[q] = chosen[label] if found is None else found[bucket.labels[found] == label]
        dense = [q for q in part if len(sets[q]) > DENSE * len(everything)] if safe else []
        together = dict(zip(dense, queries[dense].astype(np.float64) @ bucket.values.T))
        for q in part:
            places = sets[q]
            if q in together:
                scores = together[q][places].astype(np.int64)
            elif safe:
                scores = (bucket.values[places] @ queries[q].astype(np.float64)).astype(np.int64)
            else:
                scores = exact_scores(bucket.vectors[places], queries[q])
            other = bucket.ids[places] != ids[q]
            if not same:
                other &= bucket.labels[places] != labels[q]
            for ask, low, high in asks[q]:
                fit = np.flatnonzero(other & (scores >= low) & (scores <= high))
                top = fit[best_places(scores[fit], places[fit], k)]
                if len(top):
                    yield q, ask, bucket.ids[places[top]], scores[top]


class Buckets:
    """Vectors (of ``integer_vectors``) by bucket: the parts of a class of similar lengths."""

    def __init__(self, vectors: DataFrame) -> None:
        shares = [i / LENGTH_CLASSES for i in range(1, LENGTH_CLASSES)]
        cuts = sorted(set(vectors.agg(F.percentile_approx("length", shares)).first()[0] or []))
        longer = F.filter(F.array(*map(F.lit, cuts)).cast("array<double>"), lambda c: c < F.col("length"))
        # A row for each length class and vector size, however many vectors there are.
        counts = vectors.groupBy("size", F.size(longer).alias("class")).agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("longest"))
        counts = counts.orderBy("size", F.desc("class")).collect()
        each = max(1, min(VECTORS_PER_BUCKET, -(-sum(c.n for c in counts) // LEAST_BUCKETS)))
        ends, first, classes = [-1.0, *cuts, float("inf")], 0, []
        for c in counts:
            parts = -(-c.n // each)
            classes.append(F.struct(*(F.lit(x).alias(name) for name, x in (("size", c.size), ("above", ends[c["class"]]), ("upto", ends[c["class"] + 1]), ("longest", c.longest), ("first", first), ("parts", parts)))))
            first += parts
        self.classes = F.array(*classes).cast("array<struct<size int, above double, upto double, longest double, first bigint, parts bigint>>")
        own = F.filter(self.classes, lambda c: (c["size"] == F.col("size")) & (c["above"] < F.col("length")) & (c["upto"] >= F.col("length")))
        bucket = F.transform(own, lambda c: c["first"] + F.pmod(F.xxhash64("id", "hash"), c["parts"]))[0]
        self.rows = vectors.withColumn("bucket", bucket)

    def answered(self, asked: DataFrame, same: bool, k: int, pilot: bool) -> DataFrame:
        """anchor, ask, other, score: what the pilot buckets, or the others, have for the requests, from each
        bucket k rows at most."""
        chosen = (F.col("bucket") % PILOT == 0) == F.lit(pilot)
        least = F.array_min(F.transform("asks", lambda a: a["low"])).cast("double")
        in_reach = F.filter(self.classes, lambda c: (c["size"] == F.col("size")) & (F.col("length") * c["longest"] * (1 + SLACK) >= least))
        requests = asked.withColumn("to", F.explode(in_reach)).withColumn("bucket", F.explode(F.expr("sequence(to.first, to.first + to.parts - 1)")))
        requests = requests.where(chosen).select("bucket", F.lit(1).alias("kind"), "id", "label", "hash", "vector", "asks")
        none = F.lit(None).cast(asked.schema["asks"].dataType)
        rows = self.rows.where(chosen).select("bucket", F.lit(0).alias("kind"), "id", "label", "hash", "vector", none.alias("asks"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, held, index = None, [], None
            for batch in batches:
                bucket, kind, ids, labels, hashes = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
                cuts = np.flatnonzero((np.diff(bucket) != 0) | (np.diff(kind) != 0)) + 1
                for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(bucket)]):
                    if start == end:
                        continue
                    vectors = np.asarray(batch.column(5).slice(start, end - start).flatten(), np.int64).reshape(end - start, -1)
                    if bucket[start] != key:
                        key, held, index = bucket[start], [], None
                    if kind[start] == 0:
                        held.append((ids[start:end], labels[start:end], vectors))
                        continue
                    if held:
                        index, held = Bucket(*(np.concatenate(x) for x in zip(*held))), []
                    if index is not None:
                        asks = [[(a["ask"], a["low"], a["high"]) for a in own] for own in batch.column(6).slice(start, end - start).to_pylist()]
                        yield from record(hashes[start:end], answer(index, ids[start:end], labels[start:end], vectors, asks, same, k))

        def record(hashes: np.ndarray, answers: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
            if out := list(answers):
                n = [len(a[2]) for a in out]
                columns = [np.repeat(hashes[[a[0] for a in out]], n), np.repeat([a[1] for a in out], n), *(np.concatenate([a[i] for a in out]) for i in (2, 3))]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["anchor", "ask", "other", "score"])

        dealt = rows.unionByName(requests).repartition("bucket").sortWithinPartitions("bucket", "kind")
        return dealt.mapInArrow(run, "anchor bigint, ask bigint, other bigint, score bigint")


def search(buckets: Buckets, asked: DataFrame, same: bool, k: int) -> DataFrame:
    """anchor (its hash), ask, rank, other, score: the k best rows of each request within its bounds.

    ``asked`` has the rows that are anchors, and their asks: an array of (ask, low, high).
    """
    by_request = Window.partitionBy("anchor", "ask").orderBy(F.desc("score"), "other")

    def ranked(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(by_request)).where(F.col("rank") <= k)

    first = written(ranked(buckets.answered(asked, same, k, pilot=True)), "pilot")
    # A request that has k answers needs only rows that reach the last of them.
    bounds = first.where(F.col("rank") == k).groupBy(F.col("anchor").alias("hash")).agg(F.map_from_entries(F.collect_list(F.struct("ask", "score"))).alias("bounds"))
    raised = F.transform("asks", lambda a: a.withField("low", F.greatest(a["low"], F.coalesce(F.try_element_at("bounds", a["ask"]), a["low"]))))
    rest = asked.join(bounds, "hash", "left").withColumn("asks", raised).drop("bounds")
    return ranked(first.drop("rank").unionByName(buckets.answered(rest, same, k, pilot=False)))


def integer_vectors(vectors: DataFrame, scale: float, id_column: str, label_column: str, vector_column: str) -> DataFrame:
    """id, label, vector of longs, its size and length, and a hash, of the rows that take part."""
    values = F.transform(F.col(vector_column), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_column).cast("bigint").alias("id"), F.col(label_column).cast("bigint").alias("label"), values.alias("values"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("values").isNotNull()).where(
        F.forall("values", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    )
    vector = F.transform("values", lambda x: F.floor(x * scale).cast("bigint"))
    rows = rows.select("id", "label", vector.alias("vector"), F.size("values").alias("size"))
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return rows.withColumns({"length": length, "hash": F.xxhash64("id", "label", "vector")})


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 10,
    low_percent: int = 30,
    high_percent: int = 90,
    scale: float = 256.0,
    id_column: str = "vec_id",
    label_column: str = "label",
    vector_column: str = "embedding",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor (rows where
    ``is_anchor``, in terms of the column ``id``) and each of its first ``positives`` rows of the same label,
    the first ``negatives`` rows of other labels whose score is from ``low_percent`` to ``high_percent`` of the
    positive's."""
    rows = written(integer_vectors(vectors, scale, id_column, label_column, vector_column), "vectors")
    buckets = Buckets(rows)
    anchors = rows.where(is_anchor).dropDuplicates(["id", "label", "hash"])
    every = F.array(F.struct(F.lit(0).cast("bigint").alias("ask"), F.lit(LOWEST).alias("low"), F.lit(HIGHEST).alias("high")))
    near = written(search(buckets, anchors.withColumn("asks", every), True, positives).select("anchor", "rank", F.col("other").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # The least and the largest integer score in bounds; by decimals, as a hundredfold may not fit a long.
    percent = lambda p: F.col("positive_score").cast("decimal(28,0)") * p / 100
    low, high = F.ceil(percent(low_percent)).cast("bigint"), F.floor(percent(high_percent)).cast("bigint")
    asks = near.where(low <= high).groupBy("anchor").agg(
        F.sort_array(F.collect_list(F.struct(F.col("rank").cast("bigint").alias("ask"), low.alias("low"), high.alias("high")))).alias("asks")
    )
    asked = anchors.join(asks, F.col("hash") == F.col("anchor")).drop("anchor")
    found = search(buckets, asked, False, negatives)
    named = near.select("anchor", F.col("rank").cast("bigint").alias("ask"), "positive_id", "positive_score")
    ids = anchors.select(F.col("hash").alias("anchor"), F.col("id").alias("anchor_id"))
    return (
        found.join(named, ["anchor", "ask"])
        .join(ids, "anchor")
        .select("anchor_id", "positive_id", "rank", F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    )


def relabelled(label: Column, vec_id: Column) -> Column:
    """Labels of rows whose id is divisible by 7 move on by one of ten."""
    label = label.cast("bigint")
    return F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)


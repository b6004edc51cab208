"""Whitening and hard negatives against plain versions."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dueline.llm import hard_negatives
from dueline.llm.hard_negatives import Bucket, answer, mine
from dueline.llm.queries import op11_embedding_whitening
from dueline.llm.whitening import fit, inertia, leading, whiten, whitened_components

SF = "/root/testdata/sf0.01"


def spectrum(values: list[float], seed: int = 1) -> np.ndarray:
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    full = (q * np.array(values)) @ q.T
    return (full + full.T) / 2


@pytest.mark.parametrize(
    "values",
    [
        [9.0, 7.0, 5.0, 3.0, 1.0, 0.5], [5.0] * 12 + [1.0] * 20 + [0.0] * 8, [3.0] + [2.0] * 9 + list(np.linspace(0, 1, 30)),
        [1.0] + [0.0] * 9, [1.0] * 10, [1e6] + [1e-3] * 11, list(1 + np.arange(40) * 1e-7), [4.0], [0.0, 0.0],
    ],
)
def test_leading_pairs_equal_a_dense_solver(values):
    matrix = spectrum(values)
    got, vectors = leading(matrix, 8)
    expected = np.linalg.eigvalsh(matrix)[::-1]
    expected = expected[expected > len(values) * 2.3e-16 * max(expected[0], 1e-300)][:8]
    assert len(got) == len(expected) and np.allclose(got, expected, rtol=0, atol=1e-12 * max(values))
    assert np.allclose(vectors @ vectors.T, np.eye(len(got)), atol=1e-12)
    assert np.allclose(matrix @ vectors.T, vectors.T * got, atol=1e-11 * max([*values, 1.0]))


def test_inertia_counts():
    for values in ([3.0, 2.0, 2.0, -1.0, 0.5], [1.0, -1.0], [0.0, 4.0], list(np.linspace(-3, 3, 31))):
        matrix = spectrum(values, 5)
        for shift in (-5.0, -0.75, 0.25, 1.5, 2.25, 3.5):
            assert inertia(matrix, shift) == sum(v > shift for v in values)
    swap = np.array([[0.0, 1.0], [1.0, 0.0]])  # no pivot on the diagonal
    assert inertia(swap, 0.0) == 1


def brute_whitening(rows: list[tuple], k: int) -> dict:
    x = np.array([[math.floor(1024 * float(c)) + 100000 for c in v] for _, v in rows], object)
    n, s = len(x), x.sum(axis=0)
    deviation = [int(((n * row - s) ** 2).sum()) for row in x]
    centred = x.astype(float) - (s / n).astype(float)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    return {"n": n, "deviation": deviation, "whitened": centred @ vectors / np.sqrt(values), "explained": values / np.trace(centred.T @ centred / n)}


def test_whitening_equals_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()]
    expected = brute_whitening(rows, 8)
    got = op11_embedding_whitening(spark, SF).orderBy("vec_id", "component").toPandas()
    assert len(got) == 8 * len(rows) and set(got.n) == {expected["n"]} and got.component.tolist() == list(range(1, 9)) * len(rows)
    assert got.deviation.tolist() == [d for d in expected["deviation"] for _ in range(8)]
    assert np.allclose(got.explained.to_numpy().reshape(-1, 8), expected["explained"], rtol=1e-9)
    ours = got.whitened.to_numpy().reshape(-1, 8)
    signs = np.sign((ours * expected["whitened"]).sum(axis=0))
    assert np.allclose(ours * signs, expected["whitened"], atol=1e-8)
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9


def test_whitening_of_odd_tables(spark):
    rnd = random.Random(4)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(5)]) for i in range(60)]
    odd = [(None, rows[0][1]), (1, rows[1][1]), (70, None), (71, []), (72, [1.0, None, 1.0, 1.0, 1.0]), (73, [math.nan] * 5), (74, [math.inf] * 5), (75, [1.0, 2.0])]
    table = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>").repartition(4)
    table = table.withColumns({"whitened": F.lit("x"), "deviation": F.lit(1), "n": F.lit(None)})
    model = fit(table)
    assert model.n == 62 and model.dims == 5 and len(model.eigenvalues) == 5  # fewer than 8 dimensions
    out = whiten(table, model)
    assert out.columns == [*table.columns, "whitened_", "deviation_"] and out.count() == 62
    assert whitened_components(table).groupBy("component").count().count() == 5
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id bigint, embedding array<float>")
    assert whitened_components(same).collect() == []  # no variance, no components
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(9)], "vec_id bigint, embedding array<float>")
    got = whitened_components(line).toPandas()
    assert set(got.component) == {1} and abs((got.whitened**2).mean() - 1) < 1e-9
    assert whitened_components(table.limit(0)).collect() == []
    huge = spark.createDataFrame([(i, [3e38 * (-1) ** i, float(i)]) for i in range(6)], "vec_id bigint, embedding array<float>")
    assert {r.deviation for r in whitened_components(huge).collect()} == {(1 << 63) - 1}


# Hard negatives --------------------------------------------------------------------------------


def brute_mine(rows: list[tuple], anchor, positives: int, negatives: int, low: int, high: int) -> list[tuple]:
    clean = [
        (i, label, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, label, v in rows
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for a, label, v in sorted({c for c in clean if anchor(c[0])}):
        scored = [(-min(max(sum(x * y for x, y in zip(v, w)), -(1 << 63)), (1 << 63) - 1), i, m) for i, m, w in clean if i != a and len(w) == len(v)]
        first = sorted((s, i) for s, i, m in scored if m == label)[:positives]
        for p, i in first:
            fit_ = sorted((s, j) for s, j, m in scored if m != label and low * -p <= 100 * -s <= high * -p)[:negatives]
            out += [(a, i, r, j, -p, -s) for r, (s, j) in enumerate(fit_, 1)]
    return sorted(out)


def odd_vectors(seed: int, n: int = 400) -> list[tuple]:
    """Clusters of different lengths, ties, repeats, and rows that take no part."""
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 1) for _ in range(8)] for _ in range(4)]
    rows = []
    for i in range(n):
        c, length = centres[i % 4], rnd.choice([0.1, 1.0, 3.0])
        rows.append((i, rnd.choice([i % 4, i % 4, 3, 7]), [length * (x + rnd.gauss(0, 0.3)) for x in c]))
    rows += [(1000 + i, i % 2, [0.5] * 8) for i in range(40)]  # ties
    rows += [rows[10], rows[10], (10, 5, rows[10][2]), (20, rows[20][1], rows[21][2])]  # repeats, one id with two vectors
    rows += [(None, 1, [1.0] * 8), (2000, None, [1.0] * 8), (2010, 1, None), (2020, 1, [math.nan] * 8), (2030, 1, [None] * 8), (2040, 1, [0.0] * 8)]
    return rows + [(2050, 1, [1.0, 2.0]), (2051, 1, [2.0, 2.0]), (2052, 2, [1.0, 1.0]), (2060, 1, []), (2061, 1, [])]


@pytest.mark.parametrize("small_buckets", [False, True])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, small_buckets):
    monkeypatch.setattr(hard_negatives, "VECTORS_PER_BUCKET", 9 if small_buckets else 500)
    monkeypatch.setattr(hard_negatives, "LEAST_BUCKETS", 1)
    rows = odd_vectors(11)
    table = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>").withColumns({"rank": F.lit("x"), "hash": F.lit(0)})
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = mine(table, F.col("id") % 10 == 0, positives=3, negatives=4).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(map(tuple, got)) == brute_mine(rows, lambda i: i % 10 == 0, 3, 4, 30, 90)


def test_hard_negatives_of_huge_and_no_vectors(spark):
    rows = [(0, 1, [1e16, 1.0]), (1, 1, [1e16, 2.0]), (2, 2, [1e15, 0.0]), (3, 2, [5e15, 1.0]), (10, 1, [0.25, -0.5]), (11, 1, [0.5, -0.5]), (12, 2, [0.2, -0.2])]
    table = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>")
    got = mine(table, F.col("id") % 10 == 0)
    assert sorted(map(tuple, got.collect())) == brute_mine(rows, lambda i: i % 10 == 0, 5, 10, 30, 90)
    assert mine(table.limit(0), F.col("id") % 10 == 0).collect() == []
    assert mine(table.where("label = 2"), F.col("id") % 10 == 0).collect() == []


def test_coordinate_ranges_prune_and_lose_nothing():
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((50, 8))
    vectors = np.floor(256 * (centres[rng.integers(0, 50, 4000)] + 0.05 * rng.standard_normal((4000, 8)))).astype(np.int64)
    bucket = Bucket(np.arange(4000), np.zeros(4000, np.int64), vectors)
    query = vectors[7]
    scores = vectors @ query
    least = int(0.95 * scores[7])
    places = bucket.candidates(query.astype(float), least)
    assert set(np.flatnonzero(scores >= least)) <= set(places.tolist()) and len(places) < 1500
    ((_, _, ids, found),) = answer(bucket, np.array([7]), np.array([1]), query[None, :], [[(0, least, 1 << 60)]], False, 5)
    best = sorted((-s, i) for i, s in enumerate(scores.tolist()) if i != 7 and s >= least)[:5]
    assert [(-s, i) for i, s in zip(ids.tolist(), found.tolist())] == best

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from dueline.llm.components import components
from dueline.llm.exact_dedup import drop_duplicates, mark_duplicates
from dueline.llm.simhash import BLOCK_WIDTHS, buckets, drop_near_duplicates, finer_masks, fingerprints_of, forest, link_buckets, masks, near_duplicates, signed
from tests.llm import brute
from tests.llm.conftest import ODD

CLASH = {"keep_id": 1, "hash": "x", "best": 2, "simhash_fp": 3, "kept": None}


def classes(rows: list[tuple]) -> dict[str, list]:
    out: dict[str, list] = {}
    for r in rows:
        out.setdefault((r[1] or "").translate(brute.A_TO_Z), []).append(r[0])
    return out


def test_exact_marks_every_row(make):
    got = mark_duplicates(make(ODD, CLASH)).collect()
    expected = []
    for ids in classes(ODD).values():
        keep = max((i for i in ids if i is not None), default=None)
        expected += [(i, keep, len(ids), i == keep) for i in ids]
    assert sorted(map(repr, (tuple(r)[:4] for r in got))) == sorted(map(repr, expected))


@pytest.mark.parametrize("largest", [True, False])
def test_exact_keeps_one_row_of_each_text(make, largest):
    docs = make(ODD, CLASH)
    got = drop_duplicates(docs, keep_largest=largest)
    assert got.columns == docs.columns
    pick = max if largest else min
    expected = [pick((i for i in ids if i is not None), default=None) for ids in classes(ODD).values()]
    assert sorted(map(repr, (r.doc_id for r in got.collect()))) == sorted(map(repr, expected))


def test_texts_with_one_hash_stay_apart(make):
    rows = [(1, "aa"), (2, "bb"), (3, "AA"), (4, "cc")]
    got = {r.doc_id: (r.keep_id, r.group_size) for r in mark_duplicates(make(rows), content_hash=F.length).collect()}
    assert got == {1: (3, 2), 2: (2, 1), 3: (3, 2), 4: (4, 1)}
    assert {r.doc_id for r in drop_duplicates(make(rows), content_hash=F.length).collect()} == {2, 3, 4}


def test_empty_tables(make):
    for f in (mark_duplicates, drop_duplicates, near_duplicates, drop_near_duplicates):
        assert f(make([])).collect() == []


def test_fingerprints_equal_brute_force():
    texts = [t or "" for _, t in ODD] + ["a", "A b", "a b c", "a\x0bb\x1cc d e", "a b " * 500, "x" * 100_000]
    assert fingerprints_of(texts).tolist() == [brute.fingerprint(t) for t in texts]


def near_rows() -> list[tuple]:
    rnd = random.Random(3)
    rows = []
    for family in range(12):
        words = [f"w{rnd.randrange(4000)}" for _ in range(150)]
        for _ in range(8):
            own = list(words)
            for _ in range(rnd.randrange(3)):
                own[rnd.randrange(150)] = f"v{rnd.randrange(4000)}"
            rows.append((1000 * family + rnd.randrange(1000), " ".join(own)))
    return rows


def test_near_duplicates_equal_brute_force(make):
    rows = ODD + near_rows()
    got = near_duplicates(make(rows, CLASH)).collect()
    prints = [brute.fingerprint(t or "") for _, t in rows]
    least = brute.components(prints, [i for i, _ in rows])
    expected = [(i, f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, least)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))


def test_one_document_of_each_component_stays(make):
    rows = ODD + near_rows()
    docs = make(rows, CLASH)
    got = drop_near_duplicates(docs)
    assert got.columns == docs.columns
    least = brute.components([brute.fingerprint(t or "") for _, t in rows], [i for i, _ in rows])
    # Components of test rows have different smallest ids, so these name them.
    assert sorted(map(repr, (r.doc_id for r in got.collect()))) == sorted(map(repr, set(least)))


def test_repeated_id_with_different_texts(make):
    rows = [(1, "one text of some words"), (1, "quite another thing is said here"), (1, "one text of some words")]
    assert len(drop_near_duplicates(make(rows)).collect()) == 2


@pytest.mark.parametrize("most", [4096, 2, 0])
def test_links_hold_all_pairs_within_three_bits(spark, most):
    rnd = random.Random(5)
    prints = {rnd.getrandbits(64) for _ in range(300)}
    for p in list(prints)[:150]:
        for bits in (1, 2, 3, 3, 4):
            prints.add(p ^ sum(1 << b for b in rnd.sample(range(64), bits)))
    prints = sorted(prints)
    table = spark.createDataFrame([(signed(p),) for p in prints], "fp bigint")
    found = components(link_buckets(table, most)).collect()
    root = {r.node % 2**64: r.root % 2**64 for r in found}
    got: dict[int, set] = {}
    for p in prints:
        got.setdefault(root.get(p, p), set()).add(p)
    least = brute.components(prints, list(range(len(prints))))
    expected: dict[int, set] = {}
    for p, c in zip(prints, least):
        expected.setdefault(c, set()).add(p)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, expected.values()))


def test_masks_cover_half_the_bits_at_least():
    assert len(masks()) == 20 and sum(BLOCK_WIDTHS) == 64
    assert min(m.bit_count() for m in masks()) >= 31


def test_large_buckets_are_dealt_again(spark):
    assert [len(own) for own in finer_masks()] == [20] * 20
    for mask, own in zip(masks(), finer_masks()):
        assert all(m & mask == mask for m in own) and min(m.bit_count() for m in own) >= 46
    # A third of all fingerprints agree in their first 32 bits and are spread over the others.
    rnd = random.Random(6)
    prints = {rnd.getrandbits(64) for _ in range(600)} | {(rnd.getrandbits(31) << 33) | 5 for _ in range(300)}
    table = spark.createDataFrame([(signed(p),) for p in prints], "fp bigint")
    sizes = {r.choice: r["max(count)"] for r in buckets(table, 50).groupBy("choice", "bits").count().groupBy("choice").max("count").collect()}
    assert min(sizes) < 20 <= max(sizes) and max(sizes.values()) <= 50
    assert max(r["count"] for r in buckets(table).groupBy("choice", "bits").count().collect()) == 300


def test_forest_returns_no_more_links_than_members():
    import numpy as np

    prints = np.array([0, 1, 2, 3, 7, 15 << 58], np.uint64)
    assert len(forest(prints)) == 4


@pytest.mark.parametrize("shape", ["chain", "star", "none"])
def test_components(spark, shape):
    n = 200
    pairs = {"chain": [(i, i + 1) for i in range(n)], "star": [(0, i) for i in range(1, n)], "none": [(4, 4)]}[shape]
    random.Random(1).shuffle(pairs)
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == ({} if shape == "none" else dict.fromkeys({x for p in pairs for x in p}, 0))


def test_maps_and_repeated_rows_are_no_obstacle(make):
    docs = make([(1, "A b"), (1, "a B"), (2, "a b"), (2, "a b"), (None, "a b"), (None, "c")], {"lang": "x"})
    docs = docs.withColumn("facts", F.create_map(F.lit("k"), F.array(F.lit(1))))
    for largest, keep in ((True, {2, None}), (False, {1, None})):
        out = drop_duplicates(docs, keep_largest=largest)
        assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == keep and out.count() == 2

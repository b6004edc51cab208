from __future__ import annotations

import random
from itertools import combinations

import pytest

import corpus_pipeline
from dueline.llm.similar import drop_similar
from tests.llm import brute
from tests.llm.conftest import ODD


def shingles(text: str | None) -> set[str]:
    words = (text or "").translate(brute.A_TO_Z).split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar(a: set, b: set) -> bool:
    return a == b or len(a & b) / len(a | b) >= 0.8


def expected(rows: list[tuple]) -> list:
    """The smallest id of each component; null if it has none."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if similar(sets[i], sets[j]):
            root[find(j)] = find(i)
    members: dict[int, list] = {}
    for i in range(len(rows)):
        members.setdefault(find(i), []).append(rows[i][0])
    return sorted((min((x for x in m if x is not None), default=None) for m in members.values()), key=repr)


def families() -> list[tuple]:
    """Texts whose similarities lie on both sides of 0.8, in chains too."""
    rnd, rows = random.Random(8), []
    for family in range(12):
        own = [f"w{rnd.randrange(4000)}" for _ in range(150)]
        for k in range(10):
            rows.append((1000 * family + 100 + k, " ".join(own)))
            own = list(own)
            for _ in range(rnd.randrange(1, 6)):
                own[rnd.randrange(150)] = f"v{rnd.randrange(4000)}"
    return rows


def chained() -> list[tuple]:
    """A large family around one text, and others that share a boilerplate with it but are not similar."""
    rnd, rows = random.Random(9), []
    common = [f"b{i}" for i in range(120)]
    for k in range(60):
        own = list(common) + [f"c{i}" for i in range(60)]
        own[rnd.randrange(180)] = f"v{k}"
        rows.append((5000 + k, " ".join(own)))
    for k in range(40):
        own = list(common) + [f"d{k // 4}x{i}" for i in range(60)]
        own[rnd.randrange(180)] = f"w{k}"
        rows.append((6000 + k, " ".join(own)))
    return rows


@pytest.mark.parametrize("block_rows", [4096, 7])
def test_families_with_a_common_boilerplate(make, block_rows):
    rows = chained() + [(i + 9000, t) for i, t in families()[:30]]
    got = drop_similar(make(rows), block_rows=block_rows)
    assert sorted((r.doc_id for r in got.collect()), key=repr) == expected(rows)


@pytest.mark.parametrize("block_rows", [4096, 3])
def test_one_document_of_each_component_stays(make, block_rows):
    rows = ODD + families()
    docs = make(rows, {"similar_words": 1})
    got = drop_similar(docs, block_rows=block_rows)
    assert got.columns == docs.columns
    assert sorted((r.doc_id for r in got.collect()), key=repr) == expected(rows)


def test_stage_leaves_no_near_copies(spark, make):
    rows = families()
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    left = [shingles(r.text) for r in stage(spark, make(rows), "").collect()]
    assert len(left) < len(rows) and not any(similar(a, b) for a, b in combinations(left, 2))


def test_empty_table(make):
    assert drop_similar(make([])).collect() == []

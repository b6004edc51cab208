"""The pipeline's stage of near copies links by SimHash fingerprints too."""

from __future__ import annotations

import corpus_pipeline
from dueline.llm.simhash import fingerprints_of, with_fingerprint
from dueline.llm.similar import drop_similar, with_bands
from tests.llm.test_similar import shingles, similar


def test_near_copies_by_fingerprint_that_sets_do_not_show(spark, make):
    """Texts that repeat themselves, with different ends; one similar to the larger of them by its set."""
    ends = [" ".join(f"e{k}x{i}" for i in range(8)) for k in range(2)]
    first, second = ("x y z " * 200 + end for end in ends)
    third = second.replace("x y z " * 200, "x y z " * 3)
    rows = [(2, first), (5, second), (9, third), (12, "something else altogether, of its own")]
    assert bin(int.__xor__(*map(int, fingerprints_of([first, second])))).count("1") <= 3
    assert not similar(shingles(first), shingles(second)) and similar(shingles(second), shingles(third))
    kept = [sorted(r.doc_id for r in out.collect()) for out in (corpus_pipeline.simhash_near_dedup(spark, make(rows), ""), drop_similar(make(rows)))]
    assert kept == [[2, 12], [2, 5, 12]]


def test_bands_and_fingerprints_are_one_pass_in_python(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b c d", "", None, "é x"])], "doc_id bigint, text string")
    marked = with_bands(docs, "words", "n", "bands", "text", 5, "fp", True)
    assert marked._jdf.queryExecution().analyzed().toString().count("MapInArrow") == 1
    want = {r.doc_id: r.fp for r in with_fingerprint(docs, "fp").collect()}
    assert {r.doc_id: r.fp for r in marked.collect()} == want
    assert [r.fp for r in with_bands(docs, "words", "n", "bands", "text", 5, "fp", False).collect()] == [None] * 4

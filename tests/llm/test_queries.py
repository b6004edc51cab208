from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from dueline.llm.mixing import mix
from dueline.llm.quality import score
from dueline.llm.queries import ORACLES, QUERIES, RECIPE, REST, SEED
from dueline.llm.shared import read, written
from tests.compare import differences, duckdb_rows
from tests.llm import brute
from tests.llm.test_similar import expected

SF_DIR = "/root/testdata/sf0.001"


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(queries()) and set(ORACLES) <= set(oracle_sql())
    assert corpus_pipeline.ORACLE_SQL is None and "pipeline" not in oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert differences(QUERIES[name](spark, SF_DIR).toPandas(), duckdb_rows(ORACLES[name], SF_DIR)) is None


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_of_an_empty_table(spark, name):
    docs = read(spark, SF_DIR, "documents").limit(0)
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, SF_DIR)
    assert out.collect() == [] and (name == "packing" or out.columns == docs.columns)


def test_pipeline_stages_equal_brute_force(spark):
    docs = read(spark, SF_DIR, "documents")
    columns = docs.columns
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(written(stage(spark, kept[-1], SF_DIR), name))
    assert all(k.columns == columns for k in kept[:-1])
    texts = [{r.doc_id: r.text or "" for r in k.select("doc_id", "text").collect()} for k in kept[:-1]]

    good = score(docs, read(spark, SF_DIR, "labels")).where("predicted = 1").collect()
    assert texts[1].keys() == {r.doc_id for r in good} < texts[0].keys()

    largest = {}
    for doc_id, text in sorted(texts[1].items()):
        largest[text.translate(brute.A_TO_Z)] = doc_id
    assert texts[2].keys() == set(largest.values())

    ids = sorted(texts[2])
    assert texts[3].keys() == set(expected([(i, texts[2][i]) for i in ids]))

    mixed = mix(kept[3], RECIPE, REST, seed=SEED, details=True).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    copies = Counter(r.doc_id for r in kept[4].collect())
    assert copies == {r.doc_id: r.n for r in mixed.collect()}

    pieces = kept[5].collect()
    for doc_id, n in copies.items():
        own = [r for r in pieces if r.doc_id == doc_id]
        assert sum(r.length for r in own) == n * own[0].doc_tokens

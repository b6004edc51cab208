from __future__ import annotations

from collections import Counter

from dueline.llm import mixing, queries
from dueline.llm.shared import read, written
from tests.llm.test_queries import SF_DIR


def test_query_mixes_whole_documents(spark, monkeypatch):
    tables = []

    def kept(df, name):
        tables.append(written(df, name))
        return tables[-1]

    monkeypatch.setattr(mixing, "written", kept, raising=False)
    got = queries.op9_mix_sources(spark, SF_DIR)
    docs = read(spark, SF_DIR, "documents")
    whole = {r.doc_id: tuple(r) for r in docs.collect()}
    mixed = tables[0].select(*docs.columns).collect()
    assert all(tuple(r) == whole[r.doc_id] for r in mixed)
    assert Counter(r.doc_id for r in mixed) == Counter(r.doc_id for r in got.collect())

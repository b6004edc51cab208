from __future__ import annotations

import os

import pytest
from pyspark.sql import DataFrame, SparkSession

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "word " * 40_000


@pytest.fixture(scope="session")
def make(spark: SparkSession):
    """Documents of (doc_id, text) or (doc_id, text, source)."""

    def build(rows: list[tuple], extra: dict[str, object] | None = None) -> DataFrame:
        full = [(r[0], r[1], None, r[2] if len(r) > 2 else "s", 7) for r in rows]
        docs = spark.createDataFrame(full, DOCS).repartition(3, "text")
        for name, value in (extra or {}).items():
            from pyspark.sql import functions as F

            docs = docs.withColumn(name, F.lit(value))
        return docs

    return build


#: Null and empty texts, null and repeated ids, copies up to case, near copies, a very long text.
ODD = [
    (5, None),
    (2, ""),
    (None, "Some words of a text that has no id at all, but that is fine."),
    (7, "some words of a text that has no id at ALL, but that is fine."),
    (7, "some words of a text that has no id at ALL, but that is fine."),
    (9, "É and é differ, a and A do not"),
    (10, "É and é differ, A and a do not"),
    (11, "é and é differ, A and a do not"),
    (12, LONG),
    (13, LONG + "end"),
    (14, " \n\t "),
    (15, "\u0001 \u0002 \U0001f600 x@y.com 1.2.3.4 \U0001f600 +1 234 567 890"),
    (16, "MIT\nReleased under the MIT License.\n"),
]

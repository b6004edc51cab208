from __future__ import annotations

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dueline.llm.packing import pack
from dueline.llm.quality import keep_good
from dueline.llm.shared import BATCH_BYTES, BYTES_OF_A_BATCH, map_batches
from dueline.llm.similar import drop_similar
from dueline.llm.simhash import near_duplicates

WORD = public_tokenizers.path("word_bpe_49k.json")


def sizes(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "bytes"])


@pytest.fixture
def unset(spark):
    before = spark.conf.get(BYTES_OF_A_BATCH, None)
    spark.conf.unset(BYTES_OF_A_BATCH)
    yield spark
    spark.conf.unset(BYTES_OF_A_BATCH)
    if before is not None:
        spark.conf.set(BYTES_OF_A_BATCH, before)


def long_texts(spark, n=3000):
    return spark.range(n, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 1000).alias("text"))


def test_batches_are_bounded_in_bytes_and_lose_nothing(unset):
    got = map_batches(long_texts(unset), sizes, "n bigint, bytes bigint").collect()
    assert sum(r.n for r in got) == 3000
    assert max(r.bytes for r in got) < BATCH_BYTES + 100_000


def test_a_smaller_bound_of_the_session_stays(unset):
    unset.conf.set(BYTES_OF_A_BATCH, "100000")
    got = map_batches(long_texts(unset, 100), sizes, "n bigint, bytes bigint").collect()
    assert sum(r.n for r in got) == 100 and max(r.bytes for r in got) < 200_000
    assert unset.conf.get(BYTES_OF_A_BATCH) == "100000"


@pytest.mark.parametrize("stage", ["keep_good", "drop_similar", "near_duplicates", "pack"])
def test_operators_that_take_whole_texts_bound_them(unset, stage):
    docs = long_texts(unset, 3)
    labels = unset.createDataFrame([(0, 1)], "doc_id bigint, quality int")
    made = {
        "keep_good": lambda: keep_good(docs, labels),
        "drop_similar": lambda: drop_similar(docs, simhash=True),
        "near_duplicates": lambda: near_duplicates(docs),
        "pack": lambda: pack(docs, WORD, 2),
    }
    made[stage]()
    assert 0 < int(unset.conf.get(BYTES_OF_A_BATCH)) <= BATCH_BYTES

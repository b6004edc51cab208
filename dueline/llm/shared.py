"""Small helpers of the corpus operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from dueline.plans.shared import shared_folder

#: Bytes of an Arrow batch of texts, up to one row more. Spark's own bound is 10,000 rows, however long they are.
BATCH_BYTES, BYTES_OF_A_BATCH = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder: computed once, and not lost with an executor."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Returns freed memory to the system, which a Python worker else holds as long as it lives."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """``mapInArrow`` in bounded memory: batches of BATCH_BYTES, and what a batch took is given back after it.

    The bound is a setting of the session, as Spark has no other; one that is smaller already stays."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(BYTES_OF_A_BATCH, None) or 0) < BATCH_BYTES:
        conf.set(BYTES_OF_A_BATCH, str(BATCH_BYTES))

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch
                del batch
                give_back()

        yield from run(each())
        give_back()

    return df.mapInArrow(bounded, schema)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame doesn't have; names are compared without case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """Only A-Z in lower case. A text with as many bytes as characters is ASCII: lower() is fast there."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))

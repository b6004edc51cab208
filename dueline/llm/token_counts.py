"""Token counts of texts, without token ids.

1. Pre-tokens: each task cuts its texts and sends on each distinct pre-token with its frequency; a
   grouping with map-side partials makes the corpus's table of them. A frequent word is one row a task.
2. The tokenizers library counts the pieces of each distinct pre-token once.
3. Texts are cut again into frequencies of pre-tokens by document. Pre-tokens that are at
   least 1 / COMMON of all occurrences, which would be hot keys, come to them by broadcast: there can be
   no more than COMMON of them, of LONG characters, whatever the corpus's size is (of natural words a
   tenth of that or less). The others go to the table by a join on the pre-token, and the products of
   frequency and pieces are summed by document.

Runs longer than LONG characters, such as paragraphs of scripts without spaces, are cut into pre-tokens by
the library. What is still longer (long names and numbers, or a run with a special string) is counted
where it stands and doesn't travel.

Null texts count as empty and have no tokens. Rows are told by a key of their own, so repeated or null
ids change nothing. Special strings in a text are special tokens, as the library's default has it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dueline.llm.shared import text_or_empty, written
from dueline.llm.tokens import blocks, bounds, short_pretokens, table

#: Pre-tokens that are broadcast at most, and the most characters of a pre-token that is shuffled.
COMMON, LONG = 1_000_000, 128
RARE = "array<struct<word: string, n: bigint>>"


def pretokens(texts: DataFrame, vocabulary: str) -> DataFrame:
    """word, n (how often it is in all texts), pieces: each distinct pre-token once."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                words, _, places, often = short_pretokens(block, vocabulary, LONG)
                n = np.bincount(places, often, len(words)).astype(np.int64)
                short = [i for i, w in enumerate(words) if len(w) <= LONG]
                yield pa.RecordBatch.from_arrays([pa.array([words[i] for i in short], pa.string()), pa.array(n[short])], names=["word", "n"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = table(vocabulary).count(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pieces)], names=["word", "n", "pieces"])

    words = texts.select("text").mapInArrow(cut, "word string, n bigint")
    distinct = words.groupBy("word").agg(F.sum("n").alias("n"))
    return distinct.mapInArrow(counted, "word string, n bigint, pieces bigint")


def frequencies(texts: DataFrame, common: dict[str, int], vocabulary: str) -> DataFrame:
    """One row per document: doc_key, doc_id, n_bytes, n_tokens (of common pre-tokens), and the others
    with their frequencies, ``rare``."""
    known = texts.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 33
        pieces_of = known.value
        for batch in batches:
            at = 0
            for block in blocks(batch.column("text")):
                words, row, places, often = short_pretokens(block, vocabulary, LONG)
                pieces = np.array([pieces_of.get(w, -1) for w in words], np.int64)
                long = [i for i, w in enumerate(words) if len(w) > LONG]
                pieces[long] = table(vocabulary).count([words[i] for i in long])
                have = pieces[places] >= 0
                totals = np.bincount(row[have], (often * pieces[places])[have], len(block)).astype(np.int64)
                rest = pa.array(words, pa.string()).take(pa.array(places[~have]))
                pairs = pa.StructArray.from_arrays([rest, pa.array(often[~have])], names=["word", "n"])
                ends = bounds(np.bincount(row[~have], minlength=len(block)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(key, key + len(block))),
                        batch.column("doc_id").slice(at, len(block)),
                        pc.binary_length(block).cast(pa.int64()),
                        pa.array(totals),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs),
                    ],
                    names=["doc_key", "doc_id", "n_bytes", "n_tokens", "rare"],
                )
                key, at = key + len(block), at + len(block)

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"doc_key bigint, doc_id {kind}, n_bytes bigint, n_tokens bigint, rare {RARE}")


def count_tokens(
    docs: DataFrame, vocabulary: str, limit: int = 1024, id_column: str = "doc_id", text_column: str = "text", common: int = COMMON
) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit). ``vocabulary`` is a
    byte-level tokenizers file that adds no space in front. The result is the same for any ``common``."""
    texts = docs.select(F.col(id_column).alias("doc_id"), text_or_empty(F.col(text_column)).alias("text"))
    distinct = written(pretokens(texts, vocabulary), "pre-tokens")
    total = distinct.agg(F.sum("n")).first()[0] or 0
    frequent = distinct.where(F.col("n") * common >= total).select("word", "pieces").collect()  # at most ``common``
    own = written(frequencies(texts, {r.word: r.pieces for r in frequent}, vocabulary), "token-frequencies")
    rare = own.select("doc_key", F.explode("rare").alias("r")).select("doc_key", "r.word", "r.n")
    sums = (
        rare.join(distinct.select("word", "pieces"), "word")
        .groupBy("doc_key")
        .agg(F.sum(F.col("n") * F.col("pieces")).alias("more"))
    )
    n_tokens = F.col("n_tokens") + F.coalesce("more", F.lit(0))
    counted = own.select("doc_key", "doc_id", "n_bytes", "n_tokens").join(sums, "doc_key", "left")
    return counted.select("doc_id", "n_bytes", n_tokens.alias("n_tokens")).withColumn("over_limit", F.col("n_tokens") > limit)

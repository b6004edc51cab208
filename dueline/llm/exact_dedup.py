"""Exact deduplication: one document of each set of equal texts stays.

Texts are equal when identical after lower-casing A-Z; null counts as empty. Documents are grouped by
a 128-bit content hash together with the bytes themselves, so two texts that share a hash are never
taken for equal. The grouping combines before its shuffle: of a third of all rows with one text, each
task sends on a single row.

Defined results: the row with the largest (or smallest) id stays; null ids lose to any other, and if
all ids are null, keep_id is null. Rows that repeat both id and text of the row that stays are that
same document: ``mark_duplicates`` flags each of them, ``drop_duplicates`` returns one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dueline.llm.shared import lower_ascii, text_or_empty


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text))


def mark_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    keep_largest: bool = True,
    content_hash: Callable[[Column], Column] = _digest,
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256. Other columns are left out."""
    pick = F.max if keep_largest else F.min
    texts = docs.select(
        F.col(id_column).alias("doc_id"), lower_ascii(text_or_empty(F.col(text_column))).alias("text")
    ).withColumn("hash", content_hash(F.col("text")))
    # The text is part of the key: this is where the bytes inside a hash group are compared.
    groups = (
        texts.groupBy("hash", "text")
        .agg(F.count(F.lit(1)).alias("group_size"), pick("doc_id").alias("keep_id"))
        .select("hash", F.unhex(F.sha2("text", 256)).alias("sha"), "group_size", "keep_id")
    )
    rows = texts.select("doc_id", "hash", F.unhex(F.sha2("text", 256)).alias("sha"))
    return rows.join(groups, ["hash", "sha"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    keep_largest: bool = True,
    content_hash: Callable[[Column], Column] = _digest,
) -> DataFrame:
    """The rows that stay, with all their columns: exactly one for each text. One shuffle. Of rows with one
    id and text the largest (or smallest) by their other columns stays; which of two that differ in maps
    only is open."""
    pick = F.max_by if keep_largest else F.min_by
    normal = lower_ascii(text_or_empty(F.col(text_column)))
    # Rows of one id and text are told apart by their other columns, where these have an order: maps don't.
    comparable = [F.col(f.name) for f in docs.schema if f.name not in (id_column, text_column) and "map<" not in f.dataType.simpleString()]
    # Nulls sort first, which suits the largest id; for the smallest they must come last.
    none = F.col(id_column).isNotNull() if keep_largest else F.col(id_column).isNull()
    order = F.struct(none.alias("none"), F.col(id_column).alias("id"), F.xxhash64(text_column).alias("text_hash"), *[c.alias(f"c{i}") for i, c in enumerate(comparable)])
    rows = docs.select(content_hash(normal).alias("hash"), normal.alias("text"), F.struct(*docs.columns).alias("row"), order.alias("order"))
    best = rows.groupBy("hash", "text").agg(pick("row", "order").alias("best"))
    return best.select("best.*")

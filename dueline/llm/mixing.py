"""Mixing sources to target weights by Poisson replication.

A recipe names sources and their shares of the mixture; all sources it doesn't name are one source,
``other``. With S characters in a source, T in all and w its share, each of its documents is repeated
at the mean rate ``epochs * T * w / S``. The number of copies is drawn by inverting the Poisson
distribution at a uniform number from a hash of seed and id, so that it is the same in every run and
whatever the partitions are. Copies are then shuffled globally: hash-partitioned and sorted by a hash of
seed, id and copy.

The counts per source are one small aggregate with map-side partials; there are at most as many as the
recipe names, plus one, and that is the proven bound of what is broadcast. A source with a third of all
rows needs no care: nothing is grouped or joined by shuffling on it.

Null sources belong to ``other``; null texts have no characters but are drawn like any other. A row
with a null id draws by its text. Equal rows draw equally. Sources without characters have no rate and
keep no rows unless the whole table has none, when every document's rate is ``epochs``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dueline.llm.shared import fresh, text_or_empty, written

#: Means above this are drawn as sums of equal smaller ones, for which exp(-mean) is a normal number.
LARGEST_MEAN = 64.0


def uniform(*parts: Column) -> Column:
    """A number from [0, 1) by 52 bits of a hash of the parts."""
    text = F.concat_ws("|", *parts)
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def poisson_table(mean: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... until nothing of weight is left."""
    last = F.ceil(mean + 12 * F.sqrt(mean) + 24).cast("int")
    empty = F.struct(
        F.exp(-mean).alias("p"), F.exp(-mean).alias("sum"), F.array(F.exp(-mean)).alias("table")
    )

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), (acc["sum"] + p).alias("sum"), F.concat(acc["table"], F.array(acc["sum"] + p)).alias("table"))

    return F.aggregate(F.sequence(F.lit(1), last), empty, step)["table"]


def rates(docs: DataFrame, recipe: dict[str, float], other: float, epochs: float, source: str, text: str) -> DataFrame:
    """One row per source of the recipe that occurs: its rate, and how copies are drawn at that rate."""
    key = _key(F.col(source), recipe)
    sizes = docs.groupBy(key.alias("mix_key")).agg(F.sum(F.char_length(text_or_empty(F.col(text)))).alias("n"))
    sizes = sizes.withColumn("total", F.sum("n").over(Window.partitionBy()))  # of a few rows
    total = sum(recipe.values()) + other
    share = F.lit(other / total)
    for name, weight in recipe.items():
        share = F.when(F.col("mix_key") == name, weight / total).otherwise(share)
    rate = F.when(F.col("total") == 0, F.lit(float(epochs))).otherwise(
        F.coalesce(F.try_divide(epochs * F.col("total") * share, F.col("n").cast("double")), F.lit(0.0))
    )
    draws = F.greatest(F.lit(1), F.ceil(rate / LARGEST_MEAN).cast("int"))
    return (
        sizes.select("mix_key", rate.alias("mix_rate"), draws.alias("mix_draws"))
        .withColumn("mix_table", poisson_table(F.col("mix_rate") / F.col("mix_draws")))
    )


def _key(source: Column, recipe: dict[str, float]) -> Column:
    """Named sources keep their name; a null key would not join, so the others' key is a text no name has."""
    other = "other"
    while other in recipe:
        other += "_"
    return F.when(source.isin(*recipe), source).otherwise(F.lit(other)) if recipe else F.lit(other)


def mix(
    docs: DataFrame,
    recipe: dict[str, float],
    other: float = 0.0,
    epochs: float = 1.0,
    seed: int = 42,
    id_column: str = "doc_id",
    source_column: str = "source",
    text_column: str = "text",
    details: bool = False,
) -> DataFrame:
    """The mixture: the columns of docs, one row per copy, in global random order. ``details`` writes the
    mixture, whole documents with how they were drawn, and returns of each of its rows doc_id, source_key,
    rate, copies, copy and shuffle_key."""
    if min([*recipe.values(), other]) < 0 or sum(recipe.values()) + other <= 0:
        raise ValueError("shares must not be negative, and not all be zero")
    names = docs.columns
    add = {n: fresh(docs, n) for n in ("mix_id", "mix_key", "mix_rate", "mix_draws", "mix_table", "mix_n", "mix_copy", "mix_order")}
    per_source = rates(docs, recipe, other, epochs, source_column, text_column)
    per_source = per_source.withColumnsRenamed({n: add[n] for n in per_source.columns})
    own_id = F.coalesce(F.col(id_column).cast("string"), F.md5(text_or_empty(F.col(text_column))))
    docs = docs.withColumn(add["mix_id"], own_id)
    drawn = F.aggregate(
        F.sequence(F.lit(1), F.col(add["mix_draws"])),
        F.lit(0),
        lambda n, i: n + F.size(F.filter(F.col(add["mix_table"]), lambda p: p <= uniform(F.lit(str(seed)), F.col(add["mix_id"]), i.cast("string")))),
    )
    copies = (
        docs.withColumn(add["mix_key"], _key(F.col(source_column), recipe))
        .join(F.broadcast(per_source), add["mix_key"])  # at most len(recipe) + 1 rows
        .withColumn(add["mix_n"], drawn)
        .where(F.col(add["mix_n"]) > 0)
        .withColumn(add["mix_copy"], F.explode(F.sequence(F.lit(1), F.col(add["mix_n"]))))
        .withColumn(add["mix_order"], F.md5(F.concat_ws("|", F.lit(f"order {seed}"), F.col(add["mix_id"]), F.col(add["mix_copy"]))))
    )
    order = add["mix_order"]
    if not details:
        return copies.select(*names, order).repartition(order).sortWithinPartitions(order).select(*names)
    kept = {id_column: "doc_id", add["mix_key"]: "source_key", add["mix_rate"]: "rate", add["mix_n"]: "copies", add["mix_copy"]: "copy", order: "shuffle_key"}
    copies = copies.select(*names, *(c for c in kept if c != id_column))
    mixed = written(copies.repartition(order).sortWithinPartitions(order), "mixture")
    return mixed.select(*(F.col(a).alias(b) for a, b in kept.items()))

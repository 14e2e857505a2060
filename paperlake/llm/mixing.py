"""Mixing sources to target weights, with DataFrame functions only.

The sizes of all documents are summed by source; sharing the total out by weight, up to a largest
repetition rate, gives every source a target and so a rate. Each document is then emitted
floor(rate) times, plus once more if a hash of its id falls below the fraction of the rate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, join_hot, unit_hash, written

#: Stands for the null source in joins; it can't be a source as it holds a lone surrogate's escape and a line end.
NO_SOURCE = "\n\\udc00 no source\n"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """From rows (source_key, source, size): one row a source with its size, target, rate and rows.

    Sources in code-point order (null last) take the weights in turn. With a common level L, a source's
    target is min(most * size, L * weight), and all targets add up to all sizes: what a source can't
    take is reshared by weight. In order of most * size / weight, L is the largest of
    (total - what the sources before can take) / (weights from here on), so no iteration is needed.
    Without any words all targets and rates are 0. The table has a row for each source of the
    mixture, whose number a recipe bounds; its windows run over these rows only."""
    by = sizes.groupBy("source_key").agg(
        F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows")
    )
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    by = by.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")).cast("long"))
    by = by.withColumn("most", F.col("source_size") * most)
    whole = Window.partitionBy()
    before = (
        Window.orderBy((F.col("most").cast("double") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0))
    weight = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    by = by.withColumn("level", left.cast("double") / weight)
    level = F.max("level").over(whole)
    by = by.withColumn("target", F.least(F.col("most").cast("double"), level * F.col("weight")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return by.select("source_key", "source_size", "source_rows", "target", rate.alias("rate"))


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: str = "mix") -> DataFrame:
    """One row for each row of docs (doc_id, source, text): size, source_size, target, rate, copies and taken.

    Null texts have size 0; null sources are one source; rows with one id, null ids too, get the same
    number of copies; an empty table gives no rows. Only doc_id, source and text are read."""
    key = F.coalesce(F.col("source"), F.lit(NO_SOURCE))
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    sizes = written(docs.select("doc_id", "source", key.alias("source_key"), size.alias("size")), "sizes")
    targets = written(source_targets(sizes, weights, most), "targets")
    chance = F.col("rate") - F.floor("rate")
    copies = F.floor("rate") + F.when(unit_hash(F.col("doc_id"), seed) < chance, 1).otherwise(0)
    planned = join_hot(sizes, targets, "source_key", "source_rows").withColumn("copies", copies.cast("int"))
    return planned.select(
        "doc_id", "source", "size", "source_size", "target", "rate", "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: str = "mix") -> DataFrame:
    """The mixture itself: docs' rows with all their columns, each repeated as often as the plan says."""
    key = F.coalesce(F.col("source"), F.lit(NO_SOURCE))
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    sizes = docs.select("source", key.alias("source_key"), size.alias("size"))
    targets = written(source_targets(sizes, weights, most), "targets")
    packed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("row_id"), key.alias("source_key"))
    chance = F.col("rate") - F.floor("rate")
    copies = F.floor("rate") + F.when(unit_hash(F.col("row_id"), seed) < chance, 1).otherwise(0)
    planned = join_hot(packed, targets, "source_key", "source_rows")
    return planned.select("row", F.explode(F.array_repeat(F.lit(0), copies.cast("int")))).select("row.*")

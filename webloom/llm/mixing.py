"""Mixing sources to target weights (problem 9).

Sizes are pre-aggregated per source and hash slice, so that prefix sums are exact without
any source ever being sorted by one task: a document's place is its slice's offset plus a
running sum inside the slice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webloom.llm.common import utf8_size
from webloom.sources.tables import checked_broadcast

#: Slices of the hash-random key space in each source.
KEY_SLICES = 1024


def _sized(documents: DataFrame) -> DataFrame:
    return (
        documents.select("doc_id", "source", utf8_size(F.col("text")).alias("size"))
        .where(F.col("doc_id").isNotNull() & F.col("source").isNotNull())
        .dropDuplicates(["doc_id"])
    )


def _targets(targets: DataFrame) -> DataFrame:
    return targets.select("source", "target_share", "max_repeats").where(F.col("source").isNotNull()).dropDuplicates(["source"])


def _plan(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Budget of each source: ``source, target_share, max_repeats, available, total, wanted, budget``."""
    have = sizes.groupBy("source").agg(F.sum("size").alias("available"))
    wanted = targets.join(have, "source", "left").fillna({"available": 0, "target_share": 0.0, "max_repeats": 0})
    total = F.sum("available").over(Window.partitionBy(F.lit(1)))  # one row a source of the small targets table
    most = (F.col("max_repeats") * F.col("available")).cast("double")
    return wanted.withColumn("total", total).withColumn("wanted", F.col("target_share") * F.col("total")).withColumn("budget", F.least(F.col("wanted"), most)).withColumn("short", F.col("wanted") > most)


def mix(documents: DataFrame, targets: DataFrame, seed: int = 7) -> DataFrame:
    """The mixed corpus: ``doc_id, source, epoch, size, position``.

    Each source is put in hash-random order (key: xxhash64 of seed and doc_id; ties by doc_id)
    and read epoch after epoch until its budget ``min(share * T, max_repeats * B)`` is reached;
    a document is taken in an epoch if it starts before the budget's end, so each source is
    within one document of its budget and no document is used more than max_repeats times.
    ``position`` is the running size before the document within its source.  Null ids, sources
    and repeated rows don't count; sources without documents contribute nothing; documents of
    size 0 are taken in every epoch that begins before the budget's end.
    """
    keyed = (
        _sized(documents)
        .join(checked_broadcast(_targets(targets).select("source")), "source")
        .withColumn("key", F.xxhash64(F.lit(seed), "doc_id"))
        .withColumn("slice", F.shiftrightunsigned("key", 54).cast("int"))
    )
    slices = keyed.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    plan = _plan(slices.select("source", F.col("slice_size").alias("size")), _targets(targets))
    # at most KEY_SLICES rows for each of the few sources in the targets table
    before = F.sum("slice_size").over(Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    offsets = slices.withColumn("before", F.coalesce(before, F.lit(0))).drop("slice_size").join(checked_broadcast(plan.select("source", "available", "budget", "max_repeats")), "source")
    inner = F.sum("size").over(Window.partitionBy("source", "slice").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1))
    placed = keyed.withColumn("inner", F.coalesce(inner, F.lit(0))).join(checked_broadcast(offsets), ["source", "slice"]).withColumn("start", F.col("before") + F.col("inner"))
    epochs = F.least(F.col("max_repeats"), F.ceil((F.col("budget") - F.col("start")) / F.greatest(F.col("available"), F.lit(1)))).cast("int")
    return (
        placed.withColumn("epochs", epochs)
        .where(F.col("epochs") > 0)
        .withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("epochs"))))
        .select("doc_id", "source", "epoch", "size", ((F.col("epoch") - 1) * F.col("available") + F.col("start")).alias("position"))
    )


def mix_report(documents: DataFrame, targets: DataFrame, seed: int = 7) -> DataFrame:
    """What each source reached: ``source, target_share, actual_share, repeats, size, short``.

    ``short`` says that the source can't reach its share even at max_repeats.
    """
    sizes = _sized(documents)
    plan = _plan(sizes.join(checked_broadcast(_targets(targets).select("source")), "source"), _targets(targets))
    used = mix(documents, targets, seed).groupBy("source").agg(F.sum("size").alias("size"), F.max("epoch").alias("repeats"))
    joined = plan.join(used, "source", "left").fillna({"size": 0, "repeats": 0})
    all_used = F.sum("size").over(Window.partitionBy(F.lit(1)))
    return joined.select("source", "target_share", (F.col("size") / F.greatest(all_used, F.lit(1))).alias("actual_share"), "repeats", "size", "short")

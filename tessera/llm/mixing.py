"""Mixing sources to target weights by a curriculum that varies over time.

Each source has a schedule of weight over training time t from 0 to 1; its integral
is the source's cumulative demand for words.  The documents of a source stand in a
fixed random order; where the source's demand reaches the words that come before a
document, that document's position is found by inverting the integral.  Sorting by
position interleaves the sources as the schedules ask.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .base import materialize, words

#: How often a source or a document may be repeated at most.
MAX_REPEATS = 3
#: Documents that a part of a source has, about; parts are told by leading hexadecimal digits of the order key and summed apart.
PART_ROWS = 50_000


def source_targets(sizes: DataFrame, weights: tuple[float, ...], max_repeats: int = MAX_REPEATS, total: float = 1.0) -> DataFrame:
    """source, source_size, target, rank, tilt for each source, by filling up to the caps.

    ``sizes`` has source and size.  Weights repeat over the sources in the order of
    their code points, null last.  A source whose share exceeds ``max_repeats`` times
    its size gets just that; what it leaves goes to the others by weight.  There is one
    row per source here, so the ordered sums below see sources and not documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    ordered = per.select("*", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))).alias("rank"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    w = ordered.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(max_repeats)))
    everything = Window.orderBy("ratio", "rank")
    before = everything.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(1))
    w = (
        w.withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("_total", F.sum("source_size").over(whole) * F.lit(float(total)))
        .withColumn("_left", F.col("_total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("_weights", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("_level", F.col("_left") / F.col("_weights"))
    )
    # The first source, by ratio, that its share doesn't overfill sets the level of all that follow.
    level = F.min(F.when(F.col("_level") <= F.col("ratio"), F.struct("ratio", "rank", "_level"))).over(whole)["_level"]
    return w.withColumn("_at", level).select(
        "source",
        "source_size",
        F.when(F.col("_at").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("_at") * F.col("weight"))).alias("target"),
        "rank",
        # The schedule's slope: the first of each three sources rises, the last falls.
        (1.0 - (F.col("rank") - 1) % 3).cast("double").alias("tilt"),
    )


def position(demand: Column, tilt: Column) -> Column:
    """The time at which a schedule ``1 + tilt * (t - 0.5)``, integrated from 0, reaches ``demand``.

    The integral is ``a t + b t^2`` with ``a = 1 - tilt / 2`` and ``b = tilt / 2``; its value at 1 is 1.
    """
    a, b = 1.0 - tilt / 2.0, tilt / 2.0
    root = F.sqrt(F.greatest(a * a + 4.0 * b * demand, F.lit(0.0)))
    return F.when(tilt == 0, demand).otherwise((root - a) / (2.0 * b))


def mix_plan(docs: DataFrame, *, weights: tuple[float, ...] = (5, 2, 1), max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, copies, taken, position, positions.

    size counts the words of the text (null: 0).  Every document of a source is taken
    ``floor(target / source_size)`` times, and those whose middle lies in the first part of
    the source's order once more, so that the source's words miss its target by half a
    document at most.  position is where the first copy stands, from 0 to 1; null if none
    is taken; positions has one for every copy, ascending.  The order is that of md5(doc_id), doc_id,
    size, text, so reruns agree; repeated rows change places without effect, and a null doc_id counts
    as an empty one.  Null and empty texts have size 0 and are not taken, very long ones are counted
    whole.  An empty table gives an empty one; further columns are ignored, whatever their names.
    """
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"), key.alias("_key"), F.xxhash64("text").alias("_t"))
    rows = materialize(rows, "sizes")
    digits = max(1, math.ceil(math.log(max(1, rows.count() / PART_ROWS), 16)))
    rows = rows.withColumn("_part", F.substring("_key", 1, digits))
    targets = source_targets(rows, weights, max_repeats)
    # Sums in two levels: parts of a source, then documents of a part; no task sees a whole source.
    part = rows.groupBy("source", "_part").agg(F.sum("size").alias("_size"))
    run = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    part = part.select(F.col("source").alias("_s"), F.col("_part").alias("_p"), F.coalesce(F.sum("_size").over(run), F.lit(0)).alias("_base"))
    part = part.join(targets, F.col("_s").eqNullSafe(F.col("source"))).drop("source")
    inner = Window.partitionBy("source", "_part").orderBy("_key", "doc_id", "size", "_t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = rows.withColumn("_upto", F.sum("size").over(inner))
    both = summed.join(part, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_part") == F.col("_p")))
    upto = F.col("_base") + F.col("_upto")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    full = F.floor("_rate")
    again = (upto - F.col("size") / 2.0) < (F.col("_rate") - full) * F.col("source_size")
    copies = F.when(F.col("size") == 0, F.lit(0)).otherwise(F.least(full + again.cast("long"), F.lit(max_repeats)))
    demand = F.when(F.col("target") > 0, (upto - F.col("size") / 2.0) / F.col("target"))
    out = both.withColumn("_rate", rate).withColumn("copies", copies.cast("long"))
    return out.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        "copies",
        (F.col("copies") * F.col("size")).cast("long").alias("taken"),
        F.when(F.col("copies") > 0, position(F.least(demand, F.lit(1.0)), F.col("tilt"))).alias("position"),
        # The copy after j whole rounds of the source stands where the demand reaches that round's words.
        F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies").cast("int") - 1), lambda j: position(F.least(demand + j * F.col("source_size") / F.col("target"), F.lit(1.0)), F.col("tilt")))).otherwise(F.array().cast("array<double>")).alias("positions"),
        "_t",
    )


def mix(docs: DataFrame, **how) -> DataFrame:
    """``mix_plan`` sorted by position through range partitions; documents not taken come last."""
    plan = materialize(mix_plan(docs, **how), "mix")
    return plan.repartitionByRange(F.asc_nulls_last("position"), "doc_id").sortWithinPartitions(F.asc_nulls_last("position"), "doc_id")


def mix_copies(docs: DataFrame, **how) -> DataFrame:
    """One row per copy of each document taken, with copy (from 0) and its own position, sorted by that through range partitions."""
    plan = materialize(mix_plan(docs, **how), "mix")
    each = plan.drop("position").select("*", F.posexplode("positions").alias("copy", "position")).drop("positions")
    return each.repartitionByRange("position", "doc_id", "copy").sortWithinPartitions("position", "doc_id", "copy")

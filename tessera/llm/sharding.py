"""Sharding by weighted rendezvous hashing of stable record keys.

Every shard draws a number from the hash of the key and its own name, and the record goes to
the shard of the best draw.  A draw depends on nothing else, so a shard that is added takes
records only into itself, one that is removed gives only its own away, and no table of keys
or ranges is kept anywhere.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .base import maybe_broadcast, quoted, unused

#: Shards that one digest serves, eight hexadecimal digits each.
PER_DIGEST = 4
#: Rows aimed at in a group that one task numbers, how many times that splits a group, and least groups of a shard.
GROUP_ROWS, TOO_LARGE, LEAST_GROUPS = 65_536, 4, 8


def _number(digest: Column, at: int) -> Column:
    """Eight hexadecimal digits of a digest as a number below 2**32."""
    return F.conv(F.substring(digest, 8 * at + 1, 8), 16, 10).cast("long")


def draws(key: Column, shards: int, weights: Sequence[float] | None = None) -> list[Column]:
    """What each shard draws: minus the logarithm of a number between 0 and 1, over its weight; the least wins."""
    weights = [1.0] * shards if weights is None else list(weights)
    if len(weights) != shards or shards < 1 or min(weights) <= 0:
        raise ValueError("a positive weight is needed for each shard")
    text = F.coalesce(key.cast("string"), F.lit("")).cast("string")
    digests = [F.md5(F.concat(F.lit(f"{g}:"), text).cast("binary")) for g in range(-(-shards // PER_DIGEST))]
    return [-F.log((_number(digests[s // PER_DIGEST], s % PER_DIGEST) + 0.5) / float(1 << 32)) / float(w) for s, w in enumerate(weights)]


def _least(values: list[Column]) -> Column:
    """The place of the least value, the first of equals."""
    best = F.least(*values) if len(values) > 1 else values[0]
    return reduce(lambda out, i: F.when(values[i] == best, F.lit(i)).otherwise(out), range(len(values) - 1, -1, -1), F.lit(None).cast("int"))


def assign(records: DataFrame, *, key: str, shards: int, weights: Sequence[float] | None = None, grown_weight: float = 1.0) -> DataFrame:
    """``records`` with ``shard`` and ``grown_shard``, its shard if there were one more of ``grown_weight``.

    Shards are numbered from 0; their weights (all 1 unless given) set their shares of the keys.  Equal
    keys share a shard; a null key is like an empty one; equal draws go to the lower number.  All rows and
    all columns stay, except those called shard or grown_shard, whatever the case; an empty table gives an empty one.
    """
    drawn, at = unused("draws", records), unused("new", records)
    rest = [quoted(c) for c in records.columns if c.lower() not in ("shard", "grown_shard")]
    both = draws(quoted(key), shards + 1, [*(weights or [1.0] * shards), grown_weight])
    # The draws are columns of their own, so that each is made once.
    one = records.select(*rest, F.array(*both[:-1]).alias(drawn), both[-1].alias(at))
    least = F.array_min(drawn)
    one = one.withColumn("shard", (F.array_position(drawn, least) - 1).cast("int"))
    return one.withColumn("grown_shard", F.when(F.col(at) < least, F.lit(shards)).otherwise(F.col("shard")).cast("int")).drop(drawn, at)


def place(assigned: DataFrame, *, key: str, shards: int, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``assigned`` with ``slot``, a record's place in its shard from 0 without gaps.

    Records stand in the order of their keys' MD5, which is as good as random; records of one key
    in the order of their columns.  Groups of neighbouring hashes are numbered side by side and
    shifted by the counts of the groups before them.  A group that a repeated key makes too large is
    split by a hash of all columns, which then comes first; of rows equal in all of them only one travels, with their
    number: which of them has which slot is the same to see.  Columns of map type can't be hashed.

    All rows and columns stay, except one called slot; an empty table gives an empty one.
    """
    rest = [c for c in assigned.columns if c.lower() != "slot"]
    rows = assigned.select(*[quoted(c) for c in rest])
    h, g, w, sub, n, at, start = (unused(x, assigned) for x in ("h", "group", "w", "sub", "n", "at", "start"))
    groups = max(LEAST_GROUPS, -(-rows.count() // (shards * group_rows)))
    digest = F.md5(F.coalesce(quoted(key).cast("string"), F.lit("")).cast("binary"))
    hashed = rows.withColumn(h, digest).withColumn(g, F.floor(_number(F.col(h), 0) * F.lit(groups) / float(1 << 32)).cast("int"))
    per = hashed.groupBy("shard", g).agg(F.count(F.lit(1)).alias(n))
    before = Window.partitionBy("shard").orderBy(g).rowsBetween(Window.unboundedPreceding, -1)  # a row per group
    table = per.withColumn(start, F.coalesce(F.sum(n).over(before), F.lit(0))).withColumn(sub, F.ceil(F.col(n) / (TOO_LARGE * group_rows)).cast("int"))
    table = maybe_broadcast(table.select("shard", g, start, sub), 1_000_000)
    located = hashed.join(table, ["shard", g])
    cold = located.filter(F.col(sub) == 1)
    within = Window.partitionBy("shard", g).orderBy(h, *map(quoted, rest))
    done = cold.withColumn("slot", F.col(start) + F.row_number().over(within) - 1).select(*map(quoted, rest), "slot")
    if not table.filter(F.col(sub) > 1).limit(1).count():
        return done
    # Within a split group the order is by part first; a row stands for all that are equal to it.
    hot = located.filter(F.col(sub) > 1).withColumn(w, F.xxhash64(*[quoted(c) for c in rest])).withColumn(sub, F.pmod(w, F.col(sub)))
    one = hot.groupBy(*map(quoted, [*rest, h, g, w, sub, start])).agg(F.count(F.lit(1)).alias(n))
    sums = one.groupBy("shard", g, sub, start).agg(F.sum(n).alias(n))
    ahead = Window.partitionBy("shard", g).orderBy(sub).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn(start, F.col(start) + F.coalesce(F.sum(n).over(ahead), F.lit(0))).select("shard", g, sub, start)
    inside = Window.partitionBy("shard", g, sub).orderBy(h, w, *map(quoted, rest)).rowsBetween(Window.unboundedPreceding, -1)
    numbered = one.drop(start).join(offsets, ["shard", g, sub]).withColumn(at, F.col(start) + F.coalesce(F.sum(n).over(inside), F.lit(0)))
    # Many equal rows are made in blocks, which are dealt over the tasks before they are spelled out.
    blocks = numbered.withColumn(start, F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1, F.lit(group_rows).cast("long"))))
    blocks = blocks.repartition(*map(quoted, ["shard", h, w, start]))
    spelled = blocks.withColumn("slot", F.explode(F.sequence(F.col(at) + F.col(start), F.col(at) + F.least(F.col(n), F.col(start) + group_rows) - 1)))
    return done.unionByName(spelled.select(*map(quoted, rest), "slot"))


def write_shards(placed: DataFrame, path: str, *, max_rows: int = 1_000_000) -> None:
    """Write placed records as Parquet, a directory for each shard, files of at most ``max_rows`` records in the order of their slots."""
    part = unused("part", placed)
    ranged = placed.withColumn(part, F.floor(F.col("slot") / max_rows)).repartition("shard", part).sortWithinPartitions("shard", part, "slot").drop(part)
    ranged.write.option("maxRecordsPerFile", max_rows).partitionBy("shard").parquet(path)

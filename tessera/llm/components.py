"""Connected components of a graph given as pairs, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import materialize, release, salted_join


def _toward_least(pairs: DataFrame, *, larger: bool) -> DataFrame:
    """One star contraction of pairs (a, b), a > b: neighbours of each node join the least node among it and them.

    ``larger`` joins the neighbours that exceed the node, else those below it and the node
    itself, without repeats.  Minima are pre-aggregated; a node of many neighbours is never gathered, and the
    join back with its minimum is salted, so that no task has all of them.
    """
    if larger:
        ends = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
        least = pairs.select(ends.alias("e")).select("e.*").groupBy("a").agg(F.min("b").alias("_m")).withColumn("_m", F.least("_m", "a"))
        return salted_join(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")), least, "a").select(F.col("b").alias("a"), F.col("_m").alias("b"))  # one row for each pair
    down = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b")
    least = down.groupBy("a").agg(F.min("b").alias("_m"))
    joined = salted_join(down, least, "a").filter("b > _m").select(F.col("b").alias("a"), F.col("_m").alias("b"))
    return joined.unionByName(least.select("a", F.col("_m").alias("b"))).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether the pairs (a, b), a > b, are stars: every a has one b, and no b is an a."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))))
    nodes = edges.select(ends.alias("e")).select("e.*").groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.filter("up > 1 OR up + down > 1").agg(F.count(F.lit(1)).alias("n")).first().n == 0


def components(pairs: DataFrame, *, rounds: int = 60) -> DataFrame:
    """(id, component): for every node of the pairs (a, b) the least node that it reaches.

    Every round is written, and the round before it deleted.  ``rounds`` is a bound on rounds, of
    which a graph needs about the logarithm of its longest path squared; more is an error.
    """
    edges = materialize(pairs.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(rounds):
        if _settled(edges):
            break
        new = materialize(_toward_least(_toward_least(edges, larger=True), larger=False), "edges")
        release(edges)
        edges = new
    else:
        raise RuntimeError("the components did not settle")
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)

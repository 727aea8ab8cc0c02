"""Connected components by alternating large-star and small-star over tables of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.session import cut_lineage


def _least_neighbour(pairs: DataFrame) -> DataFrame:
    """Smallest of a node and its neighbours; pre-aggregated before the shuffle, written so that a hot join can split."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return cut_lineage(least, "star-least").withColumnRenamed("u", "centre")


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64("a", "b")).alias("x"),
        F.bit_xor(F.xxhash64(F.lit(3), "a", "b")).alias("y"),
    ).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of ``edges`` (columns a, b); the component is its smallest node.

    Nodes may be of any type that orders. Loops and repeats are ignored; nodes without an edge are not returned. Each
    round joins on nodes: a node of very many edges is one hot key of a plain join, which the engine splits.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = cut_lineage(now, "star-edges")
    state = _state(now)
    while state[0]:
        both = now.selectExpr("a AS u", "b AS v").unionAll(now.selectExpr("b AS u", "a AS v"))
        least = _least_neighbour(both)
        large = (
            both.where("v > u").join(least, F.col("u") == F.col("centre")).where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        )
        large = cut_lineage(large.distinct(), "star-edges")
        down = large.selectExpr("a AS u", "b AS v")
        least = _least_neighbour(down)
        small = down.join(least, F.col("u") == F.col("centre")).select("u", "v", "m")
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e"))
        now = cut_lineage(small.select("e.a", "e.b").where("a <> b").distinct(), "star-edges")
        before, state = state, _state(now)
        if before == state:
            break
    return now.groupBy("a").agg(F.min("b").alias("component")).unionAll(
        now.select("b").distinct().select(F.col("b").alias("a"), F.col("b").alias("component"))
    ).groupBy("a").agg(F.min("component").alias("component")).withColumnRenamed("a", "node")

"""Connected components of links by alternating large and small stars, distributed throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut

#: Rounds at most, and parts that a node's links are dealt to: a hub of thousands is no hot task.
ROUNDS, PARTS = 60, 8
#: Links that a round writes to a file, about: a few links go to a few files, whatever the number of shuffle partitions.
FILE_LINKS = 1 << 14


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Large star: larger neighbours of u move to u's least neighbour. Small star: smaller ones and u itself do."""
    near = edges if small else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = near.groupBy("u").agg(F.min("v").alias("m"))
    if not small:
        least = least.select("u", F.least("u", "m").alias("m"))
    met = near.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(PARTS)).cast("int")).join(least.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))), ["u", "part"])
    moved = met.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v") if small else met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return (moved.unionByName(least.select("u", F.col("m").alias("v"))) if small else moved).where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """node and root (the component's least node) for every node of ``links`` (columns a, b) that is not a root itself.

    Links of a node with itself and nulls are ignored; without links the result is empty.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = cut(edges)
    state = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    for _ in range(ROUNDS):
        if not state.n:
            break
        files = max(links.sparkSession.sparkContext.defaultParallelism, state.n // FILE_LINKS + 1)
        after = cut(_star(_star(edges, small=False), small=True).coalesce(files))
        drop_cut(edges)
        edges, before = after, state
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))

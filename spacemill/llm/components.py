"""Connected components by alternating large-star and small-star steps, all on edges in the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spacemill.llm.common import delete, lookup, salt_of, stage


def _directed(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


#: Edges up to which a hub's neighbours are one task's work; beyond, they are dealt over several.
HUB_EDGES = 1_000_000


def _handed(edges: DataFrame, least: DataFrame, many: bool) -> DataFrame:
    """edges with m, the least of their a."""
    return lookup(edges.withColumn("salt", salt_of("b")), least, "a", "salt", "inner") if many else edges.join(least, "a")


def _large_star(edges: DataFrame, many: bool) -> DataFrame:
    """Each node hands its larger neighbours to the smallest of its neighbourhood. b is the smaller end in edges."""
    both = _directed(edges)
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return _handed(both.where("b > a"), least, many).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame, many: bool) -> DataFrame:
    """Each node hands its smaller neighbours, and itself, to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    handed = _handed(edges, least, many).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return handed.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame, rounds: int = 60, hub_edges: int = HUB_EDGES) -> DataFrame:
    """node, root: the smallest node that each node with an edge (columns a, b) reaches. Nodes without edges are left out; loops and repeats do no harm.

    Each round is staged in the shared folder. The number of rounds is logarithmic; one that is not done after ``rounds`` raises.
    """
    now = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    last = None
    for _ in range(rounds):
        shape = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if shape == last or not shape[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()).distinct()
        last, before = shape, now
        many = shape[0] > hub_edges
        now = stage(_small_star(_large_star(before, many), many), "edges")
        delete(before.sparkSession, [before.staged_at])
    raise RuntimeError(f"components not done after {rounds} rounds")

"""Connected components of an edge table by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import Written

#: Edges that one task takes alone, without an exchange: many small tasks would cost more than their work.
FEW = 100_000


def _state(edges: DataFrame) -> tuple:
    mixed = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.sum(mixed.cast("decimal(20,0)")), F.bit_xor(mixed)).first())


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node long, component long) for each node that a link names; component is its smallest reachable node.

    links holds pairs of longs in columns a and b; order, repeats and self-links don't matter, a pair with a
    null links nothing. Each round writes its edges to the shared folder, so lineage stays short, and only a
    three-number digest of the edges reaches the driver. Minimums are pre-aggregated before they are
    shuffled, and a hub's edges are joined, never gathered, so a hub of any size can be split by AQE.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).alias("__a"), F.col(b).alias("__b"))
    edges = edges.where("__a is not null and __b is not null and u <> v").select("u", "v").distinct()
    now = Written(edges, "edges")
    state = _state(now.df)
    while state[0]:
        e = now.df if state[0] > FEW else now.df.coalesce(1)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"))
        # large star: a node's larger neighbours move to its smallest neighbour
        large = e.join(low, F.col("v") == F.col("x")).select("u", F.least("m", "v").alias("v")).distinct()
        # small star: a node and its smaller neighbours move to the smallest of them
        least = large.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"))
        small = large.join(least, F.col("u") == F.col("x"))
        moved = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        kept = least.select(F.col("x").alias("u"), F.col("m").alias("v"))
        after = Written(moved.unionByName(kept).distinct() if state[0] > FEW else moved.unionByName(kept).coalesce(1).distinct(), "edges")
        now.drop()
        now, before, state = after, state, _state(after.df)
        if state == before:
            break
    e = now.df if state[0] > FEW else now.df.coalesce(1)
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))

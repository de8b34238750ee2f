"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspark.llm.tables import freeze


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for the ends of ``a, b``: the smallest node reachable. Nodes without a link are absent.

    Each round every node joins the smallest of its neighbours and itself, and the graph shrinks to the nodes joined.
    From the second round on, smallest means by a hash, so a long chain in id order shrinks by a constant share too.
    Links and labels stay in tables of the shared folder; a star of any size is one partial aggregate.
    Links with a null end count for nothing.
    """
    edges = freeze(links.select("a", "b").where("a <> b").distinct())
    chosen: DataFrame | None = None
    turn = 0
    while not edges.isEmpty():
        rank = F.struct("v") if turn == 0 else F.struct(F.xxhash64("v", F.lit(turn)), "v")
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("v")).union(edges.select("b", "a"))
        ends = edges.select(F.col("a").alias("node")).union(edges.select("b")).select("node", F.col("node").alias("v"))
        step = freeze(both.union(ends).groupBy("node").agg(F.min(rank).getField("v").alias("to")))
        edges = freeze(
            edges.join(step.select(F.col("node").alias("a"), F.col("to").alias("to_a")), "a")
            .join(step.select(F.col("node").alias("b"), F.col("to").alias("to_b")), "b")
            .where("to_a <> to_b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b")).distinct()
        )
        if chosen is None:
            chosen = step
        else:
            after = step.select(F.col("node").alias("to"), F.col("to").alias("next"))
            chosen = freeze(chosen.join(after, "to", "left").select("node", F.coalesce("next", "to").alias("to")))
        turn += 1
    if chosen is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    if turn == 1:
        return chosen.select("node", F.col("to").alias("component"))
    least = chosen.groupBy("to").agg(F.min("node").alias("component"))
    return chosen.join(least, "to").select("node", "component")

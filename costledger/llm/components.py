"""Connected components by alternating large-star and small-star rounds on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round.  Every node's smallest neighbour is a partial aggregate; the join that hands it
    to the neighbours is an ordinary equi-join, so a hub's rows can be split between tasks."""
    if large:
        sides = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = sides.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m"))
        moved = sides.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        moved = edges.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return moved.where("a > b").distinct()


def connected_components(edges: DataFrame, work: Workspace) -> DataFrame:
    """``edges`` (a, b) of comparable ids -> (node, component), component being the smallest node
    reachable.  Nodes without an edge are absent.  Null ends and loops are ignored.

    Each round is written to the workspace and only its row count and checksum reach the driver.
    Rounds grow with the logarithm of the longest chain, not with the size of a component.
    """
    ends = edges.where("a is not null and b is not null and a <> b")
    current = work.table(ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges-0")
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    seen, turn = mark(current), 0
    while seen[0]:
        turn += 1
        following = work.table(_star(_star(current, True), False), f"edges-{turn}")
        now = mark(following)
        work.drop(f"edges-{turn - 1}")
        current = following
        if now == seen:
            break
        seen = now
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())

"""Connected components of an edge table by alternating large-star and small-star rounds.

Each round is an aggregation (smallest neighbour of each node, partial sums first) and an
equi-join of the edges with that table. The table of smallest neighbours is written to the
shared folder before the join, so both join sides are plain exchanges and AQE can split a
hot node; the edges of each round are written too, which cuts the lineage and survives the
loss of an executor. Nothing but two numbers (edge count and checksum) reaches the driver.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation; ``edges`` are distinct (a, b) with a > b."""
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    low = materialize(both.groupBy("u").agg(F.min("v").alias("m"))
                      .select(F.col("u").alias("k"), F.least("u", "m").alias("m")), "star")
    joined = both.join(low, both.u == low.k)
    if large:  # neighbours above u point to the smallest around u
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:      # u and its smaller neighbours point to the smallest of them
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(
            low.select(F.col("k").alias("a"), F.col("m").alias("b")))
    return materialize(out.where("a > b").distinct(), "edges")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` of longs to ``(node, root)``: the smallest node reachable, for nodes with an edge.

    Empty input gives an empty result; loops and repeated edges are allowed. Raises if the
    rounds do not settle (each round at least halves long paths, so 60 cover any table).
    """
    e = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                    .where("a > b").distinct(), "edges")

    def mark(df):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = mark(e)
    if not before[0]:
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for _ in range(max_rounds):
        e = _star(_star(e, True), False)
        after = mark(e)
        if after == before:
            roots = e.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
        before = after
    raise RuntimeError("connected components did not settle")

"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sphaera.llm.common import materialise


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(id, component): the least id reachable, for every id that has an edge.  edges: a long, b long, a != b.

    Each step sends every edge to the least neighbour of one of its ends; path lengths halve, so a few rounds do.  A node
    of many edges is reduced to its least neighbour by a partial aggregate, and its join can be split.
    """
    now = materialise(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi != lo").distinct(), "edges")
    state = None
    for _ in range(max_rounds):
        # large star: neighbours above u go to the least of u and its neighbours
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        # a table of its own, so that the join's rows of one node can be split
        least = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi != lo").distinct()
        # small star: u and its lower neighbours go to the least of them
        down = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(down, "hi").where("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        now = materialise(moved.union(down.select("hi", F.col("m").alias("lo"))).distinct(), "edges")
        new = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo"))).first()
        if tuple(new) == state:
            return now.select(F.col("hi").alias("id"), F.col("lo").alias("component")).union(now.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct())
        state = tuple(new)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")

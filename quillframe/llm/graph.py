"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import remove, written


#: Edges that a task of a step writes to one file.
FILE_EDGES = 20_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node and comp, the smallest node it is connected with, for each node of the edges (u, v); loops and repeats are allowed, nodes are longs and not null.

    Alternates large-star and small-star steps until the edges are stars around the smallest nodes. Each step moves every edge once; only
    counts and minima are gathered per node, so a node of very many edges is pre-aggregated and its join is one that Spark can split.
    """
    now = written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(now)
    files = state[0] // FILE_EDGES + 1  # steps never add edges
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        # a node's edge to its least neighbour stays, the ends of its others hook on to that neighbour
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
        new = written(small.coalesce(files))
        remove(now)
        now, before, state = new, state, _state(new)
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())

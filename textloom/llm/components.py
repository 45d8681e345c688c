"""Connected components of an edge table by alternating large and small stars; nothing is gathered on the driver.

Each round writes its tables to the shared folder, so lineage stays short and a lost executor costs one stage. Minima
are written before they are joined: both sides of each join are then plain shuffles, and Spark splits a hub's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import drop_path, written

MAX_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: distinct (u, v), u > v. Large: each node's larger neighbours go to its least neighbour; small: its smaller ones and itself do."""
    if large:
        near = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        out = near.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = written(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
        out = edges.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    done = written(out.filter(F.col("u") != F.col("v")).distinct(), "stars")
    drop_path(edges.sparkSession, least._textloom_path)
    return done


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (u, v; longs); root is the least node of its component, and not listed itself."""
    edges = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "stars")
    seen = None
    for _ in range(MAX_ROUNDS):
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if mark == seen or not mark[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = mark
        was = edges
        large = _star(edges, True)
        edges = _star(large, False)
        for old in (was, large):
            drop_path(edges.sparkSession, old._textloom_path)
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")

"""Connected components of an edge table by alternating large-star and small-star steps.

Each step moves edges towards the smallest id; the rows never exceed the edges given. The tables between steps are
written to the shared folder, so a lost executor costs only the tasks it held.

Defined cases: loops and repeated edges are ignored; no edges give no rows; ids are longs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, written

ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (u, v). Large: link each larger neighbour to the least of a node's closed neighbourhood; small: the smaller ones."""
    flipped = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    if large:
        seen = edges.unionByName(flipped)
    else:
        seen = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = seen.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = seen.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge (u, v); root is the least node it is connected with."""
    now = written(edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    for _ in range(ROUNDS):
        after = written(_star(_star(now, True), False), "edges")
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(now)
        now = after
        if tuple(mark) == before:
            break
        before = tuple(mark)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root"))
    ).distinct()

"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, table


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an undirected edge table (a, b), root being the least node that it reaches.

    Rounds of large-star (link all larger neighbours to the least neighbour) and small-star (link all smaller ones and
    itself to the least) until the edges are stars. Each round is written to the shared folder, so lineage stays short.
    The rows of a hub are split by the adaptive skew join, since both sides are exchanged; its least neighbour comes from
    a partial aggregate. Null ends, self loops and repeated edges are ignored. No node or edge goes to the driver.
    """
    now = table(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = table(_star(both), "large-star")
        small = table(_star(large, own=True), "small-star")
        changed = small.exceptAll(now).limit(1).count() or now.exceptAll(small).limit(1).count()
        discard(large, now)
        now = small
        if not changed:
            break
    else:
        raise RuntimeError(f"components have not settled in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _star(pairs: DataFrame, own: bool = False) -> DataFrame:
    """Large-star of symmetric pairs: (v, least of u and its neighbours) for neighbours v > u. With `own`, pairs point
    from a larger to a smaller node, and their smaller nodes and u itself are linked to the least."""
    least = pairs.groupBy("a").agg(F.min("b").alias("m"))
    joined = pairs.join(least, "a")
    if own:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    else:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
    return out.where("a <> b").distinct()

"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.plans.durable import durable, written


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 100) -> DataFrame:
    """Smallest reachable node of every node that has an edge.

    ``edges`` is undirected; self loops, repeated edges and edges with a null end
    are ignored. Returns ``(node, component)``; nodes without a proper edge are absent.

    Every round replaces each node's neighbours by links to the smallest of them,
    so the number of rounds grows with the logarithm of the longest path. Minima
    are taken by a ``groupBy`` and joined back, a node's neighbours are never
    gathered into one row.
    """
    a, b = F.col("a"), F.col("b")
    ends = edges.select(F.col(src).alias("x"), F.col(dst).alias("y"))
    now = durable(ends.where("x != y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
    seen = None
    for round_ in range(max_rounds):
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
        if tuple(mark) == seen:
            break
        seen = tuple(mark)
        # Each star deals its rows out by node once, for the minima and for the join with them:
        # conditions that a join would send down one side alone would make that two shuffles.
        ends = F.array(F.struct("a", "b"), F.struct(b.alias("a"), a.alias("b")))
        both = now.select(F.inline(ends)).where("a is not null and b is not null").repartition("a")
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # Merged, never broadcast: in small rounds each broadcast costs the driver a job and a table.
        large = both.join(least.hint("merge"), "a").where(b > F.greatest("a", "m")).select(b.alias("a"), F.col("m").alias("b"))
        large = large.where("a is not null and b is not null").repartition("a")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        # A node's link to its smallest neighbour stays; the other neighbours are linked to that one.
        small = large.join(least.hint("merge"), "a").select(F.when(b == F.col("m"), a).otherwise(b).alias("a"), F.col("m").alias("b"))
        now = (written if round_ % 4 == 3 else durable)(small.distinct())
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(b.alias("node"), b.alias("component"))
    return now.select(a.alias("node"), b.alias("component")).union(roots).distinct()

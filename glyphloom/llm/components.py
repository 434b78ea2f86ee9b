"""Connected components of an edge table by alternating large and small stars.

Each round halves the distance of nodes from the smallest of their component or better; edges never outnumber those of
the start. Neighbourhoods are only ever reduced to their minimum, before the shuffle where possible, so a hub is no
group that one task must hold; a join on a hub is an ordinary join, which Spark splits where it is skewed. Every round
is written to the shared folder, and deleted when the next one is there; ``discard`` takes the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphloom.llm.common import discard, materialise


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 200) -> DataFrame:
    """``node`` and ``root`` (the smallest node it is connected with) for every node that isn't its own root.

    Self-loops, repeated edges, edges with a null end and either direction are allowed; without edges the result is empty.
    """
    u, v = F.col("u"), F.col("v")
    rows = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), (F.col(a) != F.col(b)).alias("_ok"))
    star = materialise(rows.where("_ok").select("u", "v").distinct(), "edges")
    for _ in range(max_rounds):
        ends = star.select(u.alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(star.select(v.alias("n"), F.lit(0), F.lit(1)))
        loose = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up > 0 and down > 0)")
        if loose.isEmpty():
            found = star.select(u.alias("node"), v.alias("root"))
            found.stored_at = star.stored_at
            return found
        both = star.union(star.select(v, u).toDF("u", "v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(v.alias("u"), F.col("m").alias("v")).distinct()
        parent = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(parent, "u").where("v != m").select(v.alias("u"), F.col("m").alias("v"))
        before, star = star, materialise(small.union(parent.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(before)
    raise RuntimeError("the components did not settle")

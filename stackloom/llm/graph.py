"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackloom.llm.common import Scratch, spread


def components(edges: DataFrame, scratch: Scratch, most: int = 60) -> DataFrame:
    """(node, root) of every node of ``edges`` (u, v), root being the smallest id of its component.

    Each step aggregates before it shuffles and is written to the shared folder; the edges of a hub are dealt over several
    tasks. Loops and null ends are left out.
    """
    e = scratch.save(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = lambda d: tuple(d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = mark(e)
    for _ in range(most):
        if not before[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"), "n")
        large = spread(both.where("v > u"), "u", least, "w", "n", F.col("v"), 2 * before[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = spread(large, "u", least.withColumnRenamed("u", "w"), "w", "n", F.col("v"), 2 * before[0]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = scratch.save(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        after = mark(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {most} steps")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

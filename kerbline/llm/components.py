"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is a grouped minimum (combined before the shuffle) and a shuffle join that adaptive execution may split, so a node
with very many neighbours is never gathered in one task. Steps are written to the shared folder; the loop ends when a step
changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.session import forget, written


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _star(edges: DataFrame, low: DataFrame) -> DataFrame:
    return edges.join(low, "u")


def components(edges: DataFrame, a: str = "u", b: str = "v") -> DataFrame:
    """Rows (node, root): root is the smallest node of the component; nodes without an edge to another node have no row.

    Null ends and self-loops are ignored; repeated edges count once; an empty table gives an empty table.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    now = written(edges.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(), "edges")
    before = _signature(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = written(_star(both, low).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        low2 = written(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        hung = _star(large, low2).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = written(hung.unionByName(low2.select("u", F.col("m").alias("v"))).distinct(), "edges")
        for x in (now, low, large, low2):
            forget(x)
        now, last, before = after, before, _signature(after)
        if before == last:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))

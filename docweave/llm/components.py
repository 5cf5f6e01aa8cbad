"""Connected components by alternating large-star and small-star over an edge table.

Every round is two aggregations and two joins on vertices, all of them distributed; a hub's edges are the
skewed side of a sort-merge join that adaptive execution splits. Each round's edges are written to the
shared folder, so lineage stays short and lost executors cost one round. Rounds: O(log**2 n) at most,
2 to 5 for the star-like graphs that deduplication makes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import Shelf


def _stats(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def connected_components(edges: DataFrame, shelf: Shelf, u: str = "u", v: str = "v") -> DataFrame:
    """Rows (node, root): root is the smallest node reachable. Nodes without an edge to another do not appear.

    Null ends and loops are dropped, repeated edges count once; an empty table gives an empty table.
    """
    a, b = F.col(u).cast("bigint"), F.col(v).cast("bigint")
    now = shelf.put(edges.filter(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    before = _stats(now)
    while before[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u != v").distinct()
        after = shelf.put(small)
        stats = _stats(after)
        shelf.drop(now)
        now = after
        if stats == before:
            break
        before = stats
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))

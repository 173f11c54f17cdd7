"""Connected components of large edge tables, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageforge.llm.common import settle


def _print(edges: DataFrame):
    """Count and order-free hash, by which a round is seen to change nothing."""
    h = F.xxhash64("u", "v")
    return edges.agg(F.count("*"), F.bit_xor(h), F.sum(F.shiftrightunsigned(h, 33))).first()


def components(edges: DataFrame) -> DataFrame:
    """(a, b) longs to settled rows (node, root) for every node with an edge; the root is the smallest node.

    No node's neighbours are gathered: each step is one minimum and one join,
    and every round is written to the shared scratch folder.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    e, seen = settle(e, "edges"), None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        )
        e = settle(small.select("e.*").filter("u <> v").distinct(), "edges")
        now = _print(e)
        if now == seen:
            break
        seen = now
    return settle(
        e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct()), "components"
    )

"""Connected components by alternating large-star and small-star rounds.

Edges stay distributed; every round writes its edges to the shared scratch
folder. Rounds needed grow with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import discard, materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of orderable ids -> ``(node, root)``, root the smallest id reached.

    Nodes without an edge to another node don't appear; self loops, repeated and
    reversed edges are fine; edges with a null end are ignored; no edges give an
    empty table.
    """
    e = materialise(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    last = None
    while True:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        old, e = e, materialise(small.union(lowest.select("a", F.col("m").alias("b"))).distinct(), "edges")
        discard(old)
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == last:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        last = now

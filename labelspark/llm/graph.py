"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelspark.llm.common import staged

MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (u, v): root is the smallest node of its component.

    Alternating large and small stars: every node links its larger neighbours, then its smaller ones,
    to the least of them. The number of rounds grows with the logarithm of the longest path; each is
    a few shuffles of the edges, staged in the shared folder. A node with very many neighbours is
    aggregated in the map tasks and joined back, so no task holds its list.
    """
    now = staged(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct(), "edges"
    )
    mark = None
    for _ in range(MAX_ROUNDS):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = staged(large, "edges")
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        rest = large.join(lower, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = staged(rest.unionByName(lower.select("u", F.col("m").alias("v"))).distinct(), "edges")
        seen = now.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )

"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelspark.session import ensure_checkpoint_dir


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b); the root is the component's least node.

    In each round nodes have a new order, given by a hash of node and round. Every node points to the
    first of itself and its neighbours, takes over what that one points to, and the edges are replaced
    by those between the nodes pointed to. Because the order is new each time, chains in ascending
    order shrink like any others and the number of rounds grows with the logarithm of a component's
    size. Rounds are staged with checkpoint() and use only the edges left; null ends are ignored.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).filter("node is not null").distinct()
    left = edges.filter("a <> b").select("a", "b").distinct().checkpoint()
    steps = []
    while not left.isEmpty():
        ranked = lambda end: F.struct(F.xxhash64(end, F.lit(len(steps))).alias("h"), F.col(end).alias("n"))  # noqa: B023,E731
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # min() combines map-side, so a node with very many neighbours sends few rows.
        hook = both.groupBy("a").agg(F.min(ranked("b")).alias("first")).select(
            F.col("a").alias("node"), F.least("first", ranked("a"))["n"].alias("up")
        )
        over = hook.select(F.col("node").alias("up"), F.col("up").alias("top"))
        step = hook.join(over, "up").select("node", F.col("top").alias("up")).checkpoint()
        steps.append(step)
        point = lambda end: step.select(F.col("node").alias(end), F.col("up").alias(f"{end}_up"))  # noqa: B023,E731
        left = (
            left.join(point("a"), "a").join(point("b"), "b")
            .select(F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b"))
            .filter("a <> b").distinct().checkpoint()
        )
    roots = nodes.withColumn("root", F.col("node"))
    for step in steps:
        moved = step.select(F.col("node").alias("root"), F.col("up").alias("moved"))
        roots = roots.join(moved, "root", "left").select("node", F.coalesce("moved", "root").alias("root"))
    if not steps:
        return roots
    roots = roots.checkpoint()
    least = roots.groupBy("root").agg(F.min("node").alias("least"))
    return roots.join(least, "root").select("node", F.col("least").alias("root"))

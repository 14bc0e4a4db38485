"""Order-aware building blocks that never put a whole hot group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 16


def mark_first(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Flag the first row of each group.

    The first key is an aggregate (combined map-side) joined back by key, so a group holding a
    third of the table is never sorted in one task; AQE may split its side of the join.
    """
    firsts = df.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_first"))
    return df.join(firsts, keys).withColumn(name, F.struct(*order) == F.col("_first")).drop("_first")


def first_rows(df: DataFrame, keys: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """First row of each group as an aggregate: keys plus the kept columns."""
    rest = [c for c in keep if c not in order]
    return (
        df.groupBy(*keys)
        .agg(F.min(F.struct(*order, *rest)).alias("_row"))
        .select(*keys, *[F.col("_row")[c].alias(c) for c in keep])
    )


def first_k(df: DataFrame, keys: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """First k rows per group with their rank.

    `row_number() <= k` lets Spark cut every map task to k rows per group before the shuffle.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def with_previous(
    df: DataFrame, keys: list[str], block: list[str], order: list[str], value: Column, depth: int,
    name: str,
) -> DataFrame:
    """Add the values of up to `depth` preceding rows of the group, nearest first.

    `block` cuts a group into runs consecutive in `order` (say `line_no div 65536`). Windows run
    inside blocks; across blocks only each block's last `depth` values travel.
    """
    inside = Window.partitionBy(*keys, *block).orderBy(*order)
    tails = (
        first_k(
            df.select(*keys, *block, *order, value.alias("_value")),
            keys + block, [F.col(c).desc() for c in order], depth, "_rank",
        )
        .groupBy(*keys, *block)
        .agg(F.array_sort(F.collect_list(F.struct("_rank", "_value"))).alias("_tail"))
        .withColumn("_tail", F.transform("_tail", lambda t: t["_value"]))
    )
    across = Window.partitionBy(*keys).orderBy(*block)
    nothing = F.slice(F.array(F.first(value).over(inside)), 1, 0)
    earlier = F.flatten(F.array_compact(F.array(*[F.lag("_tail", i).over(across) for i in range(1, depth + 1)])))
    carry = tails.select(*keys, *block, F.slice(earlier, 1, depth).alias("_carry"))
    rank = F.row_number().over(inside)
    near = F.array(*[F.lag(value, i).over(inside) for i in range(1, depth + 1)])
    return (
        df.withColumn("_near", F.slice(near, F.lit(1), F.least(rank - 1, F.lit(depth))))
        .withColumn("_none", nothing)
        .join(carry, keys + block, "left")
        .withColumn(name, F.slice(F.concat("_near", F.coalesce("_carry", "_none")), 1, depth))
        .drop("_near", "_none", "_carry")
    )

"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelspark.llm.common import WORD, no_null_text, staged

WEIGHTS = (5, 2, 1)  # by rank of the source, repeating
SHARE = 1.5  # the mix takes this share of all words
MOST = 2  # times that a document may be taken
RATE_UNIT = 1 << 20  # rates are whole numbers of this unit, so that reruns agree bit by bit
OFFSETS = 64  # roundings tried per source
BUCKETS = 256  # parts of one (source, size) cell, by hash of the id
TOLERANCE = 1e-9
MAX_STEPS = 80


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, target. One row per source goes through one task here: sources are the
    configured parts of a mix, not keys of the data.

    Sources by code point, null last, weigh `weights`, repeating. A source reaches its limit (most ×
    its size) before another exactly if limit / weight is smaller, so the rounds of resharing end at
    the first prefix of that order whose rest, shared by weight, exceeds no limit.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weigh = F.array(*[F.lit(w) for w in weights])
    ranked = totals.withColumn("w", weigh[(F.row_number().over(order) - 1) % len(weights)]).withColumn(
        "cap", most * F.col("source_size")
    )
    fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    upto, every = fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    levels = (
        ranked.withColumn("capped", F.coalesce(F.sum("cap").over(upto), F.lit(0)))
        .withColumn("w_left", F.sum("w").over(every) - F.coalesce(F.sum("w").over(upto), F.lit(0)))
        .withColumn("left", F.sum("source_size").over(every) * F.lit(float(share)) - F.col("capped"))
        .withColumn("fits", F.col("left") * F.col("w") <= F.col("cap").cast("double") * F.col("w_left"))
    )
    # The first source in this order that fits sets the level for itself and all after it.
    first = F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("w"), F.col("w_left").alias("wl"), "left"))).over(every)
    return levels.withColumn("level", first).select(
        "source", "source_size",
        F.when(
            F.col("level").isNotNull() & (F.col("cap").cast("double") * F.col("level.wl") > F.col("level.left") * F.col("w")),
            F.col("level.left") * F.col("w") / F.col("level.wl"),
        ).otherwise(F.col("cap").cast("double")).alias("target"),
    )


def _rate(tilt: Column, most: int) -> Column:
    """exp(tilt), at most `most`; the comparison comes first so that no exponent overflows."""
    return F.when(tilt >= F.log(F.lit(float(most))), F.lit(float(most))).otherwise(F.exp(tilt))


def solve_rates(cells: DataFrame, targets: DataFrame, most: int = MOST) -> DataFrame:
    """cells (source, size, n) with their `rate`, a whole number of 1/RATE_UNIT.

    Entropy balancing: among all rates within [0, most] whose words meet each source's target, the
    ones closest to 1 in relative entropy are min(most, exp(lambda * size / mean size)). The dual in
    lambda is convex; each step sums its gradient and curvature over the cells in Spark and takes a
    Newton step for every source at once, or halves the bracket where Newton leaves it. Cells are
    exact: all documents of one source and size share one rate.
    """
    known = staged(
        cells.withColumn("s", F.struct(F.col("source")))
        .groupBy("s")
        .agg(
            F.sum(F.col("n") * F.col("size")).alias("words"), F.sum("n").alias("docs"),
            F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"),
        )
        .join(targets.select(F.struct(F.col("source")).alias("s"), "target"), "s"),
        "mix-sources",
    )
    mean = F.col("words") / F.col("docs")
    step = F.col("least") / mean
    full = F.col("target") >= F.col("words") * F.lit(float(most))
    state = known.select(
        "s", "target", "words", mean.alias("mean"), full.alias("full"),
        F.when(full | (F.col("words") == 0) | (F.col("target") <= 0), True).otherwise(False).alias("done"),
        F.lit(0.0).alias("lam"),
        (-(F.log(F.greatest(F.col("words") / F.col("target"), F.lit(1.0))) + 1) / step).alias("lo"),
        ((F.log(F.lit(float(most))) + 1e-6) / step).alias("hi"),
    )
    state = staged(state, "mix-state")
    base = cells.filter("size > 0").select(F.struct(F.col("source")).alias("s"), "size", "n")
    for _ in range(MAX_STEPS):
        x = F.col("size") / F.col("mean")
        r = _rate(F.col("lam") * x, most)
        sums = (
            base.join(state.filter(~F.col("done")).select("s", "mean", "lam"), "s")
            .groupBy("s")
            .agg(
                F.sum(F.col("n") * F.col("size") * r).alias("got"),
                F.sum(F.when(r < most, F.col("n") * F.col("size") * x * r).otherwise(0.0)).alias("slope"),
            )
        )
        gap = F.col("got") - F.col("target")
        lo = F.when(gap < 0, F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(gap > 0, F.col("lam")).otherwise(F.col("hi"))
        newton = F.col("lam") - gap / F.col("slope")
        met = F.abs(gap) <= TOLERANCE * F.col("target")
        moved = state.join(sums, "s", "left").select(
            "s", "target", "words", "mean", "full",
            (F.col("done") | F.coalesce(met, F.lit(True))).alias("done"),
            F.when(F.col("done") | met, F.col("lam"))
            .when((F.col("slope") > 0) & (newton > lo) & (newton < hi), newton)
            .otherwise((lo + hi) / 2).alias("lam"),
            F.when(F.col("done"), F.col("lo")).otherwise(lo).alias("lo"),
            F.when(F.col("done"), F.col("hi")).otherwise(hi).alias("hi"),
        )
        state = staged(moved, "mix-state")
        if state.filter(~F.col("done")).isEmpty():
            break
    found = state.select("s", "lam", "mean", "full", "target")
    rate = F.when(F.col("full"), F.lit(float(most))).when(F.col("target") <= 0, F.lit(0.0)).otherwise(
        _rate(F.col("lam") * F.col("size") / F.col("mean"), most)
    )
    return (
        cells.withColumn("s", F.struct(F.col("source"))).join(found, "s")
        .select("s", "size", "n", "target", F.round(F.coalesce(rate, F.lit(0.0)) * RATE_UNIT).cast("long").alias("rate"))
    )


def _round_cells(rated: DataFrame) -> DataFrame:
    """s, size, copies: whole copies for each cell.

    Along the sizes of a source, longest first, the sum of rates is cut at whole numbers, which keeps
    the error under the longest document; of OFFSETS places for the cuts, the one whose words come
    nearest to the target is taken. The window runs over the distinct sizes of a source, not over its
    documents.
    """
    order = Window.partitionBy("s").orderBy(F.col("size").desc())
    run = rated.withColumn("upto", F.sum(F.col("n") * F.col("rate")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    cut = run.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(OFFSETS - 1)))).withColumn(
        "copies",
        F.expr(f"(upto + k * {RATE_UNIT // OFFSETS}) div {RATE_UNIT} - (upto - n * rate + k * {RATE_UNIT // OFFSETS}) div {RATE_UNIT}"),
    )
    error = cut.groupBy("s", "k").agg(F.abs(F.sum(F.col("copies") * F.col("size")) - F.max("target")).alias("error"))
    best = error.groupBy("s").agg(
        F.min_by("k", F.struct("error", "k")).alias("best")
    )
    return cut.join(best, "s").filter("k = best").select("s", "size", "n", "copies")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row per row of `docs`: doc_id, size, source_size, source, target, copies, taken.

    size counts the words of the text (null: 0). taken = copies × size, with 0 to `most` copies; which
    documents of one source and size get the extra copy is decided by a hash of the id, so reruns
    agree. Null sources are one source, the last. Rows repeated under one id may get different
    copies, always the same two. Documents without words get their copies like others but take 0.
    An empty table gives an empty result; other columns are not read.
    """
    sized = staged(
        docs.select(
            F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
            F.regexp_count(no_null_text(text_col), F.lit(WORD)).cast("long").alias("size"),
        ).withColumn("b", F.pmod(F.xxhash64(F.col("doc_id")), F.lit(BUCKETS)).cast("int")),
        "mix-sizes",
    )
    cells = staged(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-cells")
    targets = staged(source_targets(cells.select("source", (F.col("size") * F.col("n")).alias("size")), weights, share, most), "mix-targets")
    rounded = _round_cells(solve_rates(cells, targets, most))
    # A cell's copies go to its hash buckets in proportion, so no window holds a whole hot cell.
    s = F.struct(F.col("source")).alias("s")
    parts = sized.groupBy(s, "size", "b").agg(F.count(F.lit(1)).alias("m"))
    upto = Window.partitionBy("s", "size").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    shared = (
        parts.withColumn("c", F.sum("m").over(upto)).join(rounded, ["s", "size"])
        .select("s", "size", "b", "m", F.expr("(copies * c) div n - (copies * (c - m)) div n").alias("k"))
    )
    plan = staged(shared.join(targets.select(s, "source_size", "target"), "s"), "mix-plan")
    rank = Window.partitionBy("s", "size", "b").orderBy(F.xxhash64(F.lit("mix"), F.col("doc_id")), "doc_id")
    return (
        sized.withColumn("s", F.struct(F.col("source")))
        .withColumn("rank", F.row_number().over(rank))
        .join(plan, ["s", "size", "b"])
        .withColumn("copies", F.expr("k div m + if(rank <= k % m, 1, 0)"))
        .select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "source")
    )

"""Candidate regions of a panel: filtering, overlap suppression, scoring, ranking."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelspark import fixed
from labelspark.functions.geometry import clamp_box, iou
from labelspark.functions.text import rounded
from labelspark.operators.components import components
from labelspark.operators.ordered import first_k
from labelspark.session import staged

_BOX = ["x", "y", "w", "h"]


def _box(prefix: str = "") -> Column:
    return F.struct(*[F.col(prefix + c).alias(c) for c in _BOX])


def contour_boxes(boxes: DataFrame) -> DataFrame:
    """Outlines that cover at least 8 % of their image, cut to it."""
    ratio = F.col("w") * F.col("h") / (F.col("image_w") * F.col("image_h"))
    cut = clamp_box(_box(), F.col("image_w"), F.col("image_h"))
    return boxes.filter(ratio >= fixed.REGION_MIN_AREA).withColumn("_cut", cut).withColumns(
        {c: F.col("_cut")[c] for c in _BOX}
    ).drop("_cut")


def text_envelope(components: DataFrame) -> DataFrame:
    """One padded box per image around its text-like components."""
    small = F.col("area").between(8, F.col("image_w") * F.col("image_h") * 0.02)
    ends = components.filter(small & (F.col("w") >= 2) & (F.col("h") >= 2)).groupBy("image_id", "image_w", "image_h").agg(
        F.min("x").alias("x1"), F.min("y").alias("y1"),
        F.max(F.col("x") + F.col("w")).alias("x2"), F.max(F.col("y") + F.col("h")).alias("y2"),
    )
    pad_x = F.greatest(F.lit(8.0), F.floor(F.col("image_w") / 50).cast("double"))
    pad_y = F.greatest(F.lit(8.0), F.floor(F.col("image_h") / 50).cast("double"))
    padded = F.struct(
        (F.col("x1") - pad_x).alias("x"), (F.col("y1") - pad_y).alias("y"),
        (F.col("x2") - F.col("x1") + 2 * pad_x).alias("w"), (F.col("y2") - F.col("y1") + 2 * pad_y).alias("h"),
    )
    return ends.select("image_id", clamp_box(padded, F.col("image_w"), F.col("image_h")).alias("b")).select("image_id", "b.*")


def suppress_overlaps(boxes: DataFrame) -> DataFrame:
    """Drop a box that overlaps an already kept one by more than 0.85, in input order.

    Copies of a box can only be dropped, so boxes are made distinct first. Boxes meet in grid cells,
    and only those with a rival go further: chains of rivals form components, found in a number of
    rounds that grows with the logarithm of their size, and each component is decided in input order
    by one task. Boxes of one image are spread over its components; a component itself is one task's
    work, linear in its boxes and rival pairs. A task walks through its components, since a call for
    each of millions of small ones would cost far more than the decisions.
    """
    distinct = staged(boxes.groupBy("image_id", *_BOX).agg(F.min("ord").alias("ord")), "boxes")  # for three uses
    # Nodes are named by two hashes of image and box; the box itself travels along and decides.
    pairs = staged(_conflicts(distinct).withColumns({"a": _node(), "b": _node("r_")}), "rivals")
    groups = components(pairs.select("a", "b"))
    key = ["image_id", "ord", *_BOX]
    lost = (
        pairs.join(groups.select(F.col("node").alias("a"), "root"), "a")
        .select("root", *key, F.col("a").alias("later"), F.col("b").alias("earlier"))
        .repartition("root").sortWithinPartitions("root", "ord", *_BOX)
        .mapInArrow(_losers, T.StructType([distinct.schema[c] for c in key]))
    )
    kept = distinct.join(lost, key, "left_anti")
    return boxes.join(kept, key, "left_semi")


def _node(prefix: str = "") -> Column:
    """A box of an image as 32 hex digits."""
    members = [F.col("image_id"), F.col(prefix + "ord"), *[F.col(prefix + c) for c in _BOX]]
    return F.md5(F.concat_ws("/", *[c.cast("string") for c in members]))


def _losers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Boxes that lose to an earlier kept one; every row is a box and one earlier rival. Rows come by
    component and in input order, so a rival is decided before the boxes that it may drop."""
    root, lost = None, set()
    for batch in batches:
        taken = []
        rows = zip(*[batch.column(c).to_pylist() for c in ("root", "later", "earlier")])
        for at, (component, later, earlier) in enumerate(rows):
            if component != root:
                root, lost = component, set()
            if later not in lost and earlier not in lost:
                lost.add(later)
                taken.append(at)
        yield batch.select(["image_id", "ord", *_BOX]).take(pa.array(taken, pa.int64()))


def _conflicts(distinct: DataFrame) -> DataFrame:
    """(later, earlier) box pairs that exclude each other.

    IoU > 0.85 bounds the width ratio by 1/0.85 and the x offset by 0.15 of the wider box, so
    boxes meet in cells of their width class or the next. The box of the higher class comes to its own
    class's cell and those beside it, the other to its cell in that class, so a pair meets once.
    """
    level = F.floor(F.log(F.col("w")) / F.log(F.lit(1 / fixed.REGION_OVERLAP))).cast("int")
    size = F.pow(F.lit(1 / fixed.REGION_OVERLAP), F.col("level") + 1) * (1 - fixed.REGION_OVERLAP)
    box = F.struct("ord", *_BOX)
    graded = distinct.select("image_id", box.alias("box"), "x", level.alias("own"))
    cell = F.floor(F.col("x") / size)
    wide = graded.withColumn("level", F.col("own")).select(
        "image_id", "level", F.col("box").alias("wide"), F.explode(F.array(*[cell + d for d in (-1, 0, 1)])).alias("cx")
    )
    narrow = graded.withColumn("level", F.explode(F.array(*[F.col("own") + d for d in (0, 1, 2)]))).select(
        "image_id", "level", cell.alias("cx"), F.col("box").alias("narrow"), (F.col("level") == F.col("own")).alias("same")
    )
    is_later = F.col("narrow") < F.col("wide")
    pair = F.struct(
        F.when(is_later, F.col("wide")).otherwise(F.col("narrow")).alias("l"),
        F.when(is_later, F.col("narrow")).otherwise(F.col("wide")).alias("e"),
    )
    met = wide.join(narrow, ["image_id", "level", "cx"]).filter(is_later | ~F.col("same")).select("image_id", pair.alias("p"))
    return met.filter(iou(F.col("p.l"), F.col("p.e")) > fixed.REGION_OVERLAP).select(
        "image_id", "p.l.*", *[F.col(f"p.e.{c}").alias(f"r_{c}") for c in ("ord", *_BOX)]
    )


def score_regions(boxes: DataFrame) -> DataFrame:
    """Score from relative area, text density and centrality; the fallback box counts for less."""
    area = F.col("w") * F.col("h") / (F.col("image_w") * F.col("image_h"))
    dx = (F.col("x") + F.col("w") / 2) / F.col("image_w") - 0.5
    dy = (F.col("y") + F.col("h") / 2) / F.col("image_h") - 0.5
    centrality = F.greatest(F.lit(0.0), 1.0 - (dx * dx + dy * dy) * 2)
    by_area = F.greatest(F.lit(0.0), 1.0 - F.abs(area - 0.45) / 0.55)
    by_text = F.least(F.col("text_density") / 0.35, F.lit(1.0))
    score = 0.45 * by_area + 0.4 * by_text + 0.15 * centrality
    fallback = F.col("source") == "image_surface_fallback"
    return boxes.withColumns(
        {
            "relative_area": rounded(area, 4), "centrality": rounded(centrality, 4),
            "score": rounded(F.when(fallback, score * 0.55).otherwise(score), 4),
        }
    )


def top_regions(scored: DataFrame, k: int = fixed.TOP_REGIONS) -> DataFrame:
    """Best k regions per image, earlier ones first on equal scores."""
    return first_k(scored, ["image_id"], [F.col("score").desc(), F.col("ord").asc(), *[F.col(c).asc() for c in _BOX]], k)


def region_hints(panels: DataFrame, ranked: DataFrame) -> DataFrame:
    """Best region of each panel, or that there is none; never an authoritative placement."""
    best = ranked.filter("rank = 1").select("image_id", *_BOX, "score", "source")
    return panels.join(best, "image_id", "left").withColumn(
        "status", F.when(F.col("score").isNull(), "no_candidate_detected").otherwise("candidate_available")
    )

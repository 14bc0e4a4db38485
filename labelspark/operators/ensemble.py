"""Field candidates and their agreement per (scan, field).

Counting agreeing pairs never lists the pairs of a group. Equal candidates are counted once with
their number; a bound from the sizes of the text groups settles nearly every group; what is left
is joined by text and box-grid cell, where only boxes that can overlap by half can meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelspark import fixed
from labelspark.functions.geometry import iou
from labelspark.functions.text import comparison_key, holds_any, plain, strip
from labelspark.session import staged

_KEY = ["scan_id", "field_name"]
_CANDIDATE = ["text_key", "x", "y", "w", "h", "confidence"]


_LINE = ["scan_id", "panel", "line_no", "text", "confidence", "bbox", "source_provider", "preprocessing_variant"]


def _fields_found(fields: list[str] | None) -> Column:
    """Array of (field_name, context_hint) of the patterns that match, from `lowered` and `readable`."""
    readable = F.col("readable")

    def found(name: str, pattern: str) -> Column:
        words = fixed.CANDIDATE_WORDS.get(name)
        return holds_any(F.col("lowered"), words) & readable.rlike(pattern) if words else readable.rlike(pattern)

    return F.array_compact(F.array(*[
        F.when(found(name, pattern), F.struct(F.lit(name).alias("field_name"), F.lit(hint).alias("context_hint")))
        for name, pattern, hint in fixed.CANDIDATE_PATTERNS
        if fields is None or name in fields
    ]))


def candidate_marks(lines: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """The lines with `candidate_of`, the fields whose pattern matches the line, and `is_candidate`.
    Marked lines can be stored; `field_candidates` reads the marks then."""
    own = lines.columns
    return (
        lines.withColumn("stripped", strip(F.col("text")))
        .select(*own, F.lower("stripped").alias("lowered"), plain(F.col("stripped")).alias("readable"))
        .select(*own, _fields_found(fields).alias("candidate_of"))
        .withColumn("is_candidate", F.size("candidate_of") > 0)
    )


def field_candidates(lines: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """One row per (line, field) whose field pattern matches; blank lines give none. Stored marks are
    used where the lines have them."""
    if "candidate_of" in lines.columns:
        rows = lines.filter("is_candidate").withColumn("text", strip(F.col("text"))).select(*_LINE, F.inline("candidate_of"))
        return rows if fields is None else rows.filter(F.col("field_name").isin(fields))
    return (
        lines.withColumn("text", strip(F.col("text")))
        .select(*_LINE, F.lower("text").alias("lowered"), plain(F.col("text")).alias("readable"))
        # Inline of the expression itself: over a column of its own Spark would put a filter on its
        # size below, and try every pattern twice.
        .select(*_LINE, F.inline(_fields_found(fields)))
    )


def texts_agree(a: Column, b: Column) -> Column:
    return comparison_key(a) == comparison_key(b)


def boxes_agree(a: Column, b: Column) -> Column:
    return iou(a, b) >= fixed.IOU_AGREE


def confidence_similar(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= fixed.CONFIDENCE_AGREE


def _counted(candidates: DataFrame) -> DataFrame:
    """Equal candidates as one row: how many they are, and the earliest of them."""
    return (
        candidates.select(
            *_KEY, comparison_key(F.col("text")).alias("text_key"),
            *[F.coalesce(F.col("bbox")[c], F.lit(0.0)).alias(c) for c in ("x", "y", "w", "h")],
            "confidence",
            F.struct(
                F.when(F.col("panel") == "front", 0).otherwise(1).alias("panel_rank"), "line_no", "text",
            ).alias("first"),
        )
        .groupBy(*_KEY, *_CANDIDATE)
        .agg(F.count("*").alias("n"), F.min("first").alias("first"))
    )


def _half_overlap_sums(counted: DataFrame) -> DataFrame:
    """Per distinct candidate: how many candidates agree in text and box, and in confidence too.

    Two boxes with IoU >= 1/2 differ in width at most by a factor of two and in x at most by half
    the wider one, and likewise in height and y. So each box enters the grid of its own width and
    height class and of the next ones, and looks one cell to every side: boxes meet in a cell of
    place and size, wherever on the panel and however many they are.
    """
    level = lambda size: F.length(F.bin(F.floor(size).cast("long"))) - 1
    usable = counted.filter("w > 0 AND h > 0").withColumns({"own_w": level("w"), "own_h": level("h")})
    cell = lambda at, size: F.floor(F.col(at) / F.pow(F.lit(2.0), size))
    graded = usable.withColumn("level", F.explode(F.array(*[
        F.struct((F.col("own_w") + dw).alias("w"), (F.col("own_h") + dh).alias("h")) for dw in (0, 1) for dh in (0, 1)
    ]))).withColumn("cell", F.struct(cell("x", F.col("level.w")).alias("x"), cell("y", F.col("level.h")).alias("y")))
    left = graded.withColumn("cell", F.explode(F.array(*[
        F.struct((F.col("cell.x") + dx).alias("x"), (F.col("cell.y") + dy).alias("y")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)
    ])))
    place = [*_KEY, "text_key", "level", "cell"]
    right = graded.select(
        *place, *[F.col(c).alias(f"r_{c}") for c in ("x", "y", "w", "h", "confidence", "n", "own_w", "own_h")]
    )
    box = lambda prefix: F.struct(*[F.col(prefix + c).alias(c) for c in ("x", "y", "w", "h")])
    meets = (
        (F.col("level.w") == F.greatest("own_w", "r_own_w")) & (F.col("level.h") == F.greatest("own_h", "r_own_h"))
        & (iou(box(""), box("r_")) >= fixed.IOU_AGREE)
    )
    similar = confidence_similar(F.col("confidence"), F.col("r_confidence"))
    return (
        left.join(right, place)
        .filter(meets)
        .groupBy(*_KEY, *_CANDIDATE)
        .agg(
            F.sum("r_n").alias("near"),
            F.sum(F.when(similar, F.col("r_n")).otherwise(0)).alias("agreeing"),
        )
    )


def ensemble(candidates: DataFrame) -> DataFrame:
    """Status per (scan, field) with at least one candidate.

    agreed: one candidate, or more agreeing than other pairs; then the winner has the highest
    confidence * (1 + agreements), the earliest on ties. conflict otherwise: no value, and the
    candidate rows are its description (`conflict_candidates`). The counted candidates are written
    once, so the lines are read once for all the uses below.
    """
    counted = staged(_counted(candidates), "candidates")
    # Texts are told apart by a hash: two that share one only make the bound of their group larger. Only
    # the text of a single candidate is asked of these sizes, so no order of lines travels with it.
    sizes = (
        counted.groupBy(*_KEY, F.xxhash64("text_key").alias("text_hash"))
        .agg(F.sum("n").alias("same_text"), F.min("first.text").alias("text"), F.max("confidence").alias("top"))
        .groupBy(*_KEY)
        .agg(
            F.sum("same_text").alias("candidates"),
            F.sum(F.col("same_text") * (F.col("same_text") - 1)).alias("pair_bound"),
            F.min("text").alias("text"), F.max("top").alias("top"),
        )
    )
    pairs = F.col("candidates") * (F.col("candidates") - 1)
    # Ordered pairs on both sides: an agreement needs more than half of all pairs.
    open_groups = sizes.filter((F.col("candidates") > 1) & (F.col("pair_bound") * 2 > pairs)).select(*_KEY)
    # Few groups are left: written once, so that all the counted candidates are shuffled to them once,
    # without the key of the text, which the text gives again.
    compared = staged(
        counted.drop("text_key").join(open_groups, _KEY, "left_semi").withColumn("text_key", comparison_key(F.col("first.text"))),
        "compared",
    )
    scored = compared.join(_half_overlap_sums(compared), [*_KEY, *_CANDIDATE], "left").select(
        *_KEY, "n", "first", "confidence", "w", "h",
        F.coalesce("near", F.lit(0)).alias("near"), F.coalesce("agreeing", F.lit(0)).alias("agreeing"),
    )
    # A candidate meets its own copies in the join; it does not agree with itself.
    own = F.when((F.col("w") > 0) & (F.col("h") > 0), 1).otherwise(0)
    agreements = F.col("near") - own
    verdicts = scored.groupBy(*_KEY).agg(
        F.sum(F.col("n") * (F.col("agreeing") - own)).alias("agreed_pairs"),
        F.max(
            F.struct(
                (F.col("confidence") * (1 + agreements)).alias("score"),
                (-F.col("first.panel_rank")).alias("panel_back"), (-F.col("first.line_no")).alias("back"),
                F.col("first.text").alias("text"), F.col("confidence"),
            )
        ).alias("best"),
    )
    single = F.col("candidates") == 1
    agreed = single | (F.coalesce("agreed_pairs", F.lit(0)) * 2 > pairs)
    value = F.when(single, F.col("text")).when(agreed, F.col("best.text"))
    confidence = F.when(single, F.col("top")).when(agreed, F.col("best.confidence")).otherwise(0.0)
    return (
        sizes.join(verdicts, _KEY, "left")
        .select(
            *_KEY, "candidates",
            F.when(agreed, "agreed").otherwise("conflict").alias("status"),
            value.alias("fused_value"), confidence.alias("fused_confidence"),
            F.when(agreed, F.coalesce("agreed_pairs", F.lit(0)) / 2).otherwise(0).cast("long").alias("agreed_pairs"),
        )
        .withColumn(
            "verification_state",
            F.when(F.col("status") == "conflict", "CONFLICT")
            .when(F.col("fused_confidence") >= fixed.MIN_CONFIDENCE, "VERIFIED")
            .otherwise("NOT_VERIFIED"),
        )
    )


def with_missing(statuses: DataFrame, scans: DataFrame) -> DataFrame:
    """Every (scan, field): a field without candidates is missing."""
    fields = F.explode(F.array(*map(F.lit, fixed.FIELDS))).alias("field_name")
    return scans.select("scan_id", fields).join(statuses, _KEY, "left").withColumns(
        {
            "candidates": F.coalesce("candidates", F.lit(0)),
            "status": F.coalesce("status", F.lit("missing")),
            "fused_confidence": F.coalesce("fused_confidence", F.lit(0.0)),
            "verification_state": F.coalesce("verification_state", F.lit("NOT_VERIFIED")),
        }
    )


def conflict_candidates(candidates: DataFrame, statuses: DataFrame) -> DataFrame:
    """Rows that describe a conflict, one per candidate ("provider:text"), none left out.

    Joined in rows rather than in one string, which for a large scan would be one giant cell.
    """
    in_conflict = statuses.filter("status = 'conflict'").select(*_KEY)
    return candidates.join(in_conflict, _KEY, "left_semi").withColumn(
        "description", F.concat_ws(":", "source_provider", "text")
    )

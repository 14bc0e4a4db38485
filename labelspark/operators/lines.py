"""OCR tokens and lines: grouping, merging of engines, panels and preprocessing variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelspark import fixed
from labelspark.functions.text import (
    confusion_variants, line_confidence, line_key, rounded, strip, token_confidence,
)
from labelspark.operators.extraction import panel_rank
from labelspark.operators.ordered import first_rows, mark_first


def clean_lines(lines: DataFrame) -> DataFrame:
    """Line record as stored: trimmed text, confidence never negative, three decimals."""
    return lines.withColumns(
        {
            "text": F.coalesce(strip(F.col("text")), F.lit("")),
            "confidence": line_confidence(F.col("confidence")),
        }
    )


def tokens_to_lines(tokens: DataFrame) -> DataFrame:
    """Words of one (block, paragraph, line) joined left to right, with envelope and mean confidence.

    A line's words end up in one text cell, so they are gathered; everything else is a plain
    aggregate.
    """
    line = ["image_id", "block_num", "par_num", "line_num"]
    words = tokens.withColumns(
        {"text": strip(F.col("text")), "confidence": token_confidence(F.col("conf"))}
    ).filter("text <> ''")
    x, y = F.min("left"), F.min("top")
    ordered = F.array_sort(F.collect_list(F.struct("left", "pos", "text")))
    return words.groupBy(*line).agg(
        F.array_join(F.transform(ordered, lambda w: w["text"]), " ").alias("text"),
        x.alias("x"), y.alias("y"),
        (F.max(F.col("left") + F.col("width")) - x).alias("w"),
        (F.max(F.col("top") + F.col("height")) - y).alias("h"),
        # Thousandths add up exactly; a sum of doubles would depend on the order of rows.
        rounded(F.sum(F.rint(F.col("confidence") * 1000).cast("long")) / F.count("*") / 1000, 3)
        .alias("confidence"),
    )


def polygon_to_bbox(points: Column) -> Column:
    """Axis-aligned (x, y, width, height) around an array of (x, y) corners."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    x, y = F.array_min(xs), F.array_min(ys)
    return F.struct(
        x.cast("double").alias("x"), y.cast("double").alias("y"),
        (F.array_max(xs) - x).cast("double").alias("width"),
        (F.array_max(ys) - y).cast("double").alias("height"),
    )


def first_provider_with_output(lines: DataFrame, image: str = "image_id", rank: str = "provider_rank") -> DataFrame:
    """Per image only the lines of the first engine, in priority order, that returned any."""
    first = lines.groupBy(image).agg(F.min(rank).alias(rank))
    return lines.join(first, [image, rank], "left_semi")


def merge_variant_lines(lines: DataFrame) -> DataFrame:
    """All lines of all variants; a text seen before in its image names what it repeats."""
    keyed = lines.withColumn("text_key", line_key(F.col("text"))).filter("text_key <> ''")
    marked = mark_first(keyed, ["image_id", "text_key"], ["variant_rank", "ord", "text"], "is_first")
    return marked.withColumn("duplicate_of", F.when(~F.col("is_first"), F.col("text_key")))


def append_new_variant_lines(base: DataFrame, variants: DataFrame) -> DataFrame:
    """Base lines plus variant lines with a new text.

    The base texts are fixed beforehand, so equal new lines all enter. A known text instead gives
    its variant name (the last one) to the first base line with that text.
    """
    key = ["image_id", "text_key"]
    base = base.withColumn("text_key", line_key(F.col("text")))
    variants = variants.withColumn("text_key", line_key(F.col("text"))).filter("text_key <> ''")
    known = base.select(*key).distinct()
    new = variants.join(known, key, "left_anti")
    tags = (
        variants.groupBy(*key)
        .agg(F.max(F.struct("variant_rank", "ord", "variant")).alias("last"))
        .select(*key, F.col("last.variant").alias("tag"))
    )
    marked = mark_first(base, key, ["ord", "text"], "is_first").join(tags, key, "left")
    retagged = marked.withColumn(
        "variant", F.when(F.col("is_first") & F.col("tag").isNotNull(), F.col("tag")).otherwise(F.col("variant"))
    )
    return retagged.select(*base.columns).unionByName(new.select(*base.columns)).drop("text_key")


def append_new_crop_lines(base: DataFrame, crops: DataFrame) -> DataFrame:
    """Base lines plus crop lines with a new text, each new text once."""
    key = ["image_id", "text_key"]
    base = base.withColumn("text_key", line_key(F.col("text")))
    crops = crops.withColumn("text_key", line_key(F.col("text"))).filter("text_key <> ''")
    new = first_rows(
        crops.join(base.select(*key).distinct(), key, "left_anti"), key, ["ord", "text"],
        [c for c in base.columns if c not in key],
    )
    return base.unionByName(new.select(*base.columns)).drop("text_key")


def ocr_variants(blur: Column, glare: Column, resolution: Column, has_quad: Column) -> Column:
    """Names of the preprocessing variants a quality record calls for."""
    return F.array_compact(
        F.array(
            F.lit("original"),
            F.when(resolution == "low", "upscaled_2x"),
            F.when(glare == "high", "contrast_enhanced"),
            F.when((blur == "high") & has_quad, "deskewed"),
        )
    )


def needs_recrop(
    blur: Column, resolution: Column, perspective: Column, mrp: Column, quantity: Column, maker: Column
) -> Column:
    """Whether a second, targeted OCR pass is worth it."""
    nothing_found = mrp.isNull() & quantity.isNull() & maker.isNull()
    return (
        (F.coalesce(blur, F.lit("low")) != "low")
        | F.coalesce(resolution == "low", F.lit(False))
        | F.coalesce(perspective == "severe", F.lit(False))
        | nothing_found
    )


def merge_panels(lines: DataFrame) -> DataFrame:
    """Front lines before back lines: the order key of a scan."""
    return lines.withColumn("line_order", F.struct(panel_rank(F.col("panel")).alias("panel_rank"), "line_no"))


def field_context(field: Column) -> Column:
    pairs = [F.lit(v) for item in fixed.FIELD_CONTEXT.items() for v in item]
    return F.coalesce(F.create_map(*pairs)[field], F.lit("general"))


def attach_normalization(values: DataFrame, tier: Column) -> DataFrame:
    """Readings of each extracted value's raw text in the context of its field."""
    context = field_context(F.col("field_name"))
    return values.withColumn("normalized", confusion_variants(F.col("raw_text"), context, tier))


def expand_lines(
    lines: DataFrame, penalty_as_confidence: bool = False, drop_bbox: bool = False
) -> DataFrame:
    """Each line and its changed readings.

    By default a reading keeps its box and loses confidence by the penalty. The two switches give
    the literal behaviour: the penalty itself as confidence, and boxes dropped on every line.
    """
    readings = confusion_variants(F.col("text"), F.lit("general"), F.lit(4))
    changed = F.filter(readings, lambda r: r["text"] != F.col("text"))
    original = F.struct(F.col("text"), F.lit(0.0).alias("penalty"), F.lit(None).cast("string").alias("hint"))
    reduced = F.col("confidence") * (1 - F.col("r.penalty"))
    confidence = F.col("r.penalty") if penalty_as_confidence else reduced
    is_reading = F.col("r.hint").isNotNull() | (F.col("at") > 0)
    expanded = lines.select("*", F.posexplode(F.concat(F.array(original), changed)).alias("at", "r"))
    rest = [c for c in lines.columns if c not in ("text", "confidence", "bbox")]
    box = F.lit(None).cast("struct<x:double,y:double,w:double,h:double>") if drop_bbox else F.col("bbox")
    return expanded.select(
        *rest, F.col("r.text").alias("text"),
        F.when(is_reading, confidence).otherwise(F.col("confidence")).alias("confidence"),
        box.alias("bbox"), is_reading.alias("is_normalized"), F.col("r.hint").alias("hint"),
    )

"""Boxes, image quality classes and physical scale: Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelspark import fixed
from labelspark.functions.text import rounded


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two (x, y, w, h) structs; 0 where the union is empty."""

    def overlap(start: str, size: str) -> Column:
        end = F.least(a[start] + a[size], b[start] + b[size])
        return F.greatest(F.lit(0.0), end - F.greatest(a[start], b[start]))

    shared = overlap("x", "w") * overlap("y", "h")
    union = a["w"] * a["h"] + b["w"] * b["h"] - shared
    return F.when(union == 0, 0.0).otherwise(F.try_divide(shared, union))


def clamp_box(box: Column, width: Column, height: Column) -> Column:
    """Box cut to the image, at least one pixel wide and high."""
    zero, one = F.lit(0.0), F.lit(1.0)
    x = F.greatest(zero, F.least(box["x"], width - 1))
    y = F.greatest(zero, F.least(box["y"], height - 1))
    return F.struct(
        x.alias("x"), y.alias("y"),
        F.greatest(one, F.least(box["w"], width - x)).alias("w"),
        F.greatest(one, F.least(box["h"], height - y)).alias("h"),
    )


# ------------------------------------------------------------------------ image quality


def blur_class(laplacian_variance: Column) -> Column:
    return (
        F.when(laplacian_variance < fixed.BLUR_HIGH, "high")
        .when(laplacian_variance < fixed.BLUR_MEDIUM, "medium")
        .otherwise("low")
    )


def brightness_class(mean: Column) -> Column:
    return F.when(mean < fixed.MEAN_DARK, "dark").when(mean > fixed.MEAN_BRIGHT, "bright").otherwise("normal")


def glare_class(mean: Column, std: Column) -> Column:
    return F.when((mean > fixed.GLARE_MEAN) & (std > fixed.GLARE_STD), "high").otherwise("none")


def resolution_class(width: Column, height: Column) -> Column:
    return F.when(F.least(width, height) < fixed.MIN_SHORT_EDGE, "low").otherwise("adequate")


def recommended_action(blur: Column, resolution: Column, perspective: Column, brightness: Column) -> Column:
    bad = (blur == "high") | (resolution == "low") | (perspective == "severe")
    borderline = (blur == "medium") | (perspective == "slight_tilt") | brightness.isin("dark", "bright")
    return F.when(bad, "recapture").when(borderline, "proceed_with_caution").otherwise("proceed")


def _distance(a: Column, b: Column) -> Column:
    return F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]))


def perspective_class(corners: Column, area: Column) -> Column:
    """From the four corners (tl, tr, br, bl) of the largest outline and its area."""
    tl, tr, br, bl = (F.get(corners, F.lit(i)) for i in range(4))
    width = F.greatest(_distance(br, bl), _distance(tr, tl))
    height = F.greatest(_distance(tr, br), _distance(tl, bl))
    aspect = F.when(height > 0, F.try_divide(width, height)).otherwise(0.0)
    solidity = F.when(width * height > 0, F.try_divide(area, width * height)).otherwise(0.0)
    longest = 1.0 / fixed.ASPECT_LIMIT
    return (
        F.when(corners.isNull() | (F.size(corners) != 4), "none")
        .when((aspect > fixed.ASPECT_LIMIT) & (aspect < longest),
              F.when(solidity < fixed.SOLIDITY_SEVERE, "severe").otherwise("slight_tilt"))
        .when(aspect > longest, "severe")
        .otherwise("none")
    )


# ----------------------------------------------------------------------- physical scale


def barcode_scale(fmt: Column, width: Column, height: Column, has_image: Column | None = None) -> Column:
    """(status, pixels_per_mm, reason) of a decoded symbol of nominal printed size."""
    plain = F.upper(F.regexp_replace(F.coalesce(fmt, F.lit("")), "[_ ]", ""))
    long_side, short_side = F.greatest(width, height), F.least(width, height)
    image = F.lit(True) if has_image is None else has_image
    problem = (
        F.when(~image, "image is unavailable for barcode scale estimation")
        .when(~plain.isin(fixed.LINEAR_FORMATS),
              F.concat(F.lit("barcode format '"), F.coalesce(fmt, F.lit("None")),
                       F.lit("' has no configured physical module geometry")))
        .when(width.isNull() | height.isNull(), "decoded barcode has no bounding box")
        .when((width <= 0) | (height <= 0), "decoded barcode bounding box has non-positive dimensions")
        .when((long_side < fixed.MIN_SYMBOL_PX)
              | (F.try_divide(long_side, short_side) < fixed.MIN_SYMBOL_ASPECT),
              "decoded barcode bounding box is not a usable linear symbol")
    )
    return F.struct(
        F.when(problem.isNull(), "ESTABLISHED").otherwise("NOT_VERIFIED").alias("status"),
        F.when(problem.isNull(), rounded(long_side / fixed.SYMBOL_WIDTH_MM, 6)).alias("pixels_per_mm"),
        F.coalesce(
            problem, F.lit("decoded linear barcode matched configured GS1 nominal module geometry")
        ).alias("reason"),
    )


def font_height_mm(font_px: Column, scale: Column) -> Column:
    """(status, font_height_mm, reason): pixels become millimetres only on an established scale."""
    px, per_mm = font_px.cast("double"), scale["pixels_per_mm"]
    problem = (
        F.when(scale.isNull() | (scale["status"] != "ESTABLISHED"), "physical scale could not be established")
        .when(px.isNull() | per_mm.isNull(), "font pixel height or scale factor is unavailable")
        .when((px <= 0) | (per_mm <= 0), "font pixel height or scale factor is invalid")
    )
    return F.struct(
        F.when(problem.isNull(), "ESTABLISHED").otherwise("NOT_VERIFIED").alias("status"),
        F.when(problem.isNull(), rounded(F.try_divide(px, per_mm), 4)).alias("font_height_mm"),
        problem.alias("reason"),
    )

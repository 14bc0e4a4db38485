"""From extracted fields, ensemble outcome and catalog answer to one declaration per field.

Everything here is per scan on one row: inputs are aggregates keyed by scan_id, so their joins
reuse one partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelspark import fixed
from labelspark.functions.display import format_value
from labelspark.functions.fields import compare_dates
from labelspark.functions.fusion import fuse_field, typed_value
from labelspark.operators.catalog import image_of_panel, no_scale, panel_images
from labelspark.session import staged

FUSED = ["mrp", "net_quantity", "manufacturer"]


def _ocr_value(field: str) -> Column:
    value = F.col(field)["value"]
    if field == "mrp":
        typed = typed_value(amount=value["amount"], currency=value["currency"], tier=value["tier"])
    elif field == "net_quantity":
        typed = typed_value(value=value["value"], unit=value["unit"])
    elif field == "manufacturer":
        typed = typed_value(name=value["name"])
    elif field == "cautions":
        typed = typed_value(present=value["present"], text=value["text"])
    else:
        typed = typed_value(day=value["day"], month=value["month"], year=value["year"])
    return F.when(value.isNotNull(), typed)


def _provider_value(field: str) -> Column:
    product = F.col("product")
    if field == "mrp":
        return F.when(
            product["mrp_amount"].isNotNull(),
            typed_value(amount=product["mrp_amount"], currency=product["mrp_currency"]),
        )
    if field == "net_quantity":
        return F.when(
            product["quantity_value"].isNotNull(),
            typed_value(value=product["quantity_value"], unit=product["quantity_unit"]),
        )
    return F.when(product["manufacturer"].isNotNull(), typed_value(name=product["manufacturer"]))


def _declared(
    field: str, value: Column, verdict: Column, reason: Column, confidence: Column, panel: Column,
    raw_text: Column,
) -> Column:
    return F.struct(
        F.lit(field).alias("field_name"), value.alias("value"), verdict.alias("verdict"),
        reason.alias("reason"), confidence.cast("double").alias("confidence"),
        panel.alias("panel"), raw_text.alias("raw_text"),
        F.coalesce(F.when(panel == "back", F.col("scale_back")).otherwise(F.col("scale_front")), no_scale()).alias("scale"),
    )


def _fused(field: str) -> Column:
    """Price, quantity and maker: OCR and catalog, unless the OCR candidates contradict each other."""
    fused = F.col(f"fused_{field}")
    conflict = F.coalesce(F.col(f"{field}_conflict"), F.lit(False)) | (fused["status"] == "conflict")
    missing = ~conflict & (fused["status"] == "missing")
    raw = F.coalesce(F.col(field)["value"]["raw_text"], F.lit(""))
    clash = lambda i: format_value(F.lit(field), fused["conflict_values"][i])
    detail = F.coalesce(F.concat(F.lit(": OCR="), clash(0), F.lit(" vs provider="), clash(1)), F.lit(""))
    # A value without OCR text and without catalog evidence has nothing to stand on.
    groundless = ~conflict & ~missing & (raw == "") & _provider_value(field).isNull()
    return _declared(
        field,
        F.when(~conflict & ~missing & ~groundless, fused["value"]),
        F.when(conflict, "CONFLICT").when(missing | groundless, "NOT_VERIFIED").otherwise("SATISFIED"),
        F.when(conflict, F.concat(F.lit(f"conflicting evidence for '{field}'"), F.when(fused["status"] == "conflict", detail).otherwise("")))
        .when(missing, f"{field} not found in any evidence source")
        .when(groundless, f"{field}: extraction produced value without evidence (guardrail)"),
        F.when(conflict, 0.0).otherwise(fused["confidence"]),
        F.coalesce(F.col(field)["panel"], F.lit("front")), raw,
    )


def _dated(field: str) -> Column:
    value = F.col(field)["value"]
    found, clash = value.isNotNull(), F.col("date_comparison") == "conflict"
    sure = value["confidence"] >= fixed.MIN_CONFIDENCE
    low = F.concat(
        F.lit("insufficient confidence ("), F.format_string("%.2f", value["confidence"]),
        F.lit(f" < {fixed.MIN_CONFIDENCE})"),
    )
    return _declared(
        field, _ocr_value(field),
        F.when(clash, "CONFLICT").when(found & sure, "SATISFIED").otherwise("NOT_VERIFIED"),
        F.when(clash, "expiry date is chronologically before manufacture date")
        .when(~found, f"{field} not found in any evidence source")
        .when(~sure, low),
        F.coalesce(value["confidence"], F.lit(0.0)),
        F.coalesce(F.col(field)["panel"], F.lit("front")), F.coalesce(value["raw_text"], F.lit("")),
    )


def _caution() -> Column:
    value = F.col("cautions")["value"]
    found = value.isNotNull()
    return _declared(
        "cautions", _ocr_value("cautions"),
        F.when(found, "SATISFIED").otherwise("NOT_VERIFIED"),
        F.when(~found, "no caution/warning found on label"),
        F.coalesce(value["confidence"], F.lit(0.0)),
        F.coalesce(F.col("cautions")["panel"], F.lit("front")), F.coalesce(value["raw_text"], F.lit("")),
    )


def _nutrition() -> Column:
    nutrients = F.col("nutrients")
    some = F.coalesce(F.size(nutrients) > 0, F.lit(False))
    readable = F.exists(nutrients, lambda n: n["value"].isNotNull())
    total = F.aggregate(nutrients, F.lit(0.0), lambda acc, n: acc + n["confidence"])
    return _declared(
        "nutrition_facts", F.when(some, typed_value(nutrients=nutrients)),
        F.when(some & readable, "SATISFIED").otherwise("NOT_VERIFIED"),
        F.when(~some, "no nutrition panel detected").when(~readable, "no nutrition data found"),
        F.when(some, total / F.size(nutrients)).otherwise(0.0),
        F.coalesce("nutrition_panel", F.lit("front")), F.lit(""),
    )


def ensemble_conflicts(statuses: DataFrame) -> DataFrame:
    """Per scan whether the OCR candidates of each fused field are in conflict."""
    in_conflict = F.col("status") == "conflict"
    return statuses.groupBy("scan_id").agg(
        *[F.bool_or(in_conflict & (F.col("field_name") == f)).alias(f"{f}_conflict") for f in FUSED]
    )


def _absent_caution() -> Column:
    """The answer for a scan without lines: no caution word is itself an answer."""
    value = F.struct(
        F.lit(False).alias("present"), F.lit("").alias("text"), F.lit(fixed.ABSENT_CAUTION_CONFIDENCE).alias("confidence"),
        F.lit("").alias("raw_text"),
    )
    return F.struct(value.alias("value"), F.lit("front").alias("panel"))


def build_declarations(
    scans: DataFrame, extracted: DataFrame, nutrition: DataFrame, conflicts: DataFrame, resolved: DataFrame,
    scales: DataFrame,
) -> DataFrame:
    """One row per row of `scans` with its seven declarations in `declared`; a scan without label lines
    gets what its catalog says, an absent caution, and otherwise unverified fields. Each declaration
    carries the physical scale of its panel."""
    joined = (
        scans.select("scan_id").join(extracted, "scan_id", "left")
        .withColumn("cautions", F.coalesce("cautions", _absent_caution()))
        .join(nutrition, "scan_id", "left")
        .join(conflicts, "scan_id", "left")
        .join(resolved, "scan_id", "left")
        .join(scales, "scan_id", "left")
        .withColumn(
            "date_comparison",
            compare_dates(F.col("manufacture_date")["value"], F.col("expiry_date")["value"]),
        )
    )
    fused = joined.withColumns(
        {
            f"fused_{f}": fuse_field(
                f, _ocr_value(f), F.coalesce(F.col(f)["value"]["confidence"], F.lit(0.0)), _provider_value(f)
            )
            for f in FUSED
        }
    )
    return fused.select(
        "scan_id", "barcode", "product", "date_comparison", "nutrients",
        F.struct(*[F.col(f"fused_{f}")["conflict_values"].alias(f) for f in FUSED]).alias("conflict_values"),
        *[F.col(f"{f}_conflict") for f in FUSED],
        *[F.coalesce(F.col(f)["value"]["confidence"], F.lit(0.0)).alias(f"{f}_ocr_confidence") for f in FUSED],
        F.array(
            *[_fused(f) for f in FUSED], _dated("manufacture_date"), _dated("expiry_date"), _caution(), _nutrition()
        ).alias("declared"),
    )


def declaration_rows(declared: DataFrame) -> DataFrame:
    return declared.select("scan_id", F.explode("declared").alias("d")).select("scan_id", "d.*")


def conflict_rows(declared: DataFrame) -> DataFrame:
    """Both values of every field on which label and catalog disagree: one row per source."""
    fields = F.array(*[
        F.struct(F.lit(f).alias("field_name"), F.col("conflict_values")[f].alias("values")) for f in FUSED
    ])
    clashes = declared.select("scan_id", F.explode(F.filter(fields, lambda c: c["values"].isNotNull())).alias("c"))
    return clashes.select("scan_id", "c.field_name", F.posexplode("c.values").alias("pos", "value")).select(
        "scan_id", "field_name", F.when(F.col("pos") == 0, "OCR").otherwise("PRODUCT_DATABASE").alias("source_type"), "value"
    )


def evidence_rows(declared: DataFrame, candidates: DataFrame, images: DataFrame) -> DataFrame:
    """One row per source of each declaration, with the image of its panel.

    In an ensemble conflict the candidates themselves are the sources, one row each. What follows from
    the declarations is written once, with a mark for every such conflict, so that they are put together
    once for both kinds of rows. Images are looked up for the scans, before there is a row per source.
    """

    def row(source: str, text: Column, confidence: Column, variant: str) -> Column:
        return F.struct(
            F.lit(source).alias("source_type"), text.alias("raw_text"),
            confidence.cast("double").alias("confidence"), F.lit(variant).alias("preprocessing_variant"),
            F.when(F.lit(variant != "date_cross_check"), image_of_panel(F.col("panel"))).alias("image_id"),
        )

    conflict = F.coalesce(
        *[F.when(F.col("field_name") == f, F.coalesce(f"{f}_conflict", F.lit(False))) for f in FUSED], F.lit(False)
    )
    ocr_confidence = F.coalesce(
        *[F.when(F.col("field_name") == f, F.col(f"{f}_ocr_confidence")) for f in FUSED], F.col("confidence")
    )
    provider = F.coalesce(
        *[F.when(F.col("field_name") == f, _provider_value(f).isNotNull()) for f in FUSED], F.lit(False)
    )
    dates = F.col("field_name").isin("manufacture_date", "expiry_date")
    own = F.array_compact(
        F.array(
            F.when(
                (F.col("raw_text") != "") & ~conflict,
                row("OCR", F.col("raw_text"), ocr_confidence, "ocr_single_pass"),
            ),
            F.when(
                provider & ~conflict,
                row("PRODUCT_DATABASE", F.lit("Provider lookup: provider_lookup"), F.lit(1.0), "provider_lookup"),
            ),
            F.when(
                dates & (F.col("date_comparison") == "conflict"),
                row("OCR", F.lit("Chronological conflict: expiry date is before manufacture date"),
                    F.lit(1.0), "date_cross_check"),
            ),
        )
    )
    per_nutrient = F.transform(
        F.coalesce("value.nutrients", F.slice(F.col("value.nutrients"), 1, 0)),
        lambda n: row("OCR", n["raw_text"], n["confidence"], "ocr_single_pass"),
    )
    flat = declared.join(panel_images(images), "scan_id", "left").select(
        "scan_id", "product", "date_comparison", "front_image", "back_image", "first_image",
        *[f"{f}_conflict" for f in FUSED], *[f"{f}_ocr_confidence" for f in FUSED], F.explode("declared").alias("d"),
    ).select("*", "d.*")
    # No row of a source has null as its type: the mark of a conflict whose candidates follow.
    mark = F.array(row("", F.lit(""), F.lit(0.0), "ensemble").withField("source_type", F.lit(None).cast("string")))
    found = F.concat(own, F.coalesce(per_nutrient, F.slice(own, 1, 0)), F.when(conflict, mark).otherwise(F.slice(mark, 1, 0)))
    stored = staged(
        flat.select("scan_id", "field_name", F.explode(found).alias("e")).select("scan_id", "field_name", "e.*"), "evidence",
    )
    plain = stored.filter("source_type is not null")
    contradicting = candidates.join(
        stored.filter("source_type is null").select("scan_id", "field_name", "image_id"), ["scan_id", "field_name"]
    ).select(
        "scan_id", "field_name", F.lit("OCR").alias("source_type"), F.col("text").alias("raw_text"),
        "confidence", "preprocessing_variant", "image_id",
    )
    return plain.unionByName(contradicting)


def nutrition_rows(nutrition: DataFrame) -> DataFrame:
    """One row per nutrient of a scan."""
    return nutrition.select("scan_id", F.posexplode("nutrients").alias("pos", "n")).select("scan_id", "pos", "n.*")

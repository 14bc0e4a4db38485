"""Report content as tables keyed by scan; a renderer reads the rows of one scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelspark.functions.display import number_text, source_label

COUNTED = ["SATISFIED", "VIOLATION", "NOT_VERIFIED", "CONFLICT"]


def report_summary(scans: DataFrame, products: DataFrame, declarations: DataFrame) -> DataFrame:
    """Header per scan: product strings, overall status, declarations per verdict."""
    counts = declarations.groupBy("scan_id").agg(
        *[F.count_if(F.col("verdict") == v).alias(v.lower()) for v in COUNTED]
    )
    priced, filled = F.col("mrp_amount") != 0, F.col("quantity_value") != 0
    product = products.select(
        "product_id", F.col("identity").alias("name"), "brand", "category", "manufacturer",
        F.col("barcode_code").alias("barcode"),
        F.when(priced, F.concat_ws(" ", "mrp_currency", number_text(F.col("mrp_amount")))).alias("mrp"),
        F.when(filled, F.concat_ws(" ", number_text(F.col("quantity_value")), "quantity_unit")).alias("quantity"),
    )
    rows = scans.select("scan_id", "product_id", "overall_status").join(counts, "scan_id", "left").join(product, "product_id", "left")
    return rows.select(
        "scan_id", "overall_status", "name", "brand", F.col("category"), "manufacturer", "barcode", "mrp", "quantity",
        *[F.coalesce(v.lower(), F.lit(0)).alias(v.lower()) for v in COUNTED],
    )


def report_fields(reviewed: DataFrame) -> DataFrame:
    """One row per declaration; after a correction also what it was before."""
    correction = F.col("officer_correction")
    return reviewed.select(
        "scan_id", "declaration_id", "field_name", "verdict", F.coalesce("reason", F.lit("")).alias("reason"),
        "confidence", correction["corrected_value"].alias("corrected_value"),
        correction["original_verdict"].alias("ai_verdict"), correction["original_reason"].alias("ai_reason"),
    )


def report_evidence(declarations: DataFrame, evidence: DataFrame) -> DataFrame:
    return declarations.select("scan_id", "declaration_id", "field_name").join(evidence, "declaration_id").select(
        "scan_id", "field_name", "source_type", source_label(F.col("source_type")).alias("source_label"),
        "raw_text", "confidence",
    )


def report_inspections(inspections: DataFrame, officers: DataFrame, locations: DataFrame) -> DataFrame:
    named = officers.select("officer_id", F.col("name").alias("officer_name"))
    return (
        inspections.select("scan_id", "inspection_id", "officer_id", "actions_count", "notes")
        .join(named, "officer_id", "left")
        .join(locations.select("inspection_id", "latitude", "longitude", "source"), "inspection_id", "left")
        .select(
            "scan_id", "inspection_id", F.coalesce("officer_name", F.lit("Unknown")).alias("officer_name"),
            "actions_count", "notes", "latitude", "longitude", "source",
        )
    )

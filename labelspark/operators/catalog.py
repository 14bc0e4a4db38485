"""Symbols of a scan and what the catalogs know about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelspark import fixed
from labelspark.functions.fields import catalog_quantity, symbol_text
from labelspark.functions.geometry import barcode_scale
from labelspark.functions.text import matched, strip
from labelspark.operators.extraction import panel_rank

PRODUCT_FIELDS = [
    "name", "brand", "category", "manufacturer", "quantity_value", "quantity_unit", "mrp_amount", "mrp_currency",
]


def _truthy(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def _some_field(df: DataFrame, fields: list[str]) -> DataFrame:
    """Without any field a record is a miss."""
    return df.filter(F.coalesce(*[F.col(f).cast("string") for f in fields]).isNotNull())


def grocery_records(documents: DataFrame) -> DataFrame:
    """First catalog: `{status, product{…}}`; only status 1 is a hit."""
    product, parsed = F.col("product"), catalog_quantity(F.col("product.quantity"))
    found = documents.filter("status = 1").select(
        F.col("code").alias("barcode"), _truthy(product["product_name"]).alias("name"),
        _truthy(product["brands"]).alias("brand"), _truthy(product["categories"]).alias("category"),
        _truthy(product["manufacturers"]).alias("manufacturer"),
        parsed["value"].alias("quantity_value"), parsed["unit"].alias("quantity_unit"),
    )
    return _some_field(found, ["name", "brand", "category", "manufacturer", "quantity_value"])


def item_records(documents: DataFrame) -> DataFrame:
    """Second catalog: the first of `items`; its description stands in for the manufacturer."""
    item = F.get("items", F.lit(0))
    found = documents.select(
        F.col("code").alias("barcode"), _truthy(item["title"]).alias("name"),
        _truthy(item["brand"]).alias("brand"), _truthy(item["category"]).alias("category"),
        _truthy(item["description"]).alias("manufacturer"),
    )
    return _some_field(found, ["name", "brand", "category", "manufacturer"])


def company_records(pages: DataFrame, patterns: list[str] | None = None) -> DataFrame:
    """Third catalog: the company name found in an HTML answer; a blank one is a miss."""
    first, *rest = patterns or [fixed.COMPANY_CELL, fixed.COMPANY_JSON]
    name = F.coalesce(matched(F.col("html"), first, 1), *[matched(F.col("html"), p, 1) for p in rest])
    return pages.withColumn("manufacturer", F.nullif(strip(name), F.lit(""))).filter("manufacturer is not null")


def known_products(catalog: DataFrame) -> DataFrame:
    """One answer per barcode: the record of the first catalog, in precedence, that has one."""
    record = F.struct("source_rank", *PRODUCT_FIELDS)
    return (
        catalog.groupBy("barcode").agg(F.min(record).alias("record"))
        .select("barcode", "record.source_rank", F.struct(*[F.col("record")[f].alias(f) for f in PRODUCT_FIELDS]).alias("product"))
    )


def lookup(keys: DataFrame, cache: DataFrame, catalog: DataFrame) -> DataFrame:
    """Answer per barcode: a cached one (also "asked, not found"), else the catalogs in order.

    cache: (barcode, product) with null product for a known miss. A key that is no number has no
    answer and is marked.
    """
    cached = cache.select("barcode", F.col("product").alias("cached"), F.lit(True).alias("in_cache"))
    answer = F.when(F.col("in_cache"), F.col("cached")).otherwise(F.col("product"))
    return (
        keys.select("barcode").distinct()
        .join(cached, "barcode", "left")
        .join(known_products(catalog), "barcode", "left")
        .select(
            "barcode", F.col("barcode").rlike("^[0-9]+$").alias("valid_key"),
            F.coalesce("in_cache", F.lit(False)).alias("in_cache"),
            F.when(~F.coalesce("in_cache", F.lit(False)), F.col("source_rank")).alias("source_rank"),
            F.when(F.col("barcode").rlike("^[0-9]+$"), answer).alias("product"),
        )
    )


def dedupe_symbols(symbols: DataFrame) -> DataFrame:
    """One row per (scan, decoded value): the first of its kind, "both" when on two panels."""
    rank = panel_rank(F.col("panel"))
    first = F.struct(rank.alias("panel_rank"), F.col("ord"), F.col("panel"), F.col("format"))
    return (
        symbols.groupBy("scan_id", "data")
        .agg(F.min(first).alias("first"), (F.min("panel") != F.max("panel")).alias("on_both"))
        .select(
            "scan_id", "data", "first.format",
            F.when(F.col("on_both"), "both").otherwise(F.col("first.panel")).alias("source_image"),
            F.struct("first.panel_rank", "first.ord").alias("symbol_order"),
        )
    )


def symbol_mismatch(deduped: DataFrame) -> DataFrame:
    """Scans with more than one different barcode (QR codes apart)."""
    return (
        deduped.filter("format <> 'QRCODE'").groupBy("scan_id").agg(F.count("*").alias("barcodes"))
        .filter("barcodes > 1")
    )


def resolve_images(images: DataFrame) -> DataFrame:
    """Usable images: uploaded ones; an unlabelled image counts as the front."""
    return images.filter(F.col("url").startswith("/uploads/")).select(
        "image_id", "scan_id", "url", F.coalesce("label", F.lit("front")).alias("label")
    )


def panel_images(images: DataFrame) -> DataFrame:
    """Per scan the image id of each panel and of the first image, the default for both."""
    front, back = F.col("label") == "front", F.col("label") == "back"
    return images.groupBy("scan_id").agg(
        F.min(F.when(front, F.col("image_id"))).alias("front_image"),
        F.min(F.when(back, F.col("image_id"))).alias("back_image"),
        F.min("image_id").alias("first_image"),
    )


def image_of_panel(panel: Column) -> Column:
    own = F.when(panel == "front", F.col("front_image")).when(panel == "back", F.col("back_image"))
    return F.coalesce(own, F.col("first_image"))


def symbol_evidence(deduped: DataFrame, images: DataFrame) -> DataFrame:
    """Evidence row of every deduplicated symbol; it belongs to no declaration."""
    return deduped.join(panel_images(images), "scan_id", "left").select(
        "scan_id",
        F.when(F.col("format") == "QRCODE", "QR").otherwise("BARCODE").alias("source_type"),
        symbol_text(F.col("format"), F.col("data")).alias("raw_text"),
        F.lit(1.0).alias("confidence"), image_of_panel(F.col("source_image")).alias("image_id"),
    )


def first_resolved(deduped: DataFrame, answers: DataFrame) -> DataFrame:
    """Per scan: product of the first barcode that resolves; the barcode kept is the last one tried."""
    tried = deduped.filter("format <> 'QRCODE'").select("scan_id", "symbol_order", F.col("data").alias("barcode"))
    answered = tried.join(answers.select("barcode", "product"), "barcode", "left")
    hit = F.when(F.col("product").isNotNull(), F.struct("symbol_order", "barcode", "product"))
    return (
        answered.groupBy("scan_id")
        .agg(F.min(hit).alias("hit"), F.max(F.struct("symbol_order", "barcode")).alias("last"))
        .select("scan_id", F.coalesce("hit.barcode", "last.barcode").alias("barcode"), F.col("hit.product").alias("product"))
    )


def no_scale() -> Column:
    """Scale of a panel on which no usable symbol was decoded."""
    return F.struct(
        F.lit("NOT_VERIFIED").alias("status"), F.lit(None).cast("double").alias("pixels_per_mm"),
        F.lit("no usable EAN-13 or UPC-A barcode decoded for this image").alias("reason"),
    )


def scale_per_panel(symbols: DataFrame) -> DataFrame:
    """Physical scale of each panel: that of its last usable symbol, before deduplication."""
    scale = barcode_scale(F.col("format"), F.col("width"), F.col("height"))
    scaled = symbols.select("scan_id", "panel", "ord", scale.alias("scale"))
    usable = F.when(F.col("scale.status") == "ESTABLISHED", F.struct("ord", "scale"))
    return scaled.groupBy("scan_id", "panel").agg(F.max(usable).alias("last")).select(
        "scan_id", "panel", F.coalesce("last.scale", no_scale()).alias("scale")
    )


def scale_per_scan(symbols: DataFrame) -> DataFrame:
    """The scales of a scan's panels on one row: scale_front, scale_back."""
    here = lambda panel: F.max(F.when(F.col("panel") == panel, F.col("scale")))
    return scale_per_panel(symbols).groupBy("scan_id").agg(here("front").alias("scale_front"), here("back").alias("scale_back"))


def new_products(resolved: DataFrame, products: DataFrame, formats: DataFrame) -> DataFrame:
    """Products to insert: barcodes not in the table yet, one row each.

    The stored format is that of the scan's first symbol, even when that one is a QR code.
    """
    first_format = formats.groupBy("scan_id").agg(
        F.min(F.struct("symbol_order", "format")).alias("first")
    ).select("scan_id", F.col("first.format").alias("barcode_format"))
    fresh = resolved.filter("barcode is not null").join(
        products.select(F.col("barcode_code").alias("barcode")).distinct(), "barcode", "left_anti"
    ).join(first_format, "scan_id", "left")
    return (
        fresh.groupBy("barcode")
        .agg(F.min(F.struct("scan_id", "product", "barcode_format")).alias("first"))
        .select(
            F.col("barcode").alias("barcode_code"), F.col("first.barcode_format").alias("barcode_format"),
            F.col("first.product.name").alias("identity"),
            *[F.col("first.product")[c].alias(c) for c in PRODUCT_FIELDS if c != "name"],
        )
    )


def newest_cache(cache: DataFrame, answers: DataFrame) -> DataFrame:
    """Cache after an upsert by barcode, misses included: the newest answer of each key."""
    both = cache.unionByName(answers)
    rest = [c for c in both.columns if c not in ("barcode", "fetched_at")]
    return (
        both.groupBy("barcode").agg(F.max_by(F.struct("fetched_at", *rest), "fetched_at").alias("row"))
        .select("barcode", "row.*")
    )

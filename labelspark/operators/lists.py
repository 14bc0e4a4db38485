"""Filtered lists, pages, dashboard and detail queries over the stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelspark import fixed
from labelspark.functions.fields import symbol_code


# ------------------------------------------------------------------------ filters, pages


def known_status(df: DataFrame, status: str | None, allowed: list[str], column: str) -> DataFrame:
    """Equality on a status; a name that does not exist is ignored, not an error."""
    return df.filter(F.col(column) == status) if status in allowed else df


def in_days(df: DataFrame, column: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Inclusive day range as a half-open range on the bare column, so it reaches the scan."""
    if first:
        df = df.filter(F.col(column) >= F.to_timestamp_ntz(F.lit(first + " 00:00:00")))
    if last:
        after = F.to_timestamp_ntz(F.lit(last + " 00:00:00")) + F.expr("INTERVAL 1 DAY")
        df = df.filter(F.col(column) < after)
    return df


def text_like(df: DataFrame, part: str | None, *columns: str) -> DataFrame:
    """Case-free substring in any of the columns; % and _ in the text stay wildcards."""
    if not part:
        return df
    condition: Column | None = None
    for column in columns:
        test = F.col(column).ilike(f"%{part}%")
        condition = test if condition is None else condition | test
    return df.filter(condition)


def page(
    df: DataFrame, newest: str, key: str, number: int = 1, size: int = 20, after: tuple | None = None
) -> DataFrame:
    """One page, newest first, the key breaking ties.

    Page numbers cost offset + size rows per task; for deep pages pass `after`, the (time, key) of
    the last row seen, and the page is cut by a filter instead.
    """
    if not 1 <= size <= 100 or number < 1:
        raise ValueError("page must be >= 1 and size within 1..100")
    if after is not None:
        time, last = F.lit(after[0]), F.lit(after[1])
        df = df.filter((F.col(newest) < time) | ((F.col(newest) == time) & (F.col(key) > last)))
        number = 1
    ordered = df.orderBy(F.col(newest).desc(), F.col(key).asc())
    return ordered.offset((number - 1) * size).limit(size) if number > 1 else ordered.limit(size)


def by_id(df: DataFrame, key: str, value) -> DataFrame:
    return df.filter(F.col(key) == value)


# --------------------------------------------------------------------------------- scans


def symbol_scans(evidence: DataFrame, images: DataFrame) -> DataFrame:
    """Barcode and QR evidence with its scan."""
    return evidence.filter(F.col("source_type").isin("BARCODE", "QR")).join(
        images.select("image_id", "scan_id"), "image_id"
    )


def filter_scans(
    scans: DataFrame, inspections: DataFrame | None = None, symbols: DataFrame | None = None,
    products: DataFrame | None = None, status: str | None = None, date_from: str | None = None,
    date_to: str | None = None, officer_id=None, barcode: str | None = None,
    product_name: str | None = None, brand: str | None = None, category: str | None = None,
) -> DataFrame:
    scans = known_status(scans, status, fixed.VERDICTS, "overall_status")
    scans = in_days(scans, "created_at", date_from, date_to)
    if officer_id is not None:
        mine = inspections.filter(F.col("officer_id") == officer_id).select("scan_id")
        scans = scans.join(mine, "scan_id", "left_semi")
    if barcode:
        scans = scans.join(text_like(symbols, barcode, "raw_text").select("scan_id"), "scan_id", "left_semi")
    if product_name or brand or category:
        wanted = text_like(text_like(text_like(products, product_name, "identity"), brand, "brand"), category, "category")
        scans = scans.join(wanted.select("product_id"), "product_id", "left_semi")
    return scans


def scan_items(
    scans: DataFrame, inspections: DataFrame, declarations: DataFrame, products: DataFrame, symbols: DataFrame
) -> DataFrame:
    """List item per scan: product, barcode (the product's, else the first symbol's), counts."""
    inspected = inspections.select("scan_id").distinct().withColumn("has_inspection", F.lit(True))
    declared = declarations.groupBy("scan_id").agg(F.count("*").alias("declarations_count"))
    first_symbol = symbols.groupBy("scan_id").agg(
        F.min_by("raw_text", F.struct("extracted_at", "evidence_no")).alias("symbol_text")
    )
    named = products.select("product_id", F.col("identity").alias("product_name"), "barcode_code")
    return (
        scans.join(inspected, "scan_id", "left")
        .join(declared, "scan_id", "left")
        .join(first_symbol, "scan_id", "left")
        .join(named, "product_id", "left")
        .select(
            "scan_id", "status", "overall_status", "product_name",
            F.coalesce(F.nullif("barcode_code", F.lit("")), symbol_code(F.col("symbol_text"))).alias("barcode"),
            F.coalesce("has_inspection", F.lit(False)).alias("has_inspection"),
            F.coalesce("declarations_count", F.lit(0)).alias("declarations_count"), "created_at",
        )
    )


def scan_detail(scans: DataFrame, images: DataFrame, declarations: DataFrame) -> DataFrame:
    """Scan rows with their images and declarations, flat: one row per (scan, part).

    A scan with very many parts stays many rows instead of one nested cell.
    """
    panels = images.select(
        "scan_id", F.lit("image").alias("part"), F.col("image_id").alias("part_id"), F.col("label").alias("name"),
        F.col("url").alias("detail"),
    )
    fields = declarations.select(
        "scan_id", F.lit("declaration").alias("part"), F.col("declaration_id").alias("part_id"),
        F.col("field_name").alias("name"), F.col("verdict").alias("detail"),
    )
    return scans.select("scan_id", "product_id", "status", "overall_status").join(
        panels.unionByName(fields), "scan_id", "left"
    )


def quality_with_blur(image_quality: Column) -> Column:
    """Only the entries of a quality map that are quality records (they have "blur")."""
    return F.map_filter(image_quality, lambda _, v: v["blur"].isNotNull())


def evidence_groups(declarations: DataFrame, linked: DataFrame, symbols: DataFrame) -> DataFrame:
    """Evidence of each declaration, plus one `barcode_qr` group per scan with unlinked evidence."""
    counts = linked.groupBy("declaration_id").agg(F.count("*").alias("evidence"), F.max("confidence").alias("best"))
    own = declarations.join(counts, "declaration_id", "left").select(
        "scan_id", "declaration_id", "field_name", F.coalesce("evidence", F.lit(0)).alias("evidence"), "best"
    )
    unlinked = symbols.groupBy("scan_id").agg(F.count("*").alias("evidence")).select(
        "scan_id", F.lit(None).cast("bigint").alias("declaration_id"), F.lit("barcode_qr").alias("field_name"),
        "evidence", F.lit(None).cast("double").alias("best"),
    )
    return own.unionByName(unlinked)


_EVIDENCE = ["source_type", "raw_text", "confidence", "image_id", "extracted_at"]


def evidence_items(declarations: DataFrame, linked: DataFrame, unlinked: DataFrame) -> DataFrame:
    """The evidence itself, one row per item: that of each declaration (a declaration without any has
    one row with nulls), and the items that belong to none, as `barcode_qr`, under the scan of their
    image. A declaration with very many items stays many rows. `unlinked` without a confidence column
    was decoded, not read, and has confidence 1."""
    own = declarations.select("scan_id", "declaration_id", "field_name").join(
        linked.select("declaration_id", *_EVIDENCE), "declaration_id", "left"
    )
    if "confidence" not in unlinked.columns:
        unlinked = unlinked.withColumn("confidence", F.lit(1.0))
    rest = unlinked.select(
        "scan_id", F.lit(None).cast(declarations.schema["declaration_id"].dataType).alias("declaration_id"),
        F.lit("barcode_qr").alias("field_name"), *_EVIDENCE,
    )
    return own.unionByName(rest)


def scan_parts(scans: DataFrame, images: DataFrame, declarations: DataFrame, linked: DataFrame) -> DataFrame:
    """A scan in full, one row per part: its images, its declarations with confidence and reason, and each
    declaration's evidence. `owner_id` is the declaration that an evidence row belongs to, `part_id` the
    image, the declaration, or the image of the evidence. A scan without parts has one row."""
    none = lambda kind: F.lit(None).cast(kind)
    panels = images.select(
        "scan_id", F.lit("image").alias("part"), F.col("image_id").alias("part_id"), none("bigint").alias("owner_id"),
        F.col("label").alias("name"), F.col("url").alias("detail"), none("string").alias("reason"), none("double").alias("confidence"),
    )
    fields = declarations.select(
        "scan_id", F.lit("declaration").alias("part"), F.col("declaration_id").alias("part_id"), none("bigint").alias("owner_id"),
        F.col("field_name").alias("name"), F.col("verdict").alias("detail"), "reason", "confidence",
    )
    items = linked.join(declarations.select("declaration_id", "scan_id"), "declaration_id").select(
        "scan_id", F.lit("evidence").alias("part"), F.col("image_id").alias("part_id"), F.col("declaration_id").alias("owner_id"),
        F.col("source_type").alias("name"), F.col("raw_text").alias("detail"), none("string").alias("reason"), "confidence",
    )
    return scans.select("scan_id", "product_id", "status", "overall_status", "created_at").join(
        panels.unionByName(fields).unionByName(items), "scan_id", "left"
    )


def product_evidence(products: DataFrame, scans: DataFrame, declarations: DataFrame, linked: DataFrame) -> DataFrame:
    """Products with brand, category and manufacturer, and every item of evidence of the declarations of
    their latest scan, one row each; rows of a declaration without evidence and of a product without a
    scan have nulls there."""
    latest = latest_scans(scans).select("product_id", F.col("latest_scan_id").alias("scan_id"))
    items = declarations.select("scan_id", "declaration_id", "field_name", "verdict").join(
        linked.select("declaration_id", *_EVIDENCE[:-1]), "declaration_id", "left"
    )
    return products.select("product_id", "identity", "brand", "category", "manufacturer").join(
        latest, "product_id", "left"
    ).join(items, "scan_id", "left")


def scan_compliance(scans: DataFrame, declarations: DataFrame) -> DataFrame:
    return scans.select("scan_id", "overall_status").join(
        declarations.select("scan_id", "field_name", "verdict", "reason", "confidence"), "scan_id", "left"
    )


def scan_trace(scans: DataFrame, declarations: DataFrame, evidence: DataFrame) -> DataFrame:
    """Scan metadata, declarations and their evidence, flat; ordered by field inside a scan."""
    return (
        scans.select("scan_id", "status", "overall_status")
        .join(declarations.select("scan_id", "declaration_id", "field_name", "verdict", "confidence"), "scan_id")
        .join(
            evidence.select("declaration_id", "source_type", "raw_text", F.col("confidence").alias("evidence_confidence"), "image_id"),
            "declaration_id", "left",
        )
    )


# --------------------------------------------------------------------- inspections, flags


def filter_inspections(
    inspections: DataFrame, scans: DataFrame | None = None, status: str | None = None, officer_id=None,
    scan_id=None, date_from: str | None = None, date_to: str | None = None,
) -> DataFrame:
    if officer_id is not None:
        inspections = by_id(inspections, "officer_id", officer_id)
    if scan_id is not None:
        inspections = by_id(inspections, "scan_id", scan_id)
    inspections = in_days(inspections, "created_at", date_from, date_to)
    if status in fixed.VERDICTS:
        having = scans.filter(F.col("overall_status") == status).select("scan_id")
        inspections = inspections.join(having, "scan_id", "left_semi")
    return inspections


def inspection_items(inspections: DataFrame, officers: DataFrame) -> DataFrame:
    names = officers.select("officer_id", F.col("name").alias("officer_name"))
    return inspections.join(names, "officer_id", "left").select(
        "inspection_id", "scan_id", "officer_id", "officer_name", "actions_count", "notes", "created_at"
    )


def filter_flags(
    flags: DataFrame, scans: DataFrame | None = None, products: DataFrame | None = None,
    status: str | None = None, scan_id=None, date_from: str | None = None, date_to: str | None = None,
    brand: str | None = None, manufacturer: str | None = None, barcode: str | None = None, category: str | None = None,
) -> DataFrame:
    flags = known_status(flags, status, fixed.FLAG_STATUSES, "status")
    flags = in_days(flags, "created_at", date_from, date_to)
    if scan_id is not None:
        flags = by_id(flags, "scan_id", scan_id)
    if brand or manufacturer or barcode or category:
        wanted = text_like(products, brand, "brand")
        wanted = text_like(text_like(text_like(wanted, manufacturer, "manufacturer"), barcode, "barcode_code"), category, "category")
        of_products = scans.join(wanted.select("product_id"), "product_id", "left_semi")
        flags = flags.join(of_products.select("scan_id"), "scan_id", "left_semi")
    return flags


def with_role(rows: DataFrame, officers: DataFrame, roles: list[str] | None = None) -> DataFrame:
    """Rows of officers that hold one of the roles (flag lists and reviews need one)."""
    allowed = officers.filter(F.col("role").isin(roles or ["ADMIN", "INSPECTOR"])).select("officer_id")
    return rows.join(allowed, "officer_id", "left_semi")


# ------------------------------------------------------------------------------ products


def latest_scans(scans: DataFrame) -> DataFrame:
    """Per product: latest scan, its status, and the number of scans."""
    latest = F.max(F.struct("created_at", "scan_id", "overall_status"))
    return scans.filter("product_id is not null").groupBy("product_id").agg(
        latest.alias("latest"), F.count("*").alias("total_scans")
    ).select(
        "product_id", F.col("latest.scan_id").alias("latest_scan_id"),
        F.col("latest.overall_status").alias("latest_scan_status"), "total_scans",
    )


def product_items(
    products: DataFrame, scans: DataFrame, search: str | None = None, brand: str | None = None,
    category: str | None = None, barcode: str | None = None, manufacturer: str | None = None,
    compliance_status: str | None = None,
) -> DataFrame:
    """Products that occur in scans, with latest status and number of scans."""
    products = text_like(products, search, "identity", "brand", "manufacturer")
    products = text_like(text_like(products, brand, "brand"), category, "category")
    products = text_like(text_like(products, barcode, "barcode_code"), manufacturer, "manufacturer")
    items = products.join(latest_scans(scans), "product_id")
    items = known_status(items, compliance_status, fixed.VERDICTS, "latest_scan_status")
    return items.select(
        "product_id", "identity", "brand", "category", "manufacturer", "barcode_code", "mrp_amount",
        "latest_scan_status", "total_scans",
    )


def product_detail(products: DataFrame, scans: DataFrame, declarations: DataFrame) -> DataFrame:
    """Canonical product with the declarations of its latest scan, flat.

    A group (quantity, price, barcode) is null when its value is 0 or missing.
    """
    latest = latest_scans(scans).select("product_id", F.col("latest_scan_id").alias("scan_id"))
    q, m, b = F.col("quantity_value") != 0, F.col("mrp_amount") != 0, F.col("barcode_code") != ""
    canonical = products.select(
        "product_id", "identity",
        F.when(q, F.col("quantity_value")).alias("quantity_value"), F.when(q, F.col("quantity_unit")).alias("quantity_unit"),
        F.when(m, F.col("mrp_amount")).alias("mrp_amount"), F.when(m, F.col("mrp_currency")).alias("mrp_currency"),
        F.when(b, F.col("barcode_code")).alias("barcode_code"), F.when(b, F.col("barcode_format")).alias("barcode_format"),
    )
    return canonical.join(latest, "product_id", "left").join(
        declarations.select("scan_id", "declaration_id", "field_name", "verdict"), "scan_id", "left"
    )


# ----------------------------------------------------------------------------- dashboard


def confirmed_violations(declarations: DataFrame, audit: DataFrame) -> DataFrame:
    """Scans where an officer confirmed a declaration in violation."""
    confirmed = audit.filter("action = 'inspection_confirm'").select(F.col("target_id").alias("declaration_id"))
    return declarations.filter("verdict = 'VIOLATION'").join(confirmed, "declaration_id", "left_semi").select("scan_id").distinct()


def dashboard(
    scans: DataFrame, inspections: DataFrame, declarations: DataFrame, audit: DataFrame, flags: DataFrame, now: Column
) -> DataFrame:
    """The nine counts in one pass over the scans; today starts at midnight, the week on Monday."""
    inspected = inspections.select("scan_id").distinct().withColumn("inspected", F.lit(True))
    confirmed = confirmed_violations(declarations, audit).withColumn("confirmed", F.lit(True))
    joined = scans.join(inspected, "scan_id", "left").join(confirmed, "scan_id", "left")
    status = lambda name: F.count_if(F.col("overall_status") == name)
    counts = joined.agg(
        F.count("*").alias("total_scans"),
        F.count_if(F.col("inspected").isNull()).alias("scans_pending_review"),
        status("VIOLATION").alias("violations_ai"),
        F.count_if(F.col("confirmed")).alias("violations_officer_confirmed"),
        status("NOT_VERIFIED").alias("not_verified"),
        status("CONFLICT").alias("conflict"),
        F.count_if(F.col("created_at") >= F.date_trunc("day", now)).alias("scans_today"),
        F.count_if(F.col("created_at") >= F.date_trunc("week", now)).alias("scans_this_week"),
    )
    pending = flags.agg(F.count_if(F.col("status") == "NEW").alias("pending_flags"))
    return counts.crossJoin(pending)  # one row each


def compliance_share(counts: DataFrame) -> DataFrame:
    """Compliant scans and rounded percentages of a dashboard row."""
    total = F.col("total_scans")
    compliant = F.greatest(F.lit(0), total - F.col("violations_ai") - F.col("not_verified") - F.col("conflict"))
    percent = lambda n: F.floor(F.try_divide(n * 100.0, total) + 0.5)
    return counts.select(
        compliant.alias("compliant"), percent(compliant).alias("compliant_percent"),
        percent(F.col("violations_ai")).alias("violation_percent"),
        percent(F.col("not_verified")).alias("not_verified_percent"), percent(F.col("conflict")).alias("conflict_percent"),
    )


# -------------------------------------------------------------------------------- timing


def stage_latency(log: DataFrame) -> DataFrame:
    """Per stage and event: how many, and the elapsed milliseconds."""
    return log.groupBy("stage", "event").agg(
        F.count("*").alias("n"), F.avg("elapsed_ms").alias("mean_ms"), F.max("elapsed_ms").alias("max_ms"),
        F.percentile_approx("elapsed_ms", 0.5, 10000).alias("median_ms"),
    )


def requests_by_status(log: DataFrame) -> DataFrame:
    return log.groupBy("status_code").agg(F.count("*").alias("requests"))


def engine_comparison(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Lines and mean confidence per image and engine (thousandths add up exactly)."""
    total = F.sum(F.rint(F.col("confidence") * 1000).cast("long"))
    return lines.groupBy(*keys, "source_provider").agg(
        F.count("*").alias("lines"), (total / F.count("*") / 1000).alias("mean_confidence")
    )

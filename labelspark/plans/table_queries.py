"""List, dashboard, review, report and region queries over the stored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelspark import fixed
from labelspark.functions import display
from labelspark.functions import geometry as G
from labelspark.functions.fusion import typed_value
from labelspark.operators import lines as LN
from labelspark.operators import lists as Q
from labelspark.operators.latency import latency_quantiles, latency_sketches
from labelspark.operators import quality as V
from labelspark.operators import regions as Z
from labelspark.operators import reports as P
from labelspark.operators import review as W
from labelspark.plans.text_queries import iou_sql
from labelspark.plans.views import label_lines, table, view, with_views

NOW = "2001-06-20 12:00:00"


def _v(name):
    return lambda spark, sf_dir: view(spark, sf_dir, name)


_scans, _images, _products, _declarations = _v("scans"), _v("images"), _v("products"), _v("declarations")
_inspections, _officers, _flags, _actions = _v("inspections"), _v("officers"), _v("flags"), _v("actions")
_linked = _v("declaration_evidence")


def _symbols(spark, sf_dir):
    return Q.symbol_scans(view(spark, sf_dir, "symbol_evidence"), _images(spark, sf_dir))


def _scan_filter(spark, sf_dir):
    return Q.filter_scans(
        _scans(spark, sf_dir), _inspections(spark, sf_dir), _symbols(spark, sf_dir), _products(spark, sf_dir),
        status="VIOLATION", date_from="1996-03-01", date_to="1999-11-30", barcode="89000000",
    )


def _scan_filter_product(spark, sf_dir):
    found = Q.filter_scans(
        _scans(spark, sf_dir), products=_products(spark, sf_dir), status="NO SUCH STATUS", brand="brand#1", category="o",
    )
    return found.select("scan_id", "product_id", "overall_status")


def _scan_filter_officer(spark, sf_dir):
    busy = Q.filter_scans(_scans(spark, sf_dir), _inspections(spark, sf_dir), officer_id=7)
    return busy.select("scan_id", "overall_status")


def _scan_items(spark, sf_dir):
    return Q.scan_items(
        _scans(spark, sf_dir), _inspections(spark, sf_dir), _declarations(spark, sf_dir), _products(spark, sf_dir),
        _symbols(spark, sf_dir),
    )


def _scan_page(spark, sf_dir):
    rows = Q.page(_scans(spark, sf_dir), "created_at", "scan_id", 2, 20)
    # Only what belongs to the page is aggregated.
    of_page = lambda df: df.join(rows.select("scan_id"), "scan_id", "left_semi")
    return Q.scan_items(
        rows, of_page(_inspections(spark, sf_dir)), of_page(_declarations(spark, sf_dir)), _products(spark, sf_dir),
        of_page(_symbols(spark, sf_dir)),
    )


def _recent_five(spark, sf_dir):
    return Q.page(_scans(spark, sf_dir), "created_at", "scan_id", 1, 5).select("scan_id", "created_at")


def _totals(spark, sf_dir):
    return _scan_filter(spark, sf_dir).agg(F.count("*").alias("total"))


def _audit(spark, sf_dir):
    checked = W.checked_actions(_actions(spark, sf_dir), _declarations(spark, sf_dir))
    return W.inspection_audit(W.accepted_actions(checked))


def _dashboard(spark, sf_dir):
    return Q.dashboard(
        _scans(spark, sf_dir), _inspections(spark, sf_dir), _declarations(spark, sf_dir), _audit(spark, sf_dir),
        _flags(spark, sf_dir), F.lit(NOW).cast("timestamp_ntz"),
    )


def _inspection_list(spark, sf_dir):
    found = Q.filter_inspections(
        _inspections(spark, sf_dir), _scans(spark, sf_dir), status="CONFLICT", date_from="2024-01-01", date_to="2024-01-20"
    )
    return Q.inspection_items(found, _officers(spark, sf_dir))


def _flag_list(spark, sf_dir):
    found = Q.filter_flags(_flags(spark, sf_dir), status="NEW")
    return found.select("flag_id", "scan_id", "reporter_note", "status", "created_at")


def _flag_filter(spark, sf_dir):
    found = Q.filter_flags(
        _flags(spark, sf_dir), _scans(spark, sf_dir), _products(spark, sf_dir), date_to="2024-01-25", brand="brand#2", category="a"
    )
    return found.select("flag_id", "scan_id", "status")


def _product_list(spark, sf_dir):
    return Q.product_items(_products(spark, sf_dir), _scans(spark, sf_dir))


def _product_search(spark, sf_dir):
    return Q.product_items(
        _products(spark, sf_dir), _scans(spark, sf_dir), search="ring", compliance_status="SATISFIED"
    ).select("product_id", "identity", "latest_scan_status")


def _product_detail(spark, sf_dir):
    return Q.product_detail(_products(spark, sf_dir), _scans(spark, sf_dir), _declarations(spark, sf_dir))


def _scan_detail(spark, sf_dir):
    return Q.scan_detail(_scans(spark, sf_dir), _images(spark, sf_dir), _declarations(spark, sf_dir))


def _scan_quality(spark, sf_dir):
    classed = _classified(spark, sf_dir)
    record = F.struct("blur", "resolution")
    empty = F.struct(F.lit(None).cast("string").alias("blur"), F.lit(None).cast("string").alias("resolution"))
    panel = F.when(F.col("part_no") % 2 == 0, "front").otherwise("back")
    quality = F.create_map(panel, record, F.lit("_barcode_warnings"), empty)
    kept = Q.quality_with_blur(quality)
    return classed.select(
        "image_id", "partkey", F.array_join(F.map_keys(kept), ",").alias("panels"), F.size(kept).alias("records")
    )


def _evidence_groups(spark, sf_dir):
    return Q.evidence_groups(_declarations(spark, sf_dir), _linked(spark, sf_dir), _symbols(spark, sf_dir))


def _evidence_items(spark, sf_dir):
    rows = Q.evidence_items(_declarations(spark, sf_dir), _linked(spark, sf_dir), _unlinked(spark, sf_dir))
    return rows.drop("extracted_at")


def _unlinked(spark, sf_dir):
    evidence = view(spark, sf_dir, "symbol_evidence")
    return evidence.join(_images(spark, sf_dir).select("image_id", "scan_id"), "image_id")


def _scan_parts(spark, sf_dir):
    return Q.scan_parts(_scans(spark, sf_dir), _images(spark, sf_dir), _declarations(spark, sf_dir), _linked(spark, sf_dir)).drop("created_at")


def _product_evidence(spark, sf_dir):
    return Q.product_evidence(_products(spark, sf_dir), _scans(spark, sf_dir), _declarations(spark, sf_dir), _linked(spark, sf_dir))


def _scan_compliance(spark, sf_dir):
    return Q.scan_compliance(_scans(spark, sf_dir), _declarations(spark, sf_dir))


def _scan_trace(spark, sf_dir):
    return Q.scan_trace(_scans(spark, sf_dir), _declarations(spark, sf_dir), _linked(spark, sf_dir))


# -------------------------------------------------------------------------------- review


def _checked(spark, sf_dir):
    return W.checked_actions(_actions(spark, sf_dir), _declarations(spark, sf_dir))


def _reviewed(spark, sf_dir):
    accepted = W.accepted_actions(_checked(spark, sf_dir))
    return W.apply_review_actions(_declarations(spark, sf_dir), accepted, _officers(spark, sf_dir))


def _review_state(spark, sf_dir):
    c = F.col("officer_correction")
    return _reviewed(spark, sf_dir).select(
        "declaration_id", "verdict", "reason", c["officer_id"].alias("officer_id"), c["officer_name"].alias("officer_name"),
        c["corrected_value"].alias("corrected_value"), c["original_verdict"].alias("original_verdict"),
        c["original_reason"].alias("original_reason"),
    )


def _accepted(spark, sf_dir):
    return W.accepted_inspections(_inspections(spark, sf_dir), _checked(spark, sf_dir), _scans(spark, sf_dir)).select(
        "inspection_id", "scan_id"
    )


def _locations(spark, sf_dir):
    return W.inspection_locations(_inspections(spark, sf_dir))


def _create_flags(spark, sf_dir):
    requests = _flags(spark, sf_dir).drop("status").withColumn("scan_id", F.col("flag_id") * 3)
    return W.create_flags(requests, _scans(spark, sf_dir)).select("flag_id", "scan_id", "status")



def _review_flags(spark, sf_dir):
    return W.review_flags(_flags(spark, sf_dir), view(spark, sf_dir, "flag_reviews"), _officers(spark, sf_dir)).select(
        "flag_id", "status", "reviewed_by_officer_id", "officer_notes"
    )


def _flag_audit(spark, sf_dir):
    return W.flag_audit(_flags(spark, sf_dir), view(spark, sf_dir, "flag_reviews"), _officers(spark, sf_dir))


def _role_filter(spark, sf_dir):
    return Q.with_role(view(spark, sf_dir, "flag_reviews"), _officers(spark, sf_dir)).select("review_id", "officer_id")


def _add_images(spark, sf_dir):
    uploads = _flags(spark, sf_dir).select(
        (F.col("flag_id") + 10000000).alias("image_id"), "scan_id", F.lit("/uploads/new.jpg").alias("url")
    )
    return W.add_images(_images(spark, sf_dir), uploads, _scans(spark, sf_dir))


def _reanalyze(spark, sf_dir):
    return W.mark_reanalyze(_scans(spark, sf_dir), _flags(spark, sf_dir)).groupBy("status").agg(F.count("*").alias("scans"))


# ------------------------------------------------------------------------------- reports


def _report_summary(spark, sf_dir):
    return P.report_summary(_scans(spark, sf_dir), _products(spark, sf_dir), _declarations(spark, sf_dir))


def _report_fields(spark, sf_dir):
    return P.report_fields(_reviewed(spark, sf_dir))


def _report_evidence(spark, sf_dir):
    return P.report_evidence(_declarations(spark, sf_dir), _linked(spark, sf_dir))


def _report_inspections(spark, sf_dir):
    return P.report_inspections(_inspections(spark, sf_dir), _officers(spark, sf_dir), _locations(spark, sf_dir))


def _format_values(spark, sf_dir):
    """Display text over line items read as typed values."""
    li = table(spark, sf_dir, "lineitem")
    n = F.col("l_linenumber")
    field = (
        F.when(n == 1, "mrp").when(n == 2, "net_quantity").when(n == 3, "manufacturer").when(n == 4, "expiry_date")
        .when(n == 5, "cautions").otherwise("nutrition_facts")
    )
    nutrients = F.array(
        F.struct(
            F.lit("saturated_fat").alias("nutrient"), F.when(F.col("l_quantity") > 10, F.col("l_quantity")).alias("value"),
            F.lit("g").alias("unit"), F.lit(0.5).alias("confidence"), F.lit("x").alias("raw_text"),
        )
    )
    value = (
        F.when(n == 1, typed_value(amount=F.col("l_extendedprice"), currency=F.when(F.col("l_partkey") % 3 == 0, "USD").when(F.col("l_partkey") % 3 == 1, "GBP").otherwise("INR")))
        .when(n == 2, typed_value(value=F.col("l_quantity"), unit=F.lit("kg")))
        .when(n == 3, typed_value(name=F.col("l_returnflag")))
        .when(n == 4, typed_value(day=F.when(F.col("l_partkey") % 2 == 0, F.dayofmonth("l_shipdate")), month=F.month("l_shipdate"), year=F.year("l_shipdate")))
        .when(n == 5, typed_value(present=F.col("l_partkey") % 2 == 0, text=F.lit("hot")))
        .when(n == 6, typed_value(nutrients=nutrients))
    )
    return li.select(
        field.alias("field_name"), display.format_value(field, value).alias("display"),
    ).groupBy("field_name", "display").agg(F.count("*").alias("n"))


def _stage_latency(spark, sf_dir):
    return Q.stage_latency(view(spark, sf_dir, "log")).select(
        "stage", "event", "n", F.rint(F.col("mean_ms") * 1000).cast("long").alias("mean_us"), "max_ms"
    )


def _latency_quantiles(spark, sf_dir):
    """Quantiles of the first half year from daily sketches."""
    return latency_quantiles(latency_sketches(view(spark, sf_dir, "log")), [0.5, 0.9, 0.99], last="2024-06-30")


def _stage_median(spark, sf_dir):
    return Q.stage_latency(view(spark, sf_dir, "log")).select("stage", "event", "median_ms")


def _requests(spark, sf_dir):
    return Q.requests_by_status(view(spark, sf_dir, "log"))


def _engines(spark, sf_dir):
    return Q.engine_comparison(label_lines(spark, sf_dir), ["scan_id", "panel"])


# ----------------------------------------------------------------------- quality, regions


def _classified(spark, sf_dir):
    q = view(spark, sf_dir, "quality")
    w, h = F.col("quad_w"), F.col("quad_h")
    at = lambda x, y: F.struct(F.lit(x * 1.0).alias("x") if isinstance(x, int) else x.alias("x"), (F.lit(0.0) if isinstance(y, int) else y).alias("y"))
    corners = F.when(F.col("has_quad"), F.array(at(0, 0), at(w, 0), at(w, h), at(0, h)))
    return V.classify(q, corners, w * h * F.col("fill"))


def _quality(spark, sf_dir):
    return _classified(spark, sf_dir).select(
        "image_id", "part_no", "partkey", "blur", "brightness", "glare", "perspective", "resolution", "recommended_action"
    )


def _variant_choice(spark, sf_dir):
    classed = _classified(spark, sf_dir)
    names = LN.ocr_variants(F.col("blur"), F.col("glare"), F.col("resolution"), F.col("has_quad"))
    again = LN.needs_recrop(
        F.col("blur"), F.col("resolution"), F.col("perspective"),
        F.when(F.col("partkey") % 2 == 0, 1), F.when(F.col("partkey") % 3 == 0, 1), F.when(F.col("partkey") % 5 == 0, 1),
    )
    return classed.select("image_id", F.explode(names).alias("variant"), again.alias("recrop")).groupBy("variant", "recrop").agg(
        F.count("*").alias("images")
    )


def _pixel_stats(spark, sf_dir):
    images = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.transform("embedding", lambda v: v.cast("double") * 20 + 128).alias("pixels")
    )
    return images.select("vec_id", V.pixel_stats("pixels", F.lit(8)).alias("s")).select(
        "vec_id", *[F.rint(F.col("s")[c] * 1000).alias(f"{c}_milli") for c in ("laplacian_variance", "mean", "std")]
    )


def _barcode_scale(spark, sf_dir):
    scale = G.barcode_scale(F.col("format"), F.col("width"), F.col("height"))
    font = G.font_height_mm(F.col("height") / 10, scale)
    return view(spark, sf_dir, "symbols").select(
        "image_id", scale["status"].alias("status"), scale["pixels_per_mm"].alias("pixels_per_mm"),
        scale["reason"].alias("reason"), font["font_height_mm"].alias("font_height_mm"), font["reason"].alias("font_reason"),
    )


def _contours(spark, sf_dir):
    return Z.contour_boxes(view(spark, sf_dir, "boxes")).select("image_id", "ord", "x", "y", "w", "h")


def _envelope(spark, sf_dir):
    return Z.text_envelope(view(spark, sf_dir, "components"))


def _suppressed(spark, sf_dir):
    return Z.suppress_overlaps(view(spark, sf_dir, "boxes")).select("image_id", "ord", "x", "y", "w", "h")


def _scored(spark, sf_dir):
    return Z.score_regions(view(spark, sf_dir, "boxes")).select("image_id", "ord", "relative_area", "centrality", "score")


def _top_regions(spark, sf_dir):
    return Z.top_regions(Z.score_regions(view(spark, sf_dir, "boxes"))).select("image_id", "ord", "rank", "score")


def _hints(spark, sf_dir):
    panels = _scans(spark, sf_dir).select(F.col("scan_id").alias("image_id"))
    ranked = Z.top_regions(Z.score_regions(view(spark, sf_dir, "boxes")))
    return Z.region_hints(panels, ranked).select("image_id", "status", "score", "source")


QUERIES = {
    "scan_filter": _scan_filter,
    "scan_filter_by_product": _scan_filter_product,
    "scan_filter_by_officer": _scan_filter_officer,
    "scan_total": _totals,
    "scan_list": _scan_items,
    "scan_page": _scan_page,
    "recent_scans": _recent_five,
    "dashboard": _dashboard,
    "compliance_share": lambda s, d: Q.compliance_share(_dashboard(s, d)),
    "inspection_list": _inspection_list,
    "flag_list": _flag_list,
    "flag_filter_by_product": _flag_filter,
    "product_list": _product_list,
    "product_search": _product_search,
    "product_detail": _product_detail,
    "scan_detail": _scan_detail,
    "scan_quality_records": _scan_quality,
    "scan_evidence_groups": _evidence_groups,
    "scan_evidence_items": _evidence_items,
    "scan_parts": _scan_parts,
    "product_evidence": _product_evidence,
    "scan_compliance": _scan_compliance,
    "scan_trace": _scan_trace,
    "apply_review_actions": _review_state,
    "accepted_inspections": _accepted,
    "inspection_audit": _audit,
    "inspection_locations": _locations,
    "create_flags": _create_flags,
    "review_flags": _review_flags,
    "flag_audit": _flag_audit,
    "role_filter": _role_filter,
    "add_images": _add_images,
    "mark_reanalyze": _reanalyze,
    "report_summary": _report_summary,
    "report_fields": _report_fields,
    "report_evidence": _report_evidence,
    "report_inspections": _report_inspections,
    "format_value": _format_values,
    "stage_latency": _stage_latency,
    "stage_median": _stage_median,
    "latency_quantiles": _latency_quantiles,
    "requests_by_status": _requests,
    "engine_comparison": _engines,
    "classify_quality": _quality,
    "ocr_variant_choice": _variant_choice,
    "pixel_stats": _pixel_stats,
    "barcode_scale": _barcode_scale,
    "contour_boxes": _contours,
    "text_envelope": _envelope,
    "suppress_overlaps": _suppressed,
    "score_regions": _scored,
    "top_regions": _top_regions,
    "region_hint": _hints,
}

# ------------------------------------------------------------------------------ oracles

_ITEMS = """WITH {page}
 sy AS (SELECT i.scan_id, arg_min(e.raw_text, (e.extracted_at, e.evidence_no)) AS t FROM v_symbol_evidence e JOIN v_images i ON i.image_id = e.image_id GROUP BY i.scan_id),
 dc AS (SELECT scan_id, count(*) AS n FROM v_declarations GROUP BY scan_id)
 SELECT s.scan_id, s.status, s.overall_status, p.identity AS product_name,
  coalesce(nullif(p.barcode_code, ''), CASE WHEN instr(t, ': ') > 0 THEN substr(t, instr(t, ': ') + 2) ELSE t END) AS barcode,
  s.scan_id IN (SELECT scan_id FROM v_inspections) AS has_inspection, coalesce(dc.n, 0) AS declarations_count, s.created_at
 FROM {scans} s LEFT JOIN v_products p ON p.product_id = s.product_id LEFT JOIN sy ON sy.scan_id = s.scan_id LEFT JOIN dc ON dc.scan_id = s.scan_id"""
_ITEM_VIEWS = "scans images products declarations inspections symbol_evidence"
_CHECKED = """
ch AS (SELECT a.*, d.field_name, d.verdict AS base_verdict, d.reason AS base_reason,
  coalesce(d.scan_id = a.scan_id, false) AND a.action IN ('confirm', 'correct', 'mark_unresolved') AND NOT (a.action = 'correct' AND a.new_value IS NULL) AS ok
 FROM v_actions a LEFT JOIN v_declarations d ON d.declaration_id = a.declaration_id),
acc AS (SELECT * FROM ch WHERE inspection_id NOT IN (SELECT inspection_id FROM ch WHERE NOT ok))"""
_REVIEW = f"""{_CHECKED},
chg AS (SELECT *, CASE action WHEN 'correct' THEN 'SATISFIED' ELSE 'NOT_VERIFIED' END AS rv,
   CASE action WHEN 'correct' THEN 'officer corrected: ' ELSE 'officer marked unresolved: ' END || reason AS rr FROM acc WHERE action <> 'confirm'),
lst AS (SELECT *, coalesce(lag(rv) OVER w, base_verdict) AS ov, coalesce(lag(rr) OVER w, base_reason) AS orr,
   row_number() OVER (PARTITION BY declaration_id ORDER BY created_at DESC, inspection_id DESC, pos DESC) AS rn FROM chg
   WINDOW w AS (PARTITION BY declaration_id ORDER BY created_at, inspection_id, pos)),
rev AS (SELECT d.*, l.rv, l.rr, l.officer_id, o.name AS officer_name, CASE WHEN l.action = 'correct' THEN l.new_value END AS corrected_value,
   l.ov AS original_verdict, l.orr AS original_reason
  FROM v_declarations d LEFT JOIN lst l ON l.declaration_id = d.declaration_id AND l.rn = 1 LEFT JOIN v_officers o ON o.officer_id = l.officer_id)"""
_REVIEW_VIEWS = "actions declarations officers"
_DASH = f"""{_CHECKED},
conf AS (SELECT DISTINCT d.scan_id FROM v_declarations d JOIN acc ON acc.declaration_id = d.declaration_id WHERE acc.action = 'confirm' AND d.verdict = 'VIOLATION'),
dash AS (SELECT count(*) AS total_scans, count(*) FILTER (WHERE scan_id NOT IN (SELECT scan_id FROM v_inspections)) AS scans_pending_review,
  count(*) FILTER (WHERE overall_status = 'VIOLATION') AS violations_ai, count(*) FILTER (WHERE scan_id IN (SELECT scan_id FROM conf)) AS violations_officer_confirmed,
  count(*) FILTER (WHERE overall_status = 'NOT_VERIFIED') AS not_verified, count(*) FILTER (WHERE overall_status = 'CONFLICT') AS conflict,
  count(*) FILTER (WHERE created_at >= TIMESTAMP '2001-06-20') AS scans_today,
  count(*) FILTER (WHERE created_at >= date_trunc('week', TIMESTAMP '{NOW}')) AS scans_this_week,
  (SELECT count(*) FROM v_flags WHERE status = 'NEW') AS pending_flags FROM v_scans)"""
_DASH_VIEWS = "scans actions declarations inspections flags"
_LATEST = """
lat AS (SELECT product_id, arg_max(scan_id, (created_at, scan_id)) AS scan_id, count(*) AS total_scans FROM v_scans WHERE product_id IS NOT NULL GROUP BY product_id),
lats AS (SELECT lat.*, s.overall_status AS latest_scan_status FROM lat JOIN v_scans s ON s.scan_id = lat.scan_id)"""
_FILTERED = """v_scans s WHERE overall_status = 'VIOLATION' AND created_at >= TIMESTAMP '1996-03-01' AND created_at < TIMESTAMP '1999-12-01'
 AND scan_id IN (SELECT i.scan_id FROM v_symbol_evidence e JOIN v_images i ON i.image_id = e.image_id WHERE e.raw_text ILIKE '%89000000%' AND e.source_type IN ('BARCODE', 'QR'))"""
_KNOWN_REVIEWS = """
kr AS (SELECT r.*, f.scan_id, f.status AS first_status FROM v_flag_reviews r JOIN v_flags f ON f.flag_id = r.flag_id
  WHERE r.officer_id IN (SELECT officer_id FROM v_officers WHERE role IN ('ADMIN', 'INSPECTOR')))"""
_QUALITY = """
q AS (SELECT *, CASE WHEN laplacian_variance < 100 THEN 'high' WHEN laplacian_variance < 200 THEN 'medium' ELSE 'low' END AS blur,
  CASE WHEN mean < 80 THEN 'dark' WHEN mean > 180 THEN 'bright' ELSE 'normal' END AS brightness,
  CASE WHEN mean > 200 AND std > 40 THEN 'high' ELSE 'none' END AS glare,
  CASE WHEN least(image_w, image_h) < 800 THEN 'low' ELSE 'adequate' END AS resolution,
  CASE WHEN quad_h > 0 THEN quad_w / quad_h ELSE 0 END AS aspect,
  CASE WHEN quad_w * quad_h > 0 THEN quad_w * quad_h * fill / (quad_w * quad_h) ELSE 0 END AS solidity FROM v_quality),
p AS (SELECT *, CASE WHEN NOT has_quad THEN 'none' WHEN aspect > 0.4::DOUBLE AND aspect < 2.5::DOUBLE THEN CASE WHEN solidity < 0.6::DOUBLE THEN 'severe' ELSE 'slight_tilt' END
  WHEN aspect > 2.5::DOUBLE THEN 'severe' ELSE 'none' END AS perspective FROM q),
cl AS (SELECT *, CASE WHEN blur = 'high' OR resolution = 'low' OR perspective = 'severe' THEN 'recapture'
  WHEN blur = 'medium' OR perspective = 'slight_tilt' OR brightness <> 'normal' THEN 'proceed_with_caution' ELSE 'proceed' END AS recommended_action FROM p)"""
_SCALE = f"""
sc AS (SELECT *, upper(replace(replace(format, '_', ''), ' ', '')) AS f, greatest(width, height) AS lo, least(width, height) AS sh FROM v_symbols),
pr AS (SELECT *, CASE WHEN f NOT IN ('EAN13', 'EAN-13', 'UPCA', 'UPC-A') THEN 'barcode format ''' || format || ''' has no configured physical module geometry'
  WHEN width <= 0 OR height <= 0 THEN 'decoded barcode bounding box has non-positive dimensions'
  WHEN lo < 95 OR lo / sh < 1.5 THEN 'decoded barcode bounding box is not a usable linear symbol' END AS problem,
  round_even(lo / {fixed.SYMBOL_WIDTH_MM!r}::DOUBLE, 6) AS ppm FROM sc)"""
_SCORE = """
sr AS (SELECT *, w * h / (image_w * image_h) AS area, (x + w / 2) / image_w - 0.5::DOUBLE AS dx, (y + h / 2) / image_h - 0.5::DOUBLE AS dy FROM v_boxes),
s2 AS (SELECT *, greatest(0.0::DOUBLE, 1.0::DOUBLE - (dx * dx + dy * dy) * 2) AS ce, greatest(0.0::DOUBLE, 1.0::DOUBLE - abs(area - 0.45::DOUBLE) / 0.55::DOUBLE) AS ar,
  least(text_density / 0.35::DOUBLE, 1.0::DOUBLE) AS te FROM sr),
s3 AS (SELECT *, 0.45::DOUBLE * ar + 0.4::DOUBLE * te + 0.15::DOUBLE * ce AS raw FROM s2),
sco AS (SELECT *, round_even(area, 4) AS relative_area, round_even(ce, 4) AS centrality,
  round_even(CASE WHEN source = 'image_surface_fallback' THEN raw * 0.55::DOUBLE ELSE raw END, 4) AS score FROM s3),
top AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, ord, x, y, w, h) AS rank FROM sco)"""
_IOU_BK = iou_sql("b.", "k.")

ORACLE = {
    "scan_filter": with_views("scans images symbol_evidence", f"SELECT s.* FROM {_FILTERED}"),
    "scan_filter_by_product": with_views(
        "scans products",
        """SELECT scan_id, product_id, overall_status FROM v_scans WHERE product_id IN
           (SELECT product_id FROM v_products WHERE brand ILIKE '%brand#1%' AND category ILIKE '%o%')""",
    ),
    "scan_filter_by_officer": with_views(
        "scans inspections", "SELECT scan_id, overall_status FROM v_scans WHERE scan_id IN (SELECT scan_id FROM v_inspections WHERE officer_id = 7)"
    ),
    "scan_total": with_views("scans images symbol_evidence", f"SELECT count(*) AS total FROM {_FILTERED}"),
    "scan_list": with_views(_ITEM_VIEWS, _ITEMS.format(page="", scans="v_scans")),
    "scan_page": with_views(
        _ITEM_VIEWS,
        _ITEMS.format(page="pg AS (SELECT * FROM v_scans ORDER BY created_at DESC, scan_id LIMIT 20 OFFSET 20),", scans="pg"),
    ),
    "recent_scans": with_views("scans", "SELECT scan_id, created_at FROM v_scans ORDER BY created_at DESC, scan_id LIMIT 5"),
    "dashboard": with_views(_DASH_VIEWS, f"WITH {_DASH} SELECT * FROM dash"),
    "compliance_share": with_views(
        _DASH_VIEWS,
        f"""WITH {_DASH}, c AS (SELECT *, greatest(0, total_scans - violations_ai - not_verified - conflict) AS compliant FROM dash)
            SELECT compliant, floor(compliant * 100.0 / total_scans + 0.5) AS compliant_percent, floor(violations_ai * 100.0 / total_scans + 0.5) AS violation_percent,
             floor(not_verified * 100.0 / total_scans + 0.5) AS not_verified_percent, floor(conflict * 100.0 / total_scans + 0.5) AS conflict_percent FROM c""",
    ),
    "inspection_list": with_views(
        "inspections scans officers",
        """SELECT inspection_id, scan_id, i.officer_id, o.name AS officer_name, actions_count, notes, created_at FROM v_inspections i
           LEFT JOIN v_officers o ON o.officer_id = i.officer_id WHERE created_at >= TIMESTAMP '2024-01-01' AND created_at < TIMESTAMP '2024-01-21'
           AND scan_id IN (SELECT scan_id FROM v_scans WHERE overall_status = 'CONFLICT')""",
    ),
    "flag_list": with_views("flags", "SELECT flag_id, scan_id, reporter_note, status, created_at FROM v_flags WHERE status = 'NEW'"),
    "flag_filter_by_product": with_views(
        "flags scans products",
        """SELECT flag_id, scan_id, status FROM v_flags WHERE created_at < TIMESTAMP '2024-01-26' AND scan_id IN (SELECT scan_id FROM v_scans
           WHERE product_id IN (SELECT product_id FROM v_products WHERE brand ILIKE '%brand#2%' AND category ILIKE '%a%'))""",
    ),
    "product_list": with_views(
        "products scans",
        f"""WITH {_LATEST} SELECT p.product_id, identity, brand, category, manufacturer, barcode_code, mrp_amount, latest_scan_status, total_scans
            FROM v_products p JOIN lats ON lats.product_id = p.product_id""",
    ),
    "product_search": with_views(
        "products scans",
        f"""WITH {_LATEST} SELECT p.product_id, identity, latest_scan_status FROM v_products p JOIN lats ON lats.product_id = p.product_id
            WHERE latest_scan_status = 'SATISFIED' AND (identity ILIKE '%ring%' OR brand ILIKE '%ring%' OR manufacturer ILIKE '%ring%')""",
    ),
    "product_detail": with_views(
        "products scans declarations",
        f"""WITH {_LATEST} SELECT p.product_id, identity, nullif(quantity_value, 0) AS quantity_value, CASE WHEN quantity_value <> 0 THEN quantity_unit END AS quantity_unit,
             nullif(mrp_amount, 0) AS mrp_amount, CASE WHEN mrp_amount <> 0 THEN mrp_currency END AS mrp_currency, barcode_code, barcode_format,
             l.scan_id, d.declaration_id, d.field_name, d.verdict FROM v_products p LEFT JOIN lats l ON l.product_id = p.product_id
            LEFT JOIN v_declarations d ON d.scan_id = l.scan_id""",
    ),
    "scan_detail": with_views(
        "scans images declarations",
        """SELECT s.scan_id, product_id, status, overall_status, part, part_id, name, detail FROM v_scans s LEFT JOIN (
            SELECT scan_id, 'image' AS part, image_id AS part_id, label AS name, url AS detail FROM v_images UNION ALL
            SELECT scan_id, 'declaration', declaration_id, field_name, verdict FROM v_declarations) p ON p.scan_id = s.scan_id""",
    ),
    "scan_quality_records": with_views(
        "quality", "SELECT image_id, partkey, CASE WHEN part_no % 2 = 0 THEN 'front' ELSE 'back' END AS panels, 1 AS records FROM v_quality"
    ),
    "scan_evidence_groups": with_views(
        "declarations declaration_evidence symbol_evidence images",
        """SELECT d.scan_id, d.declaration_id, field_name, count(e.declaration_id) AS evidence, max(e.confidence) AS best FROM v_declarations d
            LEFT JOIN v_declaration_evidence e ON e.declaration_id = d.declaration_id GROUP BY ALL
           UNION ALL SELECT i.scan_id, NULL, 'barcode_qr', count(*), NULL FROM v_symbol_evidence e JOIN v_images i ON i.image_id = e.image_id GROUP BY i.scan_id""",
    ),
    "scan_evidence_items": with_views(
        "declarations declaration_evidence symbol_evidence images",
        """SELECT d.scan_id, d.declaration_id, field_name, source_type, raw_text, e.confidence, image_id FROM v_declarations d
            LEFT JOIN v_declaration_evidence e ON e.declaration_id = d.declaration_id
           UNION ALL SELECT i.scan_id, NULL, 'barcode_qr', source_type, raw_text, 1.0::DOUBLE, e.image_id FROM v_symbol_evidence e JOIN v_images i ON i.image_id = e.image_id""",
    ),
    "scan_parts": with_views(
        "scans images declarations declaration_evidence",
        """SELECT s.scan_id, product_id, status, overall_status, part, part_id, owner_id, name, detail, reason, confidence FROM v_scans s LEFT JOIN (
            SELECT scan_id, 'image' AS part, image_id AS part_id, NULL::BIGINT AS owner_id, label AS name, url AS detail, NULL AS reason, NULL::DOUBLE AS confidence FROM v_images
            UNION ALL SELECT scan_id, 'declaration', declaration_id, NULL, field_name, verdict, reason, confidence FROM v_declarations
            UNION ALL SELECT scan_id, 'evidence', image_id, e.declaration_id, source_type, raw_text, NULL, e.confidence
             FROM v_declaration_evidence e JOIN v_declarations d ON d.declaration_id = e.declaration_id) p ON p.scan_id = s.scan_id""",
    ),
    "product_evidence": with_views(
        "products scans declarations declaration_evidence",
        f"""WITH {_LATEST} SELECT p.product_id, identity, brand, category, manufacturer, l.scan_id, d.declaration_id, field_name, verdict,
             source_type, raw_text, e.confidence, image_id FROM v_products p LEFT JOIN lats l ON l.product_id = p.product_id
            LEFT JOIN v_declarations d ON d.scan_id = l.scan_id LEFT JOIN v_declaration_evidence e ON e.declaration_id = d.declaration_id""",
    ),
    "scan_compliance": with_views(
        "scans declarations",
        "SELECT s.scan_id, overall_status, field_name, verdict, reason, confidence FROM v_scans s LEFT JOIN v_declarations d ON d.scan_id = s.scan_id",
    ),
    "scan_trace": with_views(
        "scans declarations declaration_evidence",
        """SELECT s.scan_id, status, overall_status, d.declaration_id, field_name, verdict, d.confidence, source_type, raw_text,
            e.confidence AS evidence_confidence, image_id FROM v_scans s JOIN v_declarations d ON d.scan_id = s.scan_id
           LEFT JOIN v_declaration_evidence e ON e.declaration_id = d.declaration_id""",
    ),
    "apply_review_actions": with_views(
        _REVIEW_VIEWS,
        f"""WITH {_REVIEW} SELECT declaration_id, coalesce(rv, verdict) AS verdict, coalesce(rr, reason) AS reason, officer_id, officer_name,
             corrected_value, original_verdict, original_reason FROM rev""",
    ),
    "accepted_inspections": with_views(
        "inspections scans actions declarations",
        f"""WITH {_CHECKED} SELECT inspection_id, scan_id FROM v_inspections WHERE inspection_id NOT IN (SELECT inspection_id FROM ch WHERE NOT ok)
            AND scan_id IN (SELECT scan_id FROM v_scans)""",
    ),
    "inspection_audit": with_views(
        "actions declarations",
        f"""WITH {_CHECKED} SELECT officer_id, 'inspection_' || action AS action, 'declaration' AS target_type, declaration_id AS target_id, scan_id,
             field_name, new_value, reason, created_at FROM acc""",
    ),
    "inspection_locations": with_views(
        "inspections",
        """SELECT inspection_id, latitude, longitude, location_source AS source, created_at AS captured_at FROM v_inspections
           WHERE latitude IS NOT NULL AND longitude IS NOT NULL""",
    ),
    "create_flags": with_views(
        "flags scans", "SELECT flag_id, flag_id * 3 AS scan_id, 'NEW' AS status FROM v_flags WHERE flag_id * 3 IN (SELECT scan_id FROM v_scans)"
    ),
    "review_flags": with_views(
        "flags flag_reviews officers",
        f"""WITH {_KNOWN_REVIEWS}, l AS (SELECT *, row_number() OVER (PARTITION BY flag_id ORDER BY reviewed_at DESC, review_id DESC) AS rn FROM kr)
            SELECT f.flag_id, coalesce(l.new_status, f.status) AS status, l.officer_id AS reviewed_by_officer_id, l.officer_notes
            FROM v_flags f LEFT JOIN l ON l.flag_id = f.flag_id AND l.rn = 1""",
    ),
    "flag_audit": with_views(
        "flags flag_reviews officers",
        f"""WITH {_KNOWN_REVIEWS} SELECT officer_id, 'flag_' || lower(new_status) AS action, 'consumer_flag' AS target_type, flag_id AS target_id, scan_id,
             coalesce(lag(new_status) OVER (PARTITION BY flag_id ORDER BY reviewed_at, review_id), first_status) AS old_status, new_status, officer_notes,
             reviewed_at AS created_at FROM kr""",
    ),
    "role_filter": with_views(
        "flag_reviews officers",
        """SELECT review_id, officer_id FROM v_flag_reviews WHERE officer_id IN (SELECT officer_id FROM v_officers WHERE role IN ('ADMIN', 'INSPECTOR'))""",
    ),
    "add_images": with_views(
        "images flags scans",
        """SELECT * FROM v_images UNION ALL SELECT flag_id + 10000000, scan_id, '/uploads/new.jpg', NULL FROM v_flags WHERE scan_id IN (SELECT scan_id FROM v_scans)""",
    ),
    "mark_reanalyze": with_views(
        "scans flags",
        """SELECT CASE WHEN scan_id IN (SELECT scan_id FROM v_flags) THEN 'PROCESSING' ELSE status END AS status, count(*) AS scans FROM v_scans GROUP BY 1""",
    ),
    "report_summary": with_views(
        "scans products declarations",
        """WITH c AS (SELECT scan_id, count(*) FILTER (WHERE verdict = 'SATISFIED') AS satisfied, count(*) FILTER (WHERE verdict = 'VIOLATION') AS violation,
             count(*) FILTER (WHERE verdict = 'NOT_VERIFIED') AS not_verified, count(*) FILTER (WHERE verdict = 'CONFLICT') AS conflict FROM v_declarations GROUP BY scan_id)
           SELECT s.scan_id, overall_status, identity AS name, brand, p.category, manufacturer, barcode_code AS barcode,
            CASE WHEN mrp_amount <> 0 THEN mrp_currency || ' ' || CAST(mrp_amount AS VARCHAR) END AS mrp,
            CASE WHEN quantity_value <> 0 THEN CAST(quantity_value AS VARCHAR) || ' ' || quantity_unit END AS quantity,
            satisfied, violation, not_verified, conflict FROM v_scans s LEFT JOIN c ON c.scan_id = s.scan_id LEFT JOIN v_products p ON p.product_id = s.product_id""",
    ),
    "report_fields": with_views(
        _REVIEW_VIEWS,
        f"""WITH {_REVIEW} SELECT scan_id, declaration_id, field_name, coalesce(rv, verdict) AS verdict, coalesce(rr, reason) AS reason, confidence,
             corrected_value, original_verdict AS ai_verdict, original_reason AS ai_reason FROM rev""",
    ),
    "report_evidence": with_views(
        "declarations declaration_evidence",
        """SELECT scan_id, field_name, source_type, CASE source_type WHEN 'OCR' THEN 'AI (OCR)' WHEN 'PRODUCT_DATABASE' THEN 'Product Database'
            WHEN 'MANUAL_ENTRY' THEN 'Manual Entry' WHEN 'OFFICER_CORRECTION' THEN 'Officer Correction' WHEN 'PRIOR_RECORD' THEN 'Prior Record' END AS source_label,
            raw_text, e.confidence FROM v_declarations d JOIN v_declaration_evidence e ON e.declaration_id = d.declaration_id""",
    ),
    "report_inspections": with_views(
        "inspections officers",
        """SELECT scan_id, inspection_id, coalesce(o.name, 'Unknown') AS officer_name, actions_count, notes, latitude, longitude,
            CASE WHEN latitude IS NOT NULL THEN location_source END AS source FROM v_inspections i LEFT JOIN v_officers o ON o.officer_id = i.officer_id""",
    ),
    "format_value": """WITH t AS (SELECT CASE l_linenumber WHEN 1 THEN 'mrp' WHEN 2 THEN 'net_quantity' WHEN 3 THEN 'manufacturer' WHEN 4 THEN 'expiry_date' WHEN 5 THEN 'cautions' ELSE 'nutrition_facts' END AS field_name,
      CASE l_linenumber WHEN 1 THEN CASE l_partkey % 3 WHEN 0 THEN '$' WHEN 1 THEN 'GBP ' ELSE '₹' END || CAST(l_extendedprice AS VARCHAR)
       WHEN 2 THEN CAST(l_quantity AS VARCHAR) || ' kg' WHEN 3 THEN l_returnflag
       WHEN 4 THEN CASE WHEN l_partkey % 2 = 0 THEN CAST(day(l_shipdate) AS VARCHAR) || ' ' ELSE '' END || strftime(l_shipdate, '%b') || ' ' || CAST(year(l_shipdate) AS VARCHAR)
       WHEN 5 THEN CASE WHEN l_partkey % 2 = 0 THEN 'Present: hot' ELSE 'Not present' END
       WHEN 6 THEN 'Saturated Fat: ' || CASE WHEN l_quantity > 10 THEN CAST(l_quantity AS VARCHAR) || ' g' ELSE '—' END ELSE '—' END AS display FROM lineitem)
      SELECT field_name, display, count(*) AS n FROM t GROUP BY ALL""",
    "stage_latency": with_views(
        "log",
        "SELECT stage, event, count(*) AS n, CAST(round_even(avg(elapsed_ms) * 1000, 0) AS BIGINT) AS mean_us, max(elapsed_ms) AS max_ms FROM v_log GROUP BY ALL",
    ),
    "requests_by_status": with_views("log", "SELECT status_code, count(*) AS requests FROM v_log GROUP BY ALL"),
    "engine_comparison": with_views(
        "label_lines",
        """SELECT scan_id, panel, source_provider, count(*) AS lines, CAST(sum(CAST(round(confidence * 1000) AS BIGINT)) AS DOUBLE) / count(*) / 1000 AS mean_confidence
           FROM v_label_lines GROUP BY ALL""",
    ),
    "classify_quality": with_views(
        "quality",
        f"WITH {_QUALITY} SELECT image_id, part_no, partkey, blur, brightness, glare, perspective, resolution, recommended_action FROM cl",
    ),
    "ocr_variant_choice": with_views(
        "quality",
        f"""WITH {_QUALITY}, v AS (SELECT *, blur <> 'low' OR resolution = 'low' OR perspective = 'severe' OR (partkey % 2 <> 0 AND partkey % 3 <> 0 AND partkey % 5 <> 0) AS recrop FROM cl)
            SELECT variant, recrop, count(*) AS images FROM (SELECT 'original' AS variant, recrop FROM v UNION ALL SELECT 'upscaled_2x', recrop FROM v WHERE resolution = 'low'
             UNION ALL SELECT 'contrast_enhanced', recrop FROM v WHERE glare = 'high' UNION ALL SELECT 'deskewed', recrop FROM v WHERE blur = 'high' AND has_quad) GROUP BY ALL""",
    ),
    "barcode_scale": with_views(
        "symbols",
        f"""WITH {_SCALE} SELECT image_id, CASE WHEN problem IS NULL THEN 'ESTABLISHED' ELSE 'NOT_VERIFIED' END AS status, CASE WHEN problem IS NULL THEN ppm END AS pixels_per_mm,
             coalesce(problem, 'decoded linear barcode matched configured GS1 nominal module geometry') AS reason,
             CASE WHEN problem IS NULL THEN round_even(height / 10 / ppm, 4) END AS font_height_mm,
             CASE WHEN problem IS NOT NULL THEN 'physical scale could not be established' END AS font_reason FROM pr""",
    ),
    "contour_boxes": with_views(
        "boxes",
        """WITH c AS (SELECT *, greatest(0, least(x, image_w - 1)) AS cx, greatest(0, least(y, image_h - 1)) AS cy FROM v_boxes WHERE w * h / (image_w * image_h) >= 0.08)
           SELECT image_id, ord, cx AS x, cy AS y, greatest(1, least(w, image_w - cx)) AS w, greatest(1, least(h, image_h - cy)) AS h FROM c""",
    ),
    "text_envelope": with_views(
        "components",
        """WITH e AS (SELECT image_id, min(x) - 8 AS x, min(y) - 8 AS y, max(x + w) - min(x) + 16 AS w, max(y + h) - min(y) + 16 AS h FROM v_components
             WHERE area BETWEEN 8 AND image_w * image_h * 0.02 AND w >= 2 AND h >= 2 GROUP BY image_id),
            c AS (SELECT *, greatest(0, least(x, 299)) AS cx, greatest(0, least(y, 319)) AS cy FROM e)
           SELECT image_id, cx AS x, cy AS y, greatest(1, least(w, 300 - cx)) AS w, greatest(1, least(h, 320 - cy)) AS h FROM c""",
    ),
    "suppress_overlaps": with_views(
        "boxes",
        f"""WITH l AS (SELECT image_id, list({{'ord': ord, 'x': x, 'y': y, 'w': w, 'h': h}} ORDER BY ord, x, y, w, h) AS bs FROM v_boxes GROUP BY image_id),
            k AS (SELECT image_id, unnest(list_reduce(bs, lambda a, b: CASE WHEN len(list_filter(a, lambda k: {_IOU_BK} > 0.85)) > 0 THEN a ELSE list_append(a, b) END, bs[1:0])) AS b FROM
             (SELECT image_id, bs FROM l))
            SELECT image_id, b.ord AS ord, b.x AS x, b.y AS y, b.w AS w, b.h AS h FROM k""",
    ),
    "score_regions": with_views("boxes", f"WITH {_SCORE} SELECT image_id, ord, relative_area, centrality, score FROM sco"),
    "top_regions": with_views("boxes", f"WITH {_SCORE} SELECT image_id, ord, rank, score FROM top WHERE rank <= 3"),
    "region_hint": with_views(
        "boxes scans",
        f"""WITH {_SCORE} SELECT s.scan_id AS image_id, CASE WHEN score IS NULL THEN 'no_candidate_detected' ELSE 'candidate_available' END AS status, score, source
            FROM v_scans s LEFT JOIN (SELECT * FROM top WHERE rank = 1) t ON t.image_id = s.scan_id""",
    ),
}

"""Catalog, declaration and rule queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelspark import fixed
from labelspark.functions.display import format_value
from labelspark.functions.fusion import typed_value
from labelspark.operators import catalog as C
from labelspark.operators import declarations as D
from labelspark.operators import ensemble as E
from labelspark.operators import rules as R
from labelspark.plans.extraction_queries import (
    CAUTION_SQL, MAKER_SQL, NUTRITION_SQL, PRICE_SQL, QUANTITY_SQL, _EXPIRES, _MADE,
)
from labelspark.plans.judging import LabelInputs, declare, judge, judged_declarations, read_once
from labelspark.plans.text_queries import ENSEMBLE_SQL
from labelspark.plans.views import label_lines, table, view, with_views
from labelspark.functions.fields import catalog_quantity

RULE_SETS = [f"set-{i}" for i in range(5)]


def _catalog(spark, sf_dir):
    parsed = catalog_quantity(F.col("quantity"))
    return view(spark, sf_dir, "catalog").select(
        "barcode", "source_rank", "name", "brand", "category", "manufacturer",
        parsed["value"].alias("quantity_value"), parsed["unit"].alias("quantity_unit"),
        F.col("mrp").alias("mrp_amount"), F.when(F.col("mrp").isNotNull(), "INR").alias("mrp_currency"),
    )


def _cache(spark, sf_dir):
    fields = [
        F.col("name").alias(c) if c == "name" else F.lit(None).cast("double" if c.endswith(("value", "amount")) else "string").alias(c)
        for c in C.PRODUCT_FIELDS
    ]
    return view(spark, sf_dir, "product_cache").select("barcode", F.when(F.col("found"), F.struct(*fields)).alias("product"))


def _scans(spark, sf_dir):
    return view(spark, sf_dir, "scans").select(
        "scan_id", "category", F.lit("India").alias("jurisdiction"), F.to_date("created_at").alias("inspection_date")
    )


def inputs(spark, sf_dir) -> LabelInputs:
    return LabelInputs(
        lines=label_lines(spark, sf_dir), scans=_scans(spark, sf_dir),
        symbols=view(spark, sf_dir, "scan_symbols"), catalog=_catalog(spark, sf_dir), cache=_cache(spark, sf_dir),
        rule_sets=view(spark, sf_dir, "rule_sets"), rules=R.seeded_rules(spark, RULE_SETS),
    )


def _deduped(spark, sf_dir):
    return C.dedupe_symbols(view(spark, sf_dir, "scan_symbols"))


def _dedupe(spark, sf_dir):
    return _deduped(spark, sf_dir).select("scan_id", "data", "format", "source_image")


def _mismatch(spark, sf_dir):
    return C.symbol_mismatch(_deduped(spark, sf_dir))


def _symbol_evidence(spark, sf_dir):
    return C.symbol_evidence(_deduped(spark, sf_dir), C.resolve_images(view(spark, sf_dir, "images")))


def _resolve_images(spark, sf_dir):
    return C.resolve_images(view(spark, sf_dir, "images"))


def _answers(spark, sf_dir):
    keys = _deduped(spark, sf_dir).filter("format <> 'QRCODE'").select(F.col("data").alias("barcode"))
    return C.lookup(keys, _cache(spark, sf_dir), _catalog(spark, sf_dir))


def _lookup(spark, sf_dir):
    return _answers(spark, sf_dir).select(
        "barcode", "valid_key", "in_cache", "source_rank", F.col("product.name").alias("name"),
        F.col("product.manufacturer").alias("manufacturer"), F.col("product.quantity_value").alias("quantity_value"),
        F.col("product.quantity_unit").alias("quantity_unit"), F.col("product.mrp_amount").alias("mrp_amount"),
    )


def _first_resolved(spark, sf_dir):
    return C.first_resolved(_deduped(spark, sf_dir), _answers(spark, sf_dir)).select(
        "scan_id", "barcode", F.col("product.name").alias("name")
    )


def _new_products(spark, sf_dir):
    deduped = _deduped(spark, sf_dir)
    # Every second product has no code yet.
    products = view(spark, sf_dir, "products").withColumn("barcode_code", F.when(F.col("product_id") % 2 == 0, F.col("barcode_code")))
    resolved = C.first_resolved(deduped, _answers(spark, sf_dir))
    return C.new_products(resolved, products, deduped).select(
        "barcode_code", "barcode_format", "identity", "manufacturer", "quantity_value"
    )


def _cache_upsert(spark, sf_dir):
    old = _cache(spark, sf_dir).select("barcode", F.col("product.name").alias("name"), F.lit(1).alias("fetched_at"))
    fresh = _answers(spark, sf_dir).select("barcode", F.col("product.name").alias("name"), F.lit(2).alias("fetched_at"))
    return C.newest_cache(old, fresh)


def _company_pages(spark, sf_dir):
    """Pages with a company cell or entry made from their host."""
    host = F.regexp_extract("url", "^https?://([^/?#]+)", 1)
    cell = (
        F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('<td class="the company name"> '), host, F.lit(" </td>")))
        .when(F.col("page_id") % 3 == 1, F.concat(F.lit('<script>{"companyName" : "'), host, F.lit('"}</script>')))
        .otherwise("")
    )
    pages = table(spark, sf_dir, "pages").withColumn("html", F.concat("html", cell))
    return C.company_records(pages).select("page_id", "manufacturer")


def _scale(spark, sf_dir):
    return C.scale_per_panel(view(spark, sf_dir, "scan_symbols")).select("scan_id", "panel", "scale.status", "scale.pixels_per_mm")


def _select_rulesets(spark, sf_dir):
    return R.select_rulesets(_scans(spark, sf_dir), view(spark, sf_dir, "rule_sets")).select(
        "scan_id", "rule_set_id", "rule_set_error"
    )


def _quarantine(spark, sf_dir):
    return R.without_ruleset(R.select_rulesets(_scans(spark, sf_dir), view(spark, sf_dir, "rule_sets"))).select(
        "scan_id", "category", "rule_set_error"
    )


def _active_rules(spark, sf_dir):
    """Rules in force on the day of the latest order before 1998."""
    day = view(spark, sf_dir, "scans").filter("created_at < '1998-01-01'").agg(F.max(F.to_date("created_at")).alias("d"))
    rule_sets = view(spark, sf_dir, "rule_sets")
    asked = day.select(F.lit("India").alias("jurisdiction"), F.col("d").alias("inspection_date"))
    chosen = R.select_rulesets(asked, rule_sets).filter("rule_set_id is not null").select("rule_set_id")
    return R.seeded_rules(spark, RULE_SETS).join(chosen, "rule_set_id", "left_semi").select(
        "rule_set_id", "rule_id", "required_declaration", "clause", "applicability"
    )


def _table_declarations(spark, sf_dir):
    """Typed declarations of the relational table: values follow the field."""
    d = view(spark, sf_dir, "declarations")
    n, f = F.col("declaration_id"), F.col("field_name")
    value = (
        F.when(f == "mrp", typed_value(amount=(n % 500).cast("double") - 20, currency=F.lit("INR")))
        .when(f == "net_quantity", typed_value(value=(n % 90).cast("double"), unit=F.when(n % 3 == 0, "KG").when(n % 3 == 1, "lbs").otherwise("ml")))
        .when(f == "manufacturer", typed_value(name=F.when(n % 4 == 0, "  ").otherwise("Maker")))
        .when(f.isin("manufacture_date", "expiry_date"), typed_value(month=(n % 14).cast("int"), year=F.when(n % 5 != 0, 2024).cast("int")))
        .when(f == "cautions", typed_value(present=n % 2 == 0))
    )
    scale = F.struct(F.lit("ESTABLISHED").alias("status"), F.lit(12.0).alias("pixels_per_mm"))
    # A row of a field that no rule knows leaves its own field undeclared.
    return (
        d.withColumn("value", F.when(n % 13 != 0, value)).withColumn("scale", scale)
        .withColumn("field_name", F.when(n % 11 == 3, "batch_no").otherwise(f))
    )


def _evaluate_table(spark, sf_dir):
    declared = R.declared_array(_table_declarations(spark, sf_dir).select("scan_id", "declaration_id", *R.JUDGED), ["declaration_id"])
    scans = R.select_rulesets(_scans(spark, sf_dir), view(spark, sf_dir, "rule_sets"))
    return R.evaluate(scans.join(declared, "scan_id", "left"), R.seeded_rules(spark, RULE_SETS))


def _font_sizes(spark, sf_dir):
    """Rules of 2 to 4 mm against heights in pixels and the scale of each scan's front."""
    height = F.when(F.col("declaration_id") % 7 != 0, (F.col("declaration_id") % 60).cast("double"))
    declarations = (
        _table_declarations(spark, sf_dir).drop("scale")
        .join(C.scale_per_scan(view(spark, sf_dir, "scan_symbols")).select("scan_id", F.col("scale_front").alias("scale")), "scan_id", "left")
        .withColumn("value", F.when(F.col("value").isNotNull(), F.col("value").withField("font_height_px", height)))
    )
    sized = F.col("conditions").withField("min_font_size_mm", F.lit(2.0)).withField("max_font_size_mm", F.lit(4.0))
    scans = R.select_rulesets(_scans(spark, sf_dir), view(spark, sf_dir, "rule_sets"))
    declared = R.declared_array(declarations.select("scan_id", "declaration_id", *R.JUDGED), ["declaration_id"])
    rules = R.seeded_rules(spark, RULE_SETS).withColumn("conditions", sized)
    return R.evaluate(scans.join(declared, "scan_id", "left"), rules).select("scan_id", "rule_id", "field_name", "verdict", "confidence")


def _rule_results(spark, sf_dir):
    return _evaluate_table(spark, sf_dir).select("scan_id", "rule_id", "field_name", "verdict", "confidence")


def _overall(spark, sf_dir):
    return R.overall_status(_evaluate_table(spark, sf_dir))


def _reason_counts(spark, sf_dir):
    return _evaluate_table(spark, sf_dir).groupBy("field_name", "verdict", "reason").agg(F.count("*").alias("n"))


def _conflict_values(spark, sf_dir):
    rows = D.conflict_rows(declare(inputs(spark, sf_dir)))
    return rows.select("scan_id", "field_name", "source_type", format_value(F.col("field_name"), F.col("value")).alias("display"))


def _declarations(spark, sf_dir):
    rows = D.declaration_rows(declare(inputs(spark, sf_dir))).filter("field_name <> 'nutrition_facts'")
    return rows.select(
        "scan_id", "field_name", "verdict", "reason", "confidence", "panel", "raw_text",
        format_value(F.col("field_name"), F.col("value")).alias("display"),
    )


def _evidence(spark, sf_dir):
    data = read_once(inputs(spark, sf_dir))
    candidates = E.field_candidates(data.lines, D.FUSED)
    rows = D.evidence_rows(declare(data), candidates, C.resolve_images(view(spark, sf_dir, "images")))
    return rows.groupBy("field_name", "source_type", "preprocessing_variant").agg(
        F.count("*").alias("n"), F.count_if(F.col("image_id").isNull()).alias("without_image")
    )


def _scan_verdicts(spark, sf_dir):
    return judged_declarations(inputs(spark, sf_dir)).select(
        "scan_id", "field_name", "verdict", "confidence", "rule_id"
    )


def _status_counts(spark, sf_dir):
    _, results = judge(inputs(spark, sf_dir))
    return R.overall_status(results).groupBy("overall_status").agg(F.count("*").alias("scans"))


def _compliance(spark, sf_dir):
    return R.compliance_results(judged_declarations(inputs(spark, sf_dir))).groupBy("field_name", "rule_id", "status").agg(
        F.count("*").alias("n"), F.count_if(F.col("details").contains("per_nutrient")).alias("with_nutrients")
    )


QUERIES = {
    "dedupe_symbols": _dedupe,
    "symbol_mismatch": _mismatch,
    "symbol_evidence": _symbol_evidence,
    "resolve_images": _resolve_images,
    "catalog_lookup": _lookup,
    "first_resolved_barcode": _first_resolved,
    "upsert_products": _new_products,
    "upsert_product_cache": _cache_upsert,
    "extract_company_html": _company_pages,
    "scale_per_panel": _scale,
    "select_ruleset": _select_rulesets,
    "ruleset_quarantine": _quarantine,
    "active_rules": _active_rules,
    "rule_results": _rule_results,
    "font_size_rules": _font_sizes,
    "rule_reasons": _reason_counts,
    "worst_status": _overall,
    "scan_declarations": _declarations,
    "scan_conflict_values": _conflict_values,
    "scan_evidence": _evidence,
    "scan_verdicts": _scan_verdicts,
    "scan_status_counts": _status_counts,
    "compliance_results": _compliance,
}

# ------------------------------------------------------------------------------ oracles

_SYMBOLS_SQL = f"""
sym AS (SELECT *, row_number() OVER (PARTITION BY scan_id, data ORDER BY CASE WHEN panel = 'front' THEN 0 ELSE 1 END, ord) AS rn,
   min(panel) OVER (PARTITION BY scan_id, data) <> max(panel) OVER (PARTITION BY scan_id, data) AS on_both FROM v_scan_symbols),
ded AS (SELECT scan_id, data, format, CASE WHEN on_both THEN 'both' ELSE panel END AS source_image,
   (CASE WHEN panel = 'front' THEN 0 ELSE 1 END) * 1000 + ord AS o FROM sym WHERE rn = 1),
cat AS (SELECT *, CAST(regexp_extract(quantity, '{fixed.CATALOG_QUANTITY}', 1) AS DOUBLE) AS qv,
   lower(regexp_extract(quantity, '{fixed.CATALOG_QUANTITY}', 2)) AS qu FROM v_catalog),
ans AS (SELECT k.barcode, c.barcode IS NOT NULL AS in_cache, CASE WHEN c.barcode IS NULL THEN t.source_rank END AS source_rank,
   CASE WHEN c.barcode IS NULL THEN t.barcode IS NOT NULL ELSE c.found END AS hit,
   CASE WHEN c.barcode IS NULL THEN t.name ELSE c.name END AS name,
   CASE WHEN c.barcode IS NULL THEN t.manufacturer END AS manufacturer,
   CASE WHEN c.barcode IS NULL THEN t.qv END AS quantity_value, CASE WHEN c.barcode IS NULL THEN t.qu END AS quantity_unit,
   CASE WHEN c.barcode IS NULL THEN t.mrp END AS mrp_amount
  FROM (SELECT DISTINCT data AS barcode FROM ded WHERE format <> 'QRCODE') k
  LEFT JOIN v_product_cache c ON c.barcode = k.barcode LEFT JOIN cat t ON t.barcode = k.barcode),
tried AS (SELECT d.scan_id, d.o, d.data AS barcode, a.hit, a.name, a.manufacturer, a.quantity_value, a.quantity_unit, a.mrp_amount
  FROM ded d JOIN ans a ON a.barcode = d.data WHERE d.format <> 'QRCODE'),
res AS (SELECT scan_id, coalesce(arg_min(barcode, o) FILTER (WHERE hit), arg_max(barcode, o)) AS barcode,
   bool_or(hit) AS hit,
   first(name ORDER BY o) FILTER (WHERE hit) AS name, first(manufacturer ORDER BY o) FILTER (WHERE hit) AS manufacturer,
   first(quantity_value ORDER BY o) FILTER (WHERE hit) AS quantity_value, first(quantity_unit ORDER BY o) FILTER (WHERE hit) AS quantity_unit,
   first(mrp_amount ORDER BY o) FILTER (WHERE hit) AS mrp_amount FROM tried GROUP BY scan_id)"""
_SYM = "scan_symbols catalog product_cache"
_IMAGES_SQL = """
img AS (SELECT image_id, scan_id, url, coalesce(label, 'front') AS label FROM v_images WHERE starts_with(url, '/uploads/')),
pimg AS (SELECT scan_id, min(image_id) FILTER (WHERE label = 'front') AS front_image,
  min(image_id) FILTER (WHERE label = 'back') AS back_image, min(image_id) AS first_image FROM img GROUP BY scan_id)"""

_RULE_VALUES = ", ".join(
    f"({i}, '{r[0]}', '{r[4]}', '{r[3]}', {str(r[5]).lower()}, {r[6]}::DOUBLE, '{r[7] or ''}', '{r[2]}')"
    for i, r in enumerate(fixed.SEED_RULES)
)
_RULESET_SQL = f"""
dated AS (SELECT s.scan_id, s.category, count(r.rule_set_id) AS sets, min(r.rule_set_id) AS only_set
  FROM v_scans s LEFT JOIN v_rule_sets r ON r.effective_from <= CAST(s.created_at AS DATE)
   AND (r.effective_to IS NULL OR r.effective_to > CAST(s.created_at AS DATE)) GROUP BY ALL),
rules(ord, rule_id, field_name, applies, must, minimum, fmt, clause) AS (VALUES {_RULE_VALUES}),
placed AS (SELECT d.scan_id, d.category, r.* FROM dated d CROSS JOIN rules r WHERE d.sets = 1)"""


def _judge_sql(declared: str) -> str:
    """Verdict of rules against `declared` (scan_id, field_name, present, verdict, confidence, problem)."""
    return f"""
judged AS (SELECT p.scan_id, p.rule_id, p.ord, p.field_name, p.minimum, d.problem, d.confidence AS given, d.scan_id IS NOT NULL AS has,
  CASE WHEN p.category IS NOT NULL AND NOT contains(lower(p.applies), 'all') AND NOT contains(lower(p.applies), lower(p.category)) THEN 'NOT_APPLICABLE'
   WHEN d.scan_id IS NULL THEN CASE WHEN p.must THEN 'VIOLATION' ELSE 'NOT_APPLICABLE' END
   WHEN d.verdict = 'CONFLICT' THEN 'CONFLICT' WHEN d.confidence < p.minimum THEN 'NOT_VERIFIED'
   WHEN p.must AND NOT d.present THEN 'VIOLATION' WHEN d.problem THEN 'VIOLATION' ELSE 'SATISFIED' END AS verdict
 FROM placed p LEFT JOIN {declared} d ON d.scan_id = p.scan_id AND d.field_name = p.field_name),
outcome AS (SELECT *, CASE WHEN verdict = 'NOT_APPLICABLE' OR NOT has THEN NULL ELSE given END AS confidence FROM judged)"""


_TABLE_DECLARED = """
td AS (SELECT scan_id, CASE WHEN declaration_id % 11 = 3 THEN 'batch_no' ELSE field_name END AS field_name, verdict, confidence, declaration_id % 13 <> 0 AND field_name <> 'nutrition_facts' AS present,
  CASE field_name WHEN 'mrp' THEN declaration_id % 13 = 0 OR declaration_id % 500 < 20
   WHEN 'net_quantity' THEN declaration_id % 13 = 0 OR declaration_id % 3 = 1
   WHEN 'manufacturer' THEN declaration_id % 13 = 0 OR declaration_id % 4 = 0
   WHEN 'manufacture_date' THEN declaration_id % 13 = 0 OR declaration_id % 5 = 0 OR declaration_id % 14 NOT BETWEEN 1 AND 12
   WHEN 'expiry_date' THEN declaration_id % 13 = 0 OR declaration_id % 5 = 0 OR declaration_id % 14 NOT BETWEEN 1 AND 12
   WHEN 'nutrition_facts' THEN true ELSE false END AS problem
 FROM v_declarations)"""
_FRONT_SCALE = f"""
fs AS (SELECT scan_id, round_even(arg_max(greatest(width, height), ord) / {fixed.SYMBOL_WIDTH_MM!r}::DOUBLE, 6) AS per_mm FROM v_scan_symbols
  WHERE panel = 'front' AND format = 'EAN13' AND width > 0 AND height > 0 AND greatest(width, height) >= 95
   AND greatest(width, height) / least(width, height) >= 1.5 GROUP BY scan_id)"""
# A height is known where the declaration has a value and a height above 0, on a panel with a scale.
_FONT_SQL = f"""{_RULESET_SQL}, {_FRONT_SCALE},
fd AS (SELECT d.scan_id, CASE WHEN declaration_id % 11 = 3 THEN 'batch_no' ELSE field_name END AS field_name, verdict, confidence,
  CASE WHEN declaration_id % 13 <> 0 AND field_name <> 'nutrition_facts' AND declaration_id % 7 <> 0 AND declaration_id % 60 > 0
   THEN round_even((declaration_id % 60)::DOUBLE / per_mm, 4) END AS mm
 FROM v_declarations d LEFT JOIN fs ON fs.scan_id = d.scan_id),
judged AS (SELECT p.scan_id, p.rule_id, p.field_name, d.confidence AS given, d.scan_id IS NOT NULL AS has,
  CASE WHEN p.category IS NOT NULL AND NOT contains(lower(p.applies), 'all') AND NOT contains(lower(p.applies), lower(p.category)) THEN 'NOT_APPLICABLE'
   WHEN d.scan_id IS NULL THEN CASE WHEN p.must THEN 'VIOLATION' ELSE 'NOT_APPLICABLE' END
   WHEN d.verdict = 'CONFLICT' THEN 'CONFLICT' WHEN mm IS NULL THEN 'NOT_VERIFIED'
   WHEN mm BETWEEN 2.0 AND 4.0 THEN 'SATISFIED' ELSE 'VIOLATION' END AS verdict
 FROM placed p LEFT JOIN fd d ON d.scan_id = p.scan_id AND d.field_name = p.field_name)
SELECT scan_id, rule_id, field_name, verdict, CASE WHEN verdict = 'NOT_APPLICABLE' OR NOT has THEN NULL ELSE given END AS confidence FROM judged"""
_TABLE_RULES = f"{_RULESET_SQL}, {_TABLE_DECLARED}, {_judge_sql('td')}"
_WORST = (
    "coalesce((['VIOLATION', 'CONFLICT', 'NOT_VERIFIED', 'SATISFIED'])[min(CASE verdict WHEN 'VIOLATION' THEN 1 WHEN 'CONFLICT' THEN 2"
    " WHEN 'NOT_VERIFIED' THEN 3 WHEN 'SATISFIED' THEN 4 END)], 'NOT_APPLICABLE')"
)

# Declarations of the composed job except nutrition, whose reading is a fold over lines.
_UNITS = "CASE lower({0}) WHEN 'kg' THEN 1000.0::DOUBLE WHEN 'oz' THEN 28.3495::DOUBLE WHEN 'lb' THEN 453.592::DOUBLE WHEN 'l' THEN 1000.0::DOUBLE ELSE 1.0::DOUBLE END"


def _near(a: str, b: str) -> str:
    return (
        f"(CASE WHEN {a} = 0 AND {b} = 0 THEN true WHEN {a} = 0 OR {b} = 0 THEN false"
        f" ELSE abs({a} - {b}) / greatest({a}, {b}) <= 0.01::DOUBLE END)"
    )


def _fused_sql(field: str, found: str, ocr: str, provider: str, same: str, ocr_text: str, provider_text: str) -> str:
    conflict = f"(coalesce(e.status = 'conflict', false) OR ({ocr} IS NOT NULL AND {provider} IS NOT NULL AND NOT {same}))"
    return f"""SELECT s.scan_id, '{field}' AS field_name,
   CASE WHEN {conflict} THEN 'CONFLICT' WHEN {ocr} IS NULL AND {provider} IS NULL THEN 'NOT_VERIFIED' ELSE 'SATISFIED' END AS verdict,
   CASE WHEN {conflict} THEN 'conflicting evidence for ''{field}''' || CASE WHEN NOT {same} THEN coalesce(': OCR=' || {ocr_text} || ' vs provider=' || {provider_text}, '') ELSE '' END WHEN {ocr} IS NULL AND {provider} IS NULL THEN '{field} not found in any evidence source' END AS reason,
   CASE WHEN {conflict} THEN 0.0::DOUBLE WHEN {provider} IS NOT NULL THEN 1.0::DOUBLE ELSE coalesce(f.confidence, 0.0::DOUBLE) END AS confidence,
   coalesce(f.panel, 'front') AS panel, coalesce(f.raw_text, '') AS raw_text,
   CASE WHEN {conflict} THEN '—' WHEN {provider} IS NOT NULL THEN {provider_text} ELSE coalesce({ocr_text}, '—') END AS display,
   NOT {conflict} AND ({ocr} IS NOT NULL OR {provider} IS NOT NULL) AS present
  FROM sids s LEFT JOIN {found} f ON f.scan_id = s.scan_id LEFT JOIN res p ON p.scan_id = s.scan_id
  LEFT JOIN ensemble e ON e.scan_id = s.scan_id AND e.field_name = '{field}'"""


def _money(amount: str, currency: str) -> str:
    return f"CASE {currency} WHEN 'USD' THEN '$' WHEN 'EUR' THEN '€' ELSE '₹' END || CAST({amount} AS VARCHAR)"


_DATE_TEXT = (
    "CASE WHEN {0}.year = 0 THEN '—' ELSE coalesce(CAST(nullif({0}.day, 0) AS VARCHAR) || ' ', '') ||"
    " (['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'])[{0}.month] || ' ' || CAST({0}.year AS VARCHAR) END"
)


def _date_declared(field: str, found: str) -> str:
    return f"""SELECT s.scan_id, '{field}' AS field_name,
   CASE WHEN clash THEN 'CONFLICT' WHEN f.confidence >= 0.6 THEN 'SATISFIED' ELSE 'NOT_VERIFIED' END AS verdict,
   CASE WHEN clash THEN 'expiry date is chronologically before manufacture date' WHEN f.scan_id IS NULL THEN '{field} not found in any evidence source' END AS reason,
   coalesce(f.confidence, 0.0::DOUBLE) AS confidence, coalesce(f.panel, 'front') AS panel, coalesce(f.raw_text, '') AS raw_text,
   coalesce({_DATE_TEXT.format('f')}, '—') AS display, f.scan_id IS NOT NULL AS present
  FROM clash s LEFT JOIN {found} f ON f.scan_id = s.scan_id"""


_FUSED_ARGS = [
    ("mrp", "price", "f.amount", "p.mrp_amount", _near("f.amount", "p.mrp_amount"), _money("f.amount", "f.currency"), _money("p.mrp_amount", "'INR'")),
    (
        "net_quantity", "quantity", "f.value", "p.quantity_value",
        _near(f"f.value * {_UNITS.format('f.unit')}", f"p.quantity_value * {_UNITS.format('p.quantity_unit')}"),
        "CAST(f.value AS VARCHAR) || ' ' || f.unit", "CAST(p.quantity_value AS VARCHAR) || ' ' || p.quantity_unit",
    ),
    ("manufacturer", "maker", "f.name", "p.manufacturer", "lower(trim(f.name)) = lower(trim(p.manufacturer))", "f.name", "p.manufacturer"),
]


def _clash_sql(field: str, found: str, ocr: str, provider: str, same: str, ocr_text: str, provider_text: str) -> str:
    return f"""SELECT f.scan_id, '{field}' AS field_name, unnest(['OCR', 'PRODUCT_DATABASE']) AS source_type,
   unnest([{ocr_text}, {provider_text}]) AS display FROM sids s JOIN {found} f ON f.scan_id = s.scan_id JOIN res p ON p.scan_id = s.scan_id
  WHERE {ocr} IS NOT NULL AND {provider} IS NOT NULL AND NOT {same}"""


_DECLARED_SQL = f"""
{PRICE_SQL}, {QUANTITY_SQL}, {MAKER_SQL}, {_MADE}, {_EXPIRES}, {CAUTION_SQL}, {ENSEMBLE_SQL}, {_SYMBOLS_SQL},
sids AS (SELECT scan_id FROM v_scans),
clash AS (SELECT s.scan_id, coalesce(e.year < m.year OR (e.year = m.year AND (e.month < m.month OR (e.month = m.month AND e.day <= m.day))), false) AS clash
  FROM sids s LEFT JOIN made m ON m.scan_id = s.scan_id LEFT JOIN expires e ON e.scan_id = s.scan_id),
decl AS ({' UNION ALL '.join(_fused_sql(*args) for args in _FUSED_ARGS)}
 UNION ALL {_date_declared('manufacture_date', 'made')} UNION ALL {_date_declared('expiry_date', 'expires')}
 UNION ALL SELECT s.scan_id, 'cautions', 'SATISFIED', NULL, coalesce(c.confidence, 0.95::DOUBLE), coalesce(c.panel, 'front'), coalesce(c.raw_text, ''),
  CASE WHEN c.present THEN 'Present: ' || c.text ELSE 'Not present' END, true FROM sids s LEFT JOIN caution c ON c.scan_id = s.scan_id)"""

_ALL_DECLARED_SQL = f"""{_DECLARED_SQL}, {NUTRITION_SQL}, {_IMAGES_SQL},
all_decl AS (SELECT scan_id, field_name, verdict, confidence, present, raw_text,
   field_name = 'net_quantity' AND present AND split_part(display, ' ', 2) NOT IN ('g', 'kg', 'ml', 'l') AS problem FROM decl
  UNION ALL SELECT s.scan_id, 'nutrition_facts',
   CASE WHEN len(list_filter(facts, lambda f: f.value IS NOT NULL)) > 0 THEN 'SATISFIED' ELSE 'NOT_VERIFIED' END,
   CASE WHEN len(facts) > 0 THEN list_reduce(list_transform(facts, lambda f: f.confidence), lambda a, b: a + b, 0.0::DOUBLE) / len(facts) ELSE 0.0::DOUBLE END,
   coalesce(len(facts) > 0, false), '', coalesce(len(list_filter(facts, lambda f: f.value IS NOT NULL)) = 0, false)
  FROM sids s LEFT JOIN nutrition n ON n.scan_id = s.scan_id)"""
_VERDICT_VIEWS = "label_lines scans rule_sets images " + _SYM
_VERDICT_SQL = f"""{_ALL_DECLARED_SQL}, {_RULESET_SQL}, {_judge_sql('all_decl')},
final AS (SELECT d.scan_id, d.field_name, coalesce(o.verdict, d.verdict) AS verdict,
   CASE WHEN o.scan_id IS NULL THEN d.confidence ELSE coalesce(o.confidence, 0.0::DOUBLE) END AS confidence, o.rule_id
  FROM all_decl d LEFT JOIN outcome o ON o.scan_id = d.scan_id AND o.field_name = d.field_name WHERE d.scan_id IN (SELECT scan_id FROM v_scans))"""
_ENSEMBLE_FIELDS = "('mrp', 'net_quantity', 'manufacturer')"
_EVIDENCE_SQL = f"""{_ALL_DECLARED_SQL},
inconf AS (SELECT scan_id, field_name FROM ensemble WHERE status = 'conflict' AND field_name IN {_ENSEMBLE_FIELDS}),
ev AS (SELECT d.scan_id, d.field_name, 'OCR' AS source_type, 'ocr_single_pass' AS preprocessing_variant FROM all_decl d
   LEFT JOIN inconf i ON i.scan_id = d.scan_id AND i.field_name = d.field_name WHERE raw_text <> '' AND i.scan_id IS NULL
  UNION ALL SELECT d.scan_id, d.field_name, 'PRODUCT_DATABASE', 'provider_lookup' FROM all_decl d JOIN res p ON p.scan_id = d.scan_id
   LEFT JOIN inconf i ON i.scan_id = d.scan_id AND i.field_name = d.field_name WHERE i.scan_id IS NULL AND
   CASE d.field_name WHEN 'mrp' THEN p.mrp_amount IS NOT NULL WHEN 'net_quantity' THEN p.quantity_value IS NOT NULL
    WHEN 'manufacturer' THEN p.manufacturer IS NOT NULL ELSE false END
  UNION ALL SELECT c.scan_id, c.field_name, 'OCR', 'single_pass' FROM cand c JOIN inconf i ON i.scan_id = c.scan_id AND i.field_name = c.field_name
  UNION ALL SELECT scan_id, unnest(['manufacture_date', 'expiry_date']), 'OCR', 'date_cross_check' FROM clash WHERE clash
  UNION ALL SELECT scan_id, 'nutrition_facts', 'OCR', 'ocr_single_pass' FROM (SELECT scan_id, unnest(facts) AS f FROM nutrition))"""

ORACLE = {
    "scan_verdicts": with_views(_VERDICT_VIEWS, f"WITH {_VERDICT_SQL} SELECT * FROM final"),
    "scan_status_counts": with_views(
        _VERDICT_VIEWS,
        f"""WITH {_VERDICT_SQL}, w AS (SELECT scan_id, {_WORST} AS overall_status FROM outcome WHERE scan_id IN (SELECT scan_id FROM sids) GROUP BY scan_id)
            SELECT overall_status, count(*) AS scans FROM w GROUP BY ALL""",
    ),
    "compliance_results": with_views(
        _VERDICT_VIEWS,
        f"""WITH {_VERDICT_SQL} SELECT field_name, rule_id, verdict AS status, count(*) AS n,
             count(*) FILTER (WHERE field_name = 'nutrition_facts' AND len(facts) > 0) AS with_nutrients
            FROM final f LEFT JOIN nutrition n ON n.scan_id = f.scan_id WHERE rule_id IS NOT NULL GROUP BY ALL""",
    ),
    "scan_evidence": with_views(
        "label_lines scans images " + _SYM,
        f"""WITH {_EVIDENCE_SQL} SELECT field_name, source_type, preprocessing_variant, count(*) AS n,
             count(*) FILTER (WHERE preprocessing_variant = 'date_cross_check' OR scan_id NOT IN (SELECT scan_id FROM pimg)) AS without_image
            FROM ev GROUP BY ALL""",
    ),
    "dedupe_symbols": with_views(_SYM, f"WITH {_SYMBOLS_SQL} SELECT scan_id, data, format, source_image FROM ded"),
    "symbol_mismatch": with_views(
        _SYM,
        f"WITH {_SYMBOLS_SQL} SELECT scan_id, count(*) AS barcodes FROM ded WHERE format <> 'QRCODE' GROUP BY scan_id HAVING count(*) > 1",
    ),
    "symbol_evidence": with_views(
        _SYM + " images",
        f"""WITH {_SYMBOLS_SQL}, {_IMAGES_SQL} SELECT d.scan_id, CASE WHEN format = 'QRCODE' THEN 'QR' ELSE 'BARCODE' END AS source_type,
            format || ': ' || data || CASE WHEN format <> 'QRCODE' THEN '' WHEN starts_with(data, 'https') THEN ' (type=url)'
             WHEN contains(data, '=') THEN ' (type=structured_data)' ELSE ' (type=plain_text)' END AS raw_text, 1.0::DOUBLE AS confidence,
            coalesce(CASE source_image WHEN 'front' THEN front_image WHEN 'back' THEN back_image END, first_image) AS image_id
            FROM ded d LEFT JOIN pimg ON pimg.scan_id = d.scan_id""",
    ),
    "resolve_images": with_views("images", f"WITH {_IMAGES_SQL} SELECT * FROM img"),
    "catalog_lookup": with_views(_SYM, f"WITH {_SYMBOLS_SQL} SELECT * EXCLUDE (hit), true AS valid_key FROM ans"),
    "first_resolved_barcode": with_views(_SYM, f"WITH {_SYMBOLS_SQL} SELECT scan_id, barcode, name FROM res"),
    "upsert_products": with_views(
        _SYM + " products",
        f"""WITH {_SYMBOLS_SQL}, f AS (SELECT scan_id, arg_min(format, o) AS fmt FROM ded GROUP BY scan_id),
            n AS (SELECT res.*, f.fmt, row_number() OVER (PARTITION BY barcode ORDER BY res.scan_id) AS rn FROM res JOIN f ON f.scan_id = res.scan_id
             WHERE barcode NOT IN (SELECT barcode_code FROM v_products WHERE product_id % 2 = 0))
            SELECT barcode AS barcode_code, fmt AS barcode_format, name AS identity, manufacturer, quantity_value FROM n WHERE rn = 1""",
    ),
    "upsert_product_cache": with_views(
        _SYM,
        f"""WITH {_SYMBOLS_SQL} SELECT barcode, name, 2 AS fetched_at FROM ans UNION ALL
            SELECT barcode, CASE WHEN found THEN name END, 1 FROM v_product_cache WHERE barcode NOT IN (SELECT barcode FROM ans)""",
    ),
    "extract_company_html": (
        "SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS manufacturer FROM pages"
        " WHERE page_id % 3 < 2 AND html IS NOT NULL AND regexp_extract(url, '^https?://([^/?#]+)', 1) <> ''"
    ),
    "scale_per_panel": with_views(
        "scan_symbols",
        f"""WITH u AS (SELECT *, format = 'EAN13' AND width > 0 AND height > 0 AND greatest(width, height) >= 95
              AND greatest(width, height) / least(width, height) >= 1.5 AS ok FROM v_scan_symbols)
            SELECT scan_id, panel, CASE WHEN bool_or(ok) THEN 'ESTABLISHED' ELSE 'NOT_VERIFIED' END AS status,
             round_even(arg_max(greatest(width, height), ord) FILTER (WHERE ok) / {fixed.SYMBOL_WIDTH_MM!r}::DOUBLE, 6) AS pixels_per_mm
            FROM u GROUP BY scan_id, panel""",
    ),
    "select_ruleset": with_views(
        "scans rule_sets",
        f"""WITH {_RULESET_SQL} SELECT scan_id, CASE WHEN sets = 1 THEN only_set END AS rule_set_id,
             CASE WHEN sets = 0 THEN 'no rule set' WHEN sets > 1 THEN 'overlapping rule sets' END AS rule_set_error FROM dated""",
    ),
    "ruleset_quarantine": with_views(
        "scans rule_sets",
        f"""WITH {_RULESET_SQL} SELECT scan_id, category, CASE WHEN sets = 0 THEN 'no rule set' ELSE 'overlapping rule sets' END AS rule_set_error
            FROM dated WHERE sets <> 1""",
    ),
    "active_rules": with_views(
        "scans rule_sets",
        f"""WITH {_RULESET_SQL}, d AS (SELECT max(CAST(created_at AS DATE)) AS d FROM v_scans WHERE created_at < TIMESTAMP '1998-01-01')
            SELECT rule_set_id, rule_id, field_name AS required_declaration, clause, applies AS applicability FROM rules, v_rule_sets, d
            WHERE effective_from <= d AND (effective_to IS NULL OR effective_to > d)""",
    ),
    "rule_results": with_views(
        "scans rule_sets declarations", f"WITH {_TABLE_RULES} SELECT scan_id, rule_id, field_name, verdict, confidence FROM outcome"
    ),
    "font_size_rules": with_views("scans rule_sets declarations scan_symbols", f"WITH {_FONT_SQL}"),
    "worst_status": with_views(
        "scans rule_sets declarations", f"WITH {_TABLE_RULES} SELECT scan_id, {_WORST} AS overall_status FROM outcome GROUP BY scan_id"
    ),
    "scan_conflict_values": with_views(
        "label_lines scans " + _SYM, f"WITH {_DECLARED_SQL} {' UNION ALL '.join(_clash_sql(*args) for args in _FUSED_ARGS)}"
    ),
    "scan_declarations": with_views(
        "label_lines scans " + _SYM,
        f"""WITH {_DECLARED_SQL} SELECT scan_id, field_name, verdict, reason, confidence, panel, raw_text, display FROM decl""",
    ),
}

"""Token, line, candidate and ensemble queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelspark import fixed
from labelspark.functions import fusion as FU
from labelspark.functions import geometry as G
from labelspark.functions.fields import catalog_quantity
from labelspark.functions.text import clamp_confidence, rounded
from labelspark.operators import ensemble as E
from labelspark.operators import extraction as X
from labelspark.operators import lines as L
from labelspark.plans.views import label_lines, table, tokens, view, with_views


def _tokens_to_lines(spark, sf_dir):
    return L.tokens_to_lines(tokens(spark, sf_dir)).select(
        "image_id", "line_num", "text", "x", "y", "w", "h", "confidence"
    )


def _clean_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "text", "CAST(n_chars % 1300 AS DOUBLE) / 1000 - 0.1D AS confidence"
    )
    return L.clean_lines(lines).select("doc_id", "text", "confidence")


def _clamped(spark, sf_dir):
    raw = F.when(F.col("user_id") % 7 == 0, "n/a").otherwise((F.col("value") / 64 - 0.125).cast("string"))
    return table(spark, sf_dir, "events").select("event_id", clamp_confidence(raw).alias("confidence"))


def _polygons(spark, sf_dir):
    corner = lambda x, y: F.struct((F.col("x") + x).alias("x"), (F.col("y") + y).alias("y"))
    w, h = F.col("w"), F.col("h")
    box = L.polygon_to_bbox(F.array(corner(0, 0), corner(w, 2), corner(w - 3, h), corner(-1, h - 1)))
    return view(spark, sf_dir, "boxes").select("image_id", "ord", box.alias("b")).select("image_id", "ord", "b.*")


def _first_provider(spark, sf_dir):
    return L.first_provider_with_output(view(spark, sf_dir, "variant_lines"))


def _merge_variants(spark, sf_dir):
    merged = L.merge_variant_lines(view(spark, sf_dir, "variant_lines"))
    return merged.select("image_id", "variant", "variant_rank", "ord", "text", "duplicate_of")


def _split_variants(spark, sf_dir, names):
    lines = view(spark, sf_dir, "variant_lines").drop("provider_rank")
    return lines.filter("variant = 'original'"), lines.filter(F.col("variant").isin(names))


def _append_variants(spark, sf_dir):
    base, variants = _split_variants(spark, sf_dir, ["upscaled_2x", "contrast_enhanced", "deskewed"])
    return L.append_new_variant_lines(base, variants)


def _append_crops(spark, sf_dir):
    base, crops = _split_variants(spark, sf_dir, ["bottom_crop_2x"])
    return L.append_new_crop_lines(base, crops)


def _merge_panels(spark, sf_dir):
    merged = L.merge_panels(label_lines(spark, sf_dir))
    return merged.select("scan_id", F.col("line_order.panel_rank").alias("panel_rank"), "line_no", "text")


def _expand(spark, sf_dir):
    return L.expand_lines(label_lines(spark, sf_dir)).select(
        "scan_id", "line_no", "text", "confidence", "is_normalized", "hint"
    )


def _normalized_values(spark, sf_dir):
    lines = label_lines(spark, sf_dir).selectExpr(
        "scan_id", "line_no", "text AS raw_text",
        "CASE WHEN line_no < 2000000000000000 THEN 'mrp' WHEN line_no < 4000000000000000 THEN 'manufacturer'"
        " ELSE 'nutrition_facts' END AS field_name",
    )
    tier = F.when(F.col("line_no") % 2 == 0, 1).otherwise(4)
    return L.attach_normalization(lines, tier).select(
        "scan_id", "line_no", F.size("normalized").alias("readings"),
        F.array_join(F.transform("normalized", lambda r: r["text"]), "|").alias("texts"),
        F.get("normalized", F.size("normalized") - 1)["penalty"].alias("penalty"),
    )


def _candidates(spark, sf_dir):
    return E.field_candidates(label_lines(spark, sf_dir)).select(
        "scan_id", "panel", "line_no", "text", "field_name", "context_hint"
    )


def _ensemble(spark, sf_dir):
    return E.ensemble(E.field_candidates(label_lines(spark, sf_dir)))


def _ensemble_missing(spark, sf_dir):
    lines = label_lines(spark, sf_dir)
    statuses = E.with_missing(E.ensemble(E.field_candidates(lines)), view(spark, sf_dir, "scans"))
    return statuses.groupBy("field_name", "status", "verification_state").agg(F.count("*").alias("scans"))


def _conflict_candidates(spark, sf_dir):
    candidates = E.field_candidates(label_lines(spark, sf_dir))
    return E.conflict_candidates(candidates, E.ensemble(candidates)).select(
        "scan_id", "field_name", "line_no", "description"
    )


def _pair_predicates(spark, sf_dir):
    """Each line against the first one of its scan: a linear set of pairs."""
    lines = label_lines(spark, sf_dir)
    other = lines.select(
        "scan_id", "line_no", "panel", F.col("text").alias("t2"), F.col("bbox").alias("b2"), F.col("confidence").alias("c2")
    )
    firsts = other.groupBy("scan_id").agg(F.min_by(F.struct("t2", "b2", "c2"), "line_no").alias("o"))
    return lines.join(firsts, "scan_id").select(
        "scan_id", "line_no", rounded(G.iou(F.col("bbox"), F.col("o.b2")), 6).alias("iou"),
        E.texts_agree(F.col("text"), F.col("o.t2")).alias("same_text"),
        E.boxes_agree(F.col("bbox"), F.col("o.b2")).alias("same_box"),
        E.confidence_similar(F.col("confidence"), F.col("o.c2")).alias("similar"),
    )


def _catalog_agreement(spark, sf_dir):
    products = view(spark, sf_dir, "products").withColumnRenamed("manufacturer", "maker")
    catalog = view(spark, sf_dir, "catalog").withColumn("q", catalog_quantity(F.col("quantity")))
    both = products.join(catalog, F.col("barcode_code") == F.col("barcode"))
    own = FU.typed_value(amount=F.col("mrp_amount"), currency=F.lit("INR"))
    theirs = F.when(F.col("mrp").isNotNull(), FU.typed_value(amount=F.col("mrp") * 1.005, currency=F.lit("INR")))
    maker = lambda c: F.when(F.col(c).isNotNull(), FU.typed_value(name=F.col(c)))
    ours = FU.typed_value(value=F.col("quantity_value"), unit=F.col("quantity_unit"))
    listed = FU.typed_value(value=F.col("q.value"), unit=F.col("q.unit"))
    fused = FU.fuse_field("manufacturer", maker("maker"), F.lit(0.7), maker("manufacturer"))
    return both.select(
        "barcode", FU.base_quantity(F.col("q.value"), F.col("q.unit")).alias("base_quantity"),
        FU.values_match("net_quantity", ours, listed).alias("quantity_match"),
        FU.values_match("mrp", own, theirs).alias("price_match"),
        FU.values_match("manufacturer", maker("maker"), maker("manufacturer")).alias("maker_match"),
        fused["status"].alias("maker_status"), fused["value"]["name"].alias("maker_name"),
        fused["confidence"].alias("maker_confidence"),
        FU.currency_mismatch(F.when(F.col("product_id") % 2 == 0, "inr ").otherwise("USD")).alias("mismatch"),
    )


QUERIES = {
    "tokens_to_lines": _tokens_to_lines,
    "clean_lines": _clean_lines,
    "clamp_confidence": _clamped,
    "polygon_to_bbox": _polygons,
    "first_provider_with_output": _first_provider,
    "merge_variant_lines": _merge_variants,
    "append_new_variant_lines": _append_variants,
    "append_new_crop_lines": _append_crops,
    "merge_panels": _merge_panels,
    "expand_lines": _expand,
    "attach_normalization": _normalized_values,
    "field_candidates": _candidates,
    "ensemble_status": _ensemble,
    "ensemble_counts": _ensemble_missing,
    "ensemble_conflict_candidates": _conflict_candidates,
    "pair_predicates": _pair_predicates,
    "catalog_agreement": _catalog_agreement,
}

# ------------------------------------------------------------------------------ oracles

_CANDIDATES_SQL = " UNION ALL ".join(
    f"SELECT scan_id, panel, line_no, trim(text) AS text, confidence, x, y, w, h, source_provider, '{name}' AS field_name,"
    f" '{hint}' AS context_hint FROM v_label_lines WHERE regexp_matches(trim(text), '{pattern}')"
    for name, pattern, hint in fixed.CANDIDATE_PATTERNS
)


def iou_sql(a: str, b: str) -> str:
    def side(s: str, d: str) -> str:
        return (
            f"greatest(0.0::DOUBLE, least({a}{s} + {a}{d}, {b}{s} + {b}{d}) - greatest({a}{s}, {b}{s}))"
        )

    shared = f"({side('x', 'w')} * {side('y', 'h')})"
    union = f"({a}w * {a}h + {b}w * {b}h - {shared})"
    return f"(CASE WHEN {union} = 0 THEN 0.0::DOUBLE ELSE {shared} / {union} END)"


_KEY_SQL = r"regexp_replace(lower(trim({0}text)), '\s+', ' ', 'g')"
_RANK = "CASE WHEN {0}panel = 'front' THEN 0 ELSE 1 END"
ENSEMBLE_SQL = f"""
cand AS ({_CANDIDATES_SQL}),
c AS (SELECT *, {_KEY_SQL.format('')} AS tk,
   row_number() OVER (PARTITION BY scan_id, field_name ORDER BY {_RANK.format('')}, line_no, text, source_provider) AS i FROM cand),
met AS (SELECT a.scan_id, a.field_name, a.i, a.text, a.confidence,
   count(*) FILTER (WHERE b.i <> a.i AND a.tk = b.tk AND {iou_sql('a.', 'b.')} >= 0.5) AS agreements,
   count(*) FILTER (WHERE b.i > a.i AND a.tk = b.tk AND {iou_sql('a.', 'b.')} >= 0.5
     AND abs(a.confidence - b.confidence) <= 0.1::DOUBLE) AS agreed
  FROM c a JOIN c b ON a.scan_id = b.scan_id AND a.field_name = b.field_name GROUP BY ALL),
ens AS (SELECT scan_id, field_name, count(*) AS candidates,
   CAST(sum(agreed) AS BIGINT) AS all_agreed,
   arg_max(text, (confidence * (1 + agreements), -i)) AS best_text,
   arg_max(confidence, (confidence * (1 + agreements), -i)) AS best_confidence FROM met GROUP BY ALL),
ensemble AS (SELECT scan_id, field_name, candidates,
   CASE WHEN candidates = 1 OR all_agreed > candidates * (candidates - 1) / 2.0 - all_agreed THEN 'agreed' ELSE 'conflict' END AS status,
   all_agreed, best_text, best_confidence FROM ens)"""
_ENSEMBLE_OUT = """SELECT scan_id, field_name, candidates, status,
 CASE WHEN status = 'agreed' THEN best_text END AS fused_value,
 CASE WHEN status = 'agreed' THEN best_confidence ELSE 0.0::DOUBLE END AS fused_confidence,
 CASE WHEN status = 'agreed' AND candidates > 1 THEN all_agreed ELSE 0 END AS agreed_pairs,
 CASE WHEN status = 'conflict' THEN 'CONFLICT' WHEN best_confidence >= 0.6 THEN 'VERIFIED' ELSE 'NOT_VERIFIED' END AS verification_state
 FROM ensemble"""

_RULES_SQL = ", ".join(f"({i}, '{a}', '{b}', '{w}')" for i, (a, b, w) in enumerate(fixed.CONFUSIONS))


def _readings_sql(source: str, context: str, conservative: str) -> str:
    """Changed readings of `source` (rows with id columns, text t)."""
    digits = r"length(regexp_replace(t, '[^\p{Nd}]', '', 'g'))"
    letters = r"length(regexp_replace(t, '[^\p{L}]', '', 'g'))"
    numeric = f"({digits} > 0 OR {context} IN ('mrp', 'net_quantity', 'date'))"
    alpha = f"({letters} * 2 > length(t) OR {context} IN ('manufacturer', 'brand', 'cautions'))"
    admitted = (
        f"CASE r.place WHEN 'foreign' THEN regexp_matches(t, '[$€]') WHEN 'numeric' THEN {numeric} OR {digits} > {letters}"
        f" ELSE {alpha} OR ({letters} > {digits} AND length(t) > 2) END"
    )
    return f"""SELECT s.*, r.i, r.a || '→' || r.b AS hint,
      substr(t, 1, instr(t, r.a) - 1) || r.b || substr(t, instr(t, r.a) + 1) AS reading
     FROM {source} s JOIN (VALUES {_RULES_SQL}) r(i, a, b, place) ON contains(t, r.a)
     WHERE ({admitted}) AND ({numeric} OR (NOT {conservative} AND {alpha}))"""


_BOX_POINTS = "unnest([{{'x': x, 'y': y}}, {{'x': x + w, 'y': y + 2}}, {{'x': x + w - 3, 'y': y + h}}, {{'x': x - 1, 'y': y + h - 1}}])"

ORACLE = {
    "tokens_to_lines": with_views(
        "tokens",
        r"""WITH t AS (SELECT image_id, line_num, pos, regexp_replace(text, '^\s+|\s+$', '', 'g') AS word, "left", top, width, height,
              round_even(greatest(coalesce(TRY_CAST(conf AS DOUBLE), 0.0::DOUBLE), 0.0::DOUBLE) / 100, 3) AS c FROM v_tokens)
            SELECT image_id, line_num, string_agg(word, ' ' ORDER BY "left", pos) AS text, min("left") AS x, min(top) AS y,
             max("left" + width) - min("left") AS w, max(top + height) - min(top) AS h,
             round_even(CAST(sum(CAST(round(c * 1000) AS BIGINT)) AS DOUBLE) / count(*) / 1000, 3) AS confidence
            FROM t WHERE word <> '' GROUP BY ALL""",
    ),
    "clean_lines": (
        "SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text, round_even(greatest(CAST(n_chars % 1300 AS DOUBLE) / 1000 - 0.1::DOUBLE, 0.0::DOUBLE), 3)"
        " AS confidence FROM documents"
    ),
    "clamp_confidence": (
        "SELECT event_id, CASE WHEN user_id % 7 = 0 THEN 0.0::DOUBLE ELSE round_even(least(greatest(value / 64 - 0.125::DOUBLE, 0.0::DOUBLE),"
        " 1.0::DOUBLE), 3) END AS confidence FROM events"
    ),
    "polygon_to_bbox": with_views(
        "boxes",
        "SELECT image_id, ord, least(x, x - 1, x + w - 3) AS x, y AS y,"
        " greatest(x + w, x) - least(x, x - 1, x + w - 3) AS width, greatest(y + h, y + 2) - y AS height FROM v_boxes",
    ),
    "first_provider_with_output": with_views(
        "variant_lines",
        """SELECT * EXCLUDE (best) FROM (SELECT *, min(provider_rank) OVER (PARTITION BY image_id) AS best FROM v_variant_lines)
           WHERE provider_rank = best""",
    ),
    "merge_variant_lines": with_views(
        "variant_lines",
        """SELECT image_id, variant, variant_rank, ord, text, CASE WHEN row_number() OVER (PARTITION BY image_id, lower(trim(text))
            ORDER BY variant_rank, ord, text) > 1 THEN lower(trim(text)) END AS duplicate_of FROM v_variant_lines""",
    ),
    "append_new_variant_lines": with_views(
        "variant_lines",
        """WITH l AS (SELECT * EXCLUDE (provider_rank), lower(trim(text)) AS k FROM v_variant_lines),
            b AS (SELECT *, row_number() OVER (PARTITION BY image_id, k ORDER BY ord, text) AS rn FROM l WHERE variant = 'original'),
            v AS (SELECT * FROM l WHERE variant IN ('upscaled_2x', 'contrast_enhanced', 'deskewed')),
            tag AS (SELECT image_id, k, arg_max(variant, variant_rank) AS tag FROM v GROUP BY ALL)
            SELECT b.image_id, b.variant_rank, CASE WHEN rn = 1 THEN coalesce(tag, variant) ELSE variant END AS variant, b.text, b.ord
             FROM b LEFT JOIN tag ON tag.image_id = b.image_id AND tag.k = b.k
            UNION ALL SELECT image_id, variant_rank, variant, text, ord FROM v
             WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.image_id = v.image_id AND b.k = v.k)""",
    ),
    "append_new_crop_lines": with_views(
        "variant_lines",
        """WITH l AS (SELECT * EXCLUDE (provider_rank), lower(trim(text)) AS k FROM v_variant_lines),
            b AS (SELECT * FROM l WHERE variant = 'original'),
            v AS (SELECT *, row_number() OVER (PARTITION BY image_id, k ORDER BY ord, text) AS rn FROM l WHERE variant = 'bottom_crop_2x')
            SELECT image_id, variant_rank, variant, text, ord FROM b
            UNION ALL SELECT image_id, variant_rank, variant, text, ord FROM v
             WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM b WHERE b.image_id = v.image_id AND b.k = v.k)""",
    ),
    "merge_panels": with_views(
        "label_lines", f"SELECT scan_id, {_RANK.format('')} AS panel_rank, line_no, text FROM v_label_lines"
    ),
    "expand_lines": with_views(
        "label_lines",
        f"""WITH s AS (SELECT scan_id, line_no, confidence, panel, text AS t FROM v_label_lines),
            r AS ({_readings_sql('s', "'general'", 'false')}),
            u AS (SELECT *, row_number() OVER (PARTITION BY scan_id, line_no, panel, t, confidence, reading ORDER BY i) AS rn FROM r)
            SELECT scan_id, line_no, t AS text, confidence, false AS is_normalized, NULL AS hint FROM s
            UNION ALL SELECT scan_id, line_no, reading, confidence * (1 - 0.5::DOUBLE), true, hint FROM u WHERE rn = 1""",
    ),
    "attach_normalization": with_views(
        "label_lines",
        f"""WITH s AS (SELECT scan_id, line_no, panel, confidence, text AS t,
              CASE WHEN line_no < 2000000000000000 THEN 'mrp' WHEN line_no < 4000000000000000 THEN 'manufacturer' ELSE 'general' END AS ctx,
              line_no % 2 = 0 AS strict FROM v_label_lines),
            r AS ({_readings_sql('s', 'ctx', 'strict')}),
            g AS (SELECT scan_id, line_no, panel, confidence, t, count(*) AS n, string_agg(reading, '|' ORDER BY i) AS readings
              FROM r GROUP BY ALL)
            SELECT s.scan_id, s.line_no, 1 + coalesce(n, 0) AS readings, s.t || coalesce('|' || readings, '') AS texts,
             CASE WHEN n IS NULL THEN 0.0::DOUBLE WHEN strict THEN 0.3::DOUBLE ELSE 0.5::DOUBLE END AS penalty
            FROM s LEFT JOIN g ON g.scan_id = s.scan_id AND g.line_no = s.line_no AND g.panel = s.panel AND g.t = s.t AND g.confidence = s.confidence""",
    ),
    "field_candidates": with_views(
        "label_lines", f"SELECT scan_id, panel, line_no, text, field_name, context_hint FROM ({_CANDIDATES_SQL})"
    ),
    "ensemble_status": with_views("label_lines", f"WITH {ENSEMBLE_SQL} {_ENSEMBLE_OUT}"),
    "ensemble_counts": with_views(
        "label_lines scans",
        f"""WITH {ENSEMBLE_SQL}, o AS ({_ENSEMBLE_OUT}),
            f AS (SELECT scan_id, unnest([{', '.join(repr(f) for f in fixed.FIELDS)}]) AS field_name FROM v_scans)
            SELECT f.field_name, coalesce(status, 'missing') AS status, coalesce(verification_state, 'NOT_VERIFIED') AS verification_state,
             count(*) AS scans FROM f LEFT JOIN o ON o.scan_id = f.scan_id AND o.field_name = f.field_name GROUP BY ALL""",
    ),
    "ensemble_conflict_candidates": with_views(
        "label_lines",
        f"""WITH {ENSEMBLE_SQL} SELECT c.scan_id, c.field_name, c.line_no, source_provider || ':' || text AS description
            FROM cand c JOIN ensemble e ON e.scan_id = c.scan_id AND e.field_name = c.field_name WHERE e.status = 'conflict'""",
    ),
    "pair_predicates": with_views(
        "label_lines",
        f"""WITH o AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY line_no) AS rn FROM v_label_lines)
            SELECT a.scan_id, a.line_no, round_even({iou_sql('a.', 'b.')}, 6) AS iou,
             {_KEY_SQL.format('a.')} = {_KEY_SQL.format('b.')} AS same_text, {iou_sql('a.', 'b.')} >= 0.5 AS same_box,
             abs(a.confidence - b.confidence) <= 0.1::DOUBLE AS similar
            FROM v_label_lines a JOIN o b ON b.scan_id = a.scan_id AND b.rn = 1""",
    ),
    "catalog_agreement": with_views(
        "products catalog",
        f"""WITH q AS (SELECT *, CAST(regexp_extract(quantity, '{fixed.CATALOG_QUANTITY}', 1) AS DOUBLE) AS qv,
              lower(regexp_extract(quantity, '{fixed.CATALOG_QUANTITY}', 2)) AS qu FROM v_catalog),
            j AS (SELECT p.*, q.barcode, q.mrp * 1.005::DOUBLE AS their_price, q.manufacturer AS theirs, p.manufacturer AS ours,
              qv * CASE qu WHEN 'l' THEN 1000.0::DOUBLE ELSE 1.0::DOUBLE END AS base FROM v_products p JOIN q ON q.barcode = p.barcode_code)
            SELECT barcode, base AS base_quantity,
             CASE WHEN quantity_value = 0 AND base = 0 THEN true WHEN quantity_value = 0 OR base = 0 THEN false
              ELSE abs(quantity_value - base) / greatest(quantity_value, base) <= 0.01::DOUBLE END AS quantity_match,
             CASE WHEN their_price IS NULL THEN false ELSE abs(mrp_amount - their_price) / greatest(mrp_amount, their_price) <= 0.01::DOUBLE END AS price_match,
             CASE WHEN ours IS NULL AND theirs IS NULL THEN true WHEN ours IS NULL OR theirs IS NULL THEN false
              ELSE lower(trim(ours)) = lower(trim(theirs)) END AS maker_match,
             CASE WHEN ours IS NULL AND theirs IS NULL THEN 'missing' WHEN ours <> theirs THEN 'conflict' ELSE 'agreed' END AS maker_status,
             CASE WHEN ours IS NOT NULL AND theirs IS NOT NULL AND ours <> theirs THEN NULL ELSE coalesce(theirs, ours) END AS maker_name,
             CASE WHEN ours IS NULL AND theirs IS NULL THEN 0.0::DOUBLE WHEN ours <> theirs THEN 0.0::DOUBLE
              WHEN theirs IS NULL THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END AS maker_confidence,
             product_id % 2 <> 0 AS mismatch FROM j""",
    ),
}

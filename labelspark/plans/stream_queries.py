"""Limiter and source queries; the streams themselves are run in tests."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from labelspark import fixed
from labelspark.operators.catalog import known_products
from labelspark.operators.rules import seed_missing, seeded_rules
from labelspark.plans.judging_queries import RULE_SETS, _cache, _catalog
from labelspark.plans.views import table, view, with_views
from labelspark.session import ensure_checkpoint_dir
from labelspark.sources import commits, readers, sinks
from labelspark.streaming.answers import answered_symbols
from labelspark.streaming.limiter import limit_attempts
from labelspark.streaming.streams import daily_counts, stream_catalog_enrich


def _limited(limit: int, seconds: int):
    return lambda spark, sf_dir: limit_attempts(view(spark, sf_dir, "attempts"), limit, seconds)


def _daily(spark, sf_dir):
    return daily_counts(view(spark, sf_dir, "scans"))


def _enriched(spark, sf_dir):
    rows = stream_catalog_enrich(view(spark, sf_dir, "scan_symbols"), _cache(spark, sf_dir), _catalog(spark, sf_dir))
    return rows.select("scan_id", "ord", "barcode", F.col("answer.name").alias("name"))


def _images_guard(spark, sf_dir):
    files = table(spark, sf_dir, "part").selectExpr(
        "p_partkey", "concat('/in/', p_partkey, CASE p_partkey % 4 WHEN 0 THEN '.JPG' WHEN 1 THEN '.webp' WHEN 2 THEN '.gif' ELSE '.png' END) AS path",
        "CAST(p_size AS BIGINT) * 300000 AS length",
    )
    return readers.accepted_images(files)


def _exports(spark, sf_dir):
    scans = view(spark, sf_dir, "scans").filter("overall_status = 'CONFLICT'")
    return sinks.export_records(scans, "pdf")


def _seeds(spark, sf_dir):
    """Rules missing from a table that already has some of them."""
    seeds = seeded_rules(spark, RULE_SETS)
    stored = table(spark, sf_dir, "part").select(
        F.concat(F.lit("LMR-2024-00"), (F.col("p_size") % 3 + 1).cast("string")).alias("rule_id")
    )
    return seed_missing(stored, seeds).select("rule_set_id", "rule_id", "required_declaration")


def _document_folder(spark, sf_dir):
    """The parts as catalog documents over several lines each, some of them cut off in a name, as text
    files in the shared folder."""
    part = table(spark, sf_dir, "part")
    product = F.struct(
        F.concat(F.col("p_name"), F.lit(' {"} ')).alias("product_name"), F.col("p_brand").alias("brands"), F.col("p_type").alias("categories"),
        F.concat("p_size", F.lit(" g")).alias("quantity"),
    )
    document = F.to_json(F.struct(F.col("p_partkey").cast("string").alias("code"), (F.col("p_partkey") % 7 != 3).cast("int").alias("status"), product.alias("product")), {"pretty": "true"})
    torn = F.left(document, F.instr(document, F.col("p_name")) + 1)
    folder = f"{ensure_checkpoint_dir(spark)}/documents-{uuid.uuid4().hex}"
    part.select(F.when(F.col("p_partkey") % 50 == 0, torn).otherwise(document).alias("value")).write.text(folder)
    return folder


def _documents(spark, sf_dir):
    return readers.read_catalog_json(spark, _document_folder(spark, sf_dir)).select("barcode", "name", "brand", "category", "quantity_value", "quantity_unit")


def _document_rejects(spark, sf_dir):
    return readers.read_catalog_rejects(spark, _document_folder(spark, sf_dir)).groupBy("reason").agg(F.count("*").alias("documents"))


def _answered(spark, sf_dir):
    """Symbols once the catalog's answers have come; the cache knows some before."""
    catalog = known_products(_catalog(spark, sf_dir)).select("barcode", "product")
    rows = answered_symbols(view(spark, sf_dir, "scan_symbols"), catalog, _cache(spark, sf_dir))
    return rows.select("scan_id", "ord", "barcode", F.col("answer.name").alias("name"))


def _stored_cache(spark, sf_dir):
    """A stored cache after the answers of every hundredth barcode: only their buckets are written again."""
    store = commits.KeyedStore(f"{ensure_checkpoint_dir(spark)}/cache-{uuid.uuid4().hex}", "barcode", 64)
    store.create(_cache(spark, sf_dir).select("barcode", F.col("product.name").alias("name"), F.lit(1).alias("fetched_at")))
    found = view(spark, sf_dir, "products").filter("product_id % 100 = 0")
    sinks.upsert_cache(store, found.select(F.col("barcode_code").alias("barcode"), F.col("identity").alias("name"), F.lit(2).alias("fetched_at")))
    return store.read(spark)


def _stored_products(spark, sf_dir):
    """Stored products after inserting all of them: every second one is there already, under a name of its own."""
    store = commits.KeyedStore(f"{ensure_checkpoint_dir(spark)}/products-{uuid.uuid4().hex}", "barcode_code", 64)
    products = view(spark, sf_dir, "products").select("barcode_code", "identity", "brand")
    store.create(products.filter("barcode_code % 2 = 0").withColumn("identity", F.concat(F.lit("stored "), "identity")))
    sinks.insert_products(store, products)
    return store.read(spark)


def _committed_results(spark, sf_dir):
    """Declarations and scans in two batches, the second written twice, a third stopped before its commit."""
    folder = f"{ensure_checkpoint_dir(spark)}/results-{uuid.uuid4().hex}"
    facts = {
        "scans": view(spark, sf_dir, "scans").select("scan_id", "overall_status"),
        "declarations": view(spark, sf_dir, "declarations").select("scan_id", "field_name", "verdict"),
    }
    for batch, part in (("0", "scan_id % 3 = 0"), ("1", "scan_id % 3 > 0"), ("1", "scan_id % 3 = 1")):
        sinks.write_scan_results({name: df.filter(part) for name, df in facts.items()}, folder, batch)
    facts["scans"].filter("scan_id % 3 = 2").write.parquet(f"{folder}/scans/attempt=stopped")
    scans, declared = (commits.read_batches(spark, folder, name) for name in facts)
    per_scan = declared.groupBy("scan_id").agg(F.count("*").alias("declarations"))
    return scans.join(per_scan, "scan_id", "left").groupBy("overall_status").agg(
        F.count("*").alias("scans"), F.sum("declarations").alias("declarations")
    )


QUERIES = {
    "answered_symbols": _answered,
    "stored_product_cache": _stored_cache,
    "stored_products": _stored_products,
    "committed_results": _committed_results,
    "catalog_documents": _documents,
    "catalog_document_rejects": _document_rejects,
    "limit_attempts_day": _limited(5, 86_400),
    "limit_logins": _limited(fixed.LOGIN_LIMIT, fixed.LIMIT_WINDOW_SECONDS),
    "daily_scan_counts": _daily,
    "catalog_enrich": _enriched,
    "accepted_images": _images_guard,
    "report_exports": _exports,
    "seed_rules": _seeds,
}

_SEED = ", ".join(f"('{r[0]}', '{r[4]}')" for r in fixed.SEED_RULES)


def _limit_sql(limit: int, seconds: int) -> str:
    fresh = f"list_filter(a.t, lambda t: t > x.t - {seconds * 1_000_000})"
    out = "list_append(a.o, {{'e': x.e, 'ok': {0}}})"
    return with_views(
        "attempts",
        f"""WITH l AS (SELECT key_id, list({{'e': event_id, 't': epoch_us(ts)}} ORDER BY ts, event_id) AS xs FROM v_attempts GROUP BY key_id),
            r AS (SELECT key_id, list_reduce(xs, lambda a, x: CASE WHEN len({fresh}) >= {limit} THEN {{'t': a.t, 'o': {out.format('false')}}}
              ELSE {{'t': list_append({fresh}, x.t), 'o': {out.format('true')}}} END,
              {{'t': CAST([] AS BIGINT[]), 'o': CAST([] AS STRUCT(e BIGINT, ok BOOLEAN)[])}}) AS f FROM l),
            u AS (SELECT key_id, unnest(f.o) AS o FROM r)
            SELECT key_id, o.e AS event_id, o.ok AS accepted FROM u""",
    )


ORACLE = {
    "answered_symbols": with_views(
        "scan_symbols product_cache catalog",
        """SELECT scan_id, ord, data AS barcode, CASE WHEN NOT regexp_matches(data, '^[0-9]+$') THEN NULL WHEN c.barcode IS NOT NULL THEN c.name ELSE t.name END AS name
           FROM v_scan_symbols s LEFT JOIN v_product_cache c ON c.barcode = s.data LEFT JOIN v_catalog t ON t.barcode = s.data
           WHERE data IS NULL OR NOT regexp_matches(data, '^[0-9]+$') OR c.barcode IS NOT NULL OR t.barcode IS NOT NULL""",
    ),
    "stored_product_cache": with_views(
        "product_cache products",
        """SELECT barcode_code AS barcode, identity AS name, 2 AS fetched_at FROM v_products WHERE product_id % 100 = 0 UNION ALL
           SELECT barcode, CASE WHEN found THEN name END, 1 FROM v_product_cache
           WHERE barcode NOT IN (SELECT barcode_code FROM v_products WHERE product_id % 100 = 0)""",
    ),
    "stored_products": with_views(
        "products",
        """SELECT barcode_code, CASE WHEN CAST(barcode_code AS BIGINT) % 2 = 0 THEN 'stored ' ELSE '' END || identity AS identity, brand FROM v_products""",
    ),
    "committed_results": with_views(
        "scans declarations",
        """WITH d AS (SELECT scan_id, count(*) AS n FROM v_declarations GROUP BY scan_id)
           SELECT overall_status, count(*) AS scans, CAST(sum(n) AS BIGINT) AS declarations FROM v_scans s LEFT JOIN d ON d.scan_id = s.scan_id
           WHERE s.scan_id % 3 < 2 GROUP BY overall_status""",
    ),
    "catalog_documents": """SELECT CAST(p_partkey AS VARCHAR) AS barcode, p_name || ' {"} ' AS name, p_brand AS brand, p_type AS category,
        p_size::DOUBLE AS quantity_value, 'g' AS quantity_unit FROM part WHERE p_partkey % 50 <> 0 AND p_partkey % 7 <> 3""",
    "catalog_document_rejects": "SELECT 'cut off' AS reason, count(*) AS documents FROM part WHERE p_partkey % 50 = 0 HAVING count(*) > 0",
    "daily_scan_counts": with_views(
        "scans", "SELECT CAST(created_at AS DATE) AS day, overall_status, count(*) AS scans FROM v_scans GROUP BY ALL"
    ),
    "catalog_enrich": with_views(
        "scan_symbols product_cache catalog",
        """SELECT scan_id, ord, data AS barcode, CASE WHEN NOT regexp_matches(data, '^[0-9]+$') THEN NULL WHEN c.barcode IS NOT NULL THEN c.name ELSE t.name END AS name
           FROM v_scan_symbols s LEFT JOIN v_product_cache c ON c.barcode = s.data LEFT JOIN v_catalog t ON t.barcode = s.data""",
    ),
    "accepted_images": """SELECT p_partkey, '/in/' || p_partkey || CASE p_partkey % 4 WHEN 0 THEN '.JPG' WHEN 1 THEN '.webp' ELSE '.png' END AS path,
        p_size * 300000 AS length FROM part WHERE p_partkey % 4 <> 2 AND p_size * 300000 <= 10485760""",
    "report_exports": with_views(
        "scans", "SELECT scan_id, 'pdf' AS format, NULL AS file_path, 'completed' AS status FROM v_scans WHERE overall_status = 'CONFLICT'"
    ),
    "seed_rules": f"""SELECT 'set-' || i AS rule_set_id, s.rule_id, s.f AS required_declaration FROM range(5) t(i), (VALUES {_SEED}) s(rule_id, f)
        WHERE s.rule_id NOT IN (SELECT 'LMR-2024-00' || (p_size % 3 + 1) FROM part)""",
    "limit_attempts_day": _limit_sql(5, 86_400),
    "limit_logins": _limit_sql(fixed.LOGIN_LIMIT, fixed.LIMIT_WINDOW_SECONDS),
}

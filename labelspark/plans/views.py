"""Label-shaped views over the driver's tables.

Each view is a projection of one table, written once as SQL expressions and used both as a Spark
`selectExpr` and as a DuckDB CTE, so that an oracle starts from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ORDER_PRICE = "CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS STRING)"
_DAY = "lpad(CAST(day(l_shipdate) AS STRING), 2, '0')"
_MONTH = "lpad(CAST(month(l_shipdate) AS STRING), 2, '0')"
_YEAR = "CAST(year(l_shipdate) AS STRING)"
_LABEL_TEXT = f"""CASE l_linenumber
 WHEN 1 THEN CASE l_partkey % 7
   WHEN 0 THEN 'Maximum Retail Price ' || {_ORDER_PRICE}
   WHEN 1 THEN 'Price Rs. ' || {_ORDER_PRICE}
   WHEN 2 THEN 'MRP ' || {_ORDER_PRICE} || ' INR'
   WHEN 3 THEN 'MRP: ₹' || {_ORDER_PRICE}
   WHEN 4 THEN 'MRP reference code ' || CAST(l_partkey AS STRING)
   ELSE 'MRP Rs. ' || {_ORDER_PRICE} END
 WHEN 2 THEN CASE
   WHEN l_partkey % 6 = 5 THEN '7, Supplier ' || CAST(l_suppkey AS STRING) || ' Industries Ltd'
   WHEN l_partkey % 6 = 4 THEN CAST(CAST(l_quantity AS INT) AS STRING) || ' TABLETS'
   ELSE 'Net Qty: ' || CAST(CAST(l_quantity AS INT) AS STRING)
     || CASE l_partkey % 3 WHEN 0 THEN ' g' WHEN 1 THEN ' kg' ELSE ' lb' END END
 WHEN 3 THEN CASE
   WHEN l_suppkey % 4 = 0 THEN concat('REFER MANUFACTURER', chr(39), 'S NAME, ADDRESS AND LIC NO')
   ELSE 'Manufacturer: Supplier ' || CAST(l_suppkey AS STRING) || ' Pvt Ltd' END
 WHEN 4 THEN CASE
   WHEN l_partkey % 5 = 0 THEN 'Mfg Date ' || {_MONTH} || '-' || {_YEAR}
   ELSE 'MFD ' || {_DAY} || '/' || {_MONTH} || '/' || {_YEAR} END
 WHEN 5 THEN CASE
   WHEN l_partkey % 6 = 0 THEN 'Best Before: Jan ' || {_YEAR}
   ELSE 'EXP ' || {_MONTH} || '/' || CAST(year(l_shipdate) + l_partkey % 3 - 1 AS STRING) END
 WHEN 6 THEN CASE l_partkey % 8
   WHEN 0 THEN 'Nutrition Facts' WHEN 1 THEN 'Energy 250 kcal' WHEN 2 THEN 'Saturated fat 3.5g'
   WHEN 3 THEN 'Protein xyz' WHEN 4 THEN 'Nutritional values' WHEN 5 THEN 'Sodium: 120 mg'
   WHEN 6 THEN 'Fiber 3g' ELSE 'Carbohydrate 30.1 g' END
 ELSE CASE l_partkey % 3
   WHEN 0 THEN 'Caution: keep away from heat' WHEN 1 THEN 'Store in a dry place'
   ELSE 'Ingredients: sugar, salt' END END"""

_LABEL_COLUMNS = [
    "l_orderkey AS scan_id",
    "CASE WHEN l_linestatus = 'O' THEN 'front' ELSE 'back' END AS panel",
    # An order key, not a dense number: no window over an order's lines is needed to make it.
    "CAST(l_linenumber AS BIGINT) * 1000000000000000 + l_partkey * 1000000"
    " + (l_suppkey % 10000) * 100 + CAST(l_quantity AS BIGINT) AS line_no",
    "round(0.5 + l_discount * 4, 3) AS confidence",
    f"{_LABEL_TEXT} AS text",
    "CAST(l_partkey % 4 * 10 AS DOUBLE) AS x",
    "CAST(l_suppkey % 4 * 10 AS DOUBLE) AS y",
    "CAST(100 + l_linenumber * 20 AS DOUBLE) AS w",
    "CAST(100 + l_quantity * 4 AS DOUBLE) AS h",
    "CASE WHEN l_tax < 0.04 THEN 'rapidocr' ELSE 'tesseract' END AS source_provider",
    "'single_pass' AS preprocessing_variant",
]

_FIELD_CASE = (
    "CASE k WHEN 0 THEN 'mrp' WHEN 1 THEN 'net_quantity' WHEN 2 THEN 'manufacturer'"
    " WHEN 3 THEN 'manufacture_date' WHEN 4 THEN 'expiry_date' WHEN 5 THEN 'cautions'"
    " ELSE 'nutrition_facts' END"
)
_BARCODE = "'89' || lpad(CAST({0} AS STRING), 11, '0')"

# name → (table, exploded row numbers k or None, expressions, filter or None)
VIEWS: dict[str, tuple[str, int | None, list[str], str | None]] = {
    "label_lines": ("lineitem", None, _LABEL_COLUMNS, None),
    "scans": (
        "orders", None,
        [
            "o_orderkey AS scan_id",
            "CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE o_custkey END AS product_id",
            "CASE WHEN o_orderkey % 50 = 0 THEN 'FAILED' ELSE 'COMPLETED' END AS status",
            "CASE WHEN o_orderstatus = 'F' THEN 'SATISFIED' WHEN o_orderstatus = 'O' THEN 'VIOLATION'"
            " WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'CONFLICT'"
            " ELSE 'NOT_VERIFIED' END AS overall_status",
            "o_orderdate AS created_at",
            "CASE o_custkey % 4 WHEN 0 THEN 'Imported goods' WHEN 1 THEN 'Beverages' WHEN 2 THEN NULL"
            " ELSE 'goods' END AS category",
        ],
        None,
    ),
    "images": (
        "orders", 2,
        [
            "o_orderkey * 2 + k AS image_id", "o_orderkey AS scan_id",
            "CASE WHEN o_orderkey % 17 = 3 THEN 'https://elsewhere/' ELSE '/uploads/' END"
            " || CAST(o_orderkey AS STRING) || '/' || CAST(k AS STRING) || '.jpg' AS url",
            "CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN k = 0 THEN 'front' ELSE 'back' END AS label",
        ],
        None,
    ),
    "products": (
        "part", None,
        [
            "p_partkey AS product_id", "p_name AS identity", "p_brand AS brand", "p_type AS category",
            "CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'Supplier ' || CAST(p_partkey % 100 AS STRING)"
            " || ' Pvt Ltd' END AS manufacturer",
            "p_retailprice AS mrp_amount", "'INR' AS mrp_currency",
            "CASE WHEN p_partkey % 9 = 0 THEN 0.0 ELSE CAST(p_size * 50 AS DOUBLE) END AS quantity_value",
            "'g' AS quantity_unit", f"{_BARCODE.format('p_partkey')} AS barcode_code",
            "'EAN13' AS barcode_format",
        ],
        None,
    ),
    "officers": (
        "supplier", None,
        [
            "s_suppkey AS officer_id", "s_name AS name",
            "CASE s_nationkey % 3 WHEN 0 THEN 'ADMIN' WHEN 1 THEN 'INSPECTOR' ELSE 'VIEWER' END AS role",
        ],
        None,
    ),
    "declarations": (
        "orders", 7,
        [
            "o_orderkey * 7 + k AS declaration_id", "o_orderkey AS scan_id",
            f"{_FIELD_CASE} AS field_name",
            "CASE (o_orderkey + k) % 4 WHEN 0 THEN 'SATISFIED' WHEN 1 THEN 'VIOLATION'"
            " WHEN 2 THEN 'NOT_VERIFIED' ELSE 'CONFLICT' END AS verdict",
            "'as found ' || CAST((o_orderkey + k) % 9 AS STRING) AS reason",
            "CAST((o_orderkey * 7 + k) % 100 AS DOUBLE) / 100 AS confidence",
            "k AS field_no", "o_custkey AS custkey",
        ],
        None,
    ),
    "declaration_evidence": (
        "lineitem", None,
        [
            "CAST(l_orderkey * 7 + l_linenumber - 1 AS BIGINT) AS declaration_id",
            "l_orderkey * 2 + CASE WHEN l_linestatus = 'O' THEN 0 ELSE 1 END AS image_id",
            "CASE l_partkey % 7 WHEN 0 THEN 'PRODUCT_DATABASE' WHEN 1 THEN 'MANUAL_ENTRY'"
            " WHEN 2 THEN 'OFFICER_CORRECTION' WHEN 3 THEN 'PRIOR_RECORD' ELSE 'OCR' END AS source_type",
            "'line ' || CAST(l_partkey AS STRING) AS raw_text", "round(0.5 + l_discount * 4, 3) AS confidence",
            "l_shipdate AS extracted_at", "l_partkey * 100000 + l_suppkey AS evidence_no",
        ],
        None,
    ),
    "symbol_evidence": (
        "orders", 2,
        [
            "o_orderkey * 2 + k AS image_id",
            "CASE WHEN (o_orderkey + k) % 5 = 0 THEN 'QR' ELSE 'BARCODE' END AS source_type",
            "CASE WHEN (o_orderkey + k) % 5 = 0 THEN 'QRCODE: https://a.example/p: ' || CAST(o_custkey AS STRING)"
            f" ELSE 'EAN13: ' || {_BARCODE.format('o_custkey')} END AS raw_text",
            "o_orderdate AS extracted_at", "o_orderkey * 2 + k AS evidence_no",
        ],
        None,
    ),
    "inspections": (
        "events", None,
        [
            "event_id AS inspection_id", "event_id % 1000 AS scan_id", "user_id AS officer_id",
            "ts AS created_at",
            "CASE WHEN user_id % 5 = 0 THEN 2 ELSE 1 END AS actions_count",
            "CASE WHEN value < 20 THEN NULL ELSE 'note ' || CAST(user_id AS STRING) END AS notes",
            "CASE WHEN user_id % 3 = 0 THEN value ELSE NULL END AS latitude",
            "CASE WHEN user_id % 3 = 0 THEN value / 2 ELSE NULL END AS longitude",
            "CASE WHEN user_id % 2 = 0 THEN 'GPS' ELSE 'MANUAL' END AS location_source",
        ],
        "event_type IN ('view', 'click', 'purchase')",
    ),
    # One row per action of an inspection; pos orders the actions inside it.
    "actions": (
        "events", 2,
        [
            "event_id AS inspection_id", "k AS pos", "event_id % 1000 AS scan_id",
            "user_id AS officer_id", "ts AS created_at",
            "CASE WHEN k = 1 AND user_id % 20 = 0 THEN 7 * (event_id % 1000 + 1)"
            " ELSE 7 * (event_id % 1000) + (user_id + k) % 7 END AS declaration_id",
            "CASE WHEN k = 1 THEN 'confirm' WHEN event_type = 'view' THEN 'confirm'"
            " WHEN event_type = 'click' THEN 'correct' WHEN value > 95 THEN 'approve'"
            " ELSE 'mark_unresolved' END AS action",
            "CASE WHEN value < 3 THEN NULL ELSE 'v' || CAST(user_id AS STRING) END AS new_value",
            "'because ' || CAST(user_id % 11 AS STRING) AS reason",
        ],
        "event_type IN ('view', 'click', 'purchase') AND (k = 0 OR user_id % 5 = 0)",
    ),
    "flags": (
        "events", None,
        [
            "event_id AS flag_id", "event_id AS scan_id",
            "CASE WHEN value < 20 THEN 'NEW' WHEN value < 40 THEN 'ACKNOWLEDGED'"
            " WHEN value < 60 THEN 'RESOLVED' ELSE 'DISMISSED' END AS status",
            "ts AS created_at", "'note ' || CAST(user_id AS STRING) AS reporter_note",
        ],
        "event_type = 'error'",
    ),
    "flag_reviews": (
        "events", None,
        [
            "event_id AS review_id", "event_id - event_id % 5 AS flag_id", "user_id AS officer_id",
            "ts AS reviewed_at",
            "CASE WHEN value < 40 THEN 'ACKNOWLEDGED' WHEN value < 70 THEN 'RESOLVED'"
            " ELSE 'DISMISSED' END AS new_status",
            "'seen ' || CAST(user_id AS STRING) AS officer_notes",
        ],
        "event_type = 'signup'",
    ),
    "attempts": ("events", None, ["user_id AS key_id", "ts", "event_id"], None),
    "log": (
        "events", None,
        [
            "event_id", "ts",
            "CASE event_type WHEN 'error' THEN 'stage_failed' WHEN 'signup' THEN 'stage_started'"
            " ELSE 'stage_completed' END AS event",
            "'stage_' || CAST(user_id % 8 AS STRING) AS stage",
            "CASE WHEN event_type = 'signup' THEN NULL ELSE value END AS elapsed_ms",
            "CASE WHEN event_type = 'error' THEN 500 WHEN user_id % 9 = 0 THEN 404 ELSE 200 END AS status_code",
        ],
        None,
    ),
    "catalog": (
        "part", None,
        [
            # A record under another key is a miss of the catalog.
            f"CASE WHEN p_partkey % 5 = 0 THEN 'x' ELSE '' END || {_BARCODE.format('p_partkey')} AS barcode",
            "p_partkey % 3 AS source_rank",
            "p_name AS name", "p_brand AS brand", "p_type AS category",
            "CASE WHEN p_partkey % 2 = 0 THEN 'Supplier ' || CAST(p_partkey % 100 AS STRING) || ' Pvt Ltd'"
            " ELSE NULL END AS manufacturer",
            "CAST(p_size * 50 AS STRING) || CASE p_partkey % 3 WHEN 0 THEN ' g' WHEN 1 THEN ' mL'"
            " ELSE ' L' END AS quantity",
            "CASE WHEN p_partkey % 4 = 0 THEN p_retailprice ELSE NULL END AS mrp",
        ],
        None,
    ),
    "product_cache": (
        "part", None,
        [
            f"CASE WHEN p_partkey % 6 <> 0 THEN 'x' ELSE '' END || {_BARCODE.format('p_partkey')} AS barcode",
            "CASE WHEN p_partkey % 12 = 0 THEN NULL ELSE 'cached ' || p_name END AS name",
            "p_partkey % 12 <> 0 AS found",
        ],
        None,
    ),
    # Decoded symbols per scan, in decoding order.
    "scan_symbols": (
        "orders", 3,
        [
            "o_orderkey AS scan_id",
            "CASE WHEN k = 2 THEN 'back' ELSE 'front' END AS panel", "k AS ord",
            # Scans without a barcode, or without a second one, hold a code of plain words instead.
            "CASE WHEN k = 0 AND o_orderkey % 7 = 0 OR o_orderkey % 4 = 1 OR k = 2 AND o_orderkey % 2 = 1 THEN 'QRCODE'"
            " ELSE 'EAN13' END AS format",
            "CASE WHEN o_orderkey % 4 = 1 OR k = 2 AND o_orderkey % 2 = 1 THEN 'plain words'"
            " WHEN k = 0 AND o_orderkey % 7 = 0 THEN CASE o_orderkey % 3"
            "  WHEN 0 THEN 'https://a.example/' || CAST(o_custkey AS STRING)"
            "  WHEN 1 THEN 'batch=' || CAST(o_custkey AS STRING) ELSE 'plain words' END"
            f" WHEN k = 1 AND o_orderkey % 11 = 0 THEN {_BARCODE.format('(o_custkey + 1)')}"
            f" ELSE {_BARCODE.format('o_custkey')} END AS data",
            "CAST(o_orderkey % 60 * 8 AS DOUBLE) AS width",
            "CAST(20 + o_custkey % 120 AS DOUBLE) AS height",
        ],
        None,
    ),
    "symbols": (
        "part", None,
        [
            "p_partkey AS image_id",
            "CASE p_type WHEN 'SMALL' THEN 'QRCODE' WHEN 'LARGE' THEN 'UPC-A' WHEN 'PROMO' THEN 'CODE128'"
            " ELSE 'EAN13' END AS format",
            "CAST(p_size * 10 AS DOUBLE) AS width", "CAST(20 + p_partkey % 120 AS DOUBLE) AS height",
        ],
        None,
    ),
    "boxes": (
        "lineitem", None,
        [
            "l_orderkey AS image_id", _LABEL_COLUMNS[2].replace("line_no", "ord"),
            "CAST(l_partkey % 4 * 10 AS DOUBLE) AS x", "CAST(l_suppkey % 4 * 10 AS DOUBLE) AS y",
            "CAST(100 + l_linenumber * 20 AS DOUBLE) AS w", "CAST(100 + l_quantity * 4 AS DOUBLE) AS h",
            "CAST(300 AS DOUBLE) AS image_w", "CAST(320 AS DOUBLE) AS image_h",
            "round(l_discount * 3, 4) AS text_density",
            "CASE WHEN l_linenumber = 7 THEN 'image_surface_fallback' WHEN l_linenumber = 6"
            " THEN 'text_grouping' ELSE 'visual_boundary' END AS source",
        ],
        None,
    ),
    "components": (
        "lineitem", None,
        [
            "l_orderkey AS image_id", "CAST(l_partkey % 280 AS DOUBLE) AS x",
            "CAST(l_suppkey % 300 AS DOUBLE) AS y", "CAST(l_linenumber AS DOUBLE) AS w",
            "CAST(l_quantity AS DOUBLE) AS h", "l_quantity * l_linenumber * 8 AS area",
            "CAST(300 AS DOUBLE) AS image_w", "CAST(320 AS DOUBLE) AS image_h",
        ],
        None,
    ),
    "quality": (
        "lineitem", None,
        [
            "l_orderkey AS image_id", "l_linenumber AS part_no",
            "l_quantity * 6 AS laplacian_variance", "l_quantity * 5 AS mean",
            "CAST(l_partkey % 80 AS DOUBLE) AS std", "400 + l_partkey % 1000 AS image_h",
            "500 + l_suppkey * 13 % 1000 AS image_w", "l_quantity + 10 AS quad_w",
            "CAST(l_partkey % 90 AS DOUBLE) AS quad_h", "l_tax * 10 AS fill",
            "l_returnflag = 'N' AS has_quad", "CAST(l_partkey AS BIGINT) AS partkey",
        ],
        None,
    ),
    "variant_lines": (
        "lineitem", None,
        [
            "l_orderkey AS image_id", "l_linenumber AS variant_rank",
            "CASE l_linenumber WHEN 1 THEN 'original' WHEN 2 THEN 'upscaled_2x' WHEN 3 THEN"
            " 'contrast_enhanced' WHEN 4 THEN 'deskewed' ELSE 'bottom_crop_2x' END AS variant",
            "CASE WHEN l_suppkey % 2 = 0 THEN 'Text ' ELSE ' text ' END"
            " || CAST(l_partkey % 5 AS STRING) AS text",
            "l_partkey * 1000000 + (l_suppkey % 10000) * 100 + CAST(l_quantity AS BIGINT) AS ord",
            "CASE WHEN l_discount < 0.03 THEN 0 ELSE 1 END AS provider_rank",
        ],
        None,
    ),
    "rule_sets": (
        "region", None,
        [
            "'set-' || CAST(r_regionkey AS STRING) AS rule_set_id", "'India' AS jurisdiction",
            "'v' || CAST(r_regionkey AS STRING) AS rule_version",
            # 1995–96, 1997, 1998–99 and on; one gap (first half of 1998), one overlap (2000).
            "CASE r_regionkey WHEN 0 THEN DATE '1995-01-01' WHEN 1 THEN DATE '1997-01-01'"
            " WHEN 2 THEN DATE '1998-07-01' WHEN 3 THEN DATE '2000-01-01' ELSE DATE '2000-12-01' END"
            " AS effective_from",
            "CASE r_regionkey WHEN 0 THEN DATE '1997-01-01' WHEN 1 THEN DATE '1998-01-01'"
            " WHEN 2 THEN DATE '2000-01-01' WHEN 3 THEN DATE '2001-01-01' ELSE NULL END AS effective_to",
        ],
        None,
    ),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    base, rows, expressions, condition = VIEWS[name]
    df = table(spark, sf_dir, base)
    if rows:
        # Spark's size check does not count the rows that explode() makes: it would take millions of
        # declarations for the few megabytes of their order keys and broadcast them. A join it does count.
        numbers = spark.range(0, rows, 1, 1).select(F.col("id").cast("int").alias("k"))
        df = df.crossJoin(F.broadcast(numbers))
    if condition:
        df = df.filter(condition)
    return df.selectExpr(*expressions)


def label_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composed lines. The one-element explode keeps the optimizer from copying the long text
    expression into every predicate on the text, which a stored text column would not suffer."""
    lines = view(spark, sf_dir, "label_lines").withColumn("bbox", F.struct("x", "y", "w", "h"))
    rest = [c for c in lines.columns if c != "text"]
    return lines.select(*rest, F.explode(F.array("text")).alias("text"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word tokens of every document: text split at newline, then at space."""
    return (
        table(spark, sf_dir, "documents")
        .select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_num", "line"))
        .select("doc_id", "line_num", F.posexplode(F.split("line", " ")).alias("pos", "word"))
        .selectExpr(
            "doc_id AS image_id", "1 AS block_num", "1 AS par_num", "line_num", "pos", "word AS text",
            *TOKEN_COLUMNS,
        )
    )


TOKEN_COLUMNS = [
    "CASE WHEN (doc_id + pos) % 13 = 0 THEN 'x' ELSE CAST((doc_id * 7 + pos * 3) % 110 - 5 AS STRING) END AS conf",
    "CAST(pos * 10 AS DOUBLE) AS `left`", "CAST(line_num * 12 AS DOUBLE) AS `top`",
    "CAST(length(word) * 6 AS DOUBLE) AS `width`", "CAST(10 + pos % 3 AS DOUBLE) AS `height`",
]

_TOKENS_SQL = """SELECT doc_id AS image_id, 1 AS block_num, 1 AS par_num, line_num, pos, word AS text, {columns} FROM (
 SELECT doc_id, line_num, unnest(string_split(line, ' ')) AS word,
  unnest(range(len(string_split(line, ' ')))) AS pos FROM (
   SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
    unnest(range(len(string_split(text, chr(10))))) AS line_num FROM documents) l) w"""


def view_sql(name: str) -> str:
    if name == "tokens":
        return _TOKENS_SQL.format(columns=", ".join(TOKEN_COLUMNS).replace("`", '"'))
    base, rows, expressions, condition = VIEWS[name]
    numbers = f" CROSS JOIN (SELECT unnest(range({rows})) AS k) n" if rows else ""
    where = f" WHERE {condition}" if condition else ""
    return f"SELECT {', '.join(expressions)} FROM {base}{numbers}{where}"


def with_views(names: str, query: str) -> str:
    """Oracle text: the named views as CTEs before a query (which may open with more CTEs)."""
    ctes = ", ".join(f"v_{n} AS ({view_sql(n)})" for n in names.split())
    query = query.strip()
    if query[:5].upper() == "WITH ":
        return f"WITH {ctes}, {query[5:]}"
    return f"WITH {ctes} {query}"

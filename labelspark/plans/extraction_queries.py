"""Extraction queries over the label lines and their oracle texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelspark import fixed
from labelspark.functions import fields
from labelspark.functions.text import comparison_key
from labelspark.operators import extraction as X
from labelspark.plans.views import label_lines, view, with_views


_DEVANAGARI = "".join(chr(0x966 + d) for d in range(10))
_WRITTEN = ("0123456789 ", _DEVANAGARI + "\u00a0")


def _script_lines(spark, sf_dir) -> DataFrame:
    """The label lines in Devanagari digits and no-break spaces: the same values must be found."""
    return label_lines(spark, sf_dir).withColumn("text", F.translate("text", *_WRITTEN))


def _script_digits(spark, sf_dir) -> DataFrame:
    """Devanagari digits only: a word list entry of two words has a plain space between them."""
    return label_lines(spark, sf_dir).withColumn("text", F.translate("text", "0123456789", _DEVANAGARI))


def _field(field: str, *columns: str, read=label_lines):
    def run(spark, sf_dir) -> DataFrame:
        found = X.extract_fields(read(spark, sf_dir), [field]).select("scan_id", field)
        return found.filter(F.col(field)["value"].isNotNull()).select(
            "scan_id", F.col(field)["panel"].alias("panel"),
            *[F.col(field)["value"][c].alias(c) for c in columns],
        )

    return run


def _best_match(spark, sf_dir):
    return X.best_match(
        label_lines(spark, sf_dir), ["scan_id"], fixed.NUMBER_UNIT, fixed.NET_QTY_WORDS, False
    )


def _dates(spark, sf_dir) -> DataFrame:
    found = X.extract_fields(label_lines(spark, sf_dir), ["manufacture_date", "expiry_date"])
    return found.select(
        "scan_id", F.col("manufacture_date")["value"].alias("made"), F.col("expiry_date")["value"].alias("expires")
    )


def _date_checks(spark, sf_dir):
    relation = fields.date_relationship(F.col("made"), F.col("expires"))
    return _dates(spark, sf_dir).select(
        "scan_id", fields.compare_dates(F.col("made"), F.col("expires")).alias("comparison"),
        relation["consistent"].alias("consistent"), relation["conflict_reason"].alias("conflict_reason"),
    )


def _date_source(spark, sf_dir):
    found = X.extract_fields(label_lines(spark, sf_dir), ["manufacture_date", "expiry_date"])
    dates = found.select(
        "scan_id",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(f).alias("field_name"), F.col(f)["value"]["raw_text"].alias("raw_text"))
                    for f in ("manufacture_date", "expiry_date")
                ]
            )
        ).alias("d"),
    ).select("scan_id", "d.*").filter("raw_text is not null")
    return X.date_source_panel(label_lines(spark, sf_dir), dates).select("scan_id", "field_name", "panel")


def _nutrition(spark, sf_dir, read=label_lines):
    facts = X.nutrition_facts(read(spark, sf_dir))
    return facts.select("scan_id", F.posexplode("nutrients").alias("pos", "n")).select(
        "scan_id", "pos", "n.nutrient", "n.value", "n.unit", "n.confidence", "n.raw_text"
    )


def _nutrition_panels(spark, sf_dir):
    """The lines a nutrition panel consists of, before they are read in order."""
    near = X.nutrition_window(label_lines(spark, sf_dir))
    return near.select("scan_id", F.coalesce(F.size("panel_lines"), F.lit(0)).alias("lines"))


def _catalog_quantity(spark, sf_dir):
    parsed = fields.catalog_quantity(F.col("quantity"))
    return view(spark, sf_dir, "catalog").select(
        "barcode", parsed["value"].alias("value"), parsed["unit"].alias("unit")
    )


def _symbol_text(spark, sf_dir):
    text = fields.symbol_text(F.col("format"), F.col("data"))
    return view(spark, sf_dir, "scan_symbols").select(
        "scan_id", "ord", fields.classify_payload(F.col("data")).alias("payload_type"),
        text.alias("evidence_text"), fields.symbol_code(text).alias("code"),
    )


def _normalized(spark, sf_dir):
    return (
        view(spark, sf_dir, "variant_lines")
        .groupBy(comparison_key(F.col("text")).alias("text_key")).agg(F.count("*").alias("lines"))
    )


QUERIES = {
    "best_match": _best_match,
    "extract_mrp": _field("mrp", "amount", "currency", "tier", "confidence", "raw_text"),
    "extract_net_quantity": _field("net_quantity", "value", "unit", "confidence", "raw_text"),
    "extract_manufacturer": _field("manufacturer", "name", "confidence", "raw_text"),
    "extract_manufacture_date": _field("manufacture_date", "day", "month", "year", "confidence", "raw_text"),
    "extract_expiry_date": _field("expiry_date", "day", "month", "year", "confidence", "raw_text"),
    "extract_cautions": _field("cautions", "present", "text", "confidence", "raw_text"),
    "date_checks": _date_checks,
    "date_source_panel": _date_source,
    "extract_nutrition": _nutrition,
    "script_mrp": _field("mrp", "amount", "currency", "tier", "confidence", "raw_text", read=_script_lines),
    "script_net_quantity": _field("net_quantity", "value", "unit", "confidence", "raw_text", read=_script_lines),
    "script_manufacturer": _field("manufacturer", "name", "confidence", "raw_text", read=_script_lines),
    "script_expiry_date": _field("expiry_date", "day", "month", "year", "confidence", "raw_text", read=_script_digits),
    "script_nutrition": lambda spark, sf_dir: _nutrition(spark, sf_dir, _script_lines),
    "nutrition_panel_lines": _nutrition_panels,
    "parse_catalog_quantity": _catalog_quantity,
    "symbol_evidence_text": _symbol_text,
    "normalize_text_key": _normalized,
}


# ------------------------------------------------------------------------------ oracles


def _words(words: list[str], text: str = "text") -> str:
    return "(" + " OR ".join(f"contains(lower({text}), '{w}')" for w in words) + ")"


def best_sql(words: list[str], pattern: str, keys: str = "scan_id, panel") -> str:
    return (
        f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY length(m) * 10 + confidence DESC,"
        f" line_no) AS rn FROM (SELECT *, regexp_extract(text, '{pattern}', 0) AS m FROM v_label_lines"
        f" WHERE {_words(words)}) WHERE m <> '') WHERE rn = 1"
    )


def panel_choice(source: str, first: str) -> str:
    """Rows of `source` (scan_id, panel, …): of two panels the first one in order."""
    return (
        f"SELECT * EXCLUDE (pick) FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY"
        f" CASE WHEN panel = '{first}' THEN 0 ELSE 1 END) AS pick FROM {source}) WHERE pick = 1"
    )


_AMOUNT = f"TRY_CAST(replace(regexp_extract(text, '{fixed.FIRST_NUMBER}', 0), ',', '') AS DOUBLE)"
PRICE_SQL = f"""
firsts AS (SELECT scan_id, panel, arg_min(text, line_no) AS text, arg_min(confidence, line_no) AS confidence
  FROM v_label_lines GROUP BY ALL),
spelled AS (SELECT scan_id, panel, round_even({_AMOUNT}, 2) AS amount, 'INR' AS currency, 1 AS tier, confidence, text AS raw_text
  FROM firsts WHERE contains(lower(text), 'maximum') AND contains(lower(text), 'retail')),
price_best AS ({best_sql(fixed.MRP_WORDS, fixed.MRP_PATTERN)}),
price_found AS (SELECT scan_id, panel, round_even({_AMOUNT}, 2) AS amount,
   CASE WHEN regexp_matches(text, '(?i)USD|\\$') THEN 'USD' WHEN regexp_matches(text, '(?i)EUR|€') THEN 'EUR' ELSE 'INR' END AS currency,
   CASE WHEN contains(lower(text), 'price') AND NOT (contains(lower(text), 'retail') OR contains(lower(text), 'maximum'))
        THEN 2 ELSE 1 END AS tier, confidence, text AS raw_text
  FROM price_best b WHERE NOT EXISTS (SELECT 1 FROM spelled s WHERE s.scan_id = b.scan_id AND s.panel = b.panel)),
price_any AS (SELECT * FROM (SELECT * FROM spelled UNION ALL SELECT * FROM price_found) WHERE amount IS NOT NULL),
price AS ({panel_choice('price_any', 'front')})"""

_NU = fixed.NUMBER_UNIT
QUANTITY_SQL = f"""
q_best AS ({best_sql(fixed.NET_QTY_WORDS, fixed.NET_QTY_PATTERN)}),
q_line AS (SELECT scan_id, panel, text, confidence FROM q_best
  UNION ALL
  SELECT scan_id, panel, arg_min(text, line_no), arg_min(confidence, line_no) FROM v_label_lines l
  WHERE regexp_matches(text, '{_NU}') AND NOT EXISTS
   (SELECT 1 FROM q_best b WHERE b.scan_id = l.scan_id AND b.panel = l.panel) GROUP BY scan_id, panel),
q_any AS (SELECT scan_id, panel,
   round_even(TRY_CAST(replace(regexp_extract(text, '{_NU}', 1), ',', '') AS DOUBLE), 2) AS value,
   lower(regexp_extract(text, '{_NU}', 2)) AS unit, confidence, text AS raw_text FROM q_line),
q_valued AS (SELECT * FROM q_any WHERE value IS NOT NULL),
quantity AS ({panel_choice('q_valued', 'front')})"""

_ABOVE = "trim(regexp_replace({0}, '^[^A-Za-z]+', ''))"


def _lags(window: str, same_panel: bool) -> str:
    tries = []
    for i in (1, 2, 3):
        text = f"lag(text, {i}) OVER {window}"
        ok = f"regexp_matches({text}, '{fixed.COMPANY_SUFFIX}')"
        if same_panel:
            ok += f" AND lag(panel, {i}) OVER {window} = panel"
        tries.append(
            f"CASE WHEN {ok} THEN struct_pack(name := {_ABOVE.format(text)},"
            f" confidence := lag(confidence, {i}) OVER {window}, raw_text := {text}) END"
        )
    return f"coalesce({', '.join(tries)})"


_W = "(PARTITION BY scan_id ORDER BY CASE WHEN panel = 'front' THEN 0 ELSE 1 END, line_no)"
_FOOTNOTE = f"({_words(fixed.MANUFACTURER_WORDS)} AND regexp_matches(text, '{fixed.HEADER_SIGNALS}'))"
MAKER_SQL = f"""
m_best AS ({best_sql(fixed.MANUFACTURER_WORDS, fixed.MANUFACTURER_PATTERN)}),
m_named AS (SELECT scan_id, panel, trim(regexp_replace(text, '{fixed.MANUFACTURER_LABEL}', '')) AS name, confidence,
   text AS raw_text FROM m_best),
m_above AS (SELECT * FROM (SELECT *, {_lags(_W, True)} AS own, {_lags(_W, False)} AS whole,
   row_number() OVER {_W} AS pos FROM v_label_lines) WHERE {_FOOTNOTE}),
m_first AS (SELECT scan_id, panel, text, confidence, first(own ORDER BY pos) AS own, first(whole ORDER BY pos) AS whole,
   min(pos) AS pos FROM m_above GROUP BY scan_id, panel, text, confidence),
m_whole AS (SELECT scan_id, text, confidence, first(whole ORDER BY pos) AS whole, min(pos) AS pos FROM m_first GROUP BY ALL),
m_panel AS (SELECT * FROM m_named WHERE name <> ''
  UNION ALL SELECT scan_id, panel, arg_min(own, pos).name, arg_min(own, pos).confidence, arg_min(own, pos).raw_text
  FROM m_first f WHERE own IS NOT NULL AND NOT EXISTS
   (SELECT 1 FROM m_named b WHERE b.scan_id = f.scan_id AND b.panel = f.panel) GROUP BY scan_id, panel),
m_chosen AS ({panel_choice('m_panel', 'back')}),
maker AS (SELECT scan_id, panel, name, confidence, raw_text FROM m_chosen
  UNION ALL SELECT scan_id, 'front', arg_min(whole, pos).name, arg_min(whole, pos).confidence, arg_min(whole, pos).raw_text
  FROM m_whole w WHERE whole IS NOT NULL AND scan_id NOT IN (SELECT scan_id FROM m_chosen)
   AND scan_id NOT IN (SELECT scan_id FROM m_named) GROUP BY scan_id)"""

_MONTH_LIST = "[" + ", ".join(f"'{m}'" for m in fixed.MONTHS) + "]"


def _group(pattern: str, i: int) -> str:
    return f"TRY_CAST(nullif(regexp_extract(text, '{pattern}', {i}), '') AS INT)"


def date_sql(name: str, words: list[str], first: str = "back") -> str:
    century = "CASE WHEN {0} < 100 THEN {0} + 2000 ELSE {0} END"
    return f"""
{name}_best AS ({best_sql(words, '.+')}),
{name}_parts AS (SELECT scan_id, panel, text, {_group(fixed.DATE_DMY, 1)} AS d1, {_group(fixed.DATE_DMY, 2)} AS m1,
   {_group(fixed.DATE_DMY, 3)} AS y1, {_group(fixed.DATE_MY, 1)} AS m2, {_group(fixed.DATE_MY, 2)} AS y2,
   list_position({_MONTH_LIST}, lower(nullif(regexp_extract(text, '{fixed.DATE_MONTH_YEAR}', 1), ''))) AS m3,
   {_group(fixed.DATE_MONTH_YEAR, 2)} AS y3,
   coalesce(TRY_CAST(nullif(regexp_extract(text, '{fixed.EMBEDDED_CONFIDENCE}', 1), '') AS DOUBLE) / 100, 0.85::DOUBLE) AS c
  FROM {name}_best),
{name}_any AS (SELECT scan_id, panel,
   CASE WHEN m1 BETWEEN 1 AND 12 AND d1 BETWEEN 1 AND 31 THEN d1 END AS day,
   CASE WHEN m1 BETWEEN 1 AND 12 AND d1 BETWEEN 1 AND 31 THEN m1 WHEN m2 BETWEEN 1 AND 12 THEN m2 ELSE m3 END AS month,
   CASE WHEN m1 BETWEEN 1 AND 12 AND d1 BETWEEN 1 AND 31 THEN {century.format('y1')}
        WHEN m2 BETWEEN 1 AND 12 THEN {century.format('y2')} ELSE {century.format('y3')} END AS year,
   round_even(CASE WHEN (m1 BETWEEN 1 AND 12 AND d1 BETWEEN 1 AND 31) OR m2 BETWEEN 1 AND 12 THEN c * 0.8::DOUBLE ELSE c * 0.85::DOUBLE END, 4) AS confidence,
   text AS raw_text FROM {name}_parts),
{name}_dated AS (SELECT * FROM {name}_any WHERE month IS NOT NULL AND year IS NOT NULL),
{name} AS ({panel_choice(name + '_dated', first)})"""


CAUTION_SQL = f"""
c_panels AS (SELECT scan_id, panel, arg_max(text, (confidence, -line_no)) FILTER (WHERE hit) AS raw_text,
   max(confidence) FILTER (WHERE hit) AS conf
  FROM (SELECT *, regexp_matches(text, '{fixed.CAUTION_PATTERN}') AND confidence > 0 AS hit FROM v_label_lines)
  GROUP BY scan_id, panel),
c_any AS (SELECT scan_id, panel, raw_text IS NOT NULL AS present, coalesce(trim(raw_text), '') AS text,
   coalesce(round_even(conf, 4), 0.95::DOUBLE) AS confidence, coalesce(raw_text, '') AS raw_text FROM c_panels),
caution AS ({panel_choice('c_any', 'back')})"""

_MADE, _EXPIRES = date_sql("made", fixed.MFD_WORDS), date_sql("expires", fixed.EXP_WORDS)
_BOTH_DATES = (
    "SELECT s.scan_id, m.year AS my, m.month AS mm, m.day AS md, e.year AS ey, e.month AS em, e.day AS ed"
    " FROM (SELECT DISTINCT scan_id FROM v_label_lines) s LEFT JOIN made m ON m.scan_id = s.scan_id"
    " LEFT JOIN expires e ON e.scan_id = s.scan_id"
)

_READING = ", ".join(
    f"{{'nutrient': '{name}', 'value': TRY_CAST(nullif(regexp_extract(text, '{pattern}', 1), '') AS DOUBLE),"
    f" 'unit': coalesce(nullif(regexp_extract(text, '{pattern}', 2), ''), '{fields.default_unit(name)}'),"
    f" 'matches': regexp_matches(text, '{pattern}'), 'named': contains(lower(text), '{name}'), 'usual': '{fields.default_unit(name)}'}}"
    for name, pattern in fixed.NUTRIENT_PATTERNS
)
_SEEN = "list_contains(list_transform(a, lambda f: f.nutrient), {0})"
_HITS = (
    f"list_filter(x.readings, lambda r: r.matches AND NOT {_SEEN.format('r.nutrient')}"
    f" AND NOT (r.nutrient = 'fibre' AND {_SEEN.format(chr(39) + 'fiber' + chr(39))})"
    f" AND NOT (r.nutrient = 'fiber' AND {_SEEN.format(chr(39) + 'fibre' + chr(39))}))"
)
_NAMES = f"list_filter(x.readings, lambda r: r.named AND NOT {_SEEN.format('r.nutrient')})"
_FACT = "STRUCT(nutrient VARCHAR, value DOUBLE, unit VARCHAR, confidence DOUBLE, raw_text VARCHAR)"
NUTRITION_SQL = f"""
n_pos AS (SELECT *, row_number() OVER {_W} AS pos FROM v_label_lines),
n_head AS (SELECT scan_id, min(pos) AS at FROM n_pos WHERE contains(lower(text), 'nutri') GROUP BY scan_id),
n_near AS (SELECT h.scan_id, o.pos, o.text, o.confidence FROM n_head h JOIN n_pos o ON o.scan_id = h.scan_id AND o.pos > h.at AND o.pos <= h.at + 20),
n_stop AS (SELECT scan_id, min(pos) AS stop FROM n_near WHERE {_words(fixed.NUTRITION_STOP_WORDS)} GROUP BY scan_id),
n_list AS (SELECT n.scan_id, list({{'text': text, 'confidence': confidence, 'readings': [{_READING}]}} ORDER BY pos) AS xs
  FROM n_near n LEFT JOIN n_stop s ON s.scan_id = n.scan_id WHERE stop IS NULL OR pos < stop GROUP BY n.scan_id),
n_facts AS (SELECT scan_id, list_reduce(xs, lambda a, x: CASE
   WHEN len({_HITS}) > 0 THEN list_append(a, CAST({{'nutrient': {_HITS}[1].nutrient, 'value': {_HITS}[1].value, 'unit': {_HITS}[1].unit,
     'confidence': round_even(x.confidence, 4), 'raw_text': x.text}} AS {_FACT}))
   WHEN len({_NAMES}) > 0 THEN list_append(a, CAST({{'nutrient': {_NAMES}[1].nutrient, 'value': NULL, 'unit': {_NAMES}[1].usual,
     'confidence': 0.0, 'raw_text': x.text}} AS {_FACT}))
   ELSE a END, CAST([] AS {_FACT}[])) AS facts FROM n_list),
nutrition AS (SELECT h.scan_id, coalesce(facts, []) AS facts FROM n_head h LEFT JOIN n_facts f ON f.scan_id = h.scan_id)"""



def _rewritten(column: str, length: int = 11) -> str:
    return f"translate({column}, '{_WRITTEN[0][:length]}', '{_WRITTEN[1][:length]}') AS {column}"


ORACLE = {
    "extract_nutrition": with_views(
        "label_lines",
        f"""WITH {NUTRITION_SQL}, u AS (SELECT scan_id, unnest(facts) AS f, unnest(range(len(facts))) AS pos FROM nutrition)
            SELECT scan_id, pos, f.nutrient, f.value, f.unit, f.confidence, f.raw_text FROM u""",
    ),
    "best_match": with_views(
        "label_lines",
        f"""WITH t AS (SELECT *, {_words(fixed.NET_QTY_WORDS)} AS worded, length(regexp_extract(text, '{_NU}', 0)) AS n
              FROM v_label_lines),
            u AS (SELECT *, bool_or(worded) OVER (PARTITION BY scan_id) AS any_worded FROM t),
            r AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY n * 10 + confidence DESC, line_no) AS rn
              FROM u WHERE n > 0 AND (worded OR NOT any_worded))
            SELECT scan_id, text, confidence, line_no, n * 10 + confidence AS score FROM r WHERE rn = 1""",
    ),
    "extract_mrp": with_views("label_lines", f"WITH {PRICE_SQL} SELECT * FROM price"),
    "extract_net_quantity": with_views("label_lines", f"WITH {QUANTITY_SQL} SELECT * FROM quantity"),
    "extract_manufacturer": with_views("label_lines", f"WITH {MAKER_SQL} SELECT * FROM maker"),
    "extract_manufacture_date": with_views("label_lines", f"WITH {_MADE} SELECT * FROM made"),
    "extract_expiry_date": with_views("label_lines", f"WITH {_EXPIRES} SELECT * FROM expires"),
    "extract_cautions": with_views("label_lines", f"WITH {CAUTION_SQL} SELECT * FROM caution"),
    "date_checks": with_views(
        "label_lines",
        f"""WITH {_MADE}, {_EXPIRES}, b AS ({_BOTH_DATES}),
            g AS (SELECT *, CASE WHEN ey <> my THEN ey - my WHEN em <> mm THEN em - mm ELSE ed - md END AS gap FROM b)
            SELECT scan_id,
             CASE WHEN my IS NULL OR ey IS NULL THEN 'incomparable' WHEN gap > 0 THEN 'ok'
              WHEN gap IS NULL THEN 'ok' ELSE 'conflict' END AS comparison,
             gap > 0 AS consistent,
             CASE WHEN gap < 0 THEN 'expiry date is before manufacture date'
              WHEN gap = 0 THEN 'expiry date is same as manufacture date' END AS conflict_reason FROM g""",
    ),
    "date_source_panel": with_views(
        "label_lines",
        f"""WITH {_MADE}, {_EXPIRES},
            d AS (SELECT scan_id, 'manufacture_date' AS field_name, raw_text FROM made
              UNION ALL SELECT scan_id, 'expiry_date', raw_text FROM expires)
            SELECT d.scan_id, field_name, CASE WHEN bool_or(panel = 'front' AND (contains(raw_text, text) OR contains(text, raw_text)))
              THEN 'front' ELSE 'back' END AS panel
            FROM d JOIN v_label_lines l ON l.scan_id = d.scan_id GROUP BY ALL""",
    ),
    "script_mrp": with_views("label_lines", f"WITH {PRICE_SQL} SELECT * REPLACE ({_rewritten('raw_text')}) FROM price"),
    "script_net_quantity": with_views(
        "label_lines", f"WITH {QUANTITY_SQL} SELECT * REPLACE ({_rewritten('raw_text')}) FROM quantity"
    ),
    "script_manufacturer": with_views(
        "label_lines", f"WITH {MAKER_SQL} SELECT * REPLACE ({_rewritten('raw_text')}, {_rewritten('name')}) FROM maker"
    ),
    "script_expiry_date": with_views("label_lines", f"WITH {_EXPIRES} SELECT * REPLACE ({_rewritten('raw_text', 10)}) FROM expires"),
    "script_nutrition": with_views(
        "label_lines",
        f"""WITH {NUTRITION_SQL}, u AS (SELECT scan_id, unnest(facts) AS f, unnest(range(len(facts))) AS pos FROM nutrition)
            SELECT scan_id, pos, f.nutrient, f.value, f.unit, f.confidence, translate(f.raw_text, '{_WRITTEN[0]}', '{_WRITTEN[1]}') AS raw_text FROM u""",
    ),
    "nutrition_panel_lines": with_views(
        "label_lines",
        f"""WITH o AS (SELECT *, row_number() OVER {_W} AS pos FROM v_label_lines),
            h AS (SELECT scan_id, min(pos) AS at FROM o WHERE contains(lower(text), 'nutri') GROUP BY scan_id)
            SELECT h.scan_id, count(o.pos) AS lines FROM h LEFT JOIN o ON o.scan_id = h.scan_id
             AND o.pos > h.at AND o.pos <= h.at + 20 GROUP BY h.scan_id""",
    ),
    "parse_catalog_quantity": with_views(
        "catalog",
        f"""SELECT barcode, TRY_CAST(regexp_extract(quantity, '{fixed.CATALOG_QUANTITY}', 1) AS DOUBLE) AS value,
             lower(regexp_extract(quantity, '{fixed.CATALOG_QUANTITY}', 2)) AS unit FROM v_catalog""",
    ),
    "symbol_evidence_text": with_views(
        "scan_symbols",
        f"""WITH p AS (SELECT *, CASE WHEN regexp_matches(data, '{fixed.PAYLOAD_URL}') THEN 'url'
              WHEN regexp_matches(data, '{fixed.PAYLOAD_STRUCTURED}') THEN 'structured_data' ELSE 'plain_text' END AS payload_type
              FROM v_scan_symbols),
            e AS (SELECT *, format || ': ' || data || CASE WHEN format = 'QRCODE' THEN ' (type=' || payload_type || ')' ELSE '' END
              AS evidence_text FROM p)
            SELECT scan_id, ord, payload_type, evidence_text, substr(evidence_text, instr(evidence_text, ': ') + 2) AS code FROM e""",
    ),
    "normalize_text_key": with_views(
        "variant_lines",
        r"""SELECT regexp_replace(lower(trim(text)), '\s+', ' ', 'g') AS text_key, count(*) AS lines
            FROM v_variant_lines GROUP BY ALL""",
    ),
}

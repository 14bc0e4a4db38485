"""Typed field values per scan from its label lines.

One aggregation over the lines keeps, per scan and panel, only the winning line of every field.
Each winner is a `max`/`min` over a struct, combined map-side, so a scan with very many lines
costs one row per map task. Parsing runs once per scan on the winners.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelspark import fixed
from labelspark.functions import fields
from labelspark.functions.text import contains_any, holds_any, plain, rounded, strip
from labelspark.operators.ordered import BLOCK, first_k, with_previous
from labelspark.session import staged

PANELS = ["front", "back"]


def panel_rank(panel: Column) -> Column:
    return F.when(panel == "front", 0).otherwise(1)


# --------------------------------------------------------------------------- best match


def _match_length(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_extract(text, pattern, 0))


def _scored(length: Column, admitted: Column) -> Column:
    """Ordering struct of a line: longest match first, confidence next, earlier line on ties."""
    return F.when(
        admitted & (length > 0),
        F.struct(
            (length * 10 + F.col("confidence")).alias("score"),
            (-F.col("line_no")).alias("back"),
            F.col("confidence").alias("confidence"),
            F.col("text").alias("text"),
        ),
    )


def _positioned(admitted: Column) -> Column:
    return F.when(
        admitted,
        F.struct(F.col("line_no"), F.col("text"), F.col("confidence")),
    )


def best_match(
    lines: DataFrame, keys: list[str], pattern: str, words: list[str], require_word: bool
) -> DataFrame:
    """Best line per group: lines with a word, or all of them if none has one and that is allowed."""
    text = F.col("text")
    has_word = contains_any(text, words)
    length = _match_length(plain(text), pattern)
    grouped = lines.groupBy(*keys).agg(
        F.bool_or(has_word).alias("has_word"),
        F.max(_scored(length, has_word)).alias("worded"),
        F.max(_scored(length, F.lit(True))).alias("any"),
    )
    fallback = F.lit(None) if require_word else F.col("any")
    chosen = F.when(F.col("has_word"), F.col("worded")).otherwise(fallback)
    return grouped.select(*keys, chosen.alias("best")).filter("best is not null").select(
        *keys, F.col("best.text").alias("text"), F.col("best.confidence").alias("confidence"),
        (-F.col("best.back")).alias("line_no"), F.col("best.score").alias("score"),
    )


# ------------------------------------------------------------------- per-scan line state


# Word test, pattern whose match length scores a line, per winner. Text without the word can
# never win, so the pattern runs on the few lines that hold one.
_SCORED = {
    "price": (fixed.MRP_WORDS, fixed.MRP_PATTERN),
    # The quantity pattern cannot match without a quantity word, so "no word in the panel: try
    # all lines" never finds one and needs no state of its own.
    "quantity": (fixed.NET_QTY_WORDS, fixed.NET_QTY_PATTERN),
    "maker": (fixed.MANUFACTURER_WORDS, fixed.MANUFACTURER_PATTERN),
    "made": (fixed.MFD_WORDS, ".+"),
    "expires": (fixed.EXP_WORDS, ".+"),
}


_MARKS = [*_SCORED, "spelled", "quantity_first", "caution", "footnote", "nutrition"]


def line_marks(lines: DataFrame, names: list[str] | None = None) -> DataFrame:
    """The lines with what every later step asks of their text: `<winner>_length` (null without the
    winner's word) and `is_<mark>`.

    The tests are staged (lower case once, words, patterns behind their words) so that no regular
    expression is evaluated twice or on a line that cannot win. Marked lines can be stored: the steps
    below take lines with or without marks.
    """
    wanted = _MARKS if names is None else names
    own, lowered, readable = lines.columns, F.col("lowered"), F.col("readable")
    scored = [n for n in _SCORED if n in wanted]
    words = {n: _SCORED[n][0] for n in scored}
    if "caution" in wanted:
        words["caution"] = fixed.CAUTION_WORDS
    if "footnote" in wanted:
        words["footnote"] = fixed.MANUFACTURER_WORDS
    tests = {
        "spelled": lambda: lowered.contains("maximum") & lowered.contains("retail"),
        "quantity_first": lambda: readable.rlike(fixed.NUMBER_UNIT_HINT) & readable.rlike(fixed.NUMBER_UNIT),
        "caution": lambda: F.col("caution_word") & readable.rlike(fixed.CAUTION_PATTERN),
        "footnote": lambda: F.col("footnote_word") & readable.rlike(fixed.HEADER_SIGNALS),
        "nutrition": lambda: lowered.contains("nutri"),
    }
    return (
        lines.select(*own, F.lower("text").alias("lowered"), plain(F.col("text")).alias("readable"))
        .select(*own, "lowered", "readable", *[holds_any(lowered, w).alias(f"{n}_word") for n, w in words.items()])
        .select(
            *own,
            *[F.when(F.col(f"{n}_word"), _match_length(readable, _SCORED[n][1])).alias(f"{n}_length") for n in scored],
            *[test().alias(f"is_{n}") for n, test in tests.items() if n in wanted],
        )
    )


def _mark_column(name: str) -> str:
    return f"{name}_length" if name in _SCORED else f"is_{name}"


def _marked(lines: DataFrame, names: list[str]) -> DataFrame:
    """Lines with these marks, which stored lines have already."""
    columns = [_mark_column(n) for n in names]
    return lines if set(columns) <= set(lines.columns) else line_marks(lines.drop(*columns), names)


def line_states(lines: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Winning lines per (scan, panel)."""
    wanted = [*_SCORED, "first_line", "spelled", "quantity_first", "caution"] if names is None else names
    scored = [n for n in _SCORED if n in wanted]
    stored = [c for c in map(_mark_column, _MARKS) if c in lines.columns]
    base = lines.select("scan_id", "panel", "line_no", "text", "confidence", *stored)
    others = {
        "first_line": lambda: F.min("line_no"),
        "spelled": lambda: F.min(_positioned(F.col("is_spelled"))),
        "quantity_first": lambda: F.min(_positioned(F.col("is_quantity_first"))),
        "caution": lambda: F.max(
            F.when(
                F.col("is_caution") & (F.col("confidence") > 0),
                F.struct(F.col("confidence"), (-F.col("line_no")).alias("back"), F.col("text")),
            )
        ),
    }
    return _marked(base, [n for n in wanted if n in _MARKS]).groupBy("scan_id", "panel").agg(
        *[F.max(_scored(F.col(f"{n}_length"), F.lit(True))).alias(n) for n in scored],
        *[build().alias(n) for n, build in others.items() if n in wanted],
    )


# ----------------------------------------------------------------- values from one state


def price_of() -> Column:
    spelled, best = F.col("spelled"), F.col("price")
    first_is_spelled = spelled["line_no"] == F.col("first_line")
    return F.when(
        first_is_spelled, fields.spelled_price_value(spelled["text"], spelled["confidence"])
    ).otherwise(fields.price_value(best["text"], best["confidence"]))


def quantity_of() -> Column:
    best, first = F.col("quantity"), F.col("quantity_first")
    return fields.quantity_value(
        F.when(best.isNotNull(), best["text"]).otherwise(first["text"]),
        F.when(best.isNotNull(), best["confidence"]).otherwise(first["confidence"]),
    )


def maker_of() -> Column:
    return fields.manufacturer_value(F.col("maker")["text"], F.col("maker")["confidence"])


def made_of() -> Column:
    return fields.date_value(F.col("made")["text"])


def expires_of() -> Column:
    return fields.date_value(F.col("expires")["text"])


def caution_of() -> Column:
    """Never null: no caution word is itself an answer."""
    text, confidence = F.col("caution")["text"], F.col("caution")["confidence"]
    present = text.isNotNull()
    return F.struct(
        present.alias("present"),
        F.coalesce(strip(text), F.lit("")).alias("text"),
        F.when(present, rounded(confidence, 4)).otherwise(fixed.ABSENT_CAUTION_CONFIDENCE).alias("confidence"),
        F.coalesce(text, F.lit("")).alias("raw_text"),
    )


_FIELD_STATES = {
    "mrp": (price_of, ["first_line", "spelled", "price"]),
    "net_quantity": (quantity_of, ["quantity", "quantity_first"]),
    "manufacturer": (maker_of, ["maker"]),
    "manufacture_date": (made_of, ["made"]),
    "expiry_date": (expires_of, ["expires"]),
    "cautions": (caution_of, ["caution"]),
}


def in_panel_order(field: str, value: Column) -> Column:
    """Aggregate over a scan's panels: (value, panel) of the first panel, in the field's own
    order, that has a value."""
    order = fixed.PANEL_ORDER.get(field, PANELS)
    rank = F.when(F.col("panel") == order[0], 0).otherwise(1)
    return F.min(
        F.when(value.isNotNull(), F.struct(rank.alias("rank"), value.alias("value"), F.col("panel")))
    )


# ------------------------------------------------------------ names above "name, address"


def read_in_order(lines: DataFrame) -> DataFrame:
    """The lines of scans with a manufacturer footnote or a "nutri" line, with these marks: all the lines
    that are looked at by their order. Stored, they spare footnotes and nutrition a shuffle of all lines each."""
    marked = _marked(lines, ["footnote", "nutrition"]).select(
        "scan_id", "panel", "line_no", "text", "confidence", "is_footnote", "is_nutrition"
    )
    return marked.join(marked.filter("is_footnote OR is_nutrition").select("scan_id").distinct(), "scan_id", "left_semi")


def above_footnote(lines: DataFrame) -> DataFrame:
    """Per scan the company line above a manufacturer footnote: columns front, back, merged.

    Only scans with such a footnote take part. A footnote text occurring again (same text and
    confidence) looks above its first occurrence, so later copies add nothing.
    """
    marked = _marked(lines, ["footnote"]).select("scan_id", "panel", "line_no", "text", "confidence", "is_footnote")
    scans = marked.filter("is_footnote").select("scan_id").distinct()
    ordered = (
        marked.join(scans, "scan_id", "left_semi")
        .withColumn("panel_rank", panel_rank(F.col("panel")))
        .withColumn("line_block", F.floor(F.col("line_no") / BLOCK))
    )
    order = ["panel_rank", "line_no", "text", "confidence"]
    seen = with_previous(
        ordered, ["scan_id"], ["panel_rank", "line_block"], order,
        F.struct("panel", "text", "confidence"), 3, "above",
    ).filter("is_footnote")

    def name_in(candidates: Column) -> Column:
        named = F.transform(
            candidates, lambda c: fields.adjacent_manufacturer_value(c["text"], c["confidence"])
        )
        return F.get(F.array_compact(named), F.lit(0))

    named = seen.select(
        "scan_id", "panel", "panel_rank", "line_no", "text", "confidence",
        name_in(F.filter("above", lambda c: c["panel"] == F.col("panel"))).alias("own"),
        name_in(F.col("above")).alias("merged"),
    )
    # First occurrence of each footnote: within its panel, and within the whole scan. Written once,
    # since both follow from it and it is far smaller than the lines.
    own = staged(
        named.groupBy("scan_id", "panel", "text", "confidence")
        .agg(F.min(F.struct("panel_rank", "line_no", "own", "merged")).alias("first")),
        "footnotes",
    )
    whole = (
        own.groupBy("scan_id", "text", "confidence")
        .agg(F.min(F.struct("first.panel_rank", "first.line_no", "first.merged")).alias("first"))
        .filter("first.merged is not null")
        .groupBy("scan_id")
        .agg(F.min("first").alias("whole"))
    )
    chosen = own.filter("first.own is not null").groupBy("scan_id").agg(
        *[F.min(F.when(F.col("panel") == p, F.col("first"))).alias(p) for p in PANELS]
    )
    return chosen.join(whole, "scan_id", "full").select(
        "scan_id", *[F.col(p)["own"].alias(f"above_{p}") for p in PANELS],
        F.col("whole.merged").alias("above_merged"),
    )


# ---------------------------------------------------------------------------- nutrition


def nutrition_window(lines: DataFrame, in_order: DataFrame | None = None) -> DataFrame:
    """The at most 20 lines after each scan's first "nutri" line, cut at a stop word. `in_order`: the
    lines of `read_in_order`, if they are stored."""

    def ordered(lines: DataFrame) -> DataFrame:
        return _marked(lines, ["nutrition"]).select(
            "scan_id", panel_rank(F.col("panel")).alias("panel_rank"), "line_no", "text", "confidence", "is_nutrition"
        )

    order = ["panel_rank", "line_no", "text", "confidence"]
    header = (
        ordered(lines).filter("is_nutrition")
        .groupBy("scan_id")
        .agg(F.min(F.struct(*order)).alias("header"))
    )
    after = ordered(lines if in_order is None else in_order).join(header, "scan_id").filter(F.struct(*order) > F.col("header"))
    near = first_k(after, ["scan_id"], order, fixed.NUTRITION_WINDOW)
    return header.select("scan_id").join(
        near.groupBy("scan_id").agg(
            F.array_sort(
                F.collect_list(
                    F.struct("rank", "text", "confidence", fields.nutrient_readings(F.col("text")).alias("readings"))
                )
            ).alias("panel_lines")
        ),
        "scan_id", "left",
    )


def nutrition_facts(lines: DataFrame, in_order: DataFrame | None = None) -> DataFrame:
    """(scan_id, nutrients): null scan rows do not occur; a header with nothing after it gives []."""
    stop = lambda line: contains_any(line["text"], fixed.NUTRITION_STOP_WORDS)
    stops = F.transform(F.filter("panel_lines", stop), lambda line: line["rank"])
    last = F.coalesce(F.array_min(stops), F.lit(fixed.NUTRITION_WINDOW + 1))
    fact = "array<struct<nutrient:string,value:double,unit:string,confidence:double,raw_text:string>>"

    def step(found: Column, line: Column) -> Column:
        seen = F.transform(found, lambda f: f["nutrient"])

        def unseen(reading: Column) -> Column:
            name = reading["nutrient"]
            return ~F.array_contains(seen, name)

        def not_other_spelling(reading: Column) -> Column:
            name = reading["nutrient"]
            other = F.when(name == "fibre", "fiber").when(name == "fiber", "fibre").otherwise("")
            return ~F.array_contains(seen, other)

        hits = F.filter(line["readings"], lambda r: r["matches"] & unseen(r) & not_other_spelling(r))
        names = F.filter(line["readings"], lambda r: r["named"] & unseen(r))
        hit, name = F.get(hits, F.lit(0)), F.get(names, F.lit(0))

        def as_fact(reading: Column, value: Column, unit: Column, confidence: Column) -> Column:
            return F.array(
                F.struct(
                    reading["nutrient"].alias("nutrient"), value.alias("value"), unit.alias("unit"),
                    confidence.alias("confidence"), line["text"].alias("raw_text"),
                )
            ).cast(fact)

        confidence = F.when(hit["value"].isNull(), 0.0).otherwise(rounded(line["confidence"], 4))
        usual = F.when(name["nutrient"] == "energy", "kcal").when(name["nutrient"] == "sodium", "mg").otherwise("g")
        return F.concat(
            found,
            F.when(F.size(hits) > 0, as_fact(hit, hit["value"], hit["unit"], confidence))
            .when(F.size(names) > 0, as_fact(name, F.lit(None), usual, F.lit(0.0)))
            .otherwise(F.array().cast(fact)),
        ).cast(fact)

    kept = F.filter(F.coalesce("panel_lines", F.slice(F.col("panel_lines"), 1, 0)), lambda line: line["rank"] < last)
    facts = F.aggregate(kept, F.array().cast(fact), step)
    return nutrition_window(lines, in_order).select(
        "scan_id", F.coalesce(facts, F.array().cast(fact)).alias("nutrients")
    )


# ------------------------------------------------------------------------- all the fields


def extract_fields(lines: DataFrame, wanted: list[str] | None = None, in_order: DataFrame | None = None) -> DataFrame:
    """One row per scan, one (value, panel) struct per field except nutrition. `in_order`: the lines of
    `read_in_order`, if they are stored.

    Running an extractor on the merged panels can only add something for the manufacturer: every
    other winner of the merged lines is the winner of one panel and was parsed there.
    """
    wanted = [f for f in _FIELD_STATES if wanted is None or f in wanted]
    states = line_states(lines, [n for f in wanted for n in _FIELD_STATES[f][1]])
    parsed = states.select(
        "scan_id", "panel", *[_FIELD_STATES[f][0]().alias(f) for f in wanted],
        *([F.col("maker").isNotNull().alias("has_maker")] if "manufacturer" in wanted else []),
    )
    others = [f for f in wanted if f != "manufacturer"]
    aggregates = [in_panel_order(f, F.col(f)).alias(f) for f in others]
    aggregates.append(F.max(F.col("panel") == "back").alias("has_back"))
    if "manufacturer" in wanted:
        for panel in PANELS:
            here = F.col("panel") == panel
            aggregates.append(F.max(F.when(here, F.col("manufacturer"))).alias(f"maker_{panel}"))
            aggregates.append(F.bool_or(here & F.col("has_maker")).alias(f"has_{panel}_maker"))
    scans = parsed.groupBy("scan_id").agg(*aggregates)
    columns = [
        F.when(F.col(f).isNotNull(), F.struct(F.col(f)["value"].alias("value"), F.col(f)["panel"].alias("panel")))
        .alias(f)
        for f in others
    ]
    if "manufacturer" in wanted:
        scans = scans.join(above_footnote(lines if in_order is None else in_order), "scan_id", "left")
        tries = [
            (F.when(F.col(f"has_{p}_maker"), F.col(f"maker_{p}")).otherwise(F.col(f"above_{p}")), p)
            for p in fixed.PANEL_ORDER["manufacturer"]
        ]
        any_maker = F.col("has_front_maker") | F.col("has_back_maker")
        tries.append((F.when(~any_maker, F.col("above_merged")), "front"))
        columns.append(
            F.coalesce(
                *[
                    F.when(value.isNotNull(), F.struct(value.alias("value"), F.lit(p).alias("panel")))
                    for value, p in tries
                ]
            ).alias("manufacturer")
        )
    return scans.select(
        "scan_id", *columns, F.when(F.col("has_back"), "back").otherwise("front").alias("nutrition_panel")
    )


def date_source_panel(lines: DataFrame, dates: DataFrame) -> DataFrame:
    """Panel whose line holds a date's text or is held by it; front where none does.

    `dates` has one row per (scan_id, field) with raw_text.
    """
    hit = F.col("raw_text").contains(F.col("text")) | F.col("text").contains(F.col("raw_text"))
    found = (
        lines.select("scan_id", "panel", "text")
        .join(dates.select("scan_id", "field_name", "raw_text"), "scan_id")
        .filter(hit & (F.col("raw_text") != ""))
        .groupBy("scan_id", "field_name")
        .agg(F.min(panel_rank(F.col("panel"))).alias("panel_rank"))
    )
    return dates.join(found, ["scan_id", "field_name"], "left").withColumn(
        "panel", F.when(F.col("panel_rank") == 1, "back").otherwise("front")
    ).drop("panel_rank")

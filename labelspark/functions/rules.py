"""Rule conditions as Column expressions. A reason is null where the condition holds.

`conditions` is a struct<must_be_present boolean, min_confidence double, format string,
min_value double, max_value double, min_length int, allowed_units array<string>,
min_font_size_mm double, max_font_size_mm double>.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelspark import fixed
from labelspark.functions.display import number_text
from labelspark.functions.geometry import font_height_mm
from labelspark.functions.text import strip


def _say(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _bounds(name: str, number: Column, conditions: Column) -> Column:
    low, high = conditions["min_value"], conditions["max_value"]
    return F.when(number < low, _say(f"{name} ", number_text(number), " below minimum ", number_text(low))).when(
        number > high, _say(f"{name} ", number_text(number), " above maximum ", number_text(high))
    )


def check_numeric(value: Column, conditions: Column) -> Column:
    amount = value["amount"]
    return F.when(amount.isNull(), "value is not numeric").otherwise(_bounds("value", amount, conditions))


def check_quantity(value: Column, conditions: Column) -> Column:
    number, unit, allowed = value["value"], value["unit"], conditions["allowed_units"]
    known = F.array_contains(F.transform(allowed, F.lower), F.lower(unit))
    return (
        F.when(value.isNull(), "value is not a quantity object")
        .when(number.isNull(), "quantity missing 'value'")
        .when(unit.isNull(), "quantity missing 'unit'")
        .when(
            (F.size(allowed) > 0) & ~known,
            _say("unit '", unit, "' not in allowed units ['", F.array_join(allowed, "', '"), "']"),
        )
        .otherwise(_bounds("quantity value", number, conditions))
    )


def check_text(value: Column, conditions: Column) -> Column:
    text = strip(F.coalesce(value["name"], value["text"], F.lit("")))
    short = F.length(text) < conditions["min_length"]
    return F.when(F.coalesce(conditions["must_be_present"], F.lit(False)) & (text == ""), "text value is empty").when(
        short,
        _say("text length ", F.length(text).cast("string"), " below minimum ", conditions["min_length"].cast("string")),
    )


def check_date(value: Column, conditions: Column) -> Column:
    month, year = value["month"], value["year"]
    iso = value["text"]
    return (
        F.when(value.isNull(), "date value is missing")
        .when(
            iso.isNotNull(),
            F.when(F.try_to_date(iso, "yyyy-MM-dd").isNull(), _say("date '", iso, "' is not valid ISO format")),
        )
        .when(year.isNull() | month.isNull(), "date missing year or month")
        .when(~month.between(1, 12), _say("invalid month ", month.cast("string")))
    )


def check_nutrition_panel(value: Column, conditions: Column) -> Column:
    nutrients = value["nutrients"]
    return (
        F.when(value.isNull(), "nutrition panel not found")
        .when(nutrients.isNull(), "nutrition value is not a list")
        .when(F.size(nutrients) == 0, "nutrition panel is empty")
        .when(~F.exists(nutrients, lambda n: n["value"].isNotNull()), "no readable nutrients in panel")
    )


# Format name → reason builder; callers may add their own.
FORMAT_CHECKERS: dict[str, Callable[[Column, Column], Column]] = {
    "numeric": check_numeric,
    "quantity_with_unit": check_quantity,
    "text": check_text,
    "date": check_date,
    "nutrition_panel": check_nutrition_panel,
}


def low_confidence(confidence: Column, conditions: Column) -> Column:
    minimum = conditions["min_confidence"]
    return F.when(
        confidence < minimum,
        _say("insufficient confidence (", F.format_string("%.2f", confidence), " < ", number_text(minimum), ")"),
    )


def validate_conditions(value: Column, confidence: Column, conditions: Column, checkers=None) -> Column:
    """First failing condition as a reason: presence, then confidence, then format."""
    must = F.coalesce(conditions["must_be_present"], F.lit(False))
    empty_name = strip(value["name"]) == ""
    formats = None
    for name, check in (checkers or FORMAT_CHECKERS).items():
        test = conditions["format"] == name
        formats = F.when(test, check(value, conditions)) if formats is None else formats.when(test, check(value, conditions))
    return F.coalesce(
        F.when(must & value.isNull(), "required declaration not found").when(
            must & empty_name, "required declaration is empty"
        ),
        low_confidence(confidence, conditions),
        formats,
    )


def font_size_outcome(value: Column, scale: Column, conditions: Column) -> Column:
    """(verdict, reason) of a physical font-size rule, null where the rule sets no size."""
    low, high = conditions["min_font_size_mm"], conditions["max_font_size_mm"]
    measured = font_height_mm(value["font_height_px"], scale)
    height = measured["font_height_mm"]
    shown = F.format_string("%.4f", height)

    def outcome(verdict: str, reason: Column) -> Column:
        return F.struct(F.lit(verdict).alias("verdict"), reason.alias("reason"))

    return F.when(
        low.isNotNull() | high.isNotNull(),
        F.when(
            measured["status"] != "ESTABLISHED",
            outcome("NOT_VERIFIED", _say("physical font size not verified: ", measured["reason"])),
        )
        .when(height < low, outcome("VIOLATION", _say("font height ", shown, " mm below minimum ", number_text(low), " mm")))
        .when(height > high, outcome("VIOLATION", _say("font height ", shown, " mm above maximum ", number_text(high), " mm")))
        .otherwise(outcome("SATISFIED", _say("font height ", shown, " mm meets physical size rule"))),
    )


def evaluate_declaration(
    declared: Column, rule_applies_to: Column, conditions: Column, category: Column
) -> Column:
    """(verdict, reason, confidence) of one declaration under one rule.

    `declared` is null for a missing declaration, else a struct with field_name, value, verdict,
    confidence and scale.
    """
    applies_to = F.lower(F.coalesce(rule_applies_to, F.lit("")))
    wanted = F.coalesce(category, F.lit(""))
    not_applicable = (
        (wanted != "") & (applies_to != "") & ~applies_to.contains("all") & ~applies_to.contains(F.lower(wanted))
    )
    must = F.coalesce(conditions["must_be_present"], F.lit(False))
    given = declared["confidence"]
    confidence = F.coalesce(given, F.lit(0.0))
    value = declared["value"]
    too_low = low_confidence(confidence, conditions)
    failed = validate_conditions(value, confidence, conditions)

    def outcome(verdict: Column | str, reason: Column | str, sure: Column) -> Column:
        lift = lambda v: F.lit(v) if isinstance(v, str) else v
        return F.struct(lift(verdict).alias("verdict"), lift(reason).alias("reason"), sure.cast("double").alias("confidence"))

    none = F.lit(None)
    font = font_size_outcome(value, declared["scale"], conditions)
    return (
        F.when(
            not_applicable,
            outcome("NOT_APPLICABLE", _say("rule not applicable to category '", category, "'"), none),
        )
        .when(declared.isNull() & must, outcome("VIOLATION", "required declaration not found", none))
        .when(declared.isNull(), outcome("NOT_APPLICABLE", "declaration not present and not required", none))
        .when(
            declared["verdict"] == "CONFLICT",
            outcome("CONFLICT", _say("conflicting evidence for '", declared["field_name"], "'"), given),
        )
        .when(font.isNotNull(), outcome(font["verdict"], font["reason"], given))
        .when(too_low.isNotNull(), outcome("NOT_VERIFIED", too_low, confidence))
        .when(failed.isNotNull(), outcome("VIOLATION", failed, confidence))
        .otherwise(outcome("SATISFIED", "all conditions satisfied", confidence))
    )


def severity(verdict: Column) -> Column:
    """Rank of a verdict, worst first; null for "not applicable"."""
    ranks = [F.lit(v) for i, name in enumerate(fixed.VERDICTS[:-1]) for v in (name, i)]
    return F.create_map(*ranks)[verdict]


def worst(verdict: Column) -> Column:
    """Aggregate: the most severe verdict, ignoring "not applicable" unless it is alone."""
    names = F.array(*map(F.lit, fixed.VERDICTS))
    return F.coalesce(F.get(names, F.min(severity(verdict))), F.lit("NOT_APPLICABLE"))

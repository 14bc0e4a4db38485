"""From one label line to a typed value: Column in, struct Column out (null = no value)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelspark import fixed
from labelspark.functions.text import matched, number, plain, rounded, strip


def _when_all(value: Column, *needed: Column) -> Column:
    condition = needed[0].isNotNull()
    for column in needed[1:]:
        condition = condition & column.isNotNull()
    return F.when(condition, value)


# ------------------------------------------------------------------------------- price


def has_currency(text: Column) -> Column:
    return text.rlike(r"(?i)USD|\$|EUR|€|₹|INR|Rs")


def price_currency(text: Column) -> Column:
    return (
        F.when(text.rlike(r"(?i)USD|\$"), "USD")
        .when(text.rlike(r"(?i)EUR|€"), "EUR")
        .otherwise(fixed.ASSUMED_CURRENCY)
    )


def price_tier(text: Column) -> Column:
    """How strongly the wording says "maximum retail price": 1, 2 or 4."""
    lowered = F.lower(text)
    retail, maximum = lowered.contains("retail"), lowered.contains("maximum")
    plain_price = lowered.contains("price") & ~retail & ~maximum
    spelled_out = ~lowered.rlike(r"\bmrp\b") & (retail | maximum)
    return (
        F.when(plain_price, F.when(has_currency(text), 2).otherwise(4))
        .when(spelled_out | has_currency(text), 1)
        .otherwise(4)
    )


def _price(text: Column, confidence: Column, currency: Column, tier: Column) -> Column:
    amount = number(matched(plain(text), fixed.FIRST_NUMBER))
    return _when_all(
        F.struct(
            rounded(amount, 2).alias("amount"), currency.alias("currency"),
            confidence.alias("confidence"), text.alias("raw_text"), tier.alias("tier"),
        ),
        amount,
    )


def price_value(text: Column, confidence: Column) -> Column:
    """The amount is the first number of the line, wherever the currency stands."""
    return _price(text, confidence, price_currency(text), price_tier(text))


def spelled_price_value(text: Column, confidence: Column) -> Column:
    """"Maximum … retail …" line: a bare number is enough."""
    return _price(text, confidence, F.lit(fixed.ASSUMED_CURRENCY), F.lit(1))


def is_spelled_price(text: Column) -> Column:
    lowered = F.lower(text)
    return lowered.contains("maximum") & lowered.contains("retail")


# ---------------------------------------------------------------------------- quantity


def quantity_value(text: Column, confidence: Column) -> Column:
    readable = plain(text)
    value = number(matched(readable, fixed.NUMBER_UNIT, 1))
    return _when_all(
        F.struct(
            rounded(value, 2).alias("value"),
            F.lower(F.regexp_extract(readable, fixed.NUMBER_UNIT, 2)).alias("unit"),
            confidence.alias("confidence"), text.alias("raw_text"),
        ),
        value,
    )


def catalog_quantity(text: Column) -> Column:
    """"500 g" style text of a catalog record as (value, unit)."""
    trimmed = strip(plain(text))
    value = number(matched(trimmed, fixed.CATALOG_QUANTITY, 1))
    return _when_all(
        F.struct(
            value.alias("value"),
            F.lower(F.regexp_extract(trimmed, fixed.CATALOG_QUANTITY, 2)).alias("unit"),
        ),
        value,
    )


# ------------------------------------------------------------------------ manufacturer


def manufacturer_value(text: Column, confidence: Column) -> Column:
    # (?U): the blanks after the label are of any kind, and the name keeps its own characters.
    name = F.nullif(strip(F.regexp_replace(text, f"(?U){fixed.MANUFACTURER_LABEL}", "")), F.lit(""))
    return _named(name, confidence, text)


def adjacent_manufacturer_value(text: Column, confidence: Column) -> Column:
    """Line above a "name and address" footnote; needs a company word."""
    line = strip(text)
    name = F.nullif(strip(F.regexp_replace(line, "^[^A-Za-z]+", "")), F.lit(""))
    return F.when(line.rlike(fixed.COMPANY_SUFFIX), _named(name, confidence, line))


def _named(name: Column, confidence: Column, raw: Column) -> Column:
    return _when_all(
        F.struct(name.alias("name"), confidence.alias("confidence"), raw.alias("raw_text")), name
    )


# ------------------------------------------------------------------------------- dates


def _int(text: Column, pattern: str, group: int) -> Column:
    return matched(text, pattern, group).try_cast("int")


def _century(year: Column) -> Column:
    return F.when(year < 100, year + 2000).otherwise(year)


def date_value(text: Column) -> Column:
    """Partial date of a line: D/M/Y, else M/Y, else month name and year.

    The confidence comes from a written "conf: NN" or a constant, never from the OCR line.
    """
    readable = plain(text)
    written = matched(readable, fixed.EMBEDDED_CONFIDENCE, 1).try_cast("double") / 100
    base = F.coalesce(written, F.lit(fixed.DATE_CONFIDENCE))

    def dated(day: Column, month: Column, year: Column, factor: float, valid: Column) -> Column:
        return F.when(
            valid,
            F.struct(
                day.cast("int").alias("day"), month.cast("int").alias("month"),
                _century(year).cast("int").alias("year"),
                rounded(base * factor, 4).alias("confidence"), text.alias("raw_text"),
            ),
        )

    day, month, year = (_int(readable, fixed.DATE_DMY, g) for g in (1, 2, 3))
    short_month, short_year = (_int(readable, fixed.DATE_MY, g) for g in (1, 2))
    name = F.lower(matched(readable, fixed.DATE_MONTH_YEAR, 1))
    named_month = F.array_position(F.array(*map(F.lit, fixed.MONTHS)), name)
    named_year = _int(readable, fixed.DATE_MONTH_YEAR, 2)
    no_day = F.lit(None)
    return F.coalesce(
        dated(day, month, year, fixed.DATE_NUMERIC_FACTOR, month.between(1, 12) & day.between(1, 31)),
        dated(no_day, short_month, short_year, fixed.DATE_NUMERIC_FACTOR, short_month.between(1, 12)),
        dated(no_day, named_month, named_year, fixed.DATE_MONTH_NAME_FACTOR, named_month > 0),
    )


def compare_dates(made: Column, expires: Column) -> Column:
    """ok / conflict / incomparable at the finest granularity both dates share."""
    same_month = expires["month"] == made["month"]
    return (
        F.when(made.isNull() | expires.isNull(), "incomparable")
        .when(made["year"].isNull() | expires["year"].isNull(), "incomparable")
        .when(expires["year"] < made["year"], "conflict")
        .when(expires["year"] > made["year"], "ok")
        .when(made["month"].isNull() | expires["month"].isNull(), "incomparable")
        .when(expires["month"] < made["month"], "conflict")
        .when(made["day"].isNull() | expires["day"].isNull(), "ok")
        .when(expires["day"] < made["day"], "conflict")
        .when(same_month & (expires["day"] == made["day"]), "conflict")
        .otherwise("ok")
    )


def date_relationship(made: Column, expires: Column) -> Column:
    """(consistent, conflict_reason): true, false, or null where it cannot be told."""
    before = "expiry date is before manufacture date"
    same = "expiry date is same as manufacture date"
    year, month, day = (expires[p] - made[p] for p in ("year", "month", "day"))
    gap = F.when(year != 0, year).when(year == 0, F.when(month != 0, month).when(month == 0, day))
    return F.struct(
        (gap > 0).alias("consistent"),
        F.when(gap < 0, before).when(gap == 0, same).alias("conflict_reason"),
    )


# --------------------------------------------------------------------------- nutrition


def default_unit(nutrient: str) -> str:
    return {"energy": "kcal", "sodium": "mg"}.get(nutrient, "g")


def nutrient_readings(text: Column) -> Column:
    """Per nutrient in table order: does it match, its value and unit, is it at least named."""
    lowered, readable = F.lower(text), plain(text)
    return F.array(
        *[
            F.struct(
                F.lit(name).alias("nutrient"),
                matched(readable, pattern, 1).try_cast("double").alias("value"),
                F.coalesce(matched(readable, pattern, 2), F.lit(default_unit(name))).alias("unit"),
                readable.rlike(pattern).alias("matches"),
                lowered.contains(name).alias("named"),
            )
            for name, pattern in fixed.NUTRIENT_PATTERNS
        ]
    )


# ----------------------------------------------------------------------------- symbols


def classify_payload(data: Column) -> Column:
    return (
        F.when(data.rlike(fixed.PAYLOAD_URL), "url")
        .when(data.rlike(fixed.PAYLOAD_STRUCTURED), "structured_data")
        .otherwise("plain_text")
    )


def symbol_text(fmt: Column, data: Column) -> Column:
    """Evidence text of a decoded symbol; QR codes also state their payload type."""
    base = F.concat(fmt, F.lit(": "), data)
    return F.when(
        fmt == "QRCODE", F.concat(base, F.lit(" (type="), classify_payload(data), F.lit(")"))
    ).otherwise(base)


def symbol_code(evidence_text: Column) -> Column:
    """Inverse of `symbol_text`: what follows the first ": ", or all of it."""
    at = F.instr(evidence_text, ": ")
    return F.when(
        at > 0, evidence_text.substr(at + 2, F.length(evidence_text))
    ).otherwise(evidence_text)

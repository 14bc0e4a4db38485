"""Two-source fusion of typed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelspark import fixed
from labelspark.functions.text import strip
from labelspark.schemas import VALUE


def typed_value(**members: Column) -> Column:
    """Wide typed value with the given members set and all others null."""
    nutrients = "array<struct<nutrient:string,value:double,unit:string,confidence:double,raw_text:string>>"
    types = {
        "amount": "double", "currency": "string", "tier": "int", "value": "double", "unit": "string",
        "name": "string", "day": "int", "month": "int", "year": "int", "present": "boolean",
        "text": "string", "font_height_px": "double", "nutrients": nutrients,
    }
    none = F.expr("named_struct(" + ", ".join(f"'{n}', CAST(NULL AS {t})" for n, t in types.items()) + ")")
    for name, column in members.items():
        none = none.withField(name, column.cast(types[name]))
    return none.cast(VALUE)


def base_quantity(value: Column, unit: Column) -> Column:
    """Grams or millilitres; an unknown unit leaves the number as it is."""
    factors = F.create_map(*[F.lit(v) for item in fixed.UNIT_FACTORS.items() for v in item])
    return value * F.coalesce(factors[F.lower(unit)], F.lit(1.0))


def currency_mismatch(currency: Column) -> Column:
    """Price in a currency other than the assumed one: kept as it is, but worth a warning."""
    plain = F.upper(strip(F.coalesce(currency, F.lit(""))))
    return (plain != "") & (plain != fixed.ASSUMED_CURRENCY)


def within_tolerance(a: Column, b: Column) -> Column:
    near = F.try_divide(F.abs(a - b), F.greatest(a, b)) <= fixed.NUMERIC_TOLERANCE
    return F.when((a == 0) & (b == 0), True).when((a == 0) | (b == 0), False).otherwise(near)


def quantities_match(a: Column, a_unit: Column, b: Column, b_unit: Column) -> Column:
    grams = F.lit("g")
    return within_tolerance(
        base_quantity(F.coalesce(a, F.lit(0.0)), F.coalesce(a_unit, grams)),
        base_quantity(F.coalesce(b, F.lit(0.0)), F.coalesce(b_unit, grams)),
    )


def names_match(a: Column, b: Column) -> Column:
    return F.lower(strip(a)) == F.lower(strip(b))


def values_match(field: str, a: Column, b: Column) -> Column:
    """Whether two typed values of a field mean the same; two missing ones do, one missing does not."""
    if field == "net_quantity":
        same = quantities_match(a["value"], a["unit"], b["value"], b["unit"])
    elif field == "mrp":
        same = within_tolerance(F.coalesce(a["amount"], F.lit(0.0)), F.coalesce(b["amount"], F.lit(0.0)))
    elif field == "manufacturer":
        same = names_match(a["name"], b["name"])
    else:
        same = a == b
    return F.when(a.isNull() & b.isNull(), True).when(a.isNull() | b.isNull(), False).otherwise(same)


def fuse_field(
    field: str, ocr: Column, ocr_confidence: Column, provider: Column,
    provider_confidence: Column | None = None,
) -> Column:
    """(status, value, confidence, conflict_values): missing, passed through, agreed or in conflict; the
    last member holds the label's and the catalog's value when they disagree."""
    trust = F.lit(1.0) if provider_confidence is None else provider_confidence
    has_ocr, has_provider = ocr.isNotNull(), provider.isNotNull()
    both = has_ocr & has_provider
    agree = values_match(field, ocr, provider)
    status = (
        F.when(~has_ocr & ~has_provider, "missing").when(both & ~agree, "conflict").otherwise("agreed")
    )
    value = (
        F.when(both, F.when(agree, F.when(ocr_confidence >= trust, ocr).otherwise(provider)))
        .otherwise(F.coalesce(ocr, provider))
    )
    confidence = (
        F.when(both, F.when(agree, F.least(F.greatest(ocr_confidence, trust), F.lit(1.0))).otherwise(0.0))
        .when(has_ocr, ocr_confidence)
        .when(has_provider, trust)
        .otherwise(0.0)
    )
    return F.struct(
        status.alias("status"), value.alias("value"), confidence.alias("confidence"),
        F.when(both & ~agree, F.array(ocr, provider)).alias("conflict_values"),
    )

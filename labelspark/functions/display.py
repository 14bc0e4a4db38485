"""Numbers and values as the text people read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelspark import fixed


def number_text(value: Column) -> Column:
    """Shortest plain digits with at least one decimal ("10000000.0", never "1.0E7")."""
    size = F.abs(value)
    large, small = (value.try_cast(f"decimal(38,{scale})") for scale in (10, 30))
    plain = F.when(size >= 1e7, large.cast("string")).when((size > 0) & (size < 1e-3) & (small != 0), small.cast("string"))
    # Beyond 28 digits, or below 30 decimals, the exponent stays: nothing is lost and no job ends.
    return F.coalesce(F.regexp_replace(plain, r"(\.\d+?)0+$", "$1"), value.cast("string"))


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(v) for item in table.items() for v in item])[key]


def source_label(source_type: Column) -> Column:
    return F.coalesce(_lookup(fixed.SOURCE_LABELS, source_type), source_type)


def price_text(amount: Column, currency: Column) -> Column:
    currency = F.coalesce(currency, F.lit(fixed.ASSUMED_CURRENCY))
    sign = F.coalesce(_lookup(fixed.CURRENCY_SIGNS, currency), F.concat(currency, F.lit(" ")))
    return F.concat(sign, F.coalesce(number_text(amount), F.lit("?")))


def quantity_text(value: Column, unit: Column) -> Column:
    return F.concat(F.coalesce(number_text(value), F.lit("?")), F.lit(" "), F.coalesce(unit, F.lit("")))


def date_text(day: Column, month: Column, year: Column) -> Column:
    names = F.array(*[F.lit(m.capitalize()) for m in fixed.MONTHS])
    name = F.coalesce(F.get(names, month - 1), F.format_string("%02d", month))
    missing = year.isNull() | (year == 0) | month.isNull() | (month == 0)
    with_day = F.when(F.coalesce(day, F.lit(0)) != 0, F.concat(day.cast("string"), F.lit(" "))).otherwise("")
    return F.when(missing, fixed.DASH).otherwise(F.concat(with_day, name, F.lit(" "), year.cast("string")))


def nutrition_text(nutrients: Column) -> Column:
    def one(n: Column) -> Column:
        name = F.initcap(F.replace(n["nutrient"], F.lit("_"), F.lit(" ")))
        amount = F.concat(number_text(n["value"]), F.lit(" "), F.coalesce(n["unit"], F.lit("")))
        return F.concat(name, F.lit(": "), F.coalesce(amount, F.lit(fixed.DASH)))

    return F.when(F.size(nutrients) == 0, fixed.DASH).otherwise(F.array_join(F.transform(nutrients, one), "; "))


def format_value(field: Column, value: Column) -> Column:
    """Display text of a typed value by field; a dash for none."""
    return F.coalesce(
        F.when(value.isNull(), fixed.DASH)
        .when(field == "mrp", price_text(value["amount"], value["currency"]))
        .when(field == "net_quantity", quantity_text(value["value"], value["unit"]))
        .when(field == "manufacturer", value["name"])
        .when(field.isin("manufacture_date", "expiry_date"), date_text(value["day"], value["month"], value["year"]))
        .when(
            field == "cautions",
            F.when(value["present"], F.concat(F.lit("Present: "), F.coalesce(value["text"], F.lit(""))))
            .otherwise("Not present"),
        )
        .when(field == "nutrition_facts", nutrition_text(value["nutrients"])),
        F.lit(fixed.DASH),
    )

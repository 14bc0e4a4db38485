"""Text helpers: Column in, Column out."""

from __future__ import annotations

import sys
import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelspark import fixed


_DIGITS = [c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd"]
_BLANKS = [c for c in map(chr, range(128, 0x3001)) if c.isspace()]
_FOREIGN = "".join(_DIGITS + _BLANKS)
_PLAIN = "".join(str(unicodedata.decimal(c)) for c in _DIGITS) + " " * len(_BLANKS)
_BLANK = r"(?U)[\s\x1c-\x1f]"


def plain(text: Column) -> Column:
    """The text with digits of every script as 0-9 and white space outside ASCII as spaces, one
    character for one. Patterns are tried on it, so that they see every script's numbers."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, text).otherwise(F.translate(text, _FOREIGN, _PLAIN))


def strip(text: Column) -> Column:
    """Cut white space of every kind at both ends (`trim` alone cuts spaces only)."""
    return F.regexp_replace(text, rf"^{_BLANK}+|{_BLANK}+$", "")


def comparison_key(text: Column) -> Column:
    """Lower case, outer blanks cut, inner blanks one space."""
    return F.regexp_replace(F.lower(strip(text)), rf"{_BLANK}+", " ")


def line_key(text: Column) -> Column:
    """Key under which two OCR lines count as the same text."""
    return F.lower(strip(text))


def contains_any(text: Column, words: list[str]) -> Column:
    """Whether the lower-cased text holds one of the words as a substring."""
    return holds_any(F.lower(text), words)


def holds_any(lowered: Column, words: list[str]) -> Column:
    """`contains_any` of a text that is lower case already; words implied by others are skipped."""
    needed = [w for w in words if not any(o != w and o in w for o in words)]
    return reduce(lambda a, b: a | b, [lowered.contains(w) for w in needed])


def matched(text: Column, pattern: str, group: int = 0) -> Column:
    """Matched text of a pattern group, null where nothing (or nothing in that group) matched."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def number(text: Column) -> Column:
    """Number written with thousands commas; null when it is none."""
    return F.regexp_replace(text, ",", "").try_cast("double")


def rounded(value: Column, places: int) -> Column:
    """Round half to even on the binary value, so 0.5075 (stored just below) gives 0.507.

    `F.round` works on the decimal digits instead and would give 0.508. The product with the power of
    ten is rounded itself, so where it looks like a tie the sign of its error decides; the error is
    computed exactly from the halves of the factor.
    """
    scale = float(10**places)

    def nearest(v: Column) -> Column:
        product = v * scale
        # The upper 24 bits and the rest are multiplied without any error.
        high = v.cast("float").cast("double")
        error = (high * scale - product) + (v - high) * scale
        tie = F.abs(product - F.rint(product)) == 0.5
        return F.rint(product + F.when(tie, F.signum(error) * 0.25).otherwise(0.0)) / scale

    # As a lambda the value is written once into the generated code, which would else outgrow a method.
    return F.transform(F.array(value.cast("double")), nearest)[0]


def clamp_confidence(value: Column) -> Column:
    """Into [0, 1] with three decimals; unreadable is 0."""
    number_ = value.try_cast("double")
    usable = F.when(F.isnan(number_), 0.0).otherwise(F.coalesce(number_, F.lit(0.0)))
    return rounded(F.least(F.greatest(usable, F.lit(0.0)), F.lit(1.0)), 3)


def line_confidence(value: Column) -> Column:
    """OCR line confidence: never below 0, three decimals."""
    return rounded(F.greatest(value, F.lit(0.0)), 3)


def token_confidence(value: Column) -> Column:
    """Percent confidence of a word token as a fraction; below 0 or unreadable is 0."""
    return rounded(F.greatest(F.coalesce(value.try_cast("double"), F.lit(0.0)), F.lit(0.0)) / 100, 3)


# ------------------------------------------------------------------ character confusions


def _share(text: Column, cls: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{cls}]", ""))


def numeric_position(text: Column, context: Column) -> Column:
    # Any digit is enough, which also covers the "more than half digits" case.
    return text.rlike(r"\p{Nd}") | context.isin(fixed.NUMERIC_CONTEXTS)


def text_position(text: Column, context: Column) -> Column:
    return (_share(text, r"\p{L}") * 2 > F.length(text)) | context.isin(fixed.TEXT_CONTEXTS)


def likely_numeric(text: Column, context: Column) -> Column:
    return context.isin(fixed.NUMERIC_CONTEXTS) | (
        _share(text, r"\p{Nd}") > _share(text, r"\p{L}")
    )


def likely_alphabetic(text: Column, context: Column) -> Column:
    return context.isin(fixed.TEXT_CONTEXTS) | (
        (_share(text, r"\p{L}") > _share(text, r"\p{Nd}")) & (F.length(text) > 2)
    )


def digit_sequence(text: Column) -> Column:
    return text.rlike(r"\p{Nd}{2,}")


def european_context(text: Column) -> Column:
    return text.contains(",") & ~text.contains("₹")


def indian_context(text: Column) -> Column:
    return text.contains("₹")


def foreign_currency(text: Column) -> Column:
    return text.rlike("[$€]")


def rupee_currency(text: Column) -> Column:
    return text.rlike(r"₹|Rs\.?|INR")


def replace_first(text: Column, source: str, target: str) -> Column:
    """Replace the first occurrence of one character."""
    at = F.instr(text, source)
    return F.when(
        at > 0,
        F.concat(text.substr(F.lit(1), at - 1), F.lit(target), text.substr(at + 1, F.length(text))),
    ).otherwise(text)


def _once(value: Column, body) -> Column:
    """`body` of a value that is computed once a row: as a lambda's variable it is not written out again
    wherever the body uses it."""
    return F.transform(F.array(value), body)[0]


def confusion_variants(text: Column, context: Column, tier: Column) -> Column:
    """Readings of a text: array of (text, penalty, hint), the original first with penalty 0.

    All changed readings of one text share one penalty, so rule order is penalty order.
    """
    conservative = tier <= 2
    stripped = strip(text)
    numeric = numeric_position(stripped, context)
    facts = F.struct(
        stripped.alias("original"),
        F.when(conservative, fixed.PENALTY_CONSERVATIVE).otherwise(fixed.PENALTY_OPEN).alias("penalty"),
        # Whether a character may be another one at all, and where its rule stands.
        F.when(conservative, numeric).otherwise(numeric | text_position(stripped, context)).alias("admitted"),
        (european_context(text) | foreign_currency(text)).alias("foreign"),
        (numeric_position(text, context) | likely_numeric(text, context)).alias("numeric"),
        (text_position(text, context) | likely_alphabetic(text, context)).alias("text"),
    )

    def reading(changed: Column, cost: Column, hint: Column) -> Column:
        return F.struct(changed.alias("text"), cost.alias("penalty"), hint.alias("hint"))

    def readings(fact: Column) -> Column:
        original = fact["original"]
        changed = [
            F.when(
                original.contains(source) & fact["admitted"] & fact[where],
                reading(replace_first(original, source, target), fact["penalty"], F.lit(f"{source}→{target}")),
            )
            for source, target, where in fixed.CONFUSIONS
        ]
        return F.array_compact(F.array(reading(original, F.lit(0.0), F.lit(None).cast("string")), *changed))

    def different(found: Column) -> Column:
        """Every rule changes a different letter pair, but two rules may still give equal texts."""
        return _once(
            F.transform(found, lambda r: r["text"]),
            lambda texts: F.filter(found, lambda r, i: F.array_position(texts, r["text"]) == i + 1),
        )

    return _once(_once(facts, readings), different)

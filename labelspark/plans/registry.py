"""All registered queries."""

from __future__ import annotations

from labelspark.plans import (
    extraction_queries, judging_queries, stream_queries, table_queries, text_queries,
)

MODULES = [extraction_queries, text_queries, judging_queries, table_queries, stream_queries]


def queries():
    return {name: run for module in MODULES for name, run in module.QUERIES.items()}


def oracle_sql():
    return {name: exactly_rounded(sql) for module in MODULES for name, sql in module.ORACLE.items()}


def exactly_rounded(sql: str) -> str:
    """The text with every round_even(value, places) rounding the binary value: DuckDB rounds a product
    with a power of ten, so at ties the sign of the product's error has to decide here too."""
    out, at = [], 0
    while (found := sql.find("round_even(", at)) >= 0:
        out.append(sql[at:found])
        depth, start, cut = 0, found + len("round_even("), 0
        for end in range(start, len(sql)):
            if sql[end] == "," and depth == 0:
                cut = end
            if sql[end] == ")" and depth == 0:
                break
            depth += (sql[end] in "([") - (sql[end] in ")]")
        scale = f"1e{int(sql[cut + 1 : end])}::DOUBLE"
        product, high = f"(v * {scale})", "(v * 134217729::DOUBLE - (v * 134217729::DOUBLE - v))"
        error = f"(({high} * {scale} - {product}) + (v - {high}) * {scale})"
        tie = f"abs({product} - round_even({product}, 0)) = 0.5::DOUBLE"
        out.append(
            f"list_transform([({exactly_rounded(sql[start:cut])})::DOUBLE], lambda v: CASE WHEN {tie} AND {error} > 0 THEN floor({product}) + 1"
            f" WHEN {tie} AND {error} < 0 THEN floor({product}) ELSE round_even({product}, 0) END / {scale})[1]"
        )
        at = end + 1
    return "".join(out) + sql[at:]


def flagship(spark, sf_dir):
    """Verdicts of every declaration of every scan: the whole job."""
    return queries()["scan_verdicts"](spark, sf_dir)

"""Golden label lines and the values they must give."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from labelspark import fixed
from labelspark.operators import extraction as X

PRICE = {
    "p1": ([("MRP Rs. 199", 0.85)], (199.0, "INR", 1)),
    "p2": ([("Maximum Retail Price ₹299", 0.9)], (299.0, "INR", 1)),
    "p3": ([("MRP 149.00 INR", 0.87)], (149.0, "INR", 1)),
    "p4": ([("Price Rs. 200", 0.88)], (200.0, "INR", 2)),
    "p5": ([("MAXIMUM RETAIL PRICE 199", 0.85)], (199.0, "INR", 1)),
    "p6": ([("MRP reference code: ABC123", 0.7)], None),
    "p7": ([("Batch No: 12345", 0.9), ("Exp Date: 2025-12", 0.9)], None),
    # The amount is the first number of the line, wherever the currency stands.
    "p8": ([("MRP 2 pcs Rs. 1,250.50", 0.9)], (2.0, "INR", 1)),
    "p9": ([("MRP Rs. 10", 0.5), ("MRP Rs. 1000", 0.5)], (1000.0, "INR", 1)),
    "p10": ([("MRP Rs. 10", 0.5), ("MRP Rs. 20", 0.5)], (10.0, "INR", 1)),
}
QUANTITY = {
    "q1": ([("NET QUANTITY: 150g", 0.85)], (150.0, "g")),
    "q2": ([("60 TABLETS", 0.9)], (60.0, "tablets")),
    "q3": ([("Net Wt 2.5kg", 0.88)], (2.5, "kg")),
    "q4": ([("Ps AD NET QUANTITY: ee Perey", 0.9)], None),
    "q5": ([("60 TAELETS", 0.9)], None),
    # Units have no word end: "5 lb" reads as litres.
    "q6": ([("weight 5 lb", 0.9)], (5.0, "l")),
}
MAKER = {
    "m1": ([("Manufacturer: Hindustan Unilever Ltd", 0.9)], "Hindustan Unilever Ltd"),
    "m2": ([("Mfd by: Coca-Cola India Pvt Ltd", 0.9)], None),
    "m3": (
        [("12 KANDHARI BEVERAGES PVT LTD", 0.8), ("Village X", 0.8), ("Distt Y", 0.8),
         ("REFER FOR MANUFACTURER'S NAME, ADDRESS AND LICNO", 0.9)],
        "KANDHARI BEVERAGES PVT LTD",
    ),
    "m4": ([("nothing here", 0.9)], None),
    # The footnote opens the back; the company line closes the front.
    "m5": (
        [("ACME FOODS LTD", 0.7, "front"), ("REFER MANUFACTURER'S DETAILS", 0.9, "back")], "ACME FOODS LTD",
    ),
}
MADE = {
    "d1": (["MFD 12/05/2025"], (12, 5, 2025)),
    "d2": (["Mfg Date: 03/2026"], (None, 3, 2026)),
    "d3": (["Manufactured on December 2024"], (None, 12, 2024)),
    "d4": (["Batch Date: 15-08-25"], (15, 8, 2025)),
    "d5": (["MFD abc/xyz/123"], None),
    "d6": (["MFD 2025-12-01"], (25, 12, 2001)),
    "d7": (["MFD 31/02/2024"], (31, 2, 2024)),
}
EXPIRES = {
    "e1": (["EXP 25/12/2026"], (25, 12, 2026)),
    "e2": (["Best Before: 06/2027"], (None, 6, 2027)),
    "e3": (["Use By: Jan 2026"], (None, 1, 2026)),
}


def found(make_lines, cases, field, columns):
    lines = make_lines({scan: lines for scan, (lines, _) in cases.items()})
    rows = X.extract_fields(lines, [field]).collect()
    return {
        r.scan_id: (None if r[field] is None else tuple(r[field].value[c] for c in columns)) for r in rows
    }


@pytest.mark.parametrize(
    ("cases", "field", "columns"),
    [
        (PRICE, "mrp", ["amount", "currency", "tier"]),
        (QUANTITY, "net_quantity", ["value", "unit"]),
        (MADE, "manufacture_date", ["day", "month", "year"]),
        (EXPIRES, "expiry_date", ["day", "month", "year"]),
    ],
)
def test_values(make_lines, cases, field, columns):
    assert found(make_lines, cases, field, columns) == {k: want for k, (_, want) in cases.items()}


def test_manufacturer(make_lines):
    got = found(make_lines, MAKER, "manufacturer", ["name"])
    assert got["m2"][0].endswith("Coca-Cola India Pvt Ltd")
    for scan, (_, want) in MAKER.items():
        if scan != "m2":
            assert got[scan] == (None if want is None else (want,))


def test_written_confidence_and_month_name(make_lines):
    lines = make_lines({"a": ["MFD 01/2025 conf: 90"], "b": ["MFD Jan 2025"], "c": ["MFD 01/2025"]})
    rows = {r.scan_id: r.manufacture_date.value.confidence for r in X.extract_fields(lines, ["manufacture_date"]).collect()}
    assert rows == {"a": 0.72, "b": 0.7225, "c": 0.68}


def test_panel_order(make_lines):
    lines = make_lines({"a": [("MRP Rs 50", 0.95, "front"), ("MRP Rs 60000", 0.93, "back"),
                              ("Note: old", 0.9, "front"), ("plain", 0.9, "back")]})
    row = X.extract_fields(lines).first()
    assert (row.mrp.value.amount, row.mrp.panel) == (50.0, "front")
    # No caution word on the back is itself an answer, and the back is asked first.
    assert (row.cautions.value.present, row.cautions.panel, row.cautions.value.confidence) == (False, "back", 0.95)


def test_cautions(make_lines):
    lines = make_lines({"a": ["Caution: Keep away from children"], "b": ["Tasty"], "c": [("Warning", 0.0)]})
    rows = {r.scan_id: r.cautions.value.present for r in X.extract_fields(lines, ["cautions"]).collect()}
    assert rows == {"a": True, "b": False, "c": False}


def test_nutrition(make_lines):
    lines = make_lines({
        "full": ["Nutrition Facts", "Energy 250 kcal", "Protein 5.2g", "Carbohydrate 30.1g", "Fat 12.0g"],
        "head": ["Nutrition Facts"], "none": ["Energy 250 kcal"], "bad": ["Nutrition", "Protein xyz"],
        "stop": ["Nutrition", "Energy 10 kj", "Ingredients: sugar", "Fat 1g"],
        "sat": ["Nutrition", "Saturated fat 3.5g", "Fiber 3g", "Fibre 4g"],
        "far": ["Nutrition", *["filler"] * 20, "Fat 9g"],
    })
    rows = {r.scan_id: [(n.nutrient, n.value, n.unit, n.confidence) for n in r.nutrients] for r in X.nutrition_facts(lines).collect()}
    assert "none" not in rows and rows["head"] == [] and rows["far"] == []
    assert rows["bad"] == [("protein", None, "g", 0.0)]
    assert [n[0] for n in rows["full"]] == ["energy", "protein", "carbohydrate", "fat"]
    assert rows["stop"] == [("energy", 10.0, "kj", 0.9)]
    # Fat is tried before saturated fat; both spellings of fibre count once as a reading, but the
    # other spelling is still noted when it is only named.
    assert rows["sat"][:2] == [("fat", 3.5, "g", 0.9), ("fibre", 3.0, "g", 0.9)]


def test_above_footnote_across_blocks(make_lines, monkeypatch):
    """Neighbours are found across block borders: blocks of two lines give the same names."""
    scans = {
        f"s{i}": ["x"] * i + ["ACME FOODS LTD"] + ["y"] * gap + ["REFER MANUFACTURER'S DETAILS"]
        for i, gap in enumerate([0, 1, 2, 3, 2, 1, 0])
    }
    lines = make_lines(scans)
    whole = {r.scan_id: r.above_front for r in X.above_footnote(lines).collect()}
    monkeypatch.setattr(X, "BLOCK", 2)
    cut = {r.scan_id: r.above_front for r in X.above_footnote(lines).collect()}
    assert whole == cut and set(whole) == {"s0", "s1", "s2", "s4", "s5", "s6"}


def test_fixed_fields():
    assert len(fixed.FIELDS) == 7 == len(fixed.SEED_RULES)


def test_other_scripts(spark, make_lines):
    from labelspark.functions.text import comparison_key, strip

    lines = make_lines({
        "digits": ["MRP \u20b9 \u0967\u0968\u0966.\u096b\u0966", "Net Qty: \u096b\u0966\u0966 g", "MFD \u0967\u0968/\u0966\u096b/\u0968\u0966\u0968\u096b"],
        "blanks": ["MRP \u20b9\u00a0120", "NET QUANTITY:\u2009150\u00a0g", "Manufacturer:\u00a0Acme \u0967 Ltd"],
    })
    got = {r.scan_id: r for r in X.extract_fields(lines).collect()}
    a, b = got["digits"], got["blanks"]
    assert (a.mrp.value.amount, a.net_quantity.value.value, b.mrp.value.amount, b.net_quantity.value.value) == (120.5, 500.0, 120.0, 150.0)
    made = a.manufacture_date.value
    assert (made.day, made.month, made.year) == (12, 5, 2025)
    # What is quoted keeps its own characters.
    assert b.manufacturer.value.name == "Acme \u0967 Ltd" and a.mrp.value.raw_text == "MRP \u20b9 \u0967\u0968\u0966.\u096b\u0966"
    row = spark.createDataFrame([("\u00a0 a\u2003\u00a0b\x1f",)], "t string").select(strip(F.col("t")).alias("s"), comparison_key(F.col("t")).alias("k")).first()
    assert (row.s, row.k) == ("a\u2003\u00a0b", "a b")


def test_stored_marks_give_what_the_lines_give(spark, sf_dir):
    """Every step that reads marks, over stored lines and over the lines themselves."""
    from labelspark.operators import ensemble as E
    from labelspark.operators import extraction as X
    from labelspark.plans.views import label_lines
    from labelspark.session import staged

    lines = label_lines(spark, sf_dir)
    stored = staged(E.candidate_marks(X.line_marks(lines)), "marked")
    rows = lambda df: sorted(map(str, df.collect()))
    for step in (X.extract_fields, X.nutrition_facts, E.field_candidates, lambda df: E.field_candidates(df, ["mrp"])):
        assert rows(step(stored)) == rows(step(lines))


def test_lines_with_a_column_named_like_a_mark(make_lines):
    """A single column of such a name is not taken for stored marks of the step."""
    from labelspark.operators import extraction as X
    from pyspark.sql import functions as F

    lines = make_lines({1: ["MRP Rs. 45.00", "Caution: keep dry"]})
    named = lines.withColumn("price_length", F.lit("x")).withColumn("is_caution", F.lit("x"))
    wanted = ["mrp", "cautions"]
    assert X.extract_fields(named, wanted).collect() == X.extract_fields(lines, wanted).collect()

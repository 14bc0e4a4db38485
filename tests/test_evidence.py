from pyspark.sql import functions as F

from labelspark import fixed
from labelspark.operators import declarations as D
from labelspark.operators import ensemble as E
from labelspark.operators import extraction as X
from labelspark.operators import rules as R
from labelspark.plans.judging import LabelInputs, declare, read_once


def test_evidence_puts_declarations_together_once(spark, make_lines):
    empty = lambda ddl: spark.createDataFrame([], ddl)
    data = read_once(LabelInputs(
        lines=make_lines({"s": [("MRP Rs 50", 0.95, "front"), ("MRP Rs 60", 0.93, "back"), ("Net Qty: 500 g", 0.9, "back")]}),
        scans=spark.sql("SELECT 's' AS scan_id, 'India' AS jurisdiction, DATE'2024-05-01' AS inspection_date, CAST(NULL AS STRING) AS category"),
        symbols=empty("scan_id string, panel string, ord int, format string, data string, width double, height double"),
        catalog=empty("barcode string, source_rank int, name string, brand string, category string, manufacturer string,"
                      "quantity_value double, quantity_unit string, mrp_amount double, mrp_currency string"),
        cache=empty("barcode string, product struct<name:string,brand:string,category:string,manufacturer:string,"
                    "quantity_value:double,quantity_unit:string,mrp_amount:double,mrp_currency:string>"),
        rule_sets=spark.sql(f"SELECT '{fixed.RULE_SET_ID}' AS rule_set_id, 'India' AS jurisdiction, DATE'2024-01-01' AS effective_from, CAST(NULL AS DATE) AS effective_to"),
        rules=R.seeded_rules(spark),
    ))
    images = spark.createDataFrame([(7, "s", "front"), (8, "s", "back")], "image_id long, scan_id string, label string")
    rows = D.evidence_rows(declare(data), E.field_candidates(data.lines, D.FUSED), images)
    assert "declared" not in rows._jdf.queryExecution().optimizedPlan().toString()
    got = sorted((r.field_name, r.source_type, r.raw_text, r.preprocessing_variant, r.image_id) for r in rows.collect())
    assert got == [
        ("mrp", "OCR", "MRP Rs 50", "single_pass", 7), ("mrp", "OCR", "MRP Rs 60", "single_pass", 7),
        ("net_quantity", "OCR", "Net Qty: 500 g", "ocr_single_pass", 8),
    ]
    assert rows.filter(F.col("confidence") > 0).count() == 3


def test_evidence_rows_are_not_shuffled_for_images(spark, make_lines):
    candidates = E.field_candidates(make_lines({"s": [("MRP Rs 50", 0.95, "front")]}), D.FUSED)
    value = "struct<amount:double,currency:string,tier:string,value:double,unit:string,name:string,day:int,month:int,year:int," \
            "present:boolean,text:string,nutrients:array<struct<nutrient:string,value:double,unit:string,confidence:double,raw_text:string>>>"
    product = "struct<mrp_amount:double,mrp_currency:string,quantity_value:double,quantity_unit:string,manufacturer:string>"
    declared = spark.createDataFrame(
        [("s", None, None, [("expiry_date", "EXP 1/2020", 0.9, "back", None)], *[None] * 3, *[0.0] * 3),
         (None, None, "conflict", [("expiry_date", "EXP 2/2020", 0.9, "front", None)], *[None] * 3, *[0.0] * 3)],
        f"scan_id string, product {product}, date_comparison string,"
        f"declared array<struct<field_name:string,raw_text:string,confidence:double,panel:string,value:{value}>>,"
        + ",".join(f"{f}_conflict boolean" for f in D.FUSED) + "," + ",".join(f"{f}_ocr_confidence double" for f in D.FUSED),
    )
    images = spark.createDataFrame([(7, "s", "front"), (8, "s", "back"), (9, None, "front")], "image_id long, scan_id string, label string")
    rows = D.evidence_rows(declared, candidates, images)
    assert "image" not in "".join(x for x in rows._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate" in x)
    got = sorted(((r.scan_id, r.raw_text[:10], r.preprocessing_variant, r.image_id) for r in rows.collect()), key=str)
    assert got == [
        ("s", "EXP 1/2020", "ocr_single_pass", 8), (None, "Chronologi", "date_cross_check", None),
        (None, "EXP 2/2020", "ocr_single_pass", None),
    ]


def test_lines_read_in_order_are_those_of_asked_scans(spark, make_lines):
    lines = make_lines({
        "footnote": [("Acme Foods Pvt Ltd", 0.9, "front"), ("REFER MANUFACTURER'S NAME, ADDRESS AND LIC NO", 0.9, "front")],
        "panel": [("Nutrition Facts", 0.9, "back"), ("Protein 3 g", 0.8, "back"), ("Fat 1 g", 0.8, "back")],
        "neither": [("MRP Rs 50", 0.95, "front"), ("Protein 3 g", 0.8, "back")],
    })
    near = X.read_in_order(lines)
    assert {r.scan_id for r in near.collect()} == {"footnote", "panel"} and near.count() == 5
    both = lambda df: sorted(map(str, df.collect()))
    assert both(X.extract_fields(lines, in_order=near)) == both(X.extract_fields(lines))
    assert both(X.nutrition_facts(lines, near)) == both(X.nutrition_facts(lines))
    assert [len(r.nutrients) for r in X.nutrition_facts(lines, near).collect()] == [2]

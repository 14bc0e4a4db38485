"""Rounding and number text against Python's own."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from labelspark.functions.display import number_text
from labelspark.functions.text import confusion_variants, rounded


def test_rounding_is_binary(spark):
    rng = random.Random(1)
    values = [2.675, 1.115, 0.0645, 0.5075, 0.5, 1.5, 2.5, 0.125, -2.675, 1.005, 0.0, 1e12 + 0.5]
    values += [round(rng.random() * 100, 3) + 0.0005 for _ in range(2000)] + [k / 8 for k in range(100)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select(
        "v", rounded(F.col("v"), 2).alias("two"), rounded(F.col("v"), 3).alias("three"), rounded(F.col("v"), 0).alias("none")
    )
    for r in rows.collect():
        assert (r.two, r.three, r.none) == (round(r.v, 2), round(r.v, 3), float(round(r.v))), r


def test_number_text_loses_nothing(spark):
    cases = {1e-7: "0.0000001", 1e25: "10000000000000000000000000.0", 1e7: "10000000.0", 120.5: "120.5", 0.0: "0.0", 0.0005: "0.0005", 12345678.125: "12345678.125"}
    rows = spark.createDataFrame([(v,) for v in [*cases, 1e300, 1e-300]], "v double").select("v", number_text(F.col("v")).alias("t"))
    for r in rows.collect():
        assert float(r.t) == r.v and r.t == cases.get(r.v, r.t)


def test_readings_of_a_text_are_made_once(spark):
    """A text's facts and readings stand in the plan once, not once for every rule and reading."""
    rows = spark.createDataFrame([(" B0 ",), ("5 kg",), (None,)], "text string")
    made = rows.select("text", confusion_variants(F.col("text"), F.lit("general"), F.lit(4)).alias("found"))
    plan = made._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_replace") + plan.count("RLIKE") < 20
    found = {text: [(r["text"], r["hint"]) for r in readings] for text, readings in made.collect()}
    assert found == {
        " B0 ": [("B0", None), ("80", "B→8")], "5 kg": [("5 kg", None), ("S kg", "5→S")], None: [],
    }

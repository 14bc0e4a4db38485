"""Rule sets by date, rules against declarations, worst verdict per scan."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelspark import fixed
from labelspark.functions.rules import evaluate_declaration, worst

_RULE_FIELDS = (
    "rule_set_id:string,rule_ord:int,rule_id:string,source_document:string,clause:string,"
    "applicability:string,required_declaration:string,"
    "conditions:struct<must_be_present:boolean,min_confidence:double,format:string,min_value:double,"
    "max_value:double,min_length:int,allowed_units:array<string>,min_font_size_mm:double,"
    "max_font_size_mm:double>,exceptions:array<string>,evidence_requirements:array<string>"
)


def seeded_rules(spark: SparkSession, rule_set_ids: list[str] | None = None) -> DataFrame:
    """The seven built-in rules, under each given rule set.

    One literal, whose size Spark knows: to a table made from Python rows it would shuffle every scan,
    by the few keys of the rule sets.
    """
    rows = [
        {
            "rule_set_id": rule_set, "rule_ord": i, "rule_id": rule_id, "source_document": source, "clause": clause,
            "applicability": applies_to, "required_declaration": field,
            "conditions": {
                "must_be_present": must, "min_confidence": minimum, "format": fmt, "min_value": low, "min_length": length,
                "allowed_units": units,
            },
            "exceptions": exceptions, "evidence_requirements": evidence,
        }
        for rule_set in rule_set_ids or [fixed.RULE_SET_ID]
        for i, (rule_id, source, clause, applies_to, field, must, minimum, fmt, low, length, units, exceptions, evidence)
        in enumerate(fixed.SEED_RULES)
    ]
    return spark.range(0, 1, 1, 1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{_RULE_FIELDS}>>")))


def seed_missing(existing: DataFrame, seeds: DataFrame, key: str = "rule_id") -> DataFrame:
    """Seed rows whose key is not in the table yet; a second run adds none."""
    return seeds.join(existing.select(key).distinct(), key, "left_anti").select(*seeds.columns)


def select_rulesets(scans: DataFrame, rule_sets: DataFrame) -> DataFrame:
    """Adds rule_set_id and rule_set_error to scans (jurisdiction, inspection_date).

    The sets of a jurisdiction, as many as its law has versions, become one row and are matched on
    the scan's own row. That side is small enough for Spark's size check to send it to the scans, so
    these are not shuffled. Exactly one valid set or an error, never a guess; a scan without day or
    jurisdiction has no set.
    """
    versions = rule_sets.groupBy("jurisdiction").agg(
        F.collect_list(F.struct("rule_set_id", "effective_from", "effective_to")).alias("_sets")
    )
    day = F.col("inspection_date")
    valid = F.filter(
        F.coalesce("_sets", F.slice("_sets", 1, 0)),
        lambda s: (s["effective_from"] <= day) & (s["effective_to"].isNull() | (s["effective_to"] > day)),
    )
    found = F.coalesce(F.size(F.col("_valid")), F.lit(0))
    return scans.join(versions, "jurisdiction", "left").withColumn("_valid", valid).withColumns(
        {
            "rule_set_id": F.when(found == 1, F.get("_valid", F.lit(0))["rule_set_id"]),
            "rule_set_error": F.when(found < 1, "no rule set").when(found > 1, "overlapping rule sets"),
        }
    ).drop("_sets", "_valid")


def without_ruleset(dated: DataFrame) -> DataFrame:
    """Scans that no rule can judge: none or several rule sets hold on their day. `evaluate` has no rows
    for them, so a job writes these to quarantine."""
    return dated.filter("rule_set_id is null")


def active_rules(rule_sets: DataFrame, rules: DataFrame, day, jurisdiction: str = "India") -> DataFrame:
    """Rules of the one set valid on a day (a date or a Column); no rows where none or several are."""
    at = F.lit(day) if not hasattr(day, "alias") else day
    one = rule_sets.sparkSession.range(1).select(F.lit(jurisdiction).alias("jurisdiction"), at.cast("date").alias("inspection_date"))
    chosen = select_rulesets(one, rule_sets).filter("rule_set_id is not null").select("rule_set_id")
    return (
        rules.join(chosen, "rule_set_id", "left_semi")
        .join(rule_sets.select("rule_set_id", "rule_version", "jurisdiction", "effective_from", "effective_to"), "rule_set_id")
    )


#: What `evaluate` asks of a declaration; other columns need not be gathered for it.
JUDGED = ["field_name", "value", "verdict", "confidence", "scale"]


def declared_array(declarations: DataFrame, order: list[str]) -> DataFrame:
    """First declaration of each known field per scan, gathered into one row (at most seven).

    One column for each field, so that declarations are shuffled once, by scan, and only the first of
    each field of a task's scans.
    """
    known = declarations.filter(F.col("field_name").isin(fixed.FIELDS))
    columns = [c for c in declarations.columns if c not in ("scan_id", *order)]

    def first(field: str) -> Column:
        own = F.col("field_name") == field
        return F.min_by(F.when(own, F.struct(*columns)), F.when(own, F.struct(*order))).alias(field)

    firsts = known.groupBy("scan_id").agg(*map(first, fixed.FIELDS))
    return firsts.select("scan_id", F.array_compact(F.array(*fixed.FIELDS)).alias("declared"))


def evaluate(scans: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per (scan, rule): verdict, reason and confidence.

    `scans` has scan_id, rule_set_id, category and `declared`, an array of at most one declaration
    per field, so rules meet declarations on the scan's own row.
    """
    match = F.get(
        F.filter("declared", lambda d: d["field_name"] == F.col("required_declaration")), F.lit(0)
    )
    placed = scans.join(
        rules.select("rule_set_id", "rule_ord", "rule_id", "applicability", "required_declaration", "conditions"),
        "rule_set_id",
    ).withColumn("declaration", match)
    outcome = evaluate_declaration(
        F.col("declaration"), F.col("applicability"), F.col("conditions"), F.col("category")
    )
    return placed.withColumn("outcome", outcome).select(
        "scan_id", "rule_id", "rule_ord", F.col("required_declaration").alias("field_name"),
        F.col("declaration").isNotNull().alias("declared"), "outcome.*",
    )


def overall_status(results: DataFrame) -> DataFrame:
    """Worst verdict per scan."""
    return results.groupBy("scan_id").agg(worst(F.col("verdict")).alias("overall_status"))


def apply_results(declarations: DataFrame, results: DataFrame) -> DataFrame:
    """Write verdicts back by field; of several rules for a field the last one counts."""
    last = results.groupBy("scan_id", "field_name").agg(
        F.max(F.struct("rule_ord", "rule_id", "verdict", "reason", "confidence")).alias("r")
    )
    judged = F.col("r").isNotNull()
    return declarations.join(last, ["scan_id", "field_name"], "left").select(
        *[c for c in declarations.columns if c not in ("verdict", "reason", "confidence")],
        F.when(judged, F.col("r.verdict")).otherwise(F.col("verdict")).alias("verdict"),
        F.when(judged, F.col("r.reason")).otherwise(F.col("reason")).alias("reason"),
        F.when(judged, F.coalesce("r.confidence", F.lit(0.0))).otherwise(F.col("confidence")).alias("confidence"),
        F.col("r.rule_id").alias("rule_id"),
    )


def judge_declarations(scans: DataFrame, rules: DataFrame) -> DataFrame:
    """Declarations of scans with the verdict of the last rule for their field, in one pass.

    Same outcome as `apply_results` after `evaluate`, but each declaration meets its rule on its own
    row, so the scans are neither computed twice nor shuffled again.
    """
    last = rules.groupBy("rule_set_id", F.col("required_declaration").alias("field_name")).agg(
        F.max(F.struct("rule_ord", "rule_id", "applicability", "conditions")).alias("rule")
    )
    rows = scans.select("scan_id", "rule_set_id", "category", F.explode("declared").alias("declaration")).withColumn(
        "field_name", F.col("declaration.field_name")
    )
    outcome = evaluate_declaration(
        F.col("declaration"), F.col("rule.applicability"), F.col("rule.conditions"), F.col("category")
    )
    placed = rows.join(last, ["rule_set_id", "field_name"], "left").withColumn(
        "outcome", F.when(F.col("rule").isNotNull(), outcome)
    )
    judged, d = F.col("rule").isNotNull(), F.col("declaration")
    return placed.select(
        "scan_id", "field_name", d["value"].alias("value"), d["panel"].alias("panel"), d["raw_text"].alias("raw_text"),
        F.when(judged, F.col("outcome.verdict")).otherwise(d["verdict"]).alias("verdict"),
        F.when(judged, F.col("outcome.reason")).otherwise(d["reason"]).alias("reason"),
        F.when(judged, F.coalesce("outcome.confidence", F.lit(0.0))).otherwise(d["confidence"]).alias("confidence"),
        F.col("rule.rule_id").alias("rule_id"),
    )


def compliance_results(judged: DataFrame) -> DataFrame:
    """One row per judged declaration; the nutrition row also lists its nutrients, those of its value."""
    nutrients = F.transform(
        "value.nutrients",
        lambda n: F.struct(n["nutrient"].alias("nutrient"), n["value"].alias("value"), n["unit"].alias("unit"), n["confidence"].alias("confidence")),
    )
    listed = F.when((F.col("field_name") == "nutrition_facts") & (F.size("value.nutrients") > 0), nutrients)
    return judged.filter("rule_id is not null").select(
        "scan_id", "field_name", "rule_id", F.col("verdict").alias("status"),
        F.to_json(F.struct("reason", listed.alias("per_nutrient"))).alias("details"),
    )

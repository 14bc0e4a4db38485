"""The composed job: lines, symbols and catalogs in, judged declarations out."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelspark.operators import catalog as C
from labelspark.operators import declarations as D
from labelspark.operators import ensemble as E
from labelspark.operators import rules as R
from labelspark.operators.extraction import extract_fields, line_marks, nutrition_facts, read_in_order
from labelspark.session import staged


@dataclass
class LabelInputs:
    """Input tables of the job. `scans` has scan_id, jurisdiction, inspection_date, category;
    `symbols` scan_id, panel, ord, format, data, width, height."""

    lines: DataFrame
    scans: DataFrame
    symbols: DataFrame
    catalog: DataFrame
    cache: DataFrame
    rule_sets: DataFrame
    rules: DataFrame


_LINE = ["scan_id", "panel", "line_no", "text", "confidence", "bbox", "source_provider", "preprocessing_variant"]


def read_once(inputs: LabelInputs) -> LabelInputs:
    """The same inputs over stored lines: one pass over the lines tries every pattern and writes what
    extraction, footnotes, nutrition and ensemble ask of a line; these read the stored marks with
    their filters pushed down. The table is not bucketed by scan: a bucket is one task, and a scan may
    hold a third of all lines, while the steps combine map-side and send a few rows per scan and task."""
    if "candidate_of" in inputs.lines.columns:
        return inputs
    marked = E.candidate_marks(line_marks(inputs.lines.select(*_LINE)), D.FUSED)
    return replace(inputs, lines=staged(marked, "lines"))


def declare(inputs: LabelInputs) -> DataFrame:
    """One row per scan, with or without lines, with its declarations before the rules."""
    inputs = read_once(inputs)
    in_order = staged(read_in_order(inputs.lines), "in-order")
    candidates = E.field_candidates(inputs.lines, D.FUSED)
    deduped = C.dedupe_symbols(inputs.symbols)
    answers = C.lookup(
        deduped.filter("format <> 'QRCODE'").select(F.col("data").alias("barcode")), inputs.cache, inputs.catalog
    )
    return D.build_declarations(
        inputs.scans, extract_fields(inputs.lines, in_order=in_order), nutrition_facts(inputs.lines, in_order),
        D.ensemble_conflicts(E.ensemble(candidates)), C.first_resolved(deduped, answers),
        C.scale_per_scan(inputs.symbols),
    )


def judged_declarations(inputs: LabelInputs) -> DataFrame:
    """One row per declaration with its final verdict."""
    dated = R.select_rulesets(inputs.scans, inputs.rule_sets)
    return R.judge_declarations(declare(inputs).join(dated, "scan_id"), inputs.rules)


def judge(inputs: LabelInputs) -> tuple[DataFrame, DataFrame]:
    """(declared rows per scan with their rule set, rule results)."""
    dated = R.select_rulesets(inputs.scans, inputs.rule_sets)
    declared = declare(inputs).join(dated, "scan_id")
    return declared, R.evaluate(declared, inputs.rules)

"""Officer reviews and consumer flags: event tables folded into state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelspark.operators.lists import with_role
from labelspark.operators.ordered import first_k, with_previous

ACTIONS = ["confirm", "correct", "mark_unresolved"]


def checked_actions(actions: DataFrame, declarations: DataFrame) -> DataFrame:
    """Actions with their declaration and whether they are admissible.

    An action must name a declaration of its own scan and be a known kind; a correction needs a
    value.
    """
    target = declarations.select(
        "declaration_id", F.col("scan_id").alias("own_scan"), "field_name",
        F.col("verdict").alias("base_verdict"), F.col("reason").alias("base_reason"),
    )
    admissible = (
        F.coalesce(F.col("own_scan") == F.col("scan_id"), F.lit(False))
        & F.col("action").isin(ACTIONS)
        & ((F.col("action") != "correct") | F.col("new_value").isNotNull())
    )
    return actions.join(target, "declaration_id", "left").withColumn("admissible", admissible)


def accepted_actions(checked: DataFrame) -> DataFrame:
    """Actions of accepted inspections: one inadmissible action rejects its whole inspection."""
    rejected = checked.filter(~F.col("admissible")).select("inspection_id").distinct()
    return checked.join(rejected, "inspection_id", "left_anti")


def accepted_inspections(inspections: DataFrame, checked: DataFrame, scans: DataFrame) -> DataFrame:
    rejected = checked.filter(~F.col("admissible")).select("inspection_id").distinct()
    return inspections.join(rejected, "inspection_id", "left_anti").join(scans.select("scan_id"), "scan_id", "left_semi")


def _result(action: Column, reason: Column) -> Column:
    corrected = action == "correct"
    return F.struct(
        F.when(corrected, "SATISFIED").otherwise("NOT_VERIFIED").alias("verdict"),
        F.concat(
            F.when(corrected, "officer corrected: ").otherwise("officer marked unresolved: "), reason
        ).alias("reason"),
    )


def apply_review_actions(declarations: DataFrame, accepted: DataFrame, officers: DataFrame) -> DataFrame:
    """Declarations after review. Confirming changes nothing; extracted values are never touched.

    Only the last two changing actions of a declaration matter: the last one sets verdict and
    correction record, the one before it is what the record calls original. `first_k` cuts every
    map task to those two, however often one declaration was reviewed.
    """
    changing = accepted.filter("action <> 'confirm'").select(
        "declaration_id", "created_at", "inspection_id", "pos", "officer_id", "action", "new_value", "reason"
    )
    order = [F.col(c).desc() for c in ("created_at", "inspection_id", "pos")]
    last_two = first_k(changing, ["declaration_id"], order, 2)
    row = F.struct("officer_id", "action", "new_value", "reason", "created_at")
    folded = last_two.groupBy("declaration_id").agg(
        F.max(F.when(F.col("rank") == 1, row)).alias("last"), F.max(F.when(F.col("rank") == 2, row)).alias("before")
    ).withColumns(
        {
            "officer_id": F.col("last.officer_id"),
            "now": _result(F.col("last.action"), F.col("last.reason")),
            "then": F.when(F.col("before").isNotNull(), _result(F.col("before.action"), F.col("before.reason"))),
        }
    ).join(officers.select("officer_id", F.col("name").alias("officer_name")), "officer_id", "left")
    reviewed = F.col("last").isNotNull()
    correction = F.when(
        reviewed,
        F.struct(
            "officer_id", "officer_name",
            F.when(F.col("last.action") == "correct", F.col("last.new_value")).alias("corrected_value"),
            F.col("last.reason").alias("reason"), F.col("last.created_at").alias("corrected_at"),
            F.coalesce("then.verdict", "verdict").alias("original_verdict"),
            F.coalesce(F.col("then.reason"), F.col("reason"), F.lit("")).alias("original_reason"),
        ),
    )
    return declarations.join(folded, "declaration_id", "left").select(
        *[c for c in declarations.columns if c not in ("verdict", "reason")],
        F.coalesce("now.verdict", "verdict").alias("verdict"),
        F.coalesce(F.col("now.reason"), F.col("reason")).alias("reason"),
        correction.alias("officer_correction"),
    )


def inspection_audit(accepted: DataFrame) -> DataFrame:
    """One audit row per accepted action."""
    return accepted.select(
        "officer_id", F.concat(F.lit("inspection_"), F.col("action")).alias("action"),
        F.lit("declaration").alias("target_type"), F.col("declaration_id").alias("target_id"),
        "scan_id", "field_name", "new_value", "reason", "created_at",
    )


def inspection_locations(inspections: DataFrame) -> DataFrame:
    return inspections.filter("latitude is not null AND longitude is not null").select(
        "inspection_id", "latitude", "longitude", F.col("location_source").alias("source"),
        F.col("created_at").alias("captured_at"),
    )


def create_flags(requests: DataFrame, scans: DataFrame) -> DataFrame:
    """New flags for scans that exist."""
    return requests.join(scans.select("scan_id"), "scan_id", "left_semi").withColumn("status", F.lit("NEW"))


def _known_reviews(flags: DataFrame, reviews: DataFrame, officers: DataFrame) -> DataFrame:
    allowed = with_role(reviews, officers)
    return allowed.join(flags.select("flag_id", F.col("scan_id"), F.col("status").alias("first_status")), "flag_id")


def review_flags(flags: DataFrame, reviews: DataFrame, officers: DataFrame) -> DataFrame:
    """Flags after review: the latest review of an entitled officer wins."""
    latest = _known_reviews(flags, reviews, officers).groupBy("flag_id").agg(
        F.max(F.struct("reviewed_at", "review_id", "new_status", "officer_id", "officer_notes")).alias("r")
    )
    return flags.join(latest, "flag_id", "left").select(
        *[c for c in flags.columns if c != "status"],
        F.coalesce("r.new_status", "status").alias("status"), F.col("r.officer_id").alias("reviewed_by_officer_id"),
        F.col("r.reviewed_at").alias("reviewed_at"), F.col("r.officer_notes").alias("officer_notes"),
    )


def flag_audit(flags: DataFrame, reviews: DataFrame, officers: DataFrame) -> DataFrame:
    """One audit row per review with the status before it.

    The previous status is looked up inside hours and carried from hour to hour, so a flag
    reviewed without end is not sorted in one task.
    """
    known = _known_reviews(flags, reviews, officers).withColumn("hour", F.date_trunc("hour", "reviewed_at"))
    ordered = with_previous(known, ["flag_id"], ["hour"], ["reviewed_at", "review_id"], F.col("new_status"), 1, "previous")
    return ordered.select(
        "officer_id", F.concat(F.lit("flag_"), F.lower("new_status")).alias("action"),
        F.lit("consumer_flag").alias("target_type"), F.col("flag_id").alias("target_id"), "scan_id",
        F.coalesce(F.get("previous", F.lit(0)), F.col("first_status")).alias("old_status"), "new_status",
        "officer_notes", F.col("reviewed_at").alias("created_at"),
    )


def add_images(images: DataFrame, uploads: DataFrame, scans: DataFrame) -> DataFrame:
    """Image table with uploads to existing scans appended; they carry no label."""
    known = uploads.join(scans.select("scan_id"), "scan_id", "left_semi")
    return images.unionByName(known.withColumn("label", F.lit(None).cast("string")).select(*images.columns))


def mark_reanalyze(scans: DataFrame, requested: DataFrame) -> DataFrame:
    """Requested scans go back to PROCESSING."""
    asked = requested.select("scan_id").distinct().withColumn("asked", F.lit(True))
    return scans.join(asked, "scan_id", "left").withColumn(
        "status", F.when(F.col("asked"), "PROCESSING").otherwise(F.col("status"))
    ).drop("asked")

"""Exact dedup: groups by a 128-bit content hash, with the bytes compared inside each group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelspark.llm.common import no_null_text, staged


def _hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = no_null_text(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.md5(text.cast("binary"))).alias("h"), text.alias("text"))


def text_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(classes, clashes): one row per distinct text (h, keep_id, group_size, text_sha256), and every
    h that two different texts share (none, unless md5 collides).

    Grouping by (h, text) probes by hash and compares bytes; equal texts meet in the map tasks first,
    so a group holding a third of all rows sends one row per task.
    """
    by_text = _hashed(docs, id_col, text_col).groupBy("h", "text").agg(
        F.count(F.lit(1)).alias("group_size"), F.max("doc_id").alias("keep_id")
    )
    slim = staged(
        by_text.select("h", "keep_id", "group_size", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")), "classes"
    )
    clashing = slim.groupBy("h").agg(F.count(F.lit(1)).alias("n_texts")).filter("n_texts > 1")
    return slim, staged(clashing, "clashes")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their UTF-8 bytes are; the row with the largest id stays. A null text counts
    as empty, so all null and empty texts are one group. Rows repeated with one id count each in
    group_size, and all of them are kept where their id is the keep_id. A null id is never the
    keep_id unless the whole group has null ids; then keep_id is null and kept is false. Other columns
    of `docs`, whatever their names, are not read. An empty table gives an empty result.
    """
    classes, clashes = text_classes(docs, id_col, text_col)
    hashed = _hashed(docs, id_col, text_col)
    # Nearly every h has one text: the 16-byte hash alone leads to the class.
    plain = hashed.select("doc_id", "h").join(classes.join(clashes, "h", "left_anti"), "h")
    # Where two different texts share h, the bytes decide. The list is empty unless md5 collides.
    torn = _hashed(docs, id_col, text_col).join(clashes.select("h"), "h", "left_semi")
    torn_classes = torn.groupBy("h", "text").agg(F.count(F.lit(1)).alias("group_size"), F.max("doc_id").alias("keep_id"))
    torn_rows = torn.join(torn_classes, ["h", "text"]).withColumn(
        "text_sha256", F.sha2(F.col("text").cast("binary"), 256)
    )
    columns = ["doc_id", "keep_id", "group_size", "text_sha256"]
    return plain.select(columns).unionByName(torn_rows.select(columns)).select(
        "doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), "text_sha256"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row per distinct text, all columns kept: the row with the largest id; of rows
    repeated under that id one stays."""
    classes, clashes = text_classes(docs, id_col, text_col)
    keep = classes.join(clashes, "h", "left_anti").select(F.col("h").alias("_h"), F.col("keep_id").alias("_keep"))
    torn = _hashed(docs, id_col, text_col).join(clashes.select("h"), "h", "left_semi")
    torn_keep = torn.groupBy("h", "text").agg(F.max("doc_id").alias("_keep")).select(F.col("h").alias("_h"), "_keep")
    ids = keep.unionByName(torn_keep)
    hashed = docs.withColumn("_hash", F.unhex(F.md5(no_null_text(text_col).cast("binary"))))
    rows = hashed.join(ids, (F.col("_hash") == F.col("_h")) & F.col(id_col).eqNullSafe(F.col("_keep")), "left_semi")
    return rows.dropDuplicates(["_hash", id_col]).drop("_hash")

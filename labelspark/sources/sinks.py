"""Writers of results and keyed stores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelspark.operators.catalog import newest_cache
from labelspark.operators.rules import seed_missing
from labelspark.sources.commits import KeyedStore, write_batch


def write_scan_results(facts: dict[str, DataFrame], folder: str, batch: str) -> None:
    """Declarations, evidence, compliance results, nutrition rows and scan statuses of one batch, visible
    together: read them with `commits.read_batches`. A batch written again replaces its own rows."""
    write_batch(facts, folder, batch)


def write_report_rows(parts: dict[str, DataFrame], folder: str, batch: str) -> None:
    """Report tables of one batch as JSON lines; a report is the rows of one scan across them."""
    write_batch(parts, folder, batch, "json")


def upsert_cache(store: KeyedStore, answers: DataFrame) -> list[int]:
    """Newest answer per barcode, misses included; only the buckets of the answers are written."""
    return store.merge(answers, newest_cache)


def insert_products(store: KeyedStore, fresh: DataFrame) -> list[int]:
    """Products under a barcode that the store does not have yet; stored ones stay as they are. Of
    several new rows under one barcode the least stays."""

    def merged(stored: DataFrame, new: DataFrame) -> DataFrame:
        rest = [c for c in stored.columns if c != store.key]
        one = new.groupBy(store.key).agg(F.min(F.struct(*rest)).alias("row")).select(store.key, "row.*")
        return stored.unionByName(one.join(stored.select(store.key), store.key, "left_anti"))

    return store.merge(fresh, merged)


def export_records(scan_ids: DataFrame, fmt: str) -> DataFrame:
    """One export record per reported scan."""
    return scan_ids.selectExpr("scan_id", f"'{fmt}' AS format", "CAST(NULL AS STRING) AS file_path", "'completed' AS status")


def seed_rules(existing: DataFrame, seeds: DataFrame, folder: str) -> None:
    seed_missing(existing, seeds).write.mode("append").parquet(folder)

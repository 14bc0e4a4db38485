"""Tables whose changes become visible at once.

A writer first puts the rows of each slot (a batch, or a hash bucket of a keyed store) into a folder
of their own and then adds one row to a manifest. Readers take, per slot, the folder that its newest
manifest row names: what a stopped writer left is never read, and a write done again replaces the
one before it. One writer at a time per folder; readers may come at any moment. Folders that no
manifest row names any more stay until `leftover` is used to remove them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MANIFEST = "slot string, tables array<string>, attempt string, version long"


def _manifest(spark: SparkSession, folder: str) -> DataFrame:
    try:
        return spark.read.schema(_MANIFEST).parquet(f"{folder}/_manifest")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _MANIFEST)


def _current(spark: SparkSession, folder: str) -> DataFrame:
    """The newest manifest row of every slot."""
    return _manifest(spark, folder).groupBy("slot").agg(
        F.max(F.struct("version", "attempt", "tables")).alias("row")
    ).select("slot", "row.*")


def _commit(spark: SparkSession, folder: str, slots: list[str], tables: list[str], attempt: str) -> None:
    """One file with a row per slot; it appears by one rename."""
    last = _manifest(spark, folder).agg(F.max("version")).first()[0] or 0
    rows = [(slot, tables, attempt, last + 1) for slot in slots]
    spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("append").parquet(f"{folder}/_manifest")


def write_batch(facts: dict[str, DataFrame], folder: str, batch: str, fmt: str = "parquet") -> None:
    """The rows of one batch in several tables, visible together or not at all. A batch written again
    replaces all of its rows in all tables, also in tables that it does not have any more."""
    attempt = uuid.uuid4().hex
    for name, df in facts.items():
        df.write.format(fmt).save(f"{folder}/{name}/attempt={attempt}")
    _commit(next(iter(facts.values())).sparkSession, folder, [str(batch)], list(facts), attempt)


def read_batches(spark: SparkSession, folder: str, name: str, fmt: str = "parquet", schema=None) -> DataFrame:
    """Rows of a table in all committed batches. The driver holds one path per batch, as it does for
    the partitions of any table. Without a batch that has the table, `schema` gives its columns."""
    rows = _current(spark, folder).filter(F.array_contains("tables", name)).select("attempt").collect()
    if not rows:
        return spark.createDataFrame([], schema)
    reader = spark.read.format(fmt)
    return (reader.schema(schema) if schema else reader).load([f"{folder}/{name}/attempt={r.attempt}" for r in rows])


@dataclass(frozen=True)
class KeyedStore:
    """Rows with one key column in `buckets` hash buckets; a merge reads and writes only the buckets
    that its changes fall in. `buckets` stays the same for a store's life: choose it so that a bucket
    fits a task. Dynamic overwrite of partitions deletes a partition before it puts the new one in
    its place, so a stopped job could lose it; here the old folder stays."""

    folder: str
    key: str
    buckets: int

    def _bucket(self):
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int")

    def _paths(self, spark: SparkSession, slots: list[int] | None = None) -> list[str]:
        """At most one path per bucket."""
        current = _current(spark, self.folder)
        if slots is not None:
            current = current.filter(F.col("slot").isin([str(s) for s in slots]))
        return [f"{self.folder}/attempt={r.attempt}/store_bucket={r.slot}" for r in current.select("slot", "attempt").collect()]

    def _write(self, rows: DataFrame, slots: list[int]) -> None:
        spark, attempt = rows.sparkSession, uuid.uuid4().hex
        target = f"{self.folder}/attempt={attempt}"
        # Rows are one per key, so no bucket is hotter than its share of keys.
        rows.withColumn("store_bucket", self._bucket()).repartition(len(slots), "store_bucket").write.partitionBy("store_bucket").parquet(target)
        # A bucket without rows gets no folder from the write, but has to replace the one before it.
        full = {r[0] for r in spark.read.schema("store_bucket int").parquet(target).distinct().collect()}
        for slot in slots:
            if slot not in full:
                rows.limit(0).coalesce(1).write.parquet(f"{target}/store_bucket={slot}")
        _commit(spark, self.folder, [str(s) for s in slots], [], attempt)

    def create(self, rows: DataFrame) -> None:
        """The first rows of a store, one per key."""
        self._write(rows, list(range(self.buckets)))

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(*self._paths(spark))

    def lookup(self, keys: DataFrame) -> DataFrame:
        """Rows whose key occurs in `keys`, from those keys' buckets only."""
        slots = self._touched(keys)
        paths = self._paths(keys.sparkSession, slots)
        rows = keys.sparkSession.read.parquet(*paths) if paths else self.read(keys.sparkSession).limit(0)
        return rows.join(keys.select(self.key).distinct(), self.key, "left_semi")

    def _touched(self, changes: DataFrame) -> list[int]:
        """Bucket numbers, at most `buckets` of them."""
        return sorted(r[0] for r in changes.select(self._bucket()).distinct().collect())

    def merge(self, changes: DataFrame, merged: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Replace the rows of the touched buckets by `merged(stored rows there, changes)`, which gives
        one row per key and keeps the columns. Returns the buckets written. `changes` is read twice."""
        spark, slots = changes.sparkSession, self._touched(changes)
        if slots:
            stored = spark.read.parquet(*self._paths(spark, slots))
            self._write(merged(stored, changes), slots)
        return slots


def leftover(spark: SparkSession, folder: str) -> DataFrame:
    """(slot, attempt) of manifest rows that a newer one of their slot replaces."""
    return _manifest(spark, folder).select("slot", "attempt").join(_current(spark, folder), ["slot", "attempt"], "left_anti")


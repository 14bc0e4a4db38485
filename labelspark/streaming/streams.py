"""Streams over the batch operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from labelspark.operators.catalog import known_products


def stream_dashboard(scans: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Scans per day and status; rows later than the watermark are dropped."""
    return (
        scans.withColumn("at", F.col("created_at").cast("timestamp"))
        .withWatermark("at", lateness)
        .groupBy(F.window("at", "1 day"), "overall_status")
        .agg(F.count("*").alias("scans"))
        .select(F.to_date("window.start").alias("day"), "overall_status", "scans")
    )


def daily_counts(scans: DataFrame) -> DataFrame:
    """Batch twin of `stream_dashboard`."""
    return scans.groupBy(F.to_date("created_at").alias("day"), "overall_status").agg(F.count("*").alias("scans"))


def stream_catalog_enrich(symbols: DataFrame, cache: DataFrame, catalog: DataFrame) -> DataFrame:
    """Decoded symbols with the catalog answer: stream–static joins, a cached miss stays a miss.

    What is no number has no answer. Such symbols, of which very many may say the same, go through the
    joins spread out, under keys that no catalog row has left.
    """
    number = lambda df: F.coalesce(df["barcode"].rlike("^[0-9]+$"), F.lit(False))
    asked = symbols.withColumnRenamed("data", "barcode")
    asked = asked.withColumn("lookup", F.when(number(asked), F.col("barcode")).otherwise(F.concat(F.lit("no number "), F.pmod(F.xxhash64(*asked.columns), F.lit(1000)))))
    cached = cache.filter(number(cache)).select(F.col("barcode").alias("lookup"), F.col("product").alias("cached"), F.lit(True).alias("in_cache"))
    known = known_products(catalog.filter(number(catalog))).select(F.col("barcode").alias("lookup"), "product")
    answer = F.when(F.col("in_cache"), F.col("cached")).otherwise(F.col("product"))
    joined = asked.join(cached, "lookup", "left").join(known, "lookup", "left").withColumn("answer", answer)
    return joined.select(*asked.drop("lookup").columns, "answer")


def stream_compliance(
    lines: DataFrame, judge_batch: Callable[[DataFrame], DataFrame], target: str, checkpoint: str
) -> DataStreamWriter:
    """Judge arriving scans micro-batch by micro-batch; a scan arrives whole in one file.

    Each micro-batch writes its own folder, so a batch run again replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        judge_batch(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


_TALLY = T.StructType([T.StructField(n, T.LongType()) for n in ("lines", "expected", "judged", "version", "timer")])
_ASSEMBLED = "scan_id string, version long, line string"


class _Assembler(StatefulProcessor):
    """Holds the lines of a scan and gives them out, all of them, under a new version when the scan is
    complete, when it has been quiet for a while, and again when lines come after that."""

    def __init__(self, wait_ms: int, keep_ms: int | None) -> None:
        self.wait, self.keep = wait_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tally = handle.getValueState("tally", _TALLY)
        self.lines = handle.getListState("lines", T.StructType([T.StructField("line", T.StringType())]))

    def _released(self, key: str, version: int) -> Iterator[pd.DataFrame]:
        rows = self.lines.get()
        while part := [line for (line,) in islice(rows, 10_000)]:
            yield pd.DataFrame({"scan_id": key, "version": version, "line": part})

    def _timer(self, old: int, at: int | None) -> int:
        if old >= 0:
            self.handle.deleteTimer(old)
        if at is not None:
            self.handle.registerTimer(at)
        return -1 if at is None else at

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        lines, expected, judged, version, timer = self.tally.get() if self.tally.exists() else (0, -1, 0, 0, -1)
        latest = 0
        for part in rows:
            self.lines.appendList([(line,) for line in part["line"]])
            lines += len(part)
            expected = max(expected, int(part["expected"].max()))
            latest = max(latest, int(part["arrived"].max()))
        complete = 0 <= expected <= lines
        if complete:
            judged, version = lines, version + 1
        quiet = self.keep if complete else self.wait
        timer = self._timer(timer, None if quiet is None else latest + quiet)
        self.tally.update((lines, expected, judged, version, timer))
        if complete:
            yield from self._released(key[0], version)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        lines, expected, judged, version, _ = self.tally.get()
        if lines == judged:  # nothing new since the last verdict, and kept long enough
            self.lines.clear()
            self.tally.clear()
            return
        at = expiredTimerInfo.getExpiryTimeInMs()
        timer = self._timer(-1, None if self.keep is None else at + self.keep)
        self.tally.update((lines, expected, lines, version + 1, timer))
        yield from self._released(key[0], version + 1)

    def close(self) -> None:
        pass


def assembled_scans(
    lines: DataFrame, wait_seconds: int, lateness: str = "1 minute", keep_seconds: int | None = None,
    arrived: str = "arrived_at", expected: str = "scan_lines",
) -> DataFrame:
    """Stream of (scan_id, version, line): all lines so far of every scan that is to be judged now.

    A scan is complete when it has the number of lines that one of its rows announces in `expected`
    (null: not known). Otherwise it is given out when no line of it has come for `wait_seconds`, by the
    watermark of `arrived`, the time the intake gave a line; lines that come later give out the whole
    scan again under the next version. `arrived` does not go back by more than `lateness` in the stream;
    a line that is older than that is late for the stream itself. With `keep_seconds` a judged scan
    without new lines for so long is forgotten; without it, state is kept. Lines travel as JSON.
    """
    own = [c for c in lines.columns if c not in (arrived, expected)]
    rows = (
        lines.withColumn("at", F.col(arrived).cast("timestamp")).withWatermark("at", lateness)
        .select(
            "scan_id", "at", F.to_json(F.struct(*own)).alias("line"), F.coalesce(F.col(expected).cast("long"), F.lit(-1)).alias("expected"),
            F.unix_millis("at").alias("arrived"),
        )
    )
    return rows.groupBy("scan_id").transformWithStateInPandas(
        statefulProcessor=_Assembler(wait_seconds * 1000, None if keep_seconds is None else keep_seconds * 1000),
        outputStructType=_ASSEMBLED, outputMode="Append", timeMode="EventTime",
    )


def stream_scan_verdicts(
    lines: DataFrame, judge_batch: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, wait_seconds: int,
    lateness: str = "1 minute", keep_seconds: int | None = None, arrived: str = "arrived_at", expected: str = "scan_lines",
) -> DataStreamWriter:
    """Judge scans whose lines arrive in pieces: `judge_batch` gets the lines of whole scans and returns
    rows with scan_id, which are written with `version`, one folder per micro-batch. The verdicts of a
    scan are those of its greatest version: newest_verdicts()."""
    schema = T.StructType([f for f in lines.schema.fields if f.name not in (arrived, expected)])

    def write(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        versions = held.groupBy("scan_id").agg(F.max("version").alias("version"))
        whole = held.select(F.from_json("line", schema).alias("l")).select("l.*")
        judge_batch(whole).join(versions, "scan_id").write.mode("overwrite").parquet(f"{target}/batch={number}")
        held.unpersist()

    stream = assembled_scans(lines, wait_seconds, lateness, keep_seconds, arrived, expected)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def newest_verdicts(spark: SparkSession, target: str) -> DataFrame:
    """Rows of each scan's greatest version."""
    rows = spark.read.parquet(target).drop("batch")
    newest = rows.groupBy("scan_id").agg(F.max("version").alias("version"))
    return rows.join(newest, ["scan_id", "version"], "left_semi")

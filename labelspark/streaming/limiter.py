"""Sliding-window attempt limiter: at most `limit` accepted attempts per key in any window.

Rejected attempts are not recorded, so a plain count over a range window would be wrong: whether
an attempt counts depends on the ones before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


RUN_ROWS = 4096


def admit(times: list[int], now: int, limit: int, window: int) -> bool:
    """Purge what is not newer than now - window, then admit below the limit. Microseconds."""
    times[:] = [t for t in times if t > now - window]
    if len(times) >= limit:
        return False
    times.append(now)
    return True


def _segments(attempts: DataFrame, key: str, ts: str, seconds: int, limit: int, run_rows: int) -> DataFrame:
    """Adds `segment` and `warm`: runs of a key that can be decided apart from each other.

    Time is cut into windows. What counts at the end of a window lies within it, and is known in two
    cases without what came before: an empty window leaves nothing; and where a window and the one
    before it hold at most `limit` attempts together, every attempt of the window was accepted. A run
    begins after every empty window, and at the first window of the second kind in every `run_rows`
    attempts; there it gets the attempts of the window before it once more, marked `warm`, as accepted
    ones. A key that is over the limit in every pair of windows stays one run. Runs are numbered over
    one row per (key, window), which the calendar bounds.
    """
    slotted = attempts.withColumn("slot", F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (seconds * 1_000_000)))
    order = Window.partitionBy(key).orderBy("slot")
    apart = F.coalesce(F.col("slot") - F.lag("slot").over(order) != 1, F.lit(True))
    counted = (
        slotted.groupBy(key, "slot").agg(F.count(F.lit(1)).alias("n")).withColumn("apart", apart)
        # All of a window accepted: it and the one before it hold at most `limit`.
        .withColumn("accepted", F.col("n") + F.when(F.col("apart"), 0).otherwise(F.lag("n").over(order)) <= limit)
        .withColumn("stretch", F.floor((F.sum("n").over(order) - F.col("n")) / run_rows))
        .withColumn("known", ~F.col("apart") & F.lag("accepted").over(order))
    )
    first = F.row_number().over(Window.partitionBy(key, "stretch", "known").orderBy("slot")) == 1
    slots = (
        counted.withColumn("warmed", F.col("known") & first)
        .withColumn("segment", F.sum((F.col("apart") | F.col("warmed")).cast("long")).over(order))
        .withColumn("next", F.when(F.lead("warmed").over(order), F.lead("segment").over(order)))
        .select(key, "slot", F.filter(F.array(
            F.struct("segment", F.lit(False).alias("warm")), F.struct(F.col("next").alias("segment"), F.lit(True).alias("warm")),
        ), lambda x: x["segment"].isNotNull()).alias("runs"))
    )
    return slotted.join(slots, [key, "slot"]).select(*attempts.columns, F.inline("runs"))


def limit_attempts(
    attempts: DataFrame, limit: int, seconds: int, key: str = "key_id", ts: str = "ts", event: str = "event_id", run_rows: int = RUN_ROWS,
) -> DataFrame:
    """Batch form: every attempt with `accepted`.

    Attempts stream through sorted partitions; only the at most `limit` accepted times of the
    current run are held, never a whole key. `run_rows` is about how many attempts of a busy key are
    decided in one run where its rate allows a cut.
    """
    window = seconds * 1_000_000
    rows = _segments(attempts, key, ts, seconds, limit, run_rows).select(
        key, event, "segment", "warm", F.unix_micros(F.col(ts).cast("timestamp")).alias("micros")
    )
    sorted_rows = rows.repartition(key, "segment").sortWithinPartitions(key, "segment", "micros", event)
    schema = T.StructType(
        [rows.schema[key], rows.schema[event], T.StructField("accepted", T.BooleanType())]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, times = None, []
        for batch in batches:
            accepted = []
            for name, segment, warm, now in zip(batch[key], batch["segment"], batch["warm"], batch["micros"], strict=True):
                if (name, segment) != current:
                    current, times = (name, segment), []
                if warm:
                    times.append(now)
                accepted.append(warm or admit(times, now, limit, window))
            decided = pd.DataFrame({key: batch[key], event: batch[event], "accepted": accepted})
            yield decided[~batch["warm"]]

    return sorted_rows.mapInPandas(run, schema)


class _Limiter(StatefulProcessor):
    def __init__(self, limit: int, seconds: int, key: str, event: str, idle_seconds: int | None) -> None:
        self.limit, self.window, self.key, self.event = limit, seconds * 1_000_000, key, event
        self.ttl = None if idle_seconds is None else idle_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.times = handle.getListState("times", T.StructType([T.StructField("micros", T.LongType())]), ttlDurationMs=self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        times = [row[0] for row in self.times.get()] if self.times.exists() else []
        batch = pd.concat(list(rows)).sort_values(["micros", self.event])
        accepted = [admit(times, int(now), self.limit, self.window) for now in batch["micros"]]
        if times:
            self.times.put([(t,) for t in times])
        else:
            self.times.clear()
        yield pd.DataFrame({self.key: batch[self.key], self.event: batch[self.event], "accepted": accepted})

    def close(self) -> None:
        pass


def limit_stream(
    attempts: DataFrame, limit: int, seconds: int, key: str = "key_id", ts: str = "ts", event: str = "event_id",
    idle_seconds: int | None = None,
) -> DataFrame:
    """Streaming form over the same rows, state in RocksDB: at most `limit` times a key.

    There is no watermark, so a late attempt is answered too: against the accepted attempts known when
    it arrives, newer ones included. A micro-batch is decided in time order; its size is the source's to bound
    (maxFilesPerTrigger and the like). Keys are remembered unless `idle_seconds` is given: then a key
    that had no attempt for so long, by the clock, is forgotten; such a stream also runs empty batches.
    """
    rows = attempts.select(key, event, F.unix_micros(F.col(ts).cast("timestamp")).alias("micros"))
    schema = T.StructType([rows.schema[key], rows.schema[event], T.StructField("accepted", T.BooleanType())])
    return rows.groupBy(key).transformWithStateInPandas(
        statefulProcessor=_Limiter(limit, seconds, key, event, idle_seconds), outputStructType=schema,
        outputMode="Append", timeMode="None" if idle_seconds is None else "ProcessingTime",
    )

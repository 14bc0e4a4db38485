"""Answers that come before or after their symbols; quantiles from merged sketches."""

from __future__ import annotations

import bisect
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from labelspark.operators import latency as L
from labelspark.plans.views import view
from labelspark.streaming import answers as A

PRODUCT = "struct<name:string,mrp:double>"


@pytest.mark.parametrize("seed", [0, 1])
def test_stream_equals_batch_whatever_comes_first(spark, tmp_path, seed):
    source = random.Random(seed)
    symbols = [(i, source.choice(["1", "1", "1", "2", "3", "4", "5", "x9", None])) for i in range(60)]
    answers = [("1", ("one", 0.1)), ("2", None), ("4", ("four", None)), ("7", ("none asks", 1.0)), ("5", ("late", 1.0))]
    known = spark.createDataFrame([("3", ("three", 2.5)), ("5", None)], f"barcode string, product {PRODUCT}")
    symbol_rows = spark.createDataFrame(symbols, "scan_id long, data string").withColumn("at", F.timestamp_micros(F.col("scan_id") + 7))
    answer_rows = spark.createDataFrame(answers, known.schema)
    steps = [("s", i) for i in range(4)] + [("a", i) for i in range(2)]
    source.shuffle(steps)
    for kind, i in steps:  # one file per step; the other stream gets an empty one
        symbol_rows.filter((F.col("scan_id") % 4 == i) & F.lit(kind == "s")).coalesce(1).write.mode("append").parquet(str(tmp_path / "s"))
        part = answer_rows.filter((F.col("barcode") == "1") == (i == 0)).filter(F.lit(kind == "a"))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "a"))
    read = lambda name, like: (
        spark.readStream.schema(like.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    )
    stream = A.answer_symbols(read("s", symbol_rows), read("a", answer_rows), known, parts=3)
    query = (
        stream.writeStream.format("memory").queryName(f"answered{seed}").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    assert query.awaitTermination(240)
    got = sorted(spark.table(f"answered{seed}").collect(), key=str)
    batch = A.answered_symbols(symbol_rows, answer_rows, known)
    assert got == sorted(batch.collect(), key=str)
    plain = dict(answers) | {"3": ("three", 2.5), "5": None}
    assert {(r.scan_id, r.barcode, tuple(r.answer) if r.answer else None) for r in got} == {
        (i, d, plain.get(d)) for i, d in symbols if d in plain or d in ("x9", None)
    }


def test_quantiles_of_merged_days(spark, sf_dir):
    log = view(spark, sf_dir, "log")
    sketches = L.latency_sketches(log)
    rows = log.filter("elapsed_ms is not null").select(F.to_date("ts").alias("day"), "stage", "event", "elapsed_ms").collect()
    days = sorted({r.day for r in rows})
    probabilities = [0.0, 0.1, 0.5, 0.9, 0.99, 1.0]
    for first, last in ((days[0], days[-1]), (days[len(days) // 4], days[len(days) // 2])):
        seen = {}
        for r in rows:
            if first <= r.day <= last:
                seen.setdefault((r.stage, r.event), []).append(r.elapsed_ms)
        found = L.latency_quantiles(sketches, probabilities, str(first), str(last)).collect()
        assert {(r.stage, r.event): r.n for r in found} == {k: len(v) for k, v in seen.items()}
        for r in found:
            values = sorted(seen[r.stage, r.event])
            for p, q in zip(probabilities, r.quantiles):
                low, high = bisect.bisect_left(values, q), bisect.bisect_right(values, q)
                assert low - 0.02 * len(values) - 1 <= p * len(values) <= high + 0.02 * len(values) + 1
    assert L.latency_quantiles(sketches, [0.5], str(date(1800, 1, 1)), str(date(1800, 1, 2))).collect() == []

"""Latency quantiles from stored sketches: any range of days without reading the log again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Size parameter of the sketches: ranks are off by about 0.7 % of the measurements.
SKETCH_SIZE = 400


def latency_sketches(log: DataFrame, size: int = SKETCH_SIZE) -> DataFrame:
    """One KLL sketch per day, stage and event over the measured milliseconds. Events without a
    measurement do not count; a group without any has no row. Sketches combine map-side, so a hot
    stage sends one sketch per task."""
    return (
        log.filter(F.col("elapsed_ms").isNotNull())
        .groupBy(F.to_date("ts").alias("day"), "stage", "event")
        .agg(F.kll_sketch_agg_double(F.col("elapsed_ms").cast("double"), F.lit(size)).alias("sketch"))
    )


def latency_quantiles(
    sketches: DataFrame, probabilities: list[float], first: str | None = None, last: str | None = None,
    by: tuple[str, ...] = ("stage", "event"), size: int = SKETCH_SIZE,
) -> DataFrame:
    """Quantiles over the days `first` to `last`, both included, from merged daily sketches; one row per
    group with the number of measurements and `quantiles` in the order of `probabilities`."""
    if first:
        sketches = sketches.filter(F.col("day") >= F.lit(first).cast("date"))
    if last:
        sketches = sketches.filter(F.col("day") <= F.lit(last).cast("date"))
    merged = sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch", F.lit(size)).alias("sketch"))
    return merged.select(
        *by, F.kll_sketch_get_n_double("sketch").alias("n"),
        F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(float(p)) for p in probabilities])).alias("quantiles"),
    )

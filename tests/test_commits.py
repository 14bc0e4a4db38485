"""Batches that become visible at once and keyed stores that rewrite only touched buckets."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from labelspark.sources import commits, sinks


def both(spark, folder):
    return [sorted(r.v for r in commits.read_batches(spark, folder, n, schema="v long").collect()) for n in ("a", "b")]


def test_a_stopped_job_leaves_no_half_batch(spark, tmp_path):
    folder, rows = str(tmp_path / "t"), lambda n: spark.range(n).withColumnRenamed("id", "v")
    assert both(spark, folder) == [[], []]
    sinks.write_scan_results({"a": rows(2), "b": rows(1)}, folder, "one")
    broken = rows(3).select(F.raise_error(F.lit("stopped")).cast("long").alias("v"))
    with pytest.raises(Exception, match="stopped"):
        sinks.write_scan_results({"a": rows(5), "b": broken}, folder, "two")
    with pytest.raises(Exception, match="stopped"):
        sinks.write_scan_results({"a": rows(5), "b": broken}, folder, "one")
    assert both(spark, folder) == [[0, 1], [0]]
    sinks.write_scan_results({"a": rows(3), "b": rows(0)}, folder, "two")
    sinks.write_scan_results({"b": rows(4)}, folder, "one")
    assert both(spark, folder) == [[0, 1, 2], [0, 1, 2, 3]]
    assert commits.leftover(spark, folder).count() == 1


def test_merge_writes_touched_buckets_only(spark, tmp_path):
    store = commits.KeyedStore(str(tmp_path / "s"), "barcode", 50)
    old = {str(i): ("old", 1) for i in range(2000)} | {None: ("none", 1)}
    schema = "barcode string, name string, fetched_at int"
    store.create(spark.createDataFrame([(k, *v) for k, v in old.items()], schema))
    before = set(store._paths(spark))
    fresh = {str(i): ("new", 2) for i in range(0, 2000, 200)} | {"x": (None, 2), "7": ("stale", 0), None: ("some", 3)}
    changes = spark.createDataFrame([(k, *v) for k, v in fresh.items()], schema)
    written = sinks.upsert_cache(store, changes)
    assert 0 < len(written) <= len(fresh)
    assert len(before - set(store._paths(spark))) == len(written)
    expected = old | {k: v for k, v in fresh.items() if k != "7"}
    assert {r.barcode: (r.name, r.fetched_at) for r in store.read(spark).collect()} == expected
    assert {r.barcode for r in store.lookup(changes.filter("barcode = 'x'")).collect()} == {"x"}
    assert sinks.upsert_cache(store, changes.limit(0)) == []


def test_a_bucket_can_become_empty_and_empty_stores_work(spark, tmp_path):
    store = commits.KeyedStore(str(tmp_path / "s"), "k", 4)
    store.create(spark.createDataFrame([], "k int, v string"))
    assert store.read(spark).collect() == []
    rows = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], "k int, v string")
    sinks.insert_products(store, rows)
    sinks.insert_products(store, rows.withColumn("v", F.lit("0")))
    assert {tuple(r) for r in store.read(spark).collect()} == {(1, "a"), (2, "c")}
    store.merge(rows, lambda stored, gone: stored.join(gone, "k", "left_anti"))
    assert store.read(spark).collect() == []

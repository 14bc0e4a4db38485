"""Order-dependent operators against plain loops, streams against their batch form, sources."""

from __future__ import annotations

import json
from datetime import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelspark.operators import lists as Q
from labelspark.operators import quality as V
from labelspark.operators import regions as Z
from labelspark.operators.components import components
from labelspark.operators.ordered import with_previous
from labelspark.plans.judging_queries import _cache, _catalog
from labelspark.plans.views import VIEWS, table, view
from labelspark.sources import commits, readers, sinks
from labelspark.streaming import limiter as G
from labelspark.streaming import streams as S
from test_ensemble_rules import plain_iou

BOX_DDL = "image_id int, ord int, x double, y double, w double, h double"


def random_boxes(seed, images, n):
    rng = random.Random(seed)
    return [
        (image, i, float(rng.choice([0, 1, 2, 5])), float(rng.choice([0, 1, 3])), float(rng.randint(40, 52)), float(rng.randint(40, 50)))
        for image in range(images) for i in range(n)
    ]


def plain_suppression(rows):
    kept = {}
    for image, ord_, *box in sorted(rows):
        mine = kept.setdefault(image, [])
        if all(plain_iou(box, k[2:]) <= 0.85 for k in mine):
            mine.append((image, ord_, *box))
    return {k for mine in kept.values() for k in mine}


@pytest.mark.parametrize("name", ["declarations", "scan_symbols", "images", "actions"])
def test_size_of_views_with_several_rows_a_row(spark, sf_dir, name):
    """The size that decides on a broadcast counts the rows that a view makes of each row."""
    base, rows, _, _ = VIEWS[name]
    size = lambda df: int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    key = {"orders": "o_orderkey", "events": "event_id"}[base]
    assert size(view(spark, sf_dir, name).select("scan_id")) > rows * size(table(spark, sf_dir, base).select(key))


def test_suppression(spark):
    """Components decided one by one give the sequential result."""
    rows = random_boxes(3, 4, 60)
    kept = Z.suppress_overlaps(spark.createDataFrame(rows, BOX_DDL)).collect()
    assert {tuple(r) for r in kept} == plain_suppression(rows)


def test_suppression_of_many_small_components(spark):
    """A task walks through its components, also over the ends of batches, with no call for each."""
    rows = random_boxes(7, 40, 12)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        kept = Z.suppress_overlaps(spark.createDataFrame(rows, BOX_DDL))
        assert {tuple(r) for r in kept.collect()} == plain_suppression(rows)
        assert "FlatMapGroups" not in kept._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_suppression_of_a_long_chain(spark):
    """Each box overlaps only the next few: one component of 10,000 boxes in a shuffled input order."""
    order = list(range(10_000))
    random.Random(5).shuffle(order)
    rows = [(1, order[i], 10.0 * i, 0.0, 200.0, 100.0) for i in range(10_000)]
    rows += [(1, order[3], *rows[3][2:]), (2, 0, 1.0, 1.0, 0.0, 5.0)]
    kept = {(r.ord, r.x) for r in Z.suppress_overlaps(spark.createDataFrame(rows, BOX_DDL)).filter("image_id = 1").collect()}
    taken = {}
    for _, ord_, *box in sorted(rows[:10_000]):
        if not any(plain_iou(box, taken[x]) > 0.85 for x in (box[0] - 10, box[0] + 10) if x in taken):
            taken[box[0]] = box
    assert {x for _, x in kept} == set(taken)
    assert len(kept) == len(taken)


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    source = random.Random(seed)
    edges = [(source.randrange(300), source.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1400)]
    edges += [(2000, i) for i in range(2001, 2200)] + [(None, 5), (7, 7)]
    root = {n: n for e in edges for n in e if n is not None}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a is not None and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert found == root


def test_with_previous_over_blocks(spark):
    rng = random.Random(1)
    rows = [(k, t, t // 5, rng.randint(0, 99)) for k in range(3) for t in range(60) if rng.random() < 0.6]
    df = spark.createDataFrame(rows, "k int, t int, b int, v int")
    got = with_previous(df, ["k"], ["b"], ["t"], F.col("v"), 3, "prev").collect()
    values = {}
    for k, t, _, v in rows:
        values.setdefault(k, []).append((t, v))
    for r in got:
        before = [v for t, v in values[r.k] if t < r.t][-3:][::-1]
        assert r.prev == before


def plain_limit(rows, limit, seconds):
    out, times = {}, {}
    for key, at, event in sorted(rows):
        mine = times[key] = [t for t in times.get(key, []) if t > at - seconds]
        out[event] = len(mine) < limit
        if out[event]:
            mine.append(at)
    return out


def test_limiter_batch(spark):
    rng = random.Random(5)
    rows = sorted((rng.randint(0, 3), rng.randint(0, 4000), i) for i in range(400))
    df = spark.createDataFrame(rows, "key_id int, s long, event_id int").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.event_id: r.accepted for r in G.limit_attempts(df, 5, 100).collect()}
    assert got == plain_limit(rows, 5, 100) and set(got.values()) == {True, False}


@pytest.mark.parametrize(("limit", "span", "run_rows"), [(5, 4000, 1), (5, 4000, 7), (12, 9000, 20), (1, 40_000, 3), (40, 2000, 5), (3, 300, 2)])
def test_limiter_cuts_busy_keys(spark, limit, span, run_rows):
    """Runs that begin where the state is known give the loop's answers, at any rate and run length."""
    rng = random.Random(limit * span)
    rows = sorted((rng.choice([0, 0, 1, 2]), rng.choice([rng.randint(0, span), rng.randint(0, span) // 100 * 100]), i) for i in range(500))
    df = spark.createDataFrame(rows, "key_id int, s long, event_id int").withColumn("ts", F.timestamp_seconds("s"))
    got = [(r.event_id, r.accepted) for r in G.limit_attempts(df, limit, 100, run_rows=run_rows).collect()]
    assert len(got) == len(rows) and dict(got) == plain_limit(rows, limit, 100)


def test_limiter_spreads_a_key_without_pause(spark):
    """A third of all attempts under one key, never a window empty, below the limit: many runs, few rows twice."""
    rows = [(0, 20 * i, i) for i in range(3000)] + [(k, 997 * k, 3000 + k) for k in range(1, 6000)]
    df = spark.createDataFrame(rows, "key_id int, s long, event_id int").withColumn("ts", F.timestamp_seconds("s"))
    runs = G._segments(df, "key_id", "ts", 100, 10, 200).filter("key_id = 0").groupBy("segment").agg(F.count("*").alias("n"), F.count_if("warm").alias("warm"))
    sizes = runs.collect()
    assert len(sizes) >= 14 and max(r.n for r in sizes) <= 220 and sum(r.warm for r in sizes) <= 10 * len(sizes)
    got = {r.event_id: r.accepted for r in G.limit_attempts(df, 10, 100, run_rows=200).collect()}
    assert got == plain_limit(rows, 10, 100)


def run_stream(stream, mode, name, checkpoint):
    q = (
        stream.writeStream.format("memory").queryName(name).outputMode(mode)
        .option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    )
    assert q.awaitTermination(180)
    return stream.sparkSession.table(name)


def test_limiter_stream(spark, sf_dir, tmp_path):
    attempts = view(spark, sf_dir, "attempts").withColumn("ts", F.col("ts").cast("timestamp"))
    parts = tmp_path / "in"
    middle = attempts.agg(F.percentile_approx(F.unix_micros("ts"), 0.5)).first()[0]
    for i, half in enumerate([F.unix_micros("ts") <= middle, F.unix_micros("ts") > middle]):
        attempts.filter(half).coalesce(1).write.mode("append").parquet(str(parts / f"p={i}"))
    stream = spark.readStream.schema(attempts.schema).option("maxFilesPerTrigger", 1).parquet(str(parts / "p=*"))
    out = run_stream(G.limit_stream(stream, 5, 86_400 * 3), "append", "limited", tmp_path / "cp")
    want = {r.event_id: r.accepted for r in G.limit_attempts(attempts, 5, 86_400 * 3).collect()}
    assert {r.event_id: r.accepted for r in out.collect()} == want and set(want.values()) == {True, False}


def test_limiter_stream_answers_late_attempts(spark, tmp_path):
    ddl = "key_id long, ts timestamp, event_id long"
    for i, day in enumerate(("2024-03-09", "2024-01-01", "2024-03-09")):
        rows = [(1, datetime.fromisoformat(f"{day}T00:00:0{n}"), 10 * i + n) for n in range(3)]
        spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(str(tmp_path / "in" / f"p={i}"))
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "p=*"))
    out = run_stream(G.limit_stream(stream, 2, 60), "append", "late", tmp_path / "cp").collect()
    assert len(out) == 9 and sum(r.accepted for r in out) == 2


def test_dashboard_stream(spark, sf_dir, tmp_path):
    scans = view(spark, sf_dir, "scans")
    scans.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(scans.schema).parquet(str(tmp_path / "in"))
    out = run_stream(S.stream_dashboard(stream), "complete", "daily", tmp_path / "cp")
    assert {tuple(r) for r in out.collect()} == {tuple(r) for r in S.daily_counts(scans).collect()}


def test_enrich_stream(spark, sf_dir, tmp_path):
    symbols = view(spark, sf_dir, "scan_symbols")
    symbols.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(symbols.schema).parquet(str(tmp_path / "in"))
    enrich = lambda df: S.stream_catalog_enrich(df, _cache(spark, sf_dir), _catalog(spark, sf_dir)).select(
        "scan_id", "ord", "barcode", "answer.name"
    )
    out = run_stream(enrich(stream), "append", "enriched", tmp_path / "cp")
    assert sorted(out.collect(), key=str) == sorted(enrich(symbols).collect(), key=str)


def test_compliance_stream(spark, make_lines, tmp_path):
    from labelspark.operators.extraction import extract_fields

    lines = make_lines({"a": ["MRP Rs. 5"], "b": ["MRP Rs. 7"]})
    for scan in ("a", "b"):
        lines.filter(F.col("scan_id") == scan).coalesce(1).write.parquet(str(tmp_path / "in" / f"f={scan}"))
    stream = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "f=*"))
    judge = lambda df: extract_fields(df, ["mrp"]).select("scan_id", "mrp.value.amount")
    q = S.stream_compliance(stream, judge, str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    assert {(r.scan_id, r.amount) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("a", 5.0), ("b", 7.0)}


@pytest.mark.parametrize(("seed", "announced"), [(1, 0.0), (2, 0.5)])
def test_scans_in_pieces(spark, make_lines, tmp_path, seed, announced):
    """Lines of a scan spread over micro-batches in any way give the verdicts of the batch job."""
    from labelspark.operators.extraction import extract_fields

    rng = random.Random(seed)
    texts = ["MRP Rs. {}", "Net Qty {} g", "Mfd by: Acme Foods {}", "plain {}", "EXP 05/2026"]
    scans = {f"s{k}": [(rng.choice(texts).format(rng.randint(1, 99)), 0.9, rng.choice(["front", "back"])) for _ in range(rng.randint(1, 7))] for k in range(12)}
    lines = make_lines(scans)
    count = {k: len(v) for k, v in scans.items()}
    batches = 4
    at = {(r.scan_id, r.line_no): rng.randrange(batches) for r in lines.collect()}
    for b in range(batches + 1):
        rows = [
            (*r, datetime(2024, 1, 1, b, rng.randint(0, 50)), count[r.scan_id] if rng.random() < announced else None)
            for r in lines.collect() if at[r.scan_id, r.line_no] == b
        ]
        if b == batches:  # a last scan, much later, lets the watermark pass
            rows = [(*make_lines({"z": ["MRP Rs. 1"]}).first(), datetime(2024, 1, 2), 1)]
        extra = T.StructType.fromDDL("arrived_at timestamp, scan_lines int")
        part = spark.createDataFrame(rows, T.StructType([*lines.schema.fields, *extra.fields]))
        part.coalesce(1).write.parquet(str(tmp_path / "in" / f"p={b}"))
    stream = spark.readStream.schema(part.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "p=*"))
    fields = ["mrp", "net_quantity", "manufacturer", "expiry_date"]
    judge = lambda df: extract_fields(df, fields).select("scan_id", *[F.to_json(f"{f}.value").alias(f) for f in fields])
    q = S.stream_scan_verdicts(stream, judge, str(tmp_path / "out"), str(tmp_path / "cp"), 1800).trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    newest = S.newest_verdicts(spark, str(tmp_path / "out")).filter("scan_id <> 'z'")
    assert sorted(newest.drop("version").collect()) == sorted(judge(lines).collect())
    # Only scans in more than one piece are judged again, and some are.
    spread = {k for k in scans if len({at[k, i] for i in range(count[k])}) > 1}
    again = {r.scan_id for r in newest.filter("version > 1").collect()}
    assert again <= spread and (announced or again)


def test_pixel_stats(spark):
    rng = np.random.default_rng(2)
    image = rng.integers(0, 255, (6, 5)).astype(float)
    df = spark.createDataFrame([([float(v) for v in image.ravel()], 5)], "pixels array<double>, width int")
    got = df.select(V.pixel_stats("pixels", "width").alias("s")).first().s
    mirror = lambda i, n: -i if i < 0 else 2 * n - 2 - i if i >= n else i
    at = lambda r, c: image[mirror(r, 6), mirror(c, 5)]
    edges = [at(r - 1, c) + at(r + 1, c) + at(r, c - 1) + at(r, c + 1) - 4 * at(r, c) for r in range(6) for c in range(5)]
    assert abs(got.laplacian_variance - np.var(edges)) < 1e-6 and abs(got.mean - image.mean()) < 1e-9


def test_catalog_sources(spark, tmp_path):
    (tmp_path / "a").mkdir()
    good = {"code": "1", "status": 1, "product": {"product_name": "Cola", "brands": "", "quantity": "500 ml"}}
    (tmp_path / "a" / "1.json").write_text(json.dumps(good))
    (tmp_path / "a" / "2.json").write_text(json.dumps({"code": "2", "status": 0}))
    (tmp_path / "a" / "3.json").write_text(json.dumps(good)[:-9])
    (tmp_path / "a" / "4.json").write_text(json.dumps({"code": "4", "status": 1, "product": {"product_name": ""}}))
    rows = readers.read_catalog_json(spark, str(tmp_path / "a")).collect()
    assert [(r.barcode, r.name, r.brand, r.quantity_value, r.quantity_unit) for r in rows] == [("1", "Cola", None, 500.0, "ml")]
    (tmp_path / "b.json").write_text(json.dumps({"code": "5", "items": [{"title": "T", "description": "Maker"}, {"title": "U"}]}))
    assert [(r.barcode, r.name, r.manufacturer) for r in readers.read_catalog_items(spark, str(tmp_path / "b.json")).collect()] == [("5", "T", "Maker")]


def test_company_pages_and_images(spark, tmp_path):
    html = ['<td class="x company y"> Acme </td>', '{"companyName" : "Beta"}', '<td class="company">  </td>', "nothing"]
    spark.createDataFrame(list(enumerate(html)), "page_id int, html string").write.parquet(str(tmp_path / "p"))
    rows = readers.read_company_pages(spark, str(tmp_path / "p")).collect()
    assert {(r.page_id, r.manufacturer) for r in rows} == {(0, "Acme"), (1, "Beta")}
    (tmp_path / "i").mkdir()
    for name in ("a.JPG", "b.txt", "c.webp"):
        (tmp_path / "i" / name).write_bytes(b"123")
    assert {r.path.rsplit("/", 1)[1] for r in readers.read_images(spark, str(tmp_path / "i")).collect()} == {"a.JPG", "c.webp"}


def test_log_reader_and_sinks(spark, sf_dir, tmp_path):
    (tmp_path / "log.json").write_text('{"timestamp": "2024-01-01T00:00:00Z", "event": "stage_completed", "stage": "ocr", "elapsed_ms": 2.5}\n')
    log = readers.read_pipeline_log(spark, str(tmp_path / "log.json"))
    assert Q.stage_latency(log).first().mean_ms == 2.5
    for batch in ("1", "1", "2"):
        sinks.write_scan_results({"scans": view(spark, sf_dir, "scans").filter(f"scan_id % 2 = {batch} - 1")}, str(tmp_path / "facts"), batch)
    assert commits.read_batches(spark, str(tmp_path / "facts"), "scans").count() == 1500
    sinks.write_report_rows({"exports": sinks.export_records(view(spark, sf_dir, "scans"), "docx")}, str(tmp_path / "r"), "1")
    assert commits.read_batches(spark, str(tmp_path / "r"), "exports", "json").count() == 1500


def test_page_after_equals_page_number(spark, sf_dir):
    scans = view(spark, sf_dir, "scans")
    first = Q.page(scans, "created_at", "scan_id", 1, 20).collect()
    second = Q.page(scans, "created_at", "scan_id", 2, 20).collect()
    after = Q.page(scans, "created_at", "scan_id", 1, 20, (first[-1].created_at, first[-1].scan_id)).collect()
    assert second == after
    with pytest.raises(ValueError):
        Q.page(scans, "created_at", "scan_id", 1, 101)


def test_symbols_without_a_number_are_spread(spark):
    """Very many symbols that say the same and are no number do not meet in one task of the catalog joins."""
    product = "struct<name:string,brand:string,category:string,manufacturer:string,quantity_value:double,quantity_unit:string,mrp_amount:double,mrp_currency:string>"
    cache = spark.createDataFrame([("1", None), ("plain words", None)], f"barcode string, product {product}")
    catalog = spark.createDataFrame(
        [("2", 0, "two"), ("plain words", 0, "none"), (None, 0, "none")], "barcode string, source_rank int, name string"
    ).selectExpr("*", *[f"CAST(NULL AS {t}) AS {c}" for c, t in (f.split(":") for f in product[7:-1].split(",")) if c != "name"])
    data = F.when(F.col("id") < 997, "plain words").when(F.col("id") == 997, "1").when(F.col("id") == 998, "2")
    symbols = spark.range(1000).select(F.col("id").alias("scan_id"), data.alias("data"))
    held = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        rows = S.stream_catalog_enrich(symbols, cache, catalog).select("*", F.spark_partition_id().alias("task")).collect()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert len({r.task for r in rows if r.barcode == "plain words"}) > 1
    assert sorted(r.scan_id for r in rows) == list(range(1000))
    assert {(r.barcode, r.answer and r.answer.name) for r in rows} == {("plain words", None), ("1", None), ("2", "two"), (None, None)}

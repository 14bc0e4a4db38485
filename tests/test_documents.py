"""Documents over several lines against a JSON parser, whatever blocks the lines fall into."""

from __future__ import annotations

import json
import random

import pytest

from labelspark.operators import documents as D
from labelspark.sources import readers

DDL = "file string, block long, row long, value string"


def made(seed, n):
    """[(text, document or None if it was cut off)]"""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        name = rng.choice(['q"{uo}te\\ \\" ', "plain", "}{", "\\\\", "{", 'é"', ""]) + str(i)
        doc = {"code": str(i), "status": 1, "product": {"product_name": name, "more": [{"a": "}{"}, {"b": []}, [{}]]}}
        text = json.dumps(doc, indent=rng.choice([None, 1, 4]))
        torn = rng.random() < 0.15
        out.append((text[: rng.randint(3, len(text) - 2)].rstrip(" \n,:[") if torn else text, None if torn else doc))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_documents_of_any_layout(spark, seed):
    rng = random.Random(seed)
    docs = made(seed, 70)
    good = [d for _, d in docs if d is not None]
    files = {
        "many": "\n".join(t for t, _ in docs), "list": "[\n" + ",\n".join(json.dumps(d, indent=2) for d in good) + "\n]",
        "line": json.dumps(good), "stray": "}\n}}\n" + "\n\n}\n".join(json.dumps(d, indent=1) for d in good), "blank": "\n \n", "two": "".join(json.dumps(d) for d in good[:2]),
    }
    rows = []
    for name, text in files.items():
        block = 0
        for k, line in enumerate(text.split("\n")):
            block = k if rng.random() < 0.2 else block  # blocks begin anywhere, also inside documents
            rows.append((name, block, k, line))
    rng.shuffle(rows)
    whole, torn = D.documents(spark.createDataFrame(rows, DDL).repartition(5))
    got = {}
    for r in whole.collect():
        got.setdefault(r.file, []).append(json.loads(r.text))
    as_set = lambda ds: sorted(json.dumps(d) for d in ds)
    assert as_set(got.pop("two")) == as_set(good[:2]) and set(got) == {"many", "list", "line", "stray"}
    assert all(as_set(ds) == as_set(good) for ds in got.values())
    assert {(r.file) for r in torn.collect()} == {"many"} and torn.count() == len(docs) - len(good)


def test_one_large_file_is_read_by_many_tasks(spark, tmp_path):
    docs = made(9, 3000)
    (tmp_path / "all.json").write_text("\n".join(t for t, _ in docs))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        lines = D.numbered_lines(spark, str(tmp_path))
        assert lines.select("block").distinct().count() > 20
        rows = readers.read_catalog_json(spark, str(tmp_path)).collect()
        rejects = readers.read_catalog_rejects(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = {d["code"]: d["product"]["product_name"] for _, d in docs if d is not None}
    assert {r.barcode: r.name for r in rows} == want and len(rows) == len(want)
    assert len(rejects) == len(docs) - len(want) and {r.reason for r in rejects} == {"cut off"}


def test_malformed_documents_are_counted(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"code": "1", "status": 1, "product": {"product_name": "x"}}\n{"code": oops, "status": 1}\n{"code": "3"')
    assert [r.barcode for r in readers.read_catalog_json(spark, str(tmp_path)).collect()] == ["1"]
    assert sorted(r.reason for r in readers.read_catalog_rejects(spark, str(tmp_path)).collect()) == ["cut off", "malformed"]

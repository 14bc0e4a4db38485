"""Buckets of repeats: numbers that follow the input, comparisons in slices."""

from __future__ import annotations

import random

import pyarrow as pa

from labelspark.llm import repeats, substring_dedup, suffix_dedup
from labelspark.llm.common import partitions


def prose(rng, n):
    return "".join(rng.choice("abcdefgh ") for _ in range(n))


def test_bucket_is_compared_in_slices(monkeypatch):
    rng, sizes = random.Random(3), []
    texts = [prose(rng, 2000) for _ in range(30)]

    def compare(ids, counts, content, window):
        sizes.append(len(content))
        return suffix_dedup._compare(ids, counts, content, window)

    kind = repeats.Units(suffix_dedup.WINDOW, suffix_dedup.SEED, suffix_dedup._units, compare)
    sent = []
    for g in (0, 1):
        key, docs = (pa.scalar(g),), pa.table({"doc_id": [2 * i + g for i in range(30)], "text": texts})
        sent.append(repeats._send_stretches(kind, 1)(key, docs, repeats._list_seeds(kind, 1)(key, docs)))
    bucket = pa.concat_tables(sent)

    def answers(limit):
        sizes.clear()
        monkeypatch.setattr(repeats, "SLICE_BYTES", limit)
        return repeats._answer(kind)((pa.scalar(0),), bucket).to_pylist(), list(sizes)

    whole, (size,) = answers(1 << 30)
    sliced, parts = answers(1)
    assert whole == sliced and [x["g"] for x in whole] == [1]
    assert len(parts) == repeats.SLICES and sum(parts) == size and max(parts) < size / 8


def test_groups_and_buckets_follow_the_text(spark, monkeypatch):
    rng = random.Random(4)
    passage = prose(rng, 300)
    texts = [prose(rng, 900) + passage * (i % 3) for i in range(40)] + [None, ""]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert repeats._dealt_into(docs.limit(0), "text") == (1, 4 * partitions(spark))
    runs = suffix_dedup.suffix_dedup, substring_dedup.substring_dedup
    before = [sorted(map(str, run(docs).collect())) for run in runs]
    monkeypatch.setattr(repeats, "GROUP_BYTES", 4000)
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 500)
    size = sum(len(t or "") for t in texts)
    assert repeats._dealt_into(docs, "text") == (size // 4000 + 1, size // 500 + 1)
    assert size // 500 + 1 > 4 * partitions(spark)
    assert [sorted(map(str, run(docs).collect())) for run in runs] == before

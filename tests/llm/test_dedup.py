"""Exact, suffix, substring and n-gram dedup against plain loops."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest
from near_copies import jaccard

from labelspark.llm import exact_dedup, ngram_join, substring_dedup, suffix_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DDL = "doc_id long, text string, h string, node long, lang string"


def fixture_docs():
    rng = random.Random(5)
    vocabulary = ["wört" + str(i) if i % 7 else "é" * (i % 5 + 1) + str(i) for i in range(300)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, base = prose(80), prose(120)
    docs = [prose(rng.randint(1, 60)) + "\n\t" + passage[: rng.randint(0, 600)] + " " + prose(20) for _ in range(12)]
    docs += [base, base, base.replace("wört1 ", "x ", 1), base + " tail", " ".join(base.split()[:119]), base.upper()]
    docs += [f"{prose(30)} {passage} {prose(5)} {passage}" for _ in range(4)]
    docs += ["", None, None, "  \n", "one two", "one two", "ab " * 400, "ab " * 390, prose(9000)]
    order = rng.sample(range(1, 200), len(docs))
    rows = [(i, t, "x", 1, None) for i, t in zip(order, docs, strict=True)]
    return [*rows, rows[0], rows[14]]  # two rows repeated under their ids


@pytest.fixture(scope="module")
def rows():
    return fixture_docs()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DDL).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DDL)


def test_exact(docs, rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1] or "", []).append(r[0])
    want = Counter((i, max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g)
    assert Counter(map(tuple, exact_dedup.exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())) == want
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(max(g) for g in groups.values())


def test_exact_tells_colliding_texts_apart(docs, rows, monkeypatch):
    from pyspark.sql import functions as F

    plain = exact_dedup._hashed
    monkeypatch.setattr(exact_dedup, "_hashed", lambda *a: plain(*a).withColumn("h", F.substring("h", 1, 0)))
    groups = {}
    for r in rows:
        groups.setdefault(r[1] or "", []).append(r[0])
    got = exact_dedup.exact_dedup(docs).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == Counter((i, max(g), len(g)) for g in groups.values() for i in g)


def test_exact_null_ids(spark):
    got = exact_dedup.exact_dedup(spark.createDataFrame([(None, "a"), (1, "a"), (None, "b")], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.keep_id, r.kept) for r in got} == {(None, 1, False), (1, 1, True), (None, None, False)}


def removed(rows, split, join):
    """Per row: units, removed flags, joined rest, by the definition."""
    least = {}
    for i, text, *_ in rows:
        u = split(text or "")
        for s in range(len(u) - 49):
            w = tuple(u[s : s + 50])
            least[w] = min(least.get(w, i), i)
    out = []
    for i, text, *_ in rows:
        u = split(text or "")
        gone = [False] * len(u)
        for s in range(len(u) - 49):
            if least[tuple(u[s : s + 50])] < i:
                gone[s : s + 50] = [True] * 50
        runs = [(k, gone[k:].index(False) + k if False in gone[k:] else len(gone)) for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1])]
        out.append((i, len(u), tuple(runs), join([x for x, g in zip(u, gone, strict=True) if not g])))
    return Counter(out)


def test_suffix(docs, rows):
    got = suffix_dedup.suffix_dedup(docs).collect()
    want = removed(rows, lambda t: t.encode(), bytes)
    assert Counter((r.doc_id, r.n_bytes, tuple((s.start, s.end) for s in r.spans), bytes(r.kept)) for r in got) == want
    assert sum(bool(r.spans) for r in got) > 8


def test_suffix_order_without_hash(monkeypatch):
    import numpy as np

    data = np.frombuffer(bytes(random.Random(2).choices(b"ab", k=400)) * 2, np.uint8)
    suffix, ids = np.arange(700), np.repeat([3, 1], 350)
    right = suffix_dedup._compare(np.array([3, 1]), np.array([30, 30]), data[:158].tobytes(), 50)
    order, lcp = suffix_dedup.suffix_order(suffix, ids, data, 50)
    monkeypatch.setattr(suffix_dedup.arrays.Hashes, "spans", lambda self, a, b: np.zeros(len(a), np.uint64))
    assert lcp.sum() == suffix_dedup.suffix_order(suffix, ids, data, 50)[1].sum() > 0
    assert (right == suffix_dedup._compare(np.array([3, 1]), np.array([30, 30]), data[:158].tobytes(), 50)).all()


def test_substring(docs, rows):
    got = substring_dedup.substring_dedup(docs).collect()
    want = removed(rows, WORD.findall, " ".join)
    assert Counter((r.doc_id, r.n_words, tuple((s.start, s.end) for s in r.spans), r.kept) for r in got) == want
    assert sum(bool(r.spans) for r in got) > 5


@pytest.mark.parametrize("block", [256, 2])
def test_ngram(docs, rows, block, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    want = jaccard(rows)
    got = ngram_join.ngram_join(docs).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in got) == Counter((r[0], *want[r[0]]) for r in rows)


def test_ngram_large_group(spark):
    rng = random.Random(1)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base[:k] + [f"v{i}"] + base[k + 1 :])) for i, k in enumerate(rng.choices(range(200), k=600))]
    got = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.class_id for r in got} == {0} and all(r.n_links == 599 for r in got)


def test_ngram_keeps_one(docs, rows):
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {c for c, _ in jaccard(rows).values()}


def test_forest_depth():
    assert ngram_join.prefix_depth() == 5
    assert ngram_join.prefix_depth(recall=0.9) > ngram_join.prefix_depth(recall=0.99999)


def test_empty(none):
    for run in (exact_dedup.exact_dedup, suffix_dedup.suffix_dedup, substring_dedup.substring_dedup, ngram_join.ngram_join):
        assert run(none).count() == 0


def test_null_ids(spark):
    long = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(None, long), (4, long), (None, long)], "doc_id long, text string")
    for run in (suffix_dedup.suffix_dedup, substring_dedup.substring_dedup):
        assert Counter((r.doc_id, bool(r.spans)) for r in run(docs).collect()) == {(None, True): 2, (4, False): 1}
    assert Counter((r.doc_id, r.class_id) for r in ngram_join.ngram_join(docs).collect()) == {(None, None): 2, (4, 4): 1}

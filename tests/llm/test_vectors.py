"""Metric trees and vector codes against plain loops over all points and entries."""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pytest

from labelspark.llm import metric_tree, vector_codes

DDL = "vec_id long, embedding array<float>, label int, code string, _salt int, points string"


def nearest(points, entries):
    d = ((points[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
    return d.argmin(axis=1), d.min(axis=1)


def plain(rows, parts=8, entries=16, rounds=6):
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    if not kept:
        return [], None
    x = np.array([[math.floor(4096 * float(np.float32(v))) for v in r[1]] for r in kept], np.int64).reshape(len(kept), -1)
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, [float(np.float32(v)) for v in kept[k][1]]))[:entries]
    parted = np.split(x, parts, axis=1)
    books = [p[first].copy() for p in parted]
    for _ in range(rounds):
        for p, book in zip(parted, books, strict=True):
            code, _ = nearest(p, book)
            for k in range(len(book)):
                if (code == k).any():
                    book[k] = p[code == k].sum(axis=0) // (code == k).sum()
    found = [nearest(p, book) for p, book in zip(parted, books, strict=True)]
    error = sum(d for _, d in found)
    of_label = defaultdict(int)
    for r, e in zip(kept, error, strict=True):
        of_label[r[2]] += int(e)
    codes = ["".join(f"{c[k]:02x}" for c, _ in found) for k in range(len(kept))]
    return sorted(((r[0], r[2], codes[k], int(error[k]), of_label[r[2]]) for k, r in enumerate(kept)), key=str), np.stack(books)


@pytest.mark.parametrize("kind", ["spread", "clusters", "equal", "grid", "outliers", "line"])
def test_tree_settles_like_all_pairs(kind):
    rng = np.random.default_rng(7)
    n = 1500
    points = {
        "spread": lambda: rng.normal(0, 500, (n, 8)), "clusters": lambda: rng.normal(0, 3, (n, 8)) + rng.integers(-4, 5, (n, 1)) * 900,
        "equal": lambda: np.full((n, 8), 17), "grid": lambda: rng.integers(-1, 2, (n, 8)), "line": lambda: np.arange(n)[:, None] * np.ones((1, 8)),
        "outliers": lambda: np.where(rng.random((n, 1)) < 0.01, rng.normal(0, 2**26, (n, 8)), rng.normal(0, 2, (n, 8))),
    }[kind]()
    points = np.floor(points).astype(np.int64)
    tree = metric_tree.build(points)
    assert sorted(tree.order) == list(range(n)) and (tree.total[0] == points.sum(axis=0)).all()
    own = points[tree.order]
    for k in range(len(tree.first)):
        inside = own[tree.first[k] : tree.upto[k]]
        assert (inside.sum(axis=0) == tree.total[k]).all()
        assert np.sqrt(((inside - inside.mean(axis=0)) ** 2).sum(axis=1)).max() <= tree.radius[k] * (1 + 1e-9) + 1e-6
        kids = range(tree.child[k], tree.child[k] + tree.n_child[k])
        assert not len(kids) or (tree.first[kids[0]] == tree.first[k] and tree.upto[kids[-1]] == tree.upto[k] and kids[0] > k)
    for entries in (points[:16], np.concatenate([points[:8], points[:8]]), points[:1], points[rng.integers(0, n, 40)] + 1):
        code, sums, counts = metric_tree.assign(tree, own, entries)
        want, _ = nearest(own, entries)
        assert (code == want).all() and (counts == np.bincount(want, minlength=len(entries))).all()
        assert all((sums[k] == own[want == k].sum(axis=0)).all() for k in range(len(entries)))


def test_wholly_owned_balls_save_points():
    """Far clusters: nearly all points are settled by balls, without a distance of their own."""
    rng = np.random.default_rng(1)
    points = (rng.normal(0, 3, (4000, 8)) + rng.integers(0, 8, (4000, 1)) * 1000).astype(np.int64)
    tree = metric_tree.build(points)
    bad = points[tree.order].copy()
    bad[:] = 0  # points are only looked at in leaves
    entries = np.repeat(np.arange(8) * 1000, 8).reshape(8, 8)
    code, sums, counts = metric_tree.assign(tree, bad, entries)
    want, _ = nearest(points[tree.order], entries)
    assert (code == want).all() and counts.sum() == 4000 and (sums.sum(axis=0) == points.sum(axis=0)).all()


def sample(n, seed, size=16):
    rng = np.random.default_rng(seed)
    centre = rng.normal(0, 0.3, (5, size))
    rows = [(int(i), (centre[i % 5] + rng.normal(0, 0.05, size)).astype(np.float32).tolist(), int(i % 3) if i % 4 else None, "c", 1, "p") for i in rng.permutation(n)]
    bad = [None, [None] + [0.0] * (size - 1), [float("nan")] * size, [0.1] * (size - 1) + [float("inf")], [0.1] * (size - 1) + [float("-inf")]]
    rows += [(-1 - k, v, 1, "c", 1, "p") for k, v in enumerate(bad)]
    rows += [rows[3], rows[3], (None, [0.25] * size, None, None, None, None), (n, [0.5] * size, 7, "c", 1, "p")] + [(n + k, [0.125] * size, 2, "c", 1, "p") for k in range(1, 60)]
    return rows


@pytest.mark.parametrize("n", [0, 1, 7, 400])
def test_codes(spark, monkeypatch, n):
    monkeypatch.setattr(vector_codes, "CHUNK", 90)
    rows = sample(max(n, 4), 3)
    rows = rows if n > 7 else [r for r in rows[:n]]
    vectors = spark.createDataFrame(rows, DDL).repartition(3)
    got, books = vector_codes.compress(vectors)
    want, want_books = plain(rows)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    if want:
        assert (books == want_books).all() and len(vector_codes.fingerprint(books)) == 64
        near = got.withColumn("v", vector_codes.approximate("code", books)).filter("vec_id is not null").collect()
        of = {r[0]: r[1] for r in rows}
        for r in near[:20]:
            assert abs(sum((a - b) ** 2 for a, b in zip(r.v, of[r.vec_id], strict=True)) - r.error / 4096**2) < 0.01
    else:
        assert books.shape == (8, 0, 0)


def test_codes_of_the_table(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    got, books = vector_codes.compress(vectors)
    want, want_books = plain([(r.vec_id, r.embedding, r.label) for r in vectors.collect()])
    assert sorted((tuple(r) for r in got.collect()), key=str) == want and (books == want_books).all()


def test_vectors_that_cannot_be_cut(spark):
    make = lambda *v: spark.createDataFrame([(k, list(x), 0, "", 0, "") for k, x in enumerate(v)], DDL)
    for table in (make([1.0] * 8, [1.0] * 16), make([1.0] * 9), make([70_000.0] * 8)):
        with pytest.raises(ValueError):
            vector_codes.compress(table)
    got, _ = vector_codes.compress(make([], []))
    assert [(r.code, r.error) for r in got.collect()] == [("00" * 8, 0)] * 2

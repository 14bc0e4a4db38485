"""N-gram Jaccard join: MinHash LSH forest for candidates, then exact verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelspark.llm import arrays
from labelspark.llm.common import no_null_text, staged
from labelspark.llm.graph import components

SHINGLE = 5  # words
SIMILARITY = 0.8
TREES = 24
DEPTH = 8  # longest prefix of a tree
RECALL = 0.9999  # of pairs at exactly SIMILARITY
BLOCK = 256  # documents compared with each other at a time
CHUNK_BYTES = 1 << 21
COLUMNS = 4096  # shingles of a block counted at a time


def prefix_depth(trees: int = TREES, depth: int = DEPTH, similarity: float = SIMILARITY, recall: float = RECALL) -> int:
    """The longest prefix at which the forest still finds the wanted share of pairs: starting from the
    whole path, prefixes are shortened until 1 - (1 - s**d)**trees reaches it."""
    while depth > 1 and 1 - (1 - similarity**depth) ** trees < recall:
        depth -= 1
    return depth


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each row, by row and hash. A row with fewer than `size`
    words is one shingle, a row without words none."""
    start, end, bounds = arrays.word_spans(data, offsets)
    hashes = arrays.Hashes(arrays.word_values(data, start, end))
    count = np.diff(bounds)
    many = np.maximum(np.minimum(count, 1), count - size + 1)
    first = arrays.ranges(bounds[:-1], many)
    row = np.repeat(np.arange(len(count)), many)
    h = hashes.spans(first, np.minimum(first + size, bounds[row + 1]))
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.r_[True, (row[1:] != row[:-1]) | (h[1:] != h[:-1])] if len(h) else np.zeros(0, bool)
    return row[new], h[new]


def _pieces(column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end, data, offsets) of pieces of about CHUNK_BYTES."""
    data, offsets = arrays.text_buffer(column)
    at = 0
    while at < len(offsets) - 1:
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right")) - 1)
        yield at, upto, data[offsets[at] : offsets[upto]], offsets[at : upto + 1] - offsets[at]
        at = upto


def _sign(trees: int, depth: int, size: int):
    draw = np.random.default_rng(7)
    factor = draw.integers(0, 2**63, (trees, depth), dtype=np.uint64) | np.uint64(1)
    shift = draw.integers(0, 2**63, (trees, depth), dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for a, b, data, offsets in _pieces(batch.column("text")):
                row, h = shingles(data, offsets, size)
                filled, head = np.unique(row, return_index=True)
                keys = np.zeros((b - a, trees), np.uint64)
                for t in range(trees):
                    # The prefix of `depth` minima along a path of the tree, as one number.
                    path = np.zeros(len(filled), np.uint64)
                    for d in range(depth):
                        if len(h):
                            least = np.minimum.reduceat(h * factor[t, d] + shift[t, d], head)
                            path = arrays.mix(path * np.uint64(31) + least)
                    keys[filled, t] = path
                raw = data.tobytes()
                texts = [raw[x:y] for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                has = np.zeros(b - a, bool)
                has[filled] = True
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(a, b - a), pa.array([hashlib.md5(t).digest() for t in texts], pa.binary()),
                        pa.array([k.tobytes() if x else None for k, x in zip(keys.view(np.int64), has, strict=True)], pa.binary()),
                    ],
                    names=["doc_id", "h", "path"],
                )

    return run


def _pairs_in(row: np.ndarray, h: np.ndarray, docs: int) -> np.ndarray:
    """Number of common shingles for each pair of `docs` documents."""
    order = np.argsort(h, kind="stable")
    row, h = row[order], h[order]
    new = np.r_[True, h[1:] != h[:-1]] if len(h) else np.zeros(0, bool)
    column = np.cumsum(new) - 1
    shared = np.bincount(column, minlength=1)[column] > 1 if len(h) else new
    row, column = row[shared], column[shared]
    common = np.zeros((docs, docs), np.float32)
    if not len(row):
        return common
    column = np.unique(column, return_inverse=True)[1]
    edge = np.searchsorted(column, np.arange(0, column[-1] + COLUMNS + 1, COLUMNS))
    for k, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)):
        if b > a:
            x = np.zeros((docs, COLUMNS), np.float32)
            x[row[a:b], column[a:b] - k * COLUMNS] = 1
            common += x @ x.T
    return common


def _verify(similarity: float, size: int):
    def run(table: pa.Table) -> pa.Table:
        """Links of one block, or of two with each other: node, links, root."""
        comp, side = table["comp"].to_numpy(), table["part"].to_numpy()
        node, mult = table["node"].to_numpy(), table["mult"].to_numpy()
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        rows, hashes = [], []
        for a, _, data, offsets in _pieces(table["text"]):
            r, h = shingles(data, offsets, size)
            rows.append(r + a)
            hashes.append(h)
        row, h = np.concatenate(rows), np.concatenate(hashes)
        out = []
        order = np.argsort(comp, kind="stable")
        edges = np.flatnonzero(np.r_[True, comp[order][1:] != comp[order][:-1]])
        place = np.empty(len(comp), np.int64)
        for a, b in zip(edges, [*edges[1:], len(order)], strict=True):
            own = order[a:b]
            own = own[np.unique(node[own], return_index=True)[1]]  # rows repeated under one id are one node
            if len(own) < 2:
                continue
            place[own] = np.arange(len(own))
            lo = np.searchsorted(row, own)
            take = arrays.ranges(lo, np.searchsorted(row, own, "right") - lo)
            r = place[row[take]]
            common = _pairs_in(r, h[take], len(own))
            n = np.bincount(r, minlength=len(own)).astype(np.float32)
            union = n[:, None] + n[None, :] - common
            linked = (common >= similarity * union - 1e-6 * union) & (common > 0)
            np.fill_diagonal(linked, False)
            if i != j:
                linked &= side[own][:, None] != side[own][None, :]
            if not linked.any():
                continue
            links = linked @ mult[own]
            root = node[own]
            while True:
                least = np.minimum(root, np.where(linked, root[None, :], np.iinfo(np.int64).max).min(axis=1))
                if (least == root).all():
                    break
                root = least
            on = linked.any(axis=1)
            out.append((node[own][on], links[on], root[on]))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("node", "links", "root"), columns, strict=True)})

    return run


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE,
               similarity: float = SIMILARITY, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> DataFrame:
    """One row per row of `docs`: doc_id, class_id (smallest id of its group), n_links.

    Two documents are linked when the Jaccard similarity of their sets of five-word shingles is 0.8 or
    more; words are runs without the six ASCII white-space characters, unchanged. A group is a
    connected component of links. n_links counts the other rows linked to this one, equal texts
    included.

    Equal texts become one node first. Every tree of the forest orders the nodes by the path of their
    minima; nodes with one prefix are tied to the least of them, and what the ties connect is compared
    exactly, in blocks of BLOCK × BLOCK, each pair in one task, so a group of any size is spread over
    tasks and only counts and one root per node leave them. Shingles are compared by 64-bit hashes.

    A text of fewer than five words is one shingle; null, empty and blank texts have none and are
    linked to equal texts only (null equals empty). Rows repeated under one id are one node, each row
    counting as a link of the other. Rows with a null id get null and 0. An empty table gives an
    empty result; other columns are not read.
    """
    least = prefix_depth(trees, depth, similarity, recall)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), no_null_text(text_col).alias("text"))
    known = texts.filter("doc_id is not null")
    signed = staged(known.mapInArrow(_sign(trees, least, size), "doc_id long, h binary, path binary"), "signatures")
    nodes = staged(
        signed.groupBy("h").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("mult"), F.any_value("path").alias("path")), "nodes"
    )
    tree = F.posexplode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("_", "tree")
    paths = nodes.filter("path is not null").select("node", "path", tree).select(
        "node", "tree", F.substring("path", F.col("tree") * 8 + 1, F.lit(8)).alias("prefix")
    )
    heads = paths.groupBy("tree", "prefix").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    ties = paths.join(heads, ["tree", "prefix"]).filter("node > head").select(F.col("node").alias("u"), F.col("head").alias("v"))
    found = staged(components(ties).select("node", F.col("root").alias("comp")), "candidates")

    sizes = found.groupBy("comp").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    tasks = max(1, found.count() // BLOCK)
    placed = (
        found.join(sizes, "comp").join(nodes.groupBy("node").agg(F.max("mult").alias("mult")), "node")
        .withColumn("part", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    )
    placed = staged(placed, "placed")
    # Merged at every size: the texts are shuffled once, whether the candidates are few or many.
    members = placed.hint("merge").join(known.withColumnRenamed("doc_id", "node"), "node")
    # Small components share a task; a large one has a task for each pair of its blocks.
    small = members.filter("blocks = 1").select(
        F.pmod(F.xxhash64("comp"), F.lit(tasks)).alias("unit"), F.lit(0).alias("i"), F.lit(0).alias("j"), "comp", "part", "node", "mult", "text"
    )
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("k")
    large = members.filter("blocks > 1").select("*", other).select(
        (-1 - F.col("comp")).alias("unit"), F.least("part", "k").alias("i"), F.greatest("part", "k").alias("j"), "comp", "part", "node", "mult", "text"
    )
    rows = small.unionByName(large)
    links = staged(
        rows.groupBy("unit", "i", "j").applyInArrow(_verify(similarity, size), "node long, links long, root long"), "links"
    )
    groups = components(links.select(F.col("node").alias("u"), F.col("root").alias("v")))
    counted = links.groupBy("node").agg(F.sum("links").alias("links"))
    node_rows = nodes.select("h", "node", "mult").join(groups, "node", "left").join(counted, "node", "left").select(
        "h", F.coalesce("root", "node").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links")
    )
    result = signed.select("doc_id", "h").join(staged(node_rows, "classes"), "h").select("doc_id", "class_id", "n_links")
    lost = texts.filter("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return result.unionByName(lost)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`docs` with one document of each group, the one with the smallest id; rows without id stay."""
    others = staged(ngram_join(docs, id_col, text_col, **options).filter("doc_id <> class_id").select(F.col("doc_id").alias("_other")).distinct(), "others")
    return docs.join(others.hint("merge"), docs[id_col] == others["_other"], "left_anti")

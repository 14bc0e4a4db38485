"""Vector code compression: product quantisation by Lloyd's rounds in whole numbers, settled ball by ball."""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelspark.llm import metric_tree
from labelspark.llm.common import staged

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
CHUNK = 4096  # vectors under one set of trees
CHUNK_VALUES = 1 << 22  # or at so many components
LARGEST = 1 << 28  # of a whole-number component: squared distances stay within 64 bits
SALTS = 16  # a label may be that of a third of all rows


def whole(vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale × component)."""
    found = np.floor(vectors.astype(np.float64) * scale)
    if found.size and np.abs(found).max() >= LARGEST:
        raise ValueError(f"a component times {scale} reaches {LARGEST}")
    return found.astype(np.int64)


def _kept(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    return rows.filter(F.col("vector").isNotNull() & finite)


def _forest(size: int, parts: int, scale: int):
    """Rows to chunks: ids, labels, whole-number vectors, and a tree for each part."""

    def chunk(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        vectors = table["vector"].combine_chunks()
        lengths = np.diff(vectors.offsets.to_numpy())
        if (lengths != size).any():
            raise ValueError(f"vectors of {size} and of {int(lengths[lengths != size][0])} components")
        points = whole(vectors.flatten().to_numpy().reshape(len(lengths), size), scale)
        trees = io.BytesIO()
        parted = np.split(points, parts, axis=1)
        np.savez(trees, **{f"{p}-{name}": x for p, own in enumerate(parted) for name, x in metric_tree.build(own).parts().items()})
        cells = {name: table[name].combine_chunks() for name in ("vec_id", "label")}
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in cells.values()]
        return pa.RecordBatch.from_arrays(
            [*lists, pa.array([points.astype(np.int32).tobytes()]), pa.array([trees.getvalue()])], names=["vec_id", "label", "points", "trees"]
        )

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = max(1, min(CHUNK, CHUNK_VALUES // max(size, 1)))
        held, n = [], 0
        for batch in rows:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, full - n)
                held.append(part)
                n, at = n + part.num_rows, at + part.num_rows
                if n == full:
                    yield chunk(held)
                    held, n = [], 0
        if n:
            yield chunk(held)

    return batches


def _chunks(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[tuple[pa.RecordBatch, list[tuple[metric_tree.Tree, np.ndarray]]]]:
    """(one row, for each part its tree and its points in the tree's order)."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1)
            n = len(row.column("vec_id").flatten())
            points = np.frombuffer(row.column("points")[0].as_buffer(), np.int32).reshape(n, -1).astype(np.int64)
            arrays = np.load(io.BytesIO(row.column("trees")[0].as_py()))
            trees = [metric_tree.Tree(**{name.split("-")[1]: arrays[name] for name in arrays.files if name.startswith(f"{p}-")}) for p in range(parts)]
            yield row, [(tree, own[tree.order]) for tree, own in zip(trees, np.split(points, parts, axis=1), strict=True)]


def _tallied(codebooks: np.ndarray):
    """Sums of all entries' components and, after them, counts of the entries: (slot, value) per task."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(codebooks.shape, np.int64), np.zeros(codebooks.shape[:2], np.int64)
        for _, parts in _chunks(rows, len(codebooks)):
            for p, (tree, points) in enumerate(parts):
                _, own, count = metric_tree.assign(tree, points, codebooks[p])
                sums[p] += own
                counts[p] += count
        values = np.concatenate([sums.ravel(), counts.ravel()])
        slots = np.flatnonzero(values)
        yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), pa.array(values[slots], pa.int64())], names=["slot", "value"])

    return batches


def _coded(codebooks: np.ndarray):
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, parts in _chunks(rows, len(codebooks)):
            n = len(parts[0][1])
            codes, error = np.zeros((n, len(parts)), np.uint8), np.zeros(n, np.int64)
            for p, (tree, points) in enumerate(parts):
                code, _, _ = metric_tree.assign(tree, points, codebooks[p])
                codes[tree.order, p] = code
                error[tree.order] += ((points - codebooks[p][code]) ** 2).sum(axis=1)
            text, width = codes.tobytes().hex(), 2 * len(parts)
            yield pa.RecordBatch.from_arrays(
                [
                    row.column("vec_id").flatten(), row.column("label").flatten(),
                    pa.array([text[k * width : (k + 1) * width] for k in range(n)], pa.string()), pa.array(error),
                ],
                names=["vec_id", "label", "code", "error"],
            )

    return batches


def compress(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> tuple[DataFrame, np.ndarray]:
    """(one row per kept row: vec_id, label, code, error, label_error; codebooks[part, entry, place]).

    Rows whose vector is null or holds a null or non-finite component are dropped. Components become
    floor(scale × x); all that follows is in whole numbers and exact. Each part's codebook starts as that
    part of the vectors of the smallest ids. A round assigns every part to its nearest entry, ties to the
    lower index, and replaces each entry by the floor of its parts' mean; unused entries stay.

    Chunks of vectors get a metric tree per part once, written to the shared folder without a shuffle;
    every round walks the trees and sends one sum per entry and task. `code` holds two hex digits per
    part; `error` is the squared distance to the entries, `label_error` its sum over equal labels, null
    labels together.

    With fewer kept rows than entries there are fewer entries. Rows repeated under one id count and are
    coded each; at the start they are taken in the order of their vectors. A null id is the last to
    start an entry. Vectors of unequal lengths, of a length that `parts` does not divide, or with a
    component times scale of 2**28 or more raise ValueError. No kept row gives an empty result and
    codebooks without entries. Other columns are not read.
    """
    if not 1 <= entries <= 256:
        raise ValueError("1 to 256 entries have two hex digits")
    rows = _kept(vectors, id_col, vector_col, label_col)
    start = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").select("vector").limit(entries).collect()
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    coded_ddl = f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"
    if not start:
        empty = rows.sparkSession.createDataFrame([], f"{coded_ddl}, label_error long")
        return empty, np.zeros((parts, 0, 0), np.int64)
    size = len(start[0]["vector"])
    if size % parts or any(len(r["vector"]) != size for r in start):
        raise ValueError(f"vectors of {sorted({len(r['vector']) for r in start})} components in {parts} parts")
    codebooks = np.stack(np.split(whole(np.array([r["vector"] for r in start]).reshape(len(start), size), scale), parts, axis=1))
    forest = staged(
        rows.mapInArrow(_forest(size, parts, scale), f"vec_id array<{kinds['vec_id']}>, label array<{kinds['label']}>, points binary, trees binary"), "trees"
    )
    for _ in range(rounds):
        tally = forest.select("vec_id", "points", "trees").mapInArrow(_tallied(codebooks), "slot long, value long")
        # As many rows as the codebooks have numbers.
        found = tally.groupBy("slot").agg(F.sum("value").alias("value")).collect()
        values = np.zeros(codebooks.size + codebooks.shape[0] * codebooks.shape[1], np.int64)
        values[[r["slot"] for r in found]] = [r["value"] for r in found]
        sums, counts = values[: codebooks.size].reshape(codebooks.shape), values[codebooks.size :].reshape(codebooks.shape[:2])
        codebooks = np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], codebooks)
    coded = staged(forest.mapInArrow(_coded(codebooks), coded_ddl), "codes")
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).select(F.col("label").alias("_label"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    salted = coded.withColumn("_salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    same = salted["label"].eqNullSafe(sums["_label"]) & (salted["_salt"] == sums["_salt"])
    return salted.join(sums, same).select("vec_id", "label", "code", "error", "label_error"), codebooks


def fingerprint(codebooks: np.ndarray) -> str:
    """sha256 of all components as decimal numbers by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def approximate(code: str | Column, codebooks: np.ndarray, scale: int = SCALE) -> Column:
    """The vector that a code stands for: each entry's components, half a step up, over scale."""
    code = F.col(code) if isinstance(code, str) else code
    # Entries as literals: as many as the codebooks hold.
    books = [F.array(*[F.array(*[F.lit(float(x)) for x in entry]) for entry in (book + 0.5) / scale]) for book in codebooks]
    index = [F.conv(F.substring(code, 2 * p + 1, 2), 16, 10).cast("int") for p in range(len(books))]
    return F.concat(*[F.get(book, i) for book, i in zip(books, index, strict=True)])

"""Repeats between documents, found through winnowed seeds. Base of suffix and substring dedup.

Four steps, all keyed so that no group grows with the corpus:
1. Documents are dealt into groups of some hundred by a hash of their id. A group lists its seeds.
2. Buckets of seed hashes tell each group which of its seeds other documents have too.
3. For a shared seed the group sends what the seed's windows hold; a stretch that several documents
   of the group share is sent once, for the smallest id. So a passage that a third of all documents
   hold costs a bucket one entry per group, not per document.
4. Buckets compare windows, answer with one bit per window, and the group marks what to remove.
Texts are shuffled once; steps 1, 3 and 4 read the same shuffle. The numbers of groups and buckets
follow the bytes of the input, whatever the number of shuffle partitions. What a bucket holds is
compared in slices of the hash, a few megabytes at a time: small buckets instead would cost each
group a row per bucket, which grows with the square of the input.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelspark.llm import arrays
from labelspark.llm.common import no_null_text, partitions

DOCS_PER_GROUP = 256
GROUP_BYTES = 1 << 21  # of text in a group, if its documents are long
BUCKET_BYTES = 1 << 24  # of text whose seeds and windows meet in a bucket
FEW_BUCKETS = 1 << 10  # up to so many, there are four per shuffle partition, which evens them out
SLICES = 16  # of a bucket
SLICE_BYTES = 1 << 21  # of windows compared at once, slices permitting
CHUNK_BYTES = 1 << 19  # texts are worked on in pieces of about this size
NO_ID = np.iinfo(np.int64).max  # a null id is larger than any other

_SEEDS = "bucket int, g int, hashes binary, many binary"
_SHARED = "g int, hashes binary"
_STRETCHES = "bucket int, g int, kind int, ids binary, rows binary, starts binary, counts binary, cuts binary, content binary"
_ANSWERS = "g int, rows binary, starts binary, bits binary"


@dataclass(frozen=True)
class Units:
    """What windows are made of: units(data, offsets) → (hashes for the seeds, row bounds in units,
    content(first, count) → bytes of those stretches); compare(ids, counts, content, window) → bits."""

    window: int
    seed: int
    units: Callable
    compare: Callable


def _rows(table: pa.Table) -> list[tuple[int, bytes]]:
    """(id, text) of a group in one order, whatever order it arrives in."""
    ids = table["doc_id"].to_pylist()
    data, offsets = arrays.text_buffer(table["text"])
    raw = data.tobytes()
    return sorted(
        ((NO_ID if i is None else i), raw[a:b]) for i, a, b in zip(ids, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)
    )


def _chunks(rows: list[tuple[int, bytes]]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, ids, data, offsets) of pieces of about CHUNK_BYTES, whole rows only."""
    at = 0
    while at < len(rows):
        upto, size = at, 0
        while upto < len(rows) and (upto == at or size + len(rows[upto][1]) <= CHUNK_BYTES):
            size += len(rows[upto][1])
            upto += 1
        part = rows[at:upto]
        data = np.frombuffer(b"".join(t for _, t in part), np.uint8)
        yield at, np.array([i for i, _ in part], np.int64), data, np.cumsum([0, *(len(t) for _, t in part)])
        at = upto


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """Non-decreasing in h."""
    return ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _cuts(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else []
    for a, b in zip(edges, [*edges[1:], len(bucket)], strict=True):
        yield int(bucket[a]), slice(a, b)


def _joined(column: pa.ChunkedArray, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype)


def _list_seeds(kind: Units, buckets: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        found, owner = [], []
        for _, ids, data, offsets in _chunks(_rows(table)):
            hashes, bounds, _ = kind.units(data, offsets)
            at, h, _, _ = arrays.seeds(hashes, bounds, kind.window, kind.seed)
            found.append(h)
            owner.append(ids[np.searchsorted(bounds, at, "right") - 1])
        h, ids = np.concatenate(found), np.concatenate(owner)
        order = np.lexsort((ids, h))
        h, ids = h[order], ids[order]
        head = np.r_[True, h[1:] != h[:-1]] if len(h) else np.zeros(0, bool)
        heads = np.flatnonzero(head)
        last = np.append(heads[1:], len(h)) - 1 if len(h) else heads
        many, h = ids[heads] != ids[last], h[heads]
        out = [(b, key[0].as_py(), h[s].tobytes(), many[s].tobytes()) for b, s in _cuts(_bucket(h, buckets))]
        return _table(out, _SEEDS)

    return run


def _share_seeds(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Of one bucket: for each group, its hashes that more than one document has."""
    groups, lists = table["g"].to_pylist(), table["hashes"].to_pylist()
    sizes = [len(x) // 8 for x in lists]
    h, many = _joined(table["hashes"], np.uint64), _joined(table["many"], bool)
    _, back, count = np.unique(h, return_inverse=True, return_counts=True)
    weight = np.bincount(back, weights=many)
    shared = ((count > 1) | (weight > 0))[back]
    out, at = [], 0
    for g, n in zip(groups, sizes, strict=True):
        if (own := h[at : at + n][shared[at : at + n]]).size:
            out.append((g, own.tobytes()))
        at += n
    return _table(out, _SHARED)


def _send_stretches(kind: Units, buckets: int):
    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, flagged: pa.Table) -> pa.Table:
        wanted = np.sort(_joined(flagged["hashes"], np.uint64)) if flagged.num_rows else np.zeros(0, np.uint64)
        if not wanted.size:
            return _table([], _STRETCHES)
        seen: dict[tuple[int, bytes], int] = {}
        kept, local = [], []
        for row0, ids, data, offsets in _chunks(_rows(docs)):
            hashes, bounds, content = kind.units(data, offsets)
            at, h, lo, hi = arrays.seeds(hashes, bounds, kind.window, kind.seed)
            place = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
            hit = wanted[place] == h
            at, h, lo, count = at[hit], h[hit], lo[hit], (hi - lo + 1)[hit]
            row = np.searchsorted(bounds, at, "right") - 1
            blob, size = content(lo, count)
            edge = np.cumsum(size) - size
            for i, (hash_, r, a, n, e, z) in enumerate(zip(h.tolist(), row.tolist(), (lo - bounds[row]).tolist(), count.tolist(), edge.tolist(), size.tolist(), strict=True)):
                what = blob[e : e + z]
                first = seen.setdefault((hash_, what), int(ids[r]))
                # Rows come by id, so whoever else in the group has the stretch came first.
                (kept if first == ids[r] else local).append((hash_, int(ids[r]), row0 + r, a, n, what))
        g, out = key[0].as_py(), []
        kept.sort(key=lambda x: x[0])
        fine = _bucket(np.array([x[0] for x in kept], np.uint64), buckets * SLICES)
        for b, s in _cuts(fine // np.uint64(SLICES)):
            part = kept[s]
            out.append((
                b, g, 0, *_packed(part), bytes(x[4] for x in part),
                _slice_sizes(fine[s] % np.uint64(SLICES), [len(x[5]) for x in part]), _deflated(b"".join(x[5] for x in part)),
            ))
        if local:
            full = np.array([(1 << x[4]) - 1 for x in local], np.uint64)
            out.append((g % buckets, g, 1, *_packed(local), b"", b"", full.tobytes()))
        return _table(out, _STRETCHES)

    return run


def _deflated(content: bytes) -> bytes:
    return len(content).to_bytes(8, "little") + pa.compress(content, codec="zstd", asbytes=True)


def _inflated(content: bytes) -> bytes:
    return pa.decompress(content[8:], decompressed_size=int.from_bytes(content[:8], "little"), codec="zstd", asbytes=True)


def _slice_sizes(which: np.ndarray, sizes: list[int]) -> bytes:
    """For each slice of a bucket: its stretches, and the bytes of their windows."""
    which = which.astype(np.int64)
    both = np.bincount(which, minlength=SLICES), np.bincount(which, weights=sizes, minlength=SLICES)
    return np.stack(both, axis=1).astype(np.int32).tobytes()


def _packed(part) -> tuple[bytes, bytes, bytes]:
    return (
        np.array([x[1] for x in part], np.int64).tobytes(), np.array([x[2] for x in part], np.int32).tobytes(),
        np.array([x[3] for x in part], np.int32).tobytes(),
    )


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """(from, to) of neighbouring slices that together have about SLICE_BYTES, at least one."""
    first = 0
    for upto in range(1, len(sizes) + 1):
        if upto == len(sizes) or sizes[first : upto + 1].sum() > SLICE_BYTES:
            if sizes[first:upto].any():
                yield first, upto
            first = upto


def _answer(kind: Units):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        out = [(x["g"], x["rows"], x["starts"], x["content"]) for x in rows if x["kind"]]
        rows = [x for x in rows if not x["kind"]]
        if rows:
            sizes = np.stack([np.frombuffer(x["cuts"], np.int32).reshape(SLICES, 2) for x in rows]).astype(np.int64)
            edges = np.concatenate([np.zeros((len(rows), 1, 2), np.int64), sizes.cumsum(axis=1)], axis=1)
            content = [_inflated(x.pop("content")) for x in rows]
            bits = [np.zeros(len(x["counts"]), np.uint64) for x in rows]
            for a, b in _slices(sizes[:, :, 1].sum(axis=0)):
                parts = [
                    (x, text, own, n, m, i, j)
                    for x, text, own, (n, i), (m, j) in zip(rows, content, bits, edges[:, a].tolist(), edges[:, b].tolist(), strict=True)
                    if m > n
                ]
                ids = np.frombuffer(b"".join(x["ids"][8 * n : 8 * m] for x, _, _, n, m, _, _ in parts), np.int64)
                counts = np.frombuffer(b"".join(x["counts"][n:m] for x, _, _, n, m, _, _ in parts), np.uint8).astype(np.int64)
                found = kind.compare(ids, counts, b"".join(text[i:j] for _, text, _, _, _, i, j in parts), kind.window)
                at = 0
                for _, _, own, n, m, _, _ in parts:
                    own[n:m] = found[at : (at := at + m - n)]
            for x, own in zip(rows, bits, strict=True):
                if (hit := own != 0).any():
                    out.append((
                        x["g"], np.frombuffer(x["rows"], np.int32)[hit].tobytes(),
                        np.frombuffer(x["starts"], np.int32)[hit].tobytes(), own[hit].tobytes(),
                    ))
        return _table(out, _ANSWERS)

    return run


def _mark(kind: Units, finish: Callable, schema: str):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        rows = _rows(docs)
        own, start, bits = (_joined(answers[c], t) for c, t in (("rows", np.int32), ("starts", np.int32), ("bits", np.uint64)))
        order = np.argsort(own, kind="stable")
        own, start, bits = own[order], start[order], bits[order]
        bound, out = np.searchsorted(own, np.arange(len(rows) + 1)), []
        for r, (i, text) in enumerate(rows):
            s, b = start[bound[r] : bound[r + 1]], bits[bound[r] : bound[r + 1]]
            out.append((None if i == NO_ID else i, *finish(text, _spans(s, b, kind.window))))
        return _table(out, schema)

    return run


def _spans(start: np.ndarray, bits: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Maximal runs covered by the windows whose bits are set."""
    if not len(start):
        return []
    on = np.unpackbits(bits.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
    which, place = np.nonzero(on)
    at = np.sort(start[which].astype(np.int64) + place)
    new = np.flatnonzero(np.r_[True, at[1:] > at[:-1] + window])
    return list(zip(at[new].tolist(), (at[np.append(new[1:], len(at)) - 1] + window).tolist(), strict=True))


_ARROW = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(),
          "array<struct<start:int,end:int>>": pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))}


def _table(rows: list[tuple], ddl: str) -> pa.Table:
    fields = [x.strip().split(" ", 1) for x in re.split(", (?=[a-z_]+ )", ddl)]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.table({n: pa.array(c, _ARROW[t]) for (n, t), c in zip(fields, columns, strict=True)})


def _dealt_into(docs: DataFrame, text_col: str) -> tuple[int, int]:
    """Numbers of groups and buckets: by bytes of text, and of documents."""
    n, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()
    groups = max(n // DOCS_PER_GROUP, size // GROUP_BYTES) + 1
    parts = partitions(docs.sparkSession)
    return groups, max(size // BUCKET_BYTES + 1, parts, min(4 * parts, FEW_BUCKETS))


def remove_repeats(docs: DataFrame, kind: Units, finish: Callable, schema: str, id_col: str, text_col: str) -> DataFrame:
    """Rows of finish(text bytes, removed spans in units) for every document, after its doc_id."""
    groups, buckets = _dealt_into(docs, text_col)
    dealt = docs.select(
        F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(groups)).cast("int").alias("g"), F.col(id_col).cast("long").alias("doc_id"),
        no_null_text(text_col).alias("text"),
    )
    seeds = dealt.groupBy("g").applyInArrow(_list_seeds(kind, buckets), _SEEDS)
    shared = seeds.groupBy("bucket").applyInArrow(_share_seeds, _SHARED)
    stretches = dealt.groupBy("g").cogroup(shared.groupBy("g")).applyInArrow(_send_stretches(kind, buckets), _STRETCHES)
    answers = stretches.groupBy("bucket").applyInArrow(_answer(kind), _ANSWERS)
    schema = f"doc_id long, {schema}"
    return dealt.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(_mark(kind, finish, schema), schema)

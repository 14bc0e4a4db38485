"""Suffix-array dedup: bytes that an earlier document already holds, by longest previous factors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from labelspark.llm import arrays, repeats

WINDOW = 50
SEED = 20


def _units(data: np.ndarray, offsets: np.ndarray):
    def content(first: np.ndarray, count: np.ndarray) -> tuple[bytes, np.ndarray]:
        size = count + WINDOW - 1
        return data[arrays.ranges(first, size)].tobytes(), size

    return arrays.byte_hashes(data), offsets, content


def suffix_order(suffix: np.ndarray, ids: np.ndarray, data: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): suffixes in suffix order, equal prefixes of `window` bytes by id, and whether
    each shares its `window` bytes with the suffix before it.

    The order is by the first eight bytes, then by a hash of the window: all that longest previous
    factors of `window` bytes need is that suffixes with equal windows are neighbours. The bytes of
    neighbours are compared; if a hash misleads, the order is made from the bytes alone.
    """
    eight = np.zeros(len(data) + 8, np.uint64)
    padded = np.concatenate([data, np.zeros(16, np.uint8)]).astype(np.uint64)
    for i in range(8):
        eight = (eight << np.uint64(8)) | padded[i : i + len(eight)]
    places = [*range(0, window - 8, 8), window - 8]
    hashes = arrays.byte_hashes(data).spans(suffix, suffix + window)
    first = eight[suffix]
    order = np.lexsort((ids, hashes, first))

    def shared(order):
        at = suffix[order]
        same = np.zeros(len(at), bool)
        same[1:] = True
        for p in places:
            value = eight[at + p]
            same[1:] &= value[1:] == value[:-1]
        return same

    lcp = shared(order)
    near = (hashes[order][1:] == hashes[order][:-1]) & (first[order][1:] == first[order][:-1])
    if (near & ~lcp[1:]).any():
        order = np.lexsort((ids, *(eight[suffix + p] for p in reversed(places))))
        lcp = shared(order)
    return order, lcp


def _compare(ids: np.ndarray, counts: np.ndarray, content: bytes, window: int) -> np.ndarray:
    """One bit per window: whether a smaller id holds the same bytes.

    The previous smaller value in suffix order, over suffixes that share the window, is the head of
    their run, since a run is ordered by id; the next smaller one never lies in the run. So the
    longest previous factor reaches the window exactly if the head's id is smaller.
    """
    data = np.frombuffer(content, np.uint8)
    size = counts + window - 1
    suffix = arrays.ranges(np.cumsum(size) - size, counts)
    owner = np.repeat(ids, counts)
    order, lcp = suffix_order(suffix, owner, data, window)
    head = np.maximum.accumulate(np.where(lcp, 0, np.arange(len(order))))
    later = np.zeros(len(order), bool)
    later[order] = owner[order] > owner[order][head]
    offset = arrays.ranges(np.zeros_like(counts), counts).astype(np.uint64)
    return np.add.reduceat(later.astype(np.uint64) << offset, np.cumsum(counts) - counts)


def _finish(text: bytes, spans: list[tuple[int, int]]):
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at:a])
        at = b
    kept.append(text[at:])
    return len(text), [{"start": a, "end": b} for a, b in spans], b"".join(kept)


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_bytes, spans (removed, in bytes), kept (remaining bytes).

    A byte goes if it lies in a string of 50 bytes that also starts in a document with a smaller id;
    strings are judged on the input and never cross documents. A null text is empty; a null id is
    larger than any other id and equal to other null ids. Rows repeated under one id never remove
    each other's bytes. Texts shorter than 50 bytes stay whole. `kept` may end inside a character.
    An empty table gives an empty result; other columns are not read.
    """
    kind = repeats.Units(WINDOW, SEED, _units, _compare)
    return repeats.remove_repeats(
        docs, kind, _finish, "n_bytes long, spans array<struct<start:int,end:int>>, kept binary", id_col, text_col
    )

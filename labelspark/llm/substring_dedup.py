"""Substring dedup by seed and extend, on words."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from labelspark.llm import arrays, repeats

WINDOW = 50
SEED = 25


def _units(data: np.ndarray, offsets: np.ndarray):
    start, end, bounds = arrays.word_spans(data, offsets)
    streams = [arrays.Hashes(arrays.word_values(data, start, end, s), s) for s in (0, 1)]

    def content(first: np.ndarray, count: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Every window through the seed, as 128 bits: the seed extended by each split of the missing
        words between left and right."""
        at = arrays.ranges(first, count)
        pairs = np.stack([h.spans(at, at + WINDOW) for h in streams], axis=1)
        return pairs.tobytes(), count * 16

    return streams[0], bounds, content


def _compare(ids: np.ndarray, counts: np.ndarray, content: bytes, window: int) -> np.ndarray:
    """One bit per window: whether a smaller id has the same words there."""
    pairs = np.frombuffer(content, np.uint64).reshape(-1, 2)
    owner = np.repeat(ids, counts)
    order = np.lexsort((owner, pairs[:, 1], pairs[:, 0]))
    by = pairs[order]
    new = np.r_[True, (by[1:] != by[:-1]).any(axis=1)]
    head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    later = np.zeros(len(order), bool)
    later[order] = owner[order] > owner[order][head]
    offset = arrays.ranges(np.zeros_like(counts), counts).astype(np.uint64)
    return np.add.reduceat(later.astype(np.uint64) << offset, np.cumsum(counts) - counts)


def _finish(text: bytes, spans: list[tuple[int, int]]):
    words = [w for w in text.translate(_BLANKS).split(b" ") if w]
    kept, at = [], 0
    for a, b in spans:
        kept += words[at:a]
        at = b
    kept += words[at:]
    return len(words), [{"start": a, "end": b} for a, b in spans], b" ".join(kept).decode()


_BLANKS = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, spans (removed, in words), kept (the other words,
    joined by one blank).

    A seed is a winnowed run of 25 words; documents meet on equal seeds and each match is extended
    both ways, by up to 25 words, to every window of 50 words through the seed. Extensions of
    neighbouring seeds join into maximal repeats, so a repeat of 50 or more words is found in full.
    A word goes if such a window also starts in a document with a smaller id; windows are judged on
    the input and compared by 128 bits. Words are runs without the six ASCII white-space characters,
    unchanged. A null text has no words; a null id is larger than any other and equal to other null
    ids. Rows repeated under one id never remove each other's words. Shorter texts stay whole. An
    empty table gives an empty result; other columns are not read.
    """
    kind = repeats.Units(WINDOW, SEED, _units, _compare)
    return repeats.remove_repeats(
        docs, kind, _finish, "n_words long, spans array<struct<start:int,end:int>>, kept string", id_col, text_col
    )

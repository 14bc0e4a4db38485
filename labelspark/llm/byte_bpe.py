"""Byte-level BPE: texts to token ids and back, with the ranks of a public vocabulary."""

from __future__ import annotations

import array
import base64
import functools
import heapq
import json
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelspark.llm import arrays
from labelspark.llm.common import no_null_text

BUCKETS = 1 << 14  # of the literal rank map: a Spark map is searched entry by entry, so each is kept small
PLACES = 1 << 20  # a rank and a place in a word as one number
LONG_BYTES = 256  # a step of the fold looks at the whole word; longer words are merged with a heap
BLOCK_CHUNKS = 600_000  # a block of documents ends at so many different chunks
BLOCK_CODES = 16_000_000  # or at so many chunks in all
LONG_CHARS = 1 << 20  # chunks of longer texts are not listed all at once
#: White space and what follows it: no match of the tokenizers' pattern goes beyond.
CHUNK = r"[^\S\x1c-\x1f]*+[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+"  # Python's white space and that of Unicode differ in \x1c to \x1f
SLICE_CODES = 150_000  # chunks turned into ids at a time; numpy holds some 30 bytes for each id


@functools.lru_cache(4)
def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their rank from a file of lines `base64 rank`; every single byte must have one."""
    with open(path, "rb") as lines:
        found = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    if any(bytes([b]) not in found for b in range(256)):
        raise ValueError(f"{path} lacks single bytes")
    return found


def _char(rank: int) -> str:
    """One character for each rank, in the order of ranks; none is a surrogate."""
    return chr(rank + 256 if rank < 0xD700 else rank + 0x900)


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ranks of a word's pieces: neighbours of least rank, the first of equals, are joined until no two
    have a rank. A heap of pairs, of which those that no longer exist are passed over."""
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the piece that starts at a place
    heap: list[tuple[int, int, int]] = []

    def offer(a: int) -> None:
        if a >= 0 and end[a] < n and (rank := ranks.get(word[a : end[end[a]]])) is not None:
            heapq.heappush(heap, (rank, a, end[end[a]]))

    for a in range(n - 1):
        offer(a)
    while heap:
        _, a, z = heapq.heappop(heap)
        b = end[a]
        if b <= a or b >= n or end[b] != z:
            continue
        end[a], end[b] = z, 0
        if z < n:
            before[z] = a
        offer(before[a])
        offer(a)
    out, a = [], 0
    while a < n:
        out.append(ranks[word[a : end[a]]])
        a = end[a]
    return out


def word_ids(ranks: dict[bytes, int]):
    """Column function: a word given as one _char for each byte's rank → one _char for each piece's rank.

    A fold: each step joins the two neighbours of least rank, the first of equals, into one character.
    Which pairs have a rank is a literal of small maps."""
    pairs: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for piece, rank in ranks.items():
        for cut in range(1, len(piece)):
            if (a := ranks.get(piece[:cut])) is not None and (b := ranks.get(piece[cut:])) is not None:
                key = _char(a) + _char(b)
                pairs[xxhash.xxh64_intdigest(key.encode(), 42) % BUCKETS][key] = rank * PLACES  # the seed of xxhash64
    pair_map = F.from_json(F.lit(json.dumps(pairs)), "array<map<string,bigint>>")
    chars = F.from_json(F.lit(json.dumps([_char(r) for r in range(max(ranks.values()) + 1)])), "array<string>")

    def least(pieces: Column) -> Column:
        """Rank and place of the pair to join; null if there is none."""
        def rank(at: Column) -> Column:
            pair = F.substring(pieces, at, F.lit(2))
            return F.try_element_at(F.get(pair_map, F.xxhash64(pair).bitwiseAND(BUCKETS - 1).cast("int")), pair) + at

        return F.array_min(F.transform(F.sequence(F.lit(1), F.length(pieces) - 1), rank))

    def step(acc: Column, _: Column) -> Column:
        pieces, pair = acc["pieces"], acc["pair"]
        then = F.when(pair < 0, pieces).otherwise(
            F.overlay(pieces, F.get(chars, F.shiftright(pair, 20).cast("int")), pair.bitwiseAND(PLACES - 1).cast("int"), F.lit(2))
        )
        joined = F.get(F.transform(F.array(then), lambda p: F.struct(p.alias("pieces"), least(p).alias("pair"))), F.lit(0))
        return F.when(pair.isNull(), acc).otherwise(joined)

    def fold(word: Column) -> Column:
        start = F.struct(word.alias("pieces"), F.lit(-1).cast("long").alias("pair"))
        return F.aggregate(F.sequence(F.lit(1), F.length(word)), start, step, lambda acc: acc["pieces"])

    return fold


def _as_ranks(chars: str) -> np.ndarray:
    points = np.frombuffer(chars.encode("utf-32-le"), np.uint32).astype(np.int32)
    return points - np.where(points < 0xD800, 256, 0x900).astype(np.int32)


_BLOCK = "count array<int>, codes binary, words_in binary, word_codes binary, known_codes array<int>, known array<array<int>>, words array<string>"


def _blocks(pattern: str, chunk: str, ranks: dict[bytes, int], other: dict[str, int]):
    """Documents to blocks that share their different words: per block the documents' chunks as codes,
    the chunks' words as codes, and the words; those too long for the fold, or with a rank that no
    merge leads to (`other`), come with their ranks."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, cut = regex.compile(pattern), re.compile(chunk)
        first = np.array([ord(_char(ranks[bytes([b])])) for b in range(256)], np.uint32)

        def one_cell(numbers: array.array) -> pa.Array:
            """The numbers' own memory as one binary cell."""
            ends = pa.py_buffer(np.array([0, numbers.itemsize * len(numbers)], np.int32))
            return pa.Array.from_buffers(pa.binary(), 1, [None, ends, pa.py_buffer(numbers)])

        def numbered() -> defaultdict:
            found = defaultdict()
            found.default_factory = found.__len__
            return found

        chunks, ids, count, codes = numbered(), [], [], array.array("i")

        def block() -> pa.RecordBatch:
            words, in_chunk, flat = numbered(), array.array("i"), array.array("i")
            for c in chunks:
                found = find.findall(c)
                in_chunk.append(len(found))
                flat.extend(map(words.__getitem__, found))
            chunks.clear()
            data, ends = arrays.text_buffer(pa.array(list(words), pa.large_string()))
            length = np.diff(ends)
            known = {code: merged(data[ends[code] : ends[code + 1]].tobytes(), ranks) for code in np.flatnonzero(length > LONG_BYTES).tolist()}
            known |= {words[word]: [rank] for word, rank in other.items() if word in words}
            words.clear()
            # Each byte as the character of its rank; nothing of the words whose ranks are known.
            length[list(known)] = 0
            points = first[data[arrays.ranges(ends[:-1], length)]]
            width = np.concatenate([[0], np.cumsum(1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000))])
            at = width[np.concatenate([[0], np.cumsum(length)])]
            folded = pa.LargeStringArray.from_buffers(len(length), pa.py_buffer(at), pa.py_buffer(points.tobytes().decode("utf-32-le").encode()))
            plain = pa.LargeListArray.from_arrays(pa.array([0, len(folded)], pa.int64()), folded).cast(pa.list_(pa.string()))
            cells = [list(known), list(known.values())]
            kinds = [pa.list_(pa.int32()), pa.list_(pa.list_(pa.int32()))]
            doc_ids = pa.array([pa.concat_arrays(ids).to_pylist()], pa.list_(ids[0].type))
            return pa.RecordBatch.from_arrays(
                [doc_ids, pa.array([count], pa.list_(pa.int32())), *map(one_cell, (codes, in_chunk, flat)), *(pa.array([x], t) for x, t in zip(cells, kinds, strict=True)), plain],
                names=["doc_id", "count", "codes", "words_in", "word_codes", "known_codes", "known", "words"],
            )

        for batch in rows:
            texts = batch.column("text")
            at = 0
            for k, cell in enumerate(texts):
                text = cell.as_py()
                before = len(codes)
                codes.extend(chunks[m.group()] for m in cut.finditer(text)) if len(text) > LONG_CHARS else codes.extend(map(chunks.__getitem__, cut.findall(text)))
                count.append(len(codes) - before)
                if len(chunks) >= BLOCK_CHUNKS or len(codes) >= BLOCK_CODES:
                    ids.append(batch.column("doc_id").slice(at, k + 1 - at))
                    at = k + 1
                    yield block()
                    chunks, ids, count, codes = numbered(), [], [], array.array("i")
            if at < len(texts):
                # Copied, so that the texts of a batch are not kept for its ids.
                ids.append(pa.array(batch.column("doc_id").slice(at).to_pylist(), batch.column("doc_id").type))
            texts = cell = text = batch = None
        if ids:
            yield block()

    return batches


def _assembled(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with folded words to documents with their ids."""
    for batch in rows:
        for row in range(batch.num_rows):
            cell = {name: batch.column(name)[row] for name in batch.schema.names}
            binary = {name: np.frombuffer(cell[name].as_buffer(), np.int32) for name in ("codes", "words_in", "word_codes")}
            pieces = cell["words"].values
            length = pc.utf8_length(pieces).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = _as_ranks(arrays.text_buffer(pieces)[0].tobytes().decode())
            start = np.cumsum(length) - length
            known = cell["known"].as_py()
            if known:
                places, sizes = cell["known_codes"].values.to_numpy(), np.array([len(x) for x in known])
                start[places], length[places] = len(flat) + np.cumsum(sizes) - sizes, sizes
                flat = np.concatenate([flat, np.concatenate([np.array(x, np.int32) for x in known])])
            # Ids of each chunk in a row, then of each document.
            words = binary["word_codes"]
            flat = flat[arrays.ranges(start[words], length[words])]
            upto = np.concatenate([[0], np.cumsum(length[words])])
            edge = np.concatenate([[0], np.cumsum(binary["words_in"])])
            start = upto[edge[:-1]]
            length = upto[edge[1:]] - start
            count = cell["count"].values.to_numpy().astype(np.int64)
            ends = np.cumsum(count)
            low = 0
            while low < len(count):
                high = max(low + 1, int(np.searchsorted(ends, ends[low] - count[low] + SLICE_CODES, "right")))
                codes = binary["codes"][ends[low] - count[low] : ends[high - 1]]
                ids = flat[arrays.ranges(start[codes], length[codes])].astype("<i4")
                tokens = np.concatenate([[0], np.cumsum(length[codes])])
                offsets = tokens[np.concatenate([[0], ends[low:high] - (ends[low] - count[low])])]
                # The same bytes as a binary cell for each document.
                shard = pa.LargeBinaryArray.from_buffers(pa.large_binary(), high - low, [None, pa.py_buffer(4 * offsets), pa.py_buffer(ids)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [cell["doc_id"].values.slice(low, high - low), pa.array(np.diff(offsets)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32())), shard],
                    names=["doc_id", "n_tokens", "ids", "shard"],
                )
                low = high


def encode(
    docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", pattern: str = public_tokenizers.PATTERN, chunk: str = CHUNK,
) -> DataFrame:
    """One row per row of `docs`: doc_id, n_tokens, ids (array<int>) and shard (the ids as unsigned
    32-bit integers, lowest byte first, as token files hold them), by the ranks in the file `ranks_path`, which the driver reads; each match of `pattern` is encoded separately and what it
    leaves out is dropped. No special tokens.

    Documents become blocks that share their different words, and each word of a block is folded once;
    nothing is shuffled. A match of `pattern` must lie within one match of `chunk`, whatever stands
    around it (the default holds for patterns in which white space only begins a match). A null or
    empty text has no tokens. Rows repeated under one id give a row each; a null id stays null. Texts
    are encoded whole; a document's ids must fit into 2 GB. Words over LONG_BYTES bytes are merged with
    a heap, to the same ids. Other columns are not read. An empty table gives an empty result.
    """
    ranks = read_ranks(ranks_path)
    unled = {piece: rank for piece, rank in ranks.items() if len(piece) > 1 and merged(piece, ranks) != [rank]}
    # A word is whole characters, so tokens of parts of some are none.
    other = {word: rank for piece, rank in unled.items() if (word := piece.decode(errors="ignore")).encode() == piece}
    rows = docs.select(F.col(id_col).alias("doc_id"), no_null_text(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    blocks = rows.mapInArrow(_blocks(pattern, chunk, ranks, other), f"doc_id array<{kind}>, {_BLOCK}")
    return blocks.withColumn("words", F.transform("words", word_ids(ranks))).mapInArrow(_assembled, f"doc_id {kind}, n_tokens long, ids array<int>, shard binary")


def decode(ids: Column | str, ranks_path: str) -> Column:
    """Bytes of the tokens, one after the other: binary. Null if ids are null; an id without a token
    adds nothing."""
    ranks = read_ranks(ranks_path)
    pieces: list[str | None] = [None] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece.decode("latin-1")
    of_id = F.from_json(F.lit(json.dumps(pieces)), "array<string>")
    return F.encode(F.array_join(F.transform(ids, lambda i: F.get(of_id, i)), ""), "ISO-8859-1")

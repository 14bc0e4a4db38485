"""Fill-in-the-middle against a plain loop; byte-level BPE against the tokenizers' own library."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import tracemalloc

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from labelspark.llm import byte_bpe, fill_in_middle

DDL = "doc_id long, text string, n long, output string, ids array<int>, draws string"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def texts():
    rng = random.Random(11)
    out = ["", None, "\n", "a", "a\n", "\n\n\nb", "x<P>y\nz\n", "<M>", "<S\n>", "<\nP>\n<", "é\nü\n日本\n x\r\ny", "line\n" * 40_000, "w" * 300_000]
    out += ["".join(rng.choice(["a", "\n", "<", "P>", "ß", " "]) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    return [(i, t, 1, "x", None, "y") for i, t in enumerate(out)] + [(3, "a", 1, "x", None, "y"), (None, "p\nq\n", 1, None, None, None)]


def plain_fim(i, text, unit=re.compile(r"[^\n]*\n|[^\n]+"), seed=7, fim=100, spm=50):
    text = text or ""
    lines = unit.findall(text)
    h = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(lines)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= fim:
        return i, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (lines[:a], lines[a:b], lines[b:]))
    if h[3] % 100 < spm:
        return i, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return i, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(spark):
    rows = texts()
    docs = spark.createDataFrame(rows, DDL).repartition(3)
    got = fill_in_middle.fill_in_middle(docs).withColumn("restored", fill_in_middle.restore()).collect()
    key = lambda r: (str(r[0]), r[2])
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted((plain_fim(r[0], r[1]) for r in rows), key=key)
    assert all(r.restored == dict((a, b or "") for a, b, *_ in rows)[r.doc_id] for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_fill_in_middle_parameters(spark):
    rows = texts()
    docs = spark.createDataFrame(rows, DDL)
    half = fill_in_middle.fill_in_middle(docs, seed=3, fim_percent=40, spm_percent=0, unit=r"(?s:.)").collect()
    want = {(r[0], r[1] or ""): plain_fim(r[0], r[1], re.compile(r"(?s:.)"), 3, 40, 0) for r in rows}
    assert all(tuple(r) in want.values() for r in half) and {r.form for r in half} == {"plain", "psm"}
    # A unit that does not cover a text leaves it as it is; one tried left to right is not tried again.
    few = spark.createDataFrame([(1, "aab", 0, "", None, ""), (2, "aa", 0, "", None, "")], DDL)
    assert {r.doc_id: (r.n, r.form) for r in fill_in_middle.fill_in_middle(few, unit="aa|aab").collect()}[1] == (None, "plain")
    for marks in (("<P>", "<P>x", "<M>"), ("aba", "<S>", "<M>"), ("<P", "P<", "<M>"), ("", "<S>", "<M>")):
        with pytest.raises(ValueError, match="run into"):
            fill_in_middle.fill_in_middle(docs, marks=marks)
    assert fill_in_middle.fill_in_middle(docs.limit(0)).count() == 0


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


def test_bpe_is_the_librarys(spark, sf_dir, library):
    rng = random.Random(3)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    odd = [None, "", " ", "\n", "  x  \n\n y\t z ", "it's 'twas we'll I'd''s 's", "don't’s", "日本語のテキスト。" * 50, "=" * 3000, " " * 2000 + "a", "ab" * 5000]
    odd += ["<|endoftext|>", " x y\u0085z\x1cq", "a\x00b", "🙂👩‍👩‍👧 ok", "".join(rng.choice("abcdefgh") for _ in range(20_000)), "1234567890" * 40]
    odd += ["".join(rng.choice(["a", "é", " ", "\n", "'s", "7", "—", "日", "\t", "."]) for _ in range(rng.randint(1, 90))) for _ in range(80)]
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    odd += ["x".join(map(chr, points[k : k + 4000])) for k in range(0, len(points), 50_000)]
    rows += [(10_000 + k, t) for k, t in enumerate(odd)]
    rows += [rows[0], (None, "no id")]
    docs = spark.createDataFrame([(i, t, 0, None, None, None) for i, t in rows], DDL).repartition(3)
    got = byte_bpe.encode(docs, RANKS).withColumn("bytes", byte_bpe.decode("ids", RANKS)).collect()
    want = {i: library.encode_ordinary(t or "") for i, t in rows}
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
    text = dict(rows)
    for r in got:
        assert r.ids == want[r.doc_id] and r.n_tokens == len(r.ids), text[r.doc_id]
        assert bytes(r.bytes) == (text[r.doc_id] or "").encode()
        assert bytes(r.shard) == b"".join(i.to_bytes(4, "little") for i in r.ids)
    assert byte_bpe.encode(docs.limit(0), RANKS).count() == 0


def test_bpe_small_blocks_and_short_heap(spark, library, monkeypatch):
    rows = [(i, f"word{i} and{i % 7} thewordandtheother {'xy' * i}", 0, None, None, None) for i in range(200)]
    for name, value in (("BLOCK_CHUNKS", 50), ("SLICE_CODES", 3), ("LONG_BYTES", 8), ("LONG_CHARS", 20)):
        monkeypatch.setattr(byte_bpe, name, value)
    blocks = byte_bpe._blocks(public_tokenizers.PATTERN, byte_bpe.CHUNK, byte_bpe.read_ranks(RANKS), {})
    batch = pa.RecordBatch.from_pydict({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]})
    made = list(blocks(iter([batch])))
    assert len(made) > 5 and [x for b in made for x in b.column("doc_id").to_pylist()[0]] == [r[0] for r in rows]
    words = sorted({w for b in made for w in b.column("words").to_pylist()[0]})
    f = byte_bpe.word_ids(byte_bpe.read_ranks(RANKS))
    folded = spark.createDataFrame([(words,)], "w array<string>").select(F.transform("w", f).alias("x")).first().x
    fold = dict(zip(words, folded, strict=True))
    replaced = [b.set_column(b.schema.get_field_index("words"), "words", pa.array([[fold[w] for w in b.column("words").to_pylist()[0]]])) for b in made]
    got = {i: ids for b in byte_bpe._assembled(iter(replaced)) for i, ids in zip(b.column("doc_id").to_pylist(), b.column("ids").to_pylist(), strict=True)}
    assert got == {r[0]: library.encode_ordinary(r[1]) for r in rows}


def test_bpe_ids_are_made_in_slices():
    """A large block's ids are not all in memory at a time."""
    text = "a b " * 10_000
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(100)), "text": [text] * 100})
    made = list(byte_bpe._blocks(public_tokenizers.PATTERN, byte_bpe.CHUNK, byte_bpe.read_ranks(RANKS), {})(iter([batch])))
    tracemalloc.start()
    tokens = sum(sum(b.column("n_tokens").to_pylist()) for b in byte_bpe._assembled(iter(made)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert tokens == 100 * len(text) and peak < 50_000_000


def test_bpe_rank_without_merges(spark, tmp_path):
    """A vocabulary whose token `abc` no merge leads to: a word that is a token keeps its rank."""
    tokens = [bytes([b]) for b in range(256)] + [b"abc", b"ca"]
    (tmp_path / "ranks").write_text("\n".join(f"{base64.b64encode(t).decode()} {i}" for i, t in enumerate(tokens)))
    ranks = byte_bpe.read_ranks(str(tmp_path / "ranks"))
    library = tiktoken.Encoding("odd", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [(0, "abc abc xabc\ncaca", 0, None, None, None), (1, "abcabc!abc", 0, None, None, None)]
    got = {r.doc_id: r.ids for r in byte_bpe.encode(spark.createDataFrame(rows, DDL), str(tmp_path / "ranks")).collect()}
    assert got == {r[0]: library.encode_ordinary(r[1]) for r in rows}

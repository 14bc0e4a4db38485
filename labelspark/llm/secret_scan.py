"""Secret scans: fixed patterns, and an assignment-aware lexer for source and configuration text."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelspark.llm.common import no_null_text

# Fixed patterns of the base spans.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "lexed", "propagated")

ASSIGN_CHARS = 6
SCORE = 1.0  # least score of a literal
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
# Weight of a word of the target's name.
_WORDS = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 1.0, "pass": 0.7, "secret": 1.0, "secrets": 1.0, "token": 0.9,
    "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "auth": 0.5, "bearer": 0.7, "private": 0.5, "access": 0.4, "api": 0.4,
    "client": 0.2, "key": 0.5, "signing": 0.4, "encryption": 0.4,
}
_HARMLESS = frozenset(
    "name file path url uri id count length size type expiry expires ttl field label hint prompt policy rotation header column".split()
)
_PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|changeme|change_me|example|none|null|nil|true|false|todo|test|secret|password|your.*|<.*>|\$\{.*\}|\{\{.*\}\}|%\(.*\)s|\$\w+)$")
_NAME = r"[A-Za-z_$][\w$]*(?:[.\-][A-Za-z_$][\w$]*)*(?:\[['\"][\w.\-]+['\"]\])?"
#: A target, an assignment sign and a quoted literal, an identifier, or what begins the rest of a configuration line.
_LEX = re.compile(
    rf"""(?<![\w$.\-])(?:(?P<q>["'])(?P<key>[\w.\-]++)(?P=q)|(?P<name>{_NAME}))[ \t]*(?::=|=>|=(?!=)|:(?![:/]))[ \t]*"""
    r"""(?:(?P<lq>["'`])(?P<lit>[^"'`\r\n]++)(?P=lq)|(?P<ref>[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*)(?=[ \t]*(?:[;,)\]}\r\n]|$|\#|//))|(?P<bare>[^\s"'`;,]{6}))""",
    re.ASCII,
)
#: Where the rest of a configuration line ends, and what must follow there.
_STOP = re.compile(r"""[\s"'`;,]|\Z""", re.ASCII)
_LINE_END = re.compile(r"[ \t]*(?:\r|\n|\Z)")
_SPLIT = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


def name_score(name: str) -> float:
    """How much a target's name speaks of a secret: the weights of its words, none for a name such as
    token_count that ends in a harmless word."""
    words = [w.lower() for w in _SPLIT.findall(name)]
    if not words or words[-1] in _HARMLESS:
        return 0.0
    whole = "".join(words)
    return max(sum(_WORDS.get(w, 0.0) for w in words), 1.0 if "apikey" in whole or "password" in whole or "secret" in whole else 0.0)


def literal_score(value: str) -> float:
    """How much a literal looks like a secret: 0 for placeholders, words and short strings, up to 1."""
    if len(value) < ASSIGN_CHARS or _PLACEHOLDER.match(value) or " " in value:
        return 0.0
    counts = Counter(value)
    bits = -sum(c / len(value) * math.log2(c / len(value)) for c in counts.values())
    kinds = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", r"[^A-Za-z0-9]"))
    return min(1.0, bits / 4 * (0.5 + 0.25 * kinds))


def _lexed(text: str) -> list[tuple[int, int, str]]:
    """Spans of literals that a sensitive name gets, at once or through other names."""
    pairs = []  # (target, literal span or None, name it refers to)
    at, stop, whole = 0, -1, False
    while m := _LEX.search(text, at):
        target, at = m["key"] or m["name"], m.end()
        if m["bare"] is not None:
            # Looked for once per stretch, however many signs it holds, so that a long one stays linear.
            if stop < at:
                stop = _STOP.search(text, at).start()
                whole = _LINE_END.match(text, stop) is not None
            if not whole:
                at = m.start() + 1
                continue
            at = stop
            pairs.append((target, (m.start("bare"), stop), None))
        else:
            pairs.append((target, m.span("lit") if m["lit"] is not None else None, m["ref"]))
    known: dict[str, tuple[int, int]] = {}
    score: dict[tuple[int, int], float] = {}  # a literal that many names refer to is looked at once
    out = []
    for target, span, ref in pairs:
        through = span is None
        if through:
            span = known.get(ref) or known.get(ref.rsplit(".", 1)[-1])
        # A name keeps the literal it was last given; a reference passes it on.
        short = target.rsplit(".", 1)[-1]
        if span is None:
            known.pop(short, None)
            continue
        known[short] = known[target] = span
        if span not in score:
            score[span] = literal_score(text[span[0] : span[1]])
        if name_score(target) + score[span] >= SCORE + 0.5 and score[span] >= 0.4 and name_score(target) >= 0.7:
            out.append((*span, "propagated" if through else "lexed"))
    return out


def scan(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, all spans) as (start, end, kind), by start, then kind; code points."""
    low = text.lower()
    base = []
    if any(k in low for k in _KEYWORDS):
        base += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
    if "AKIA" in text:
        base += [(*m.span(), "access") for m in ACCESS.finditer(text)]
    base += [(*m.span(), "hex") for m in HEX.finditer(text)]
    order = lambda x: (x[0], KINDS.index(x[2]), x[1])
    base.sort(key=order)
    if "=" not in text and ":" not in text:
        return base, base
    return base, sorted({*base, *_lexed(text)}, key=order)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())])
    for batch in batches:
        found = [scan(t) for t in batch.column("text").to_pylist()]
        as_rows = lambda spans: [{"start": a, "end": b, "kind": k} for a, b, k in spans]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), pa.array([as_rows(b) for b, _ in found], pa.list_(span)),
                pa.array([as_rows(s) for _, s in found], pa.list_(span)),
            ],
            names=["doc_id", "base", "spans"],
        )


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, base and spans, arrays of (start, end, kind) in code points,
    by start, then kind (assign, access, hex, lexed, propagated).

    Base spans are the fixed patterns, whatever stands around them. The lexer reads name-literal pairs
    from source and configuration text (name = "x", "name": "x", name: x at the end of a line, name
    := x, name => x), carries literals over names that are assigned to other names, and reports a
    literal when the target's name is sensitive and the literal looks like no word or placeholder. A
    literal reported through another name is `propagated`; one literal is reported once per kind.

    A null or empty text has no spans; rows repeated under one id give a row each; a null id stays
    null. Texts are scanned whole, literals of any length. An empty table gives an empty result; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), no_null_text(text_col).alias("text"))
    spans = "array<struct<start:int,end:int,kind:string>>"
    return rows.mapInArrow(_scan, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, base {spans}, spans {spans}")

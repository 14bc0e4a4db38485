"""Fill-in-the-middle: documents cut into prefix, middle and suffix at unit ends, and put in another order."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelspark.llm.common import no_null_text

LINE = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def unit_pattern(unit: str) -> regex.Pattern:
    """Matches a text that is nothing but units, and keeps every one of them: units are taken left to
    right and none is tried again, so a text of any length is matched in one pass."""
    return regex.compile(f"((?>{unit}))*+")


def _checked(marks: tuple[str, ...]) -> None:
    """The marks must be found again in an output whose parts hold none of them."""
    for a, b in itertools.product(marks, repeat=2):
        if not a or any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b)) + (a != b))) or (a != b and a in b):
            raise ValueError(f"marks {a!r} and {b!r} can run into each other")


def _draws(id_col: str, seed: int) -> Column:
    """Four unsigned 32-bit numbers from the document's id; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)])


def _cut(unit: str, marks: tuple[str, ...], fim: int, spm: int):
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = unit_pattern(unit)
        for batch in rows:
            texts = batch.column("text").to_pylist()
            draws = batch.column("draws").flatten().to_numpy().reshape(-1, 4)
            out = [_arranged(units, t, d, marks, fim, spm) for t, d in zip(texts, draws.tolist(), strict=True)]
            n, form, prefix, middle, output = zip(*out, strict=True) if out else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    return batches


def _arranged(units: regex.Pattern, text: str, draws: list[int], marks: tuple[str, ...], fim: int, spm: int) -> tuple:
    match = units.fullmatch(text)
    if match is None:
        return None, "plain", None, None, text
    ends = match.ends(1)
    n = len(ends)
    if not text or any(m in text for m in marks) or draws[2] % 100 >= fim:
        return n, "plain", None, None, text
    first, second = sorted((draws[0] % (n + 1), draws[1] % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (first, second))
    prefix, suffix, middle = marks
    if draws[3] % 100 < spm:
        return n, "spm", a, b - a, f"{suffix}{text[b:]}{prefix}{text[:a]}{middle}{text[a:b]}"
    return n, "psm", a, b - a, f"{prefix}{text[:a]}{suffix}{text[b:]}{middle}{text[a:b]}"


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = LINE, seed: int = 7,
    fim_percent: int = 100, spm_percent: int = 50, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE),
) -> DataFrame:
    """One row per row of `docs`: doc_id, n (units), form (plain, psm, spm), prefix_chars, middle_chars
    (code points; null if plain), output.

    One fullmatch of (unit)* keeps the end of every repetition; two numbers drawn from the sha256 of
    `seed` and id choose the ends at which the prefix and the middle stop. `fim_percent` of the
    documents are rearranged, `spm_percent` of those with the suffix first. A text that is empty or
    holds a mark is plain. A null text is empty: n 0, plain, output empty. A text that `unit` does not
    match from end to end (the default matches every text) has n null and is plain. Cuts depend on id
    and text only, so rows repeated under one id are rearranged alike, equal texts under other ids in
    their own way, and reruns agree; a null id counts as an empty one. Texts are matched whole, in time
    and memory in proportion to their length. Other columns, whatever their names, are not read. An
    empty table gives an empty result. Marks that can run into each other raise ValueError.
    """
    _checked(marks)
    rows = docs.select(F.col(id_col).alias("doc_id"), no_null_text(text_col).alias("text"), _draws(id_col, seed).alias("draws"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        _cut(unit, marks, fim_percent, spm_percent), f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string"
    )


def restore(form: str | Column = "form", output: str | Column = "output", marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The document's text from output and form alone; null if either is null."""
    form, output = (F.col(c) if isinstance(c, str) else c for c in (form, output))
    prefix, suffix, middle = marks

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        """What follows the first, the second and the middle mark."""
        a, b = F.instr(output, second), F.instr(output, middle)
        return (
            F.substr(output, F.lit(len(first) + 1), a - len(first) - 1),
            F.substr(output, a + len(second), b - a - len(second)),
            F.substr(output, b + len(middle)),
        )

    psm, spm = parts(prefix, suffix), parts(suffix, prefix)
    return F.when(form == "plain", output).when(form == "psm", F.concat(psm[0], psm[2], psm[1])).when(form == "spm", F.concat(spm[1], spm[2], spm[0]))

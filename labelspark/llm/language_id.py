"""Language identification with interpolated Kneser-Ney character models."""

from __future__ import annotations

import re
import secrets
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from labelspark.llm import arrays
from labelspark.llm.common import no_null_text, staged

ORDER = 5  # characters of a gram: the predicted one and four before it
SPREAD = 6.0  # deviations above the mean cross-entropy at which a document is rejected
LEAST_RATIO = 2.0  # and at least so many times the mean, so that mixed or noisy prose stays
CHUNK_CHARS = 1 << 21
BLOCK_WORDS = 200_000  # a block of documents ends at so many different words
BLOCK_CODES = 4_000_000  # or at so many (document, word) pairs
BIT = 1 << 20  # bits are summed as multiples of 1 / BIT, so that no order of adding matters

UNKNOWN = "und"
_START, _END = "\x02", "\x03"
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters, in small letters."""
    return _WORD.findall(text.lower())


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _values(points: np.ndarray) -> np.ndarray:
    return arrays.mix(points.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))


def gram_hashes(grams: list[str]) -> np.ndarray:
    """Hash of each string, equal to that of the same characters inside a longer text."""
    if not len(grams):
        return np.zeros(0, np.uint64)
    ends = np.cumsum([len(g) for g in grams])
    return arrays.Hashes(_values(_code_points("".join(grams)))).spans(ends - np.array([len(g) for g in grams]), ends)


def _padded(words: list[str]) -> tuple[str, np.ndarray]:
    """(all words with ORDER - 1 start marks and an end mark, positions of the predicted characters)."""
    pad = _START * (ORDER - 1)
    size = np.array([len(w) + 1 for w in words], np.int64)
    first = np.cumsum(size + ORDER - 1) - size
    return "".join([pad + w + _END for w in words]), arrays.ranges(first, size)


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Grams of the words of (lang, text): lang, gram, count; partial per batch."""
    for batch in batches:
        by_lang: dict[str, Counter[str]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            by_lang.setdefault(lang, Counter()).update(words_of(text))
        for lang, words in by_lang.items():
            if not words:
                continue
            text, at = _padded(list(words))
            weight = np.repeat(np.fromiter(words.values(), np.int64), [len(w) + 1 for w in words])
            h = arrays.Hashes(_values(_code_points(text))).spans(at - ORDER + 1, at + 1)
            _, first, back = np.unique(h, return_index=True, return_inverse=True)
            total = np.bincount(back, weights=weight).astype(np.int64)
            grams = [text[i - ORDER + 1 : i + 1] for i in at[first].tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(grams), pa.string()), pa.array(grams, pa.string()), pa.array(total)], names=["lang", "gram", "n"]
            )


@dataclass
class Model:
    """The model in one process, which the Spark tables of gram_bits() are held against in tests.

    grams[n-1]: sorted hashes of the n-grams, and log2 of their probability in each language;
    back[n-1]: sorted hashes of contexts, and log2 of the weight that passes to the shorter gram."""

    langs: list[str]
    grams: list[tuple[np.ndarray, np.ndarray]]
    back: list[tuple[np.ndarray, np.ndarray]]
    floor: float

    def word_bits(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(bits of each word in each language, predicted characters of each word)."""
        text, at = _padded(words)
        hashes = arrays.Hashes(_values(_code_points(text)))
        logp = np.zeros((len(at), len(self.langs)), np.float32)
        open_ = np.arange(len(at))
        for n in range(ORDER, 0, -1):
            own = at[open_]
            keys, table = self.grams[n - 1]
            h = hashes.spans(own - n + 1, own + 1)
            place = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[place] == h
            logp[open_[hit]] += table[place[hit]]
            open_, own = open_[~hit], own[~hit]
            if not len(open_):
                break
            if n > 1:
                contexts, weight = self.back[n - 1]
                h = hashes.spans(own - n + 1, own)
                place = np.minimum(np.searchsorted(contexts, h), len(contexts) - 1)
                known = contexts[place] == h
                logp[open_[known]] += weight[place[known]]
        logp[open_] += self.floor
        size = np.array([len(w) + 1 for w in words], np.int64)
        return -np.add.reduceat(logp, np.cumsum(size) - size, axis=0), size


def _discount(once: int, twice: int) -> float:
    return float(np.clip(once / max(once + 2 * twice, 1), 0.1, 0.9)) if once else 0.5


def fit(counts: pd.DataFrame) -> Model:
    """Interpolated Kneser-Ney models from (lang, gram, n), grams of ORDER characters.

    Shorter grams count the different characters before them, except at the start of a word, where
    nothing but the start mark can precede and occurrences count.
    """
    langs = sorted(counts["lang"].unique())
    levels: list[dict[str, pd.Series]] = [{} for _ in range(ORDER + 1)]
    for lang, own in counts.groupby("lang"):
        longer = own.set_index("gram")["n"].astype(float)
        levels[ORDER][lang] = longer
        for n in range(ORDER - 1, 0, -1):
            starts = longer.index.str[1] == _START
            grouped = pd.DataFrame({"g": longer.index.str[1:], "n": np.where(starts, longer.to_numpy(), 1.0)}).groupby("g")["n"].sum()
            levels[n][lang] = longer = grouped
    vocabulary = len(set().union(*(levels[1][x].index for x in langs))) + 1
    floor = float(-np.log2(vocabulary))
    grams, back, shorter = [], [], None
    for n in range(1, ORDER + 1):
        index = pd.Index(sorted(set().union(*(levels[n][x].index for x in langs))))
        context = index.str[:-1]
        contexts = pd.Index(sorted(set(context)))
        logp, passed = np.zeros((len(index), len(langs))), np.zeros((len(contexts), len(langs)))
        for k, lang in enumerate(langs):
            own = levels[n][lang]
            d = _discount((own == 1).sum(), (own == 2).sum())
            by = own.groupby(own.index.str[:-1]).agg(["sum", "size"])
            weight = (d * by["size"] / by["sum"]).reindex(contexts).fillna(1.0)
            total = by["sum"].reindex(context).to_numpy()
            lower = np.full(len(index), 1 / vocabulary) if shorter is None else shorter[k].reindex(index.str[1:]).to_numpy()
            seen = np.nan_to_num(np.maximum(own.reindex(index).fillna(0).to_numpy() - d, 0) / total)
            logp[:, k] = seen + weight.reindex(context).to_numpy() * lower
            passed[:, k] = np.log2(weight.to_numpy())
        shorter = [pd.Series(logp[:, k], index=index) for k in range(len(langs))]
        for keys, table, out in ((index, np.log2(logp), grams), (contexts, passed, back)):
            h = gram_hashes(list(keys))
            order = np.argsort(h)
            out.append((h[order], table[order].astype(np.float32)))
    return Model(langs, grams, back, floor)


def _levels(counts: DataFrame) -> dict[int, DataFrame]:
    """(lang, gram, n) of each order, from all grams of ORDER characters; as in fit()."""
    levels = {ORDER: staged(counts, f"grams-{ORDER}")}
    for n in range(ORDER - 1, 0, -1):
        starts = F.substring("gram", 2, 1) == _START
        shorter = levels[n + 1].groupBy("lang", F.substring("gram", 2, n).alias("shorter")).agg(F.sum(F.when(starts, F.col("n")).otherwise(1)).alias("n"))
        levels[n] = staged(shorter.select("lang", F.col("shorter").alias("gram"), "n"), f"grams-{n}")
    return levels


def _by_lang(langs: list[str], value: Column) -> Column:
    """Values of a group's languages in the order of `langs`; null where it has none."""
    return F.array(*[F.max(F.when(F.col("lang") == x, value)) for x in langs])


def gram_bits(levels: dict[int, DataFrame], langs: list[str], discounts: dict[tuple[int, str], float], vocabulary: int, asked: DataFrame) -> DataFrame:
    """gram, bits: for each gram of ORDER characters of `asked`, seen or not, what its last character
    costs in each language, in 1 / BIT bits. Joins of the grams asked for with those counted, order by order."""
    size = range(len(langs))
    lower = None
    for n in range(1, ORDER + 1):
        d = F.create_map(*[x for lang in langs for x in (F.lit(lang), F.lit(discounts[n, lang]))])[F.col("lang")]
        own = levels[n].withColumn("context", F.substring("gram", 1, n - 1))
        by = own.groupBy("context", "lang").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("types"))
        seen = own.join(by, ["context", "lang"]).groupBy("gram").agg(_by_lang(langs, F.greatest(F.col("n") - d, F.lit(0.0)) / F.col("total")).alias("seen"))
        passed = by.groupBy("context").agg(_by_lang(langs, d * F.col("types") / F.col("total")).alias("passed"))
        table = (
            asked.select(F.substring("gram", ORDER - n + 1, n).alias("gram")).distinct()
            .select("gram", F.substring("gram", 1, n - 1).alias("context"), F.substring("gram", 2, n - 1).alias("shorter"))
            .join(seen, "gram", "left").join(passed, "context", "left")
        )
        if lower is not None:
            table = table.join(lower, "shorter")
        below = [F.lit(1 / vocabulary) if lower is None else F.col("lower")[k] for k in size]
        p = [F.coalesce(F.col("seen")[k], F.lit(0.0)) + F.coalesce(F.col("passed")[k], F.lit(1.0)) * below[k] for k in size]
        # Written order by order, so that the driver plans one order at a time.
        lower = staged(table.select(F.col("gram").alias("shorter"), F.array(*p).alias("lower")), f"prices-{n}")
    return lower.select(F.col("shorter").alias("gram"), F.transform("lower", lambda p: F.round(-F.log2(p) * BIT).cast("int")).alias("bits"))


def _packed(**columns) -> bytes:
    """Columns as one compressed Arrow stream."""
    batch = pa.RecordBatch.from_pydict(columns)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def _grams_of(words: list[str]) -> tuple[np.ndarray, list[str], np.ndarray]:
    """(gram number of each predicted character, grams, predicted characters of each word); the same
    words give the same numbers."""
    text, at = _padded(words)
    _, first, back = np.unique(arrays.Hashes(_values(_code_points(text))).spans(at - ORDER + 1, at + 1), return_index=True, return_inverse=True)
    return back, [text[i - ORDER + 1 : i + 1] for i in at[first].tolist()], np.array([len(w) + 1 for w in words], np.int64)


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of documents: rows with the documents' word codes and how often each occurs, and a last
    row per block with its words and their grams."""
    block, codes_of, pairs = secrets.randbits(63), defaultdict(), 0
    codes_of.default_factory = codes_of.__len__

    def row(docs: bytes | None, words: bytes | None = None, grams: list[str] | None = None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([block]), pa.array([docs], pa.binary()), pa.array([words], pa.binary()), pa.array([grams], pa.list_(pa.string()))],
            names=["block", "docs", "words", "grams"],
        )

    def dictionary() -> pa.RecordBatch:
        words = list(codes_of)
        return row(None, _packed(word=words), _grams_of(words)[1] if words else [])

    for batch in batches:
        texts, at = batch.column("text").to_pylist(), 0
        while at < len(texts):
            upto, chars = at, 0
            while upto < len(texts) and (upto == at or chars + len(texts[upto]) <= CHUNK_CHARS):
                chars += len(texts[upto])
                upto += 1
            found = [words_of(t) for t in texts[at:upto]]
            flat = np.fromiter((codes_of[w] for ws in found for w in ws), np.int64)
            doc = np.repeat(np.arange(len(found)), [len(ws) for ws in found])
            width = max(len(codes_of), 1)
            key, times = np.unique(doc * width + flat, return_counts=True)
            count = np.bincount(key // width, minlength=len(found))
            part = batch.slice(at, upto - at)
            # Codes as steps from the one before, which are small.
            pack = _packed(code=np.diff(key, prepend=0), times=times)
            own = _packed(**{c: part.column(c) for c in batch.schema.names if c != "text"}, count=count)
            yield row(_packed(own=[own], pack=[pack], width=[width]))
            pairs += len(key)
            at = upto
            if len(codes_of) >= BLOCK_WORDS or pairs >= BLOCK_CODES:
                yield dictionary()
                block, pairs = secrets.randbits(63), 0
                codes_of.clear()
    if codes_of:
        yield dictionary()


def _score(langs: list[str], schema: pa.Schema):
    def scores(docs: pa.Table, of_word: np.ndarray, chars: np.ndarray) -> pa.Table:
        own, pack = _unpacked(docs["own"][0].as_py()), _unpacked(docs["pack"][0].as_py())
        n, count, times = own.num_rows, own["count"].to_numpy(), pack["times"].to_numpy()
        codes = np.cumsum(pack["code"].to_numpy()) % docs["width"][0].as_py()
        bits, letters = np.zeros((n, len(langs)), np.int64), np.zeros(n, np.int64)
        if len(codes):
            has = np.flatnonzero(count)
            edge = (np.cumsum(count) - count)[has]
            for k in range(len(langs)):
                bits[has, k] = np.add.reduceat(of_word[codes, k] * times, edge)
            letters[has] = np.add.reduceat(chars[codes] * times, edge)
        none = letters == 0
        rank = bits / BIT / np.maximum(letters, 1)[:, None]
        best = bits.argmin(axis=1)
        least = rank[np.arange(n), best]
        share = 1 / np.exp2(-8 * np.minimum(rank - least[:, None], 100)).sum(axis=1)
        out = {
            "lang_pred": [UNKNOWN if x else langs[k] for x, k in zip(none, best, strict=True)],
            "score": np.where(none, 0.0, share), "entropy": np.where(none, 0.0, least), "letters": letters,
        }
        return pa.Table.from_arrays([own[f.name].cast(f.type) if f.name not in out else pa.array(out[f.name], f.type) for f in schema], schema=schema)

    def run(table: pa.Table) -> pa.Table:
        """Documents of one block; its rows are documents, the words, and the grams with their bits."""
        of_word, chars = np.zeros((0, len(langs)), np.int64), np.zeros(0, np.int64)
        for packed in table["words"].drop_null():
            if words := _unpacked(packed.as_py())["word"].to_pylist():
                gram_of, _, chars = _grams_of(words)
                priced = table.filter(pc.is_valid(table["bits"])).combine_chunks()
                of_gram = np.zeros((priced.num_rows, len(langs)), np.int64)
                of_gram[priced["gram"].to_numpy()] = priced["bits"].combine_chunks().flatten().to_numpy().reshape(-1, len(langs))
                of_word = np.add.reduceat(of_gram[gram_of], np.cumsum(chars) - chars, axis=0)
        return pa.concat_tables([schema.empty_table(), *(scores(_unpacked(d.as_py()), of_word, chars) for d in table["docs"].drop_null())])

    return run


def fold(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 3: 0 fits the models, 2 sets the limits, 1 is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3, F.lit(1)).cast("int")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, lang_pred, score, entropy (bits a character),
    letters (predicted characters), accepted.

    Models see the words of all labelled documents of fold 0, counted in Spark with every gram kept;
    the grams that occur in `docs` are joined with them. A document gets the language of least cross-entropy a
    character, over the words of its whole text; `score` is that language's share of 2**(-8 × entropy)
    over all. It is rejected (accepted false) when it has no letter or its entropy exceeds the limit of
    its language: SPREAD deviations above the mean of its labelled documents of fold 2, where short
    texts deviate more, and at least LEAST_RATIO times the mean. A language without such documents has
    the limit of those of all languages together; without any, the limit is the entropy of an even
    choice among all characters. Prediction uses the text only.

    A null text, or one without letters, is `und` with score 0. Null languages are not learned from; a
    null id counts as held out. Ties go to the first language by code point. Rows repeated under one
    id give a row each. Without labelled rows everything is `und`, not accepted. An empty table gives
    an empty result; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), no_null_text(text_col).alias("text")).withColumn("fold", fold("doc_id"))
    counts = (
        rows.filter("lang is not null and fold = 0").select("lang", "text").mapInArrow(count_grams, "lang string, gram string, n long")
        .groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    )
    levels = _levels(counts)
    tally = levels[ORDER].select(F.lit(ORDER).alias("order"), "lang", "n")
    for n in range(1, ORDER):
        tally = tally.unionAll(levels[n].select(F.lit(n), "lang", "n"))
    tally = tally.groupBy("order", "lang").agg(F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice")).collect()
    if not tally:
        return rows.select(
            "doc_id", (F.col("fold") == 1).alias("held_out"), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"),
            F.lit(0.0).alias("entropy"), F.lit(0).cast("long").alias("letters"), F.lit(False).alias("accepted"),
        )
    langs = sorted({r["lang"] for r in tally})
    discounts = {(r["order"], r["lang"]): _discount(r["once"], r["twice"]) for r in tally}
    vocabulary = levels[1].select("gram").distinct().count() + 1
    own = rows.select("doc_id", "lang", "fold")
    blocks = staged(rows.select("doc_id", "lang", "fold", "text").mapInArrow(_encode, "block long, docs binary, words binary, grams array<string>"), "blocks")
    asked = blocks.filter("grams is not null").select("block", F.posexplode("grams").alias("gram", "text"))
    bits = gram_bits(levels, langs, discounts, vocabulary, staged(asked.select(F.col("text").alias("gram")).distinct(), "asked"))
    priced = asked.join(bits.withColumnRenamed("gram", "text"), "text").select("block", "gram", "bits")
    result = StructType(own.schema.fields).add("lang_pred", "string").add("score", "double").add("entropy", "double").add("letters", "long")
    scored = staged(
        blocks.drop("grams").unionByName(priced, allowMissingColumns=True).groupBy("block").applyInArrow(_score(langs, to_arrow_schema(result)), result),
        "scored",
    )
    mean, sd, short, even = _limits(scored, langs, vocabulary)
    limit = F.when(mean.isNotNull(), F.greatest(mean * LEAST_RATIO, mean + SPREAD * F.sqrt(sd * sd + short / F.col("letters")))).otherwise(even)
    accepted = (F.col("lang_pred") != UNKNOWN) & (F.col("entropy") <= limit)
    return scored.select("doc_id", (F.col("fold") == 1).alias("held_out"), "lang_pred", "score", "entropy", "letters", accepted.alias("accepted"))


def _limits(scored: DataFrame, langs: list[str], vocabulary: int) -> tuple[Column, ...]:
    """For a row's language: mean entropy, deviation of long texts, squared deviation of one character,
    over all labelled documents of fold 2 that are recognised; and the limit where there are none."""
    rows = scored.filter("fold = 2 and letters > 0 and lang = lang_pred").select("lang", "entropy", "letters")
    mean = F.avg("entropy").alias("mean")
    means = {r["lang"]: r["mean"] for r in rows.rollup("lang").agg(mean).collect() if r["mean"] is not None}
    if not means:
        return (*[F.lit(None).cast("double")] * 3, F.lit(float(np.log2(vocabulary))))
    as_map = lambda values: F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(float(v)))])

    def spread(of: Column) -> list[Column]:
        off = (F.col("entropy") - of) ** 2
        return [F.sqrt(F.avg(F.when(F.col("letters") >= 300, off))).alias("sd"), F.avg(F.when(F.col("letters") < 300, off * F.col("letters"))).alias("short")]

    found = rows.groupBy("lang").agg(*spread(as_map({k: v for k, v in means.items() if k is not None})[F.col("lang")])).collect()
    found += rows.agg(F.lit(None).cast("string").alias("lang"), *spread(F.lit(float(means[None])))).collect()
    of = {r["lang"]: (m := means[r["lang"]], r["sd"] or 0.1 * m, r["short"] if r["short"] is not None else m**2) for r in found}
    of = {x: of.get(x, of[None]) for x in langs}
    return (*[as_map({x: v[i] for x, v in of.items()})[F.col("lang_pred")] for i in range(3)], F.lit(float(np.log2(vocabulary))))


def keep_known(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """`docs` without the documents that are rejected; columns as they were. A rejected row repeated
    under one id with an accepted one goes with all rows of that id only if every one is rejected."""
    found = identify(docs, id_col, text_col, lang_col)
    known = staged(found.filter("accepted").select(F.col("doc_id").alias("_known")).distinct(), "known")
    return docs.join(known.hint("merge"), docs[id_col].eqNullSafe(known["_known"]), "left_semi")

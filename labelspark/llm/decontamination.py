"""Benchmark decontamination by template windows: numbers, names and units become placeholders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelspark.llm.common import no_null_text, staged

WINDOW = 5  # template words in a window
LITERALS = 2  # words of a benchmark window that must not be placeholders
COVERAGE = 0.5  # share of an item's windows that must be in one place of the document
CONSISTENCY = 0.8  # share of an item's slot values that must map to one value each

NAME, NUMBER, UNIT = "\ue000", "\ue001", "\ue002"  # private-use letters
UNITS = (
    "kg g mg lb lbs oz km m cm mm mi mile miles ft foot feet inch inches yd l ml h hr hrs hour hours min minute "
    "minutes s sec second seconds day days week weeks month months year years dollar dollars euro euros cent cents "
    "percent degrees c f k w kw v hz mph kmh gb mb"
).split()
_NUM = r"\p{N}+(?:[.,:/]\p{N}+)*"
_WORDS = r"[\p{L}\p{M}" + NAME + NUMBER + UNIT + r"]+"


def _typed(text: Column) -> Column:
    """The text with every number, name and unit replaced by one placeholder letter.

    A number is a run of digits with inner points and commas; a unit is a unit word right after a
    number; a name is a capitalised word after a small letter or comma and white space, so not at the
    start of a sentence.
    """
    bare = F.regexp_replace(text, rf"[\s\p{{Z}}{NAME}{NUMBER}{UNIT}]+", " ")
    named = F.regexp_replace(bare, r"(?<=[\p{Ll},] )\p{Lu}\p{Ll}+(?![\p{L}\p{M}])", NAME)
    numbered = F.regexp_replace(named, _NUM, f" {NUMBER} ")
    return F.lower(F.regexp_replace(numbered, rf"(?i)(?<={NUMBER}  ?)(?:{'|'.join(UNITS)})(?![\p{{L}}\p{{M}}])", UNIT))


def template(text: Column) -> Column:
    """Template words of a text, in order."""
    return F.filter(F.split(_typed(text), r"[^\p{L}\p{M}" + NAME + NUMBER + UNIT + r"]+"), lambda w: w != "")


def originals(text: Column) -> Column:
    """The words that the template words stand for; same length and order as template()."""
    return F.regexp_extract_all(F.regexp_replace(text, f"[{NAME}{NUMBER}{UNIT}]", " "), F.lit(rf"({_NUM}|[\p{{L}}\p{{M}}]+)"), F.lit(1))


def _windows(df: DataFrame, key: str, words: Column, size: Column) -> DataFrame:
    """key, pos, h, cut: every window of `size` (a column of the words "w" or a generator) and its hash."""
    # The one-element explode keeps the optimizer from writing the patterns of the words into the filters too.
    rows = df.select(key, F.explode(F.array(words)).alias("w")).filter("size(w) > 0").select(key, "w", size.alias("k")).filter("size(w) >= k")
    cut = F.slice("w", F.col("pos") + 1, F.col("k"))
    return rows.select(key, "w", "k", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("k"))).alias("pos")).select(
        key, "pos", "k", F.xxhash64(cut).alias("h"), cut.alias("cut")
    )


def _sizes(windows: DataFrame) -> list[int]:
    """The window sizes in use, at most WINDOW of them."""
    return sorted(r["k"] for r in windows.select("k").distinct().collect())


def _verbatim(texts: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """Items found by their own words and numbers, all in a row, in any case and whatever stands between
    them; the columns of find_leaks().

    Of each item only the window that fewest items share is looked up, so that a phrase common to many
    items brings no pairs; where it is found, all words of the item are compared.
    """
    words = lambda text: F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+"), "")
    windows = _windows(items, "item_id", words(F.col("text")), F.least(F.size("w"), F.lit(window))).select("item_id", F.col("pos").alias("item_pos"), "k", "h")
    shared = windows.groupBy("h", "k").agg(F.countDistinct("item_id").alias("items"))
    rarest = windows.join(shared, ["h", "k"]).groupBy("item_id").agg(F.min_by(F.struct("h", "k", "item_pos"), F.struct("items", "item_pos")).alias("r"))
    anchors = staged(rarest.select("item_id", "r.*"), "anchors")
    sizes = _sizes(anchors) or [window]
    own = _windows(texts, "doc_id", words(F.col("text")), F.explode(F.array(*map(F.lit, sizes)))).select("doc_id", "pos", "k", "h")
    placed = staged(
        own.join(anchors, ["h", "k"]).select("doc_id", "item_id", "k", (F.col("pos") - F.col("item_pos")).alias("at")).filter("at >= 0").distinct(), "verbatim-candidates"
    )
    asked = texts.join(placed.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", words(F.col("text")).alias("doc_words"))
    item_words = items.select("item_id", words(F.col("text")).alias("item_words"))
    same = F.slice("doc_words", F.col("at") + 1, F.size("item_words")) == F.col("item_words")
    n = (F.size("item_words") - F.col("k") + 1).cast("long")
    return placed.join(asked, "doc_id").join(item_words, "item_id").filter(same).select(
        "doc_id", "item_id", n.alias("n_windows"), n.alias("n_matched"), F.lit(1.0).alias("coverage"), F.lit(1.0).alias("consistency")
    ).distinct()


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
               coverage: float = COVERAGE, consistency: float = CONSISTENCY) -> DataFrame:
    """One row per document and benchmark item that it contains: doc_id, item_id, n_windows (of the
    item), n_matched, coverage, consistency.

    Windows of template words are joined by hash. Those of one item that lie at one distance from
    their place in the item (up to half a window of drift) are one passage; it must cover `coverage`
    of the item's windows. For such pairs the words behind the placeholders are compared: each value in
    the item must stand for one value in the document, in `consistency` of the cases, so a question
    with new numbers and names is found and a template that merely looks alike is not. An item
    without placeholders has consistency 1.

    A window of an item with fewer than LITERALS words besides placeholders says nothing about its
    wording and is not counted. Every item, also one with such windows only, is found by its own words
    and numbers as well, all in a row, in any case, whatever white space and signs stand between them:
    such a copy has coverage and consistency 1. An item shorter than the window is one window of its
    own length.

    Null and empty texts contain nothing and items without words are never found. Documents repeated
    under one id count as one; documents without an id are not looked at (drop_leaks() looks at them); of
    items repeated under one id one is taken. Texts of any length are taken whole, a row for each
    window. Other columns, whatever their names, are not read. Empty tables give an empty result.
    """
    items = benchmark.select(F.col(item_col).alias("item_id"), no_null_text(item_text_col).alias("text")).dropDuplicates(["item_id"])
    literal = F.size(F.filter("cut", lambda w: ~w.isin(NAME, NUMBER, UNIT)))
    item_windows = staged(
        _windows(items, "item_id", template(F.col("text")), F.least(F.size("w"), F.lit(window))).filter(literal >= F.least(F.col("k"), F.lit(LITERALS)))
        .select("item_id", F.col("pos").alias("item_pos"), "k", "h"),
        "item-windows",
    )
    totals = item_windows.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_windows"))
    texts = docs.select(F.col(id_col).alias("doc_id"), no_null_text(text_col).alias("text")).filter("doc_id is not null")
    sizes = _sizes(item_windows) or [window]
    size = F.lit(sizes[0]) if len(sizes) == 1 else F.explode(F.array(*map(F.lit, sizes)))
    hits = _windows(texts, "doc_id", template(F.col("text")), size).drop("cut").join(item_windows, ["h", "k"])
    # Windows of a passage share pos - item_pos; a dropped or added word moves it by one.
    drift = window // 2 + 1
    lane = F.floor((F.col("pos") - F.col("item_pos")) / (2 * drift))
    side = F.floor((F.col("pos") - F.col("item_pos") + drift) / (2 * drift))
    placed = hits.select("doc_id", "item_id", "item_pos", "pos", F.explode(F.array(lane * 2, side * 2 + 1)).alias("lane"))
    per_place = placed.groupBy("doc_id", "item_id", "lane", "item_pos").agg(F.min("pos").alias("pos"))
    passages = (
        per_place.groupBy("doc_id", "item_id", "lane")
        .agg(F.count(F.lit(1)).alias("n_matched"), F.collect_list(F.struct("item_pos", "pos")).alias("places"))
        .join(totals, "item_id").filter(F.col("n_matched") >= F.lit(coverage) * F.col("n_windows"))
    )
    best = staged(
        passages.groupBy("doc_id", "item_id").agg(
            F.max_by(F.struct("n_matched", "n_windows", "places"), F.struct(F.col("n_matched"), -F.col("lane"))).alias("b")
        ).select("doc_id", "item_id", "b.*"),
        "leak-candidates",
    )
    # The slots: only for passages that passed, so few documents' texts are needed.
    words = texts.join(best.select("doc_id").distinct(), "doc_id", "left_semi").select(
        "doc_id", originals(F.col("text")).alias("doc_words")
    ).dropDuplicates(["doc_id"])
    item_words = items.select("item_id", template(F.col("text")).alias("t"), originals(F.col("text")).alias("item_words"))
    pairs = best.join(words, "doc_id").join(item_words, "item_id")
    slots = pairs.select(
        "doc_id", "item_id", "t", "doc_words", "item_words", F.explode("places").alias("p")
    ).select("doc_id", "item_id", "t", "doc_words", "item_words", "p.item_pos", "p.pos", F.explode(F.sequence(F.lit(1), F.lit(window))).alias("j"))
    values = slots.filter(F.get("t", F.col("item_pos") + F.col("j") - 1).isin(NAME, NUMBER, UNIT)).select(
        "doc_id", "item_id", F.get("item_words", F.col("item_pos") + F.col("j") - 1).alias("was"),
        F.get("doc_words", F.col("pos") + F.col("j") - 1).alias("now"),
    ).distinct()
    mapped = values.groupBy("doc_id", "item_id", "was").agg((F.count(F.lit(1)) == 1).alias("one")).groupBy("doc_id", "item_id").agg(
        F.avg(F.col("one").cast("int")).alias("consistency")
    )
    found = (
        best.join(mapped, ["doc_id", "item_id"], "left")
        .select(
            "doc_id", "item_id", "n_windows", "n_matched", (F.col("n_matched") / F.col("n_windows")).alias("coverage"),
            F.coalesce("consistency", F.lit(1.0)).alias("consistency"),
        )
        .filter(F.col("consistency") >= consistency)
    )
    found = staged(found, "template-leaks")
    return found.unionByName(_verbatim(texts, items, window).join(found.select("doc_id", "item_id"), ["doc_id", "item_id"], "left_anti"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`docs` without the documents that contain a benchmark item; columns as they were. Documents
    without an id are told apart by their texts; those repeated under one id go or stay together."""
    key = "leak_key" + "_" * max(len(c) for c in docs.columns)
    own = F.coalesce(F.concat(F.lit("id:"), F.col(id_col).cast("string")), F.concat(F.lit("text:"), F.sha2(no_null_text(text_col).cast("binary"), 256)))
    keyed = docs.withColumn(key, own)
    found = staged(find_leaks(keyed, benchmark, key, text_col, **options).select(F.col("doc_id").alias(key)).distinct(), "leaks")
    return keyed.join(found.hint("merge"), key, "left_anti").select(*[keyed[c] for c in docs.columns])

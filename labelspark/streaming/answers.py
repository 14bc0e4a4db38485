"""Symbols answered by catalog answers that arrive before or after them."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_EXACT_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


class _Answerer(StatefulProcessor):
    """Holds the answer of a barcode, or the symbols that wait for it."""

    def __init__(self, ttl_ms: int | None) -> None:
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.answer = handle.getValueState("answer", "product string", self.ttl)
        self.waiting = handle.getListState("waiting", "symbol string", self.ttl)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.answer.update((_best(initialState["product"]),))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        barcode = key[0]
        no_number = barcode is None or not (barcode.isascii() and barcode.isdigit())
        known = (None,) if no_number else self.answer.get() if self.answer.exists() else None
        for part in rows:
            answers = part.loc[part["symbol"].isna(), "product"]
            if known is None and len(answers):
                known = (_best(answers),)
                self.answer.update(known)
                held = self.waiting.get()
                while some := [symbol for (symbol,) in islice(held, 10_000)]:
                    yield _answered(some, known[0])
                self.waiting.clear()
            symbols = part["symbol"].dropna().tolist()
            if symbols and known is not None:
                yield _answered(symbols, known[0])
            elif symbols:
                self.waiting.appendList([(symbol,) for symbol in symbols])

    def close(self) -> None:
        pass


def _best(products: pd.Series) -> str | None:
    """Of answers that come together, a hit before a miss, then the least."""
    return min(products.dropna(), default=None)


def _answered(symbols: list[str], product: str | None) -> pd.DataFrame:
    return pd.DataFrame({"symbol": symbols, "product": pd.Series([product] * len(symbols), dtype=object)})


def answer_symbols(
    symbols: DataFrame, answers: DataFrame, known: DataFrame, parts: int = 16, ttl_seconds: int | None = None
) -> DataFrame:
    """Stream of `symbols` (`data` renamed to `barcode`) with `answer`, the product of their barcode.

    `answers` is a stream of (barcode, product) and `known` a table of them, which the first micro-batch
    takes in; a null product says "asked, not found". A symbol without an answer yet waits for it and
    is given out when it comes. The first answer of a barcode stays; of several in one micro-batch a
    hit goes before a miss, then the least. A text that is no number is answered with null at once.
    With `ttl_seconds` answers and waiting symbols are forgotten so long after they came; a forgotten
    symbol is not given out, and the stream never runs out of batches by itself. Symbols of one barcode are spread over `parts` keys, each with a copy of
    its answer, so that a barcode of very many symbols is no one task's work. A symbol is sent to a
    part by its content.
    """
    spread = lambda df: df.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    product = F.to_json("product", _EXACT_TIMES).alias("product")
    sent = symbols.select(
        F.col("data").alias("barcode"), F.to_json(F.struct(*symbols.columns), _EXACT_TIMES).alias("symbol"),
        F.lit(None).cast("string").alias("product"),
    ).withColumn("part", F.pmod(F.xxhash64("symbol"), F.lit(parts)).cast("int"))
    given = spread(answers.select("barcode", F.lit(None).cast("string").alias("symbol"), product))
    first = spread(known.filter("barcode is not null").select("barcode", product))
    out = (
        sent.unionByName(given).groupBy("barcode", "part")
        .transformWithStateInPandas(
            statefulProcessor=_Answerer(None if ttl_seconds is None else ttl_seconds * 1000),
            outputStructType="symbol string, product string", outputMode="Append",
            timeMode="None" if ttl_seconds is None else "ProcessingTime",
            initialState=first.groupBy("barcode", "part"),
        )
    )
    return out.select(
        F.from_json("symbol", symbols.schema, _EXACT_TIMES).alias("s"),
        F.from_json("product", known.schema["product"].dataType, _EXACT_TIMES).alias("answer"),
    ).select(*[F.col("s")[c].alias("barcode" if c == "data" else c) for c in symbols.columns], "answer")


def answered_symbols(symbols: DataFrame, answers: DataFrame, known: DataFrame) -> DataFrame:
    """Batch twin of `answer_symbols` once every answer has come: symbols without one are left out."""
    asked = F.col("barcode").rlike("^[0-9]+$")
    best = F.struct(F.col("product").isNull().alias("miss"), F.to_json("product").alias("text"), "product")
    taken = known.select("barcode", "product", F.lit(0).alias("rank")).unionByName(
        answers.select("barcode", "product", F.lit(1).alias("rank"))
    ).groupBy("barcode").agg(F.min(F.struct("rank", best.alias("best"))).alias("first"))
    found = taken.select("barcode", F.col("first.best.product").alias("answer"), F.lit(True).alias("given"))
    return (
        symbols.withColumnRenamed("data", "barcode").join(found, "barcode", "left")
        .filter(F.coalesce("given", ~asked, F.lit(True)))
        .select(*["barcode" if c == "data" else c for c in symbols.columns], F.when(asked, F.col("answer")).alias("answer"))
    )

"""JSON documents over several lines, put together from lines that many tasks read.

A string in JSON holds no raw line break, so what a line does to the depth of braces is a number that
its text alone gives. Sums of these numbers inside each block of a file, and one small fold over the
file's blocks, tell where every document begins and ends; no file is read in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Noncharacters stand for braces inside strings and for escapes while a line is cut.
_OPEN, _CLOSE, _BACKSLASH, _QUOTE = "\ufdd0", "\ufdd1", "\ufdd2", "\ufdd3"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, block, row, value: lines of text files; `row` orders those of one block, blocks of a file
    are ordered by where they start."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"), "value",
    )


def _veiled(value: Column) -> Column:
    """The line with braces inside strings, escaped quotes and escaped backslashes replaced."""
    plain = F.replace(F.replace(value, F.lit("\\\\"), F.lit(_BACKSLASH)), F.lit('\\"'), F.lit(_QUOTE))
    parts = F.transform(F.split(plain, '"'), lambda x, i: F.when(i % 2 == 1, F.translate(x, "{}", _OPEN + _CLOSE)).otherwise(x))
    return F.array_join(parts, '"')


def _unveiled(text: Column) -> Column:
    return F.replace(F.replace(F.translate(text, _OPEN + _CLOSE, "{}"), F.lit(_QUOTE), F.lit('\\"')), F.lit(_BACKSLASH), F.lit("\\\\"))


def _segments(lines: DataFrame) -> DataFrame:
    """Lines cut after every closing brace: file, block, row, seg, text (veiled), opens, delta, fresh.

    `fresh`: the line begins with an opening brace where no value can begin, that is not after an
    opening bracket, a comma or a colon; so a document before it that is still open was cut off.
    """
    # A line's last character matters to the next line that has one; of a block, to the next block.
    inside = Window.partitionBy("file", "block").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = F.nullif(F.right(F.rtrim("value"), F.lit(1)), F.lit(""))
    tails = (
        lines.select("file", "block", "row", last.alias("last")).groupBy("file", "block").agg(F.max_by("last", F.when(F.col("last").isNotNull(), F.col("row"))).alias("tail"))
        .select("file", F.col("block").alias("block"), F.last("tail", True).over(across).alias("carried"))
    )
    before = F.coalesce(F.last(last, True).over(inside), F.col("carried"))
    fresh = F.col("value").startswith("{") & F.coalesce(~before.isin("[", ",", ":"), F.lit(True))
    cut = (
        lines.join(tails, ["file", "block"]).withColumn("fresh", fresh)
        .select("file", "block", "row", "fresh", F.split(_veiled(F.col("value")), r"\}").alias("parts"))
        .select("file", "block", "row", "fresh", F.size("parts").alias("n"), F.posexplode("parts").alias("seg", "part"))
    )
    closes = (F.col("seg") < F.col("n") - 1).cast("int")
    opens = F.length("part") - F.length(F.replace("part", F.lit("{"), F.lit("")))
    return cut.select(
        "file", "block", "row", "seg", F.concat("part", F.when(closes == 1, "}").otherwise("")).alias("text"), opens.alias("opens"),
        (opens - closes).alias("delta"), ((F.col("seg") == 0) & F.col("fresh")).cast("int").alias("fresh"),
    )


def _placed(segments: DataFrame) -> DataFrame:
    """Segments with `before` and `after`, the depth of braces around them; never below zero."""
    block = Window.partitionBy("file", "block").orderBy("row", "seg")
    run = Window.partitionBy("file", "block", "section").orderBy("row", "seg")
    summed = segments.withColumn("section", F.sum("fresh").over(block)).withColumn("sum", F.sum("delta").over(run)).withColumn("low", F.min("sum").over(run))
    # What a block makes of the depth before it: after its last fresh start that depth counts no more.
    ends = summed.groupBy("file", "block").agg(F.max_by(F.struct("section", "sum", "low"), F.struct("row", "seg")).alias("e"))
    step = lambda acc, x: F.struct(
        (x["e"]["sum"] + F.greatest(F.when(x["e"]["section"] == 0, acc["depth"]).otherwise(0), -x["e"]["low"])).alias("depth"),
        F.array_append(acc["starts"], F.struct(x["block"].alias("block"), acc["depth"].alias("depth"))).alias("starts"),
    )
    # One entry for each block of a file.
    files = ends.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("block", "e"))).alias("blocks"))
    start = F.struct(F.lit(0).cast("long").alias("depth"), F.array().cast("array<struct<block:bigint,depth:bigint>>").alias("starts"))
    carried = files.select("file", F.explode(F.aggregate("blocks", start, step)["starts"]).alias("s")).select("file", "s.block", F.col("s.depth").alias("carried"))
    from_before = F.when(F.col("section") == 0, F.col("carried")).otherwise(0)
    lower = F.coalesce(F.lag("low").over(run), F.lit(0))
    return summed.join(carried, ["file", "block"]).withColumns(
        {
            "before": F.col("sum") - F.col("delta") + F.greatest(from_before, -lower, F.lit(0)),
            "after": F.col("sum") + F.greatest(from_before, -F.col("low"), F.lit(0)),
        }
    )


def documents(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, cut off) of (file, block, row, value).

    documents: file, at (block, row and segment in which it begins) and text, one row per object that is
    not inside another one, whether a file holds one, many in a row or a list of them. cut off: file, at,
    segments, chars, of objects that are never closed. A document cut off right after an opening bracket,
    a comma or a colon takes the one that follows with it. A closing brace too many is passed over. A
    file of one long line is one task's work. Texts that hold U+FDD0 to U+FDD3 get other characters there.
    """
    placed = _placed(_segments(lines))
    start = F.when((F.col("before") == 0) & (F.col("opens") > 0), F.struct("block", "row", "seg"))
    marked = placed.withColumn("start", start)
    across = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # The document that is open where a block begins: the last one begun in the blocks before.
    begun = marked.groupBy("file", "block").agg(F.max("start").alias("begun")).select("file", "block", F.max("begun").over(across).alias("begun"))
    block = Window.partitionBy("file", "block").orderBy("row", "seg")
    inside = (
        marked.join(begun, ["file", "block"]).withColumn("at", F.coalesce(F.last("start", True).over(block), F.col("begun")))
        .filter((F.col("before") > 0) | F.col("start").isNotNull())
        .withColumn("closes", (F.col("after") == 0) & (F.col("delta") < F.col("opens")))
        .select("file", "at", "block", "row", "seg", "closes", F.when(F.col("start").isNotNull(), F.regexp_replace("text", r"^[^{]*", "")).otherwise(F.col("text")).alias("text"))
    )
    closed = inside.filter("closes").select("file", "at").withColumn("whole", F.lit(True))
    known = inside.join(closed, ["file", "at"], "left")
    # Only documents that are closed are put together; what is cut off may be the rest of a large file.
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "row", "seg", "text"))), lambda x: F.concat(F.when(x["seg"] == 0, "\n").otherwise(""), x["text"])), "")
    whole = known.filter("whole").groupBy("file", "at").agg(_unveiled(F.ltrim(text)).alias("text"))
    torn = known.filter("whole is null").groupBy("file", "at").agg(F.count(F.lit(1)).alias("segments"), F.sum(F.length("text")).alias("chars"))
    return whole, torn


def parsed(lines: DataFrame, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows of `schema`, rejected) of numbered lines; rejected: file, at, chars, reason (cut off, malformed)."""
    corrupt = T.StructField("_corrupt", T.StringType())
    whole, torn = documents(lines)
    full = schema if "_corrupt" in schema.names else T.StructType([*schema.fields, corrupt])
    rows = whole.select("file", "at", F.length("text").alias("chars"), F.from_json("text", full, {"columnNameOfCorruptRecord": "_corrupt"}).alias("d"))
    bad = rows.filter("d._corrupt is not null").select("file", "at", F.col("chars").cast("long"), F.lit("malformed").alias("reason"))
    good = rows.filter("d._corrupt is null").select(*[F.col("d")[c].alias(c) for c in schema.names])
    return good, torn.select("file", "at", F.col("chars").cast("long"), F.lit("cut off").alias("reason")).unionByName(bad)

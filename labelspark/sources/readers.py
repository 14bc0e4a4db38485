"""Typed readers. Schemas are given, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelspark import fixed, schemas
from labelspark.operators.catalog import company_records, grocery_records, item_records
from labelspark.operators.documents import numbered_lines, parsed
from labelspark.operators.lines import clean_lines


def _read(spark: SparkSession, path: str, fmt: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).format(fmt).load(path)


def read_ocr_lines(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """OCR line records, text trimmed, confidence never negative with three decimals."""
    return clean_lines(_read(spark, path, fmt, schemas.LINE))


def read_ocr_tokens(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Word tokens; blank ones are dropped. `conf` stays text, `tokens_to_lines` reads it."""
    return _read(spark, path, fmt, schemas.TOKEN).filter(F.trim("text") != "")


def read_tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    """Stored tables by name, also registered as temp views."""
    tables = {name: spark.read.parquet(f"{folder}/{name}.parquet") for name in names}
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return tables


def read_catalog_json(spark: SparkSession, path: str) -> DataFrame:
    """Grocery catalog documents, one or many to a file, of any size; a cut-off document is a miss."""
    return grocery_records(parsed(numbered_lines(spark, path), schemas.CATALOG_DOCUMENT)[0])


def read_catalog_items(spark: SparkSession, path: str) -> DataFrame:
    return item_records(parsed(numbered_lines(spark, path), schemas.CATALOG_ITEMS)[0])


def read_catalog_rejects(spark: SparkSession, path: str, schema: T.StructType = schemas.CATALOG_DOCUMENT) -> DataFrame:
    """Documents that the catalog readers pass over: file, at, chars, reason."""
    return parsed(numbered_lines(spark, path), schema)[1]


def read_company_pages(spark: SparkSession, path: str, patterns: list[str] | None = None) -> DataFrame:
    return company_records(spark.read.parquet(path), patterns)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Image files the intake accepts: jpeg, png or webp of at most 10 MiB."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return accepted_images(files)


def accepted_images(files: DataFrame) -> DataFrame:
    return files.filter(F.col("path").rlike(fixed.IMAGE_SUFFIX) & (F.col("length") <= fixed.MAX_IMAGE_BYTES))


def read_pipeline_log(spark: SparkSession, path: str) -> DataFrame:
    """Structured JSON log lines."""
    return spark.read.schema(schemas.LOG).json(path)

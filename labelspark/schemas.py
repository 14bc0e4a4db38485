"""Column contracts of the input tables."""

from __future__ import annotations

from pyspark.sql import types as T

BOX = T.StructType([T.StructField(n, T.DoubleType()) for n in ("x", "y", "w", "h")])

# One recognised text line. `line_no` orders the lines of a panel; it need not be dense.
LINE = T.StructType(
    [
        T.StructField("scan_id", T.StringType()),
        T.StructField("panel", T.StringType()),
        T.StructField("line_no", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("bbox", BOX),
        T.StructField("source_provider", T.StringType()),
        T.StructField("preprocessing_variant", T.StringType()),
    ]
)

TOKEN = T.StructType(
    [
        T.StructField("image_id", T.StringType()),
        T.StructField("block_num", T.LongType()),
        T.StructField("par_num", T.LongType()),
        T.StructField("line_num", T.LongType()),
        T.StructField("pos", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("conf", T.StringType()),
        T.StructField("left", T.DoubleType()),
        T.StructField("top", T.DoubleType()),
        T.StructField("width", T.DoubleType()),
        T.StructField("height", T.DoubleType()),
    ]
)

CATALOG_DOCUMENT = T.StructType(
    [
        T.StructField("code", T.StringType()),
        T.StructField("status", T.LongType()),
        T.StructField(
            "product",
            T.StructType(
                [
                    T.StructField(n, T.StringType())
                    for n in ("product_name", "brands", "categories", "manufacturers", "quantity")
                ]
            ),
        ),
        T.StructField("_corrupt", T.StringType()),
    ]
)

CATALOG_ITEMS = T.StructType(
    [
        T.StructField("code", T.StringType()),
        T.StructField(
            "items",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField(n, T.StringType())
                        for n in ("title", "brand", "category", "description")
                    ]
                )
            ),
        ),
    ]
)

LOG = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType()),
        *[
            T.StructField(n, T.StringType())
            for n in ("level", "logger", "message", "request_id", "scan_id", "event", "stage")
        ],
        T.StructField("elapsed_ms", T.DoubleType()),
        T.StructField("image_label", T.StringType()),
        *[T.StructField(n, T.LongType()) for n in ("line_count", "barcode_count", "declaration_count")],
        *[T.StructField(n, T.StringType()) for n in ("overall_status", "method", "path")],
        T.StructField("status_code", T.LongType()),
        T.StructField("exception", T.StringType()),
    ]
)

# One typed value for all fields; only the members of its field are set.
VALUE = (
    "struct<amount:double,currency:string,tier:int,value:double,unit:string,name:string,"
    "day:int,month:int,year:int,present:boolean,text:string,font_height_px:double,"
    "nutrients:array<struct<nutrient:string,value:double,unit:string,confidence:double,"
    "raw_text:string>>>"
)

"""Schema of the label lines that tests build."""

LINE_DDL = (
    "scan_id string, panel string, line_no long, text string, confidence double,"
    "bbox struct<x:double,y:double,w:double,h:double>, source_provider string, preprocessing_variant string"
)

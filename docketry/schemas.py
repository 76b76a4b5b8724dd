"""Declared schemas: no input is ever inferred, so an empty one gives an empty result."""

from pyspark.sql import types as T

PRODUCT = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("name", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("image_desc", T.StringType()),
])

PAGE = T.StructType([
    T.StructField("file_path", T.StringType(), False),
    T.StructField("page", T.LongType(), False),
    T.StructField("page_text", T.StringType()),
])

TEXT_ITEM = T.StructType([
    T.StructField("doc_id", T.StringType(), False),
    T.StructField("row_idx", T.LongType(), False),
    T.StructField("self_ref", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("text", T.StringType()),
])

ENVELOPE = T.StructType([T.StructField("envelope", T.StringType())])

FILE_EVENT = T.StructType([
    T.StructField("bucket", T.StringType()),
    T.StructField("name", T.StringType()),
])

DOCUMENT_MESSAGE = T.StructType([
    T.StructField("doc_id", T.StringType()),
    T.StructField("min_page", T.LongType()),
    T.StructField("max_page", T.LongType()),
    T.StructField("bucket", T.StringType()),
    T.StructField("file_path", T.StringType()),
])

"""Declared schemas. Nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

PAGES = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
    ]
)

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)

LABELS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("quality", T.IntegerType()),
        T.StructField("toxic", T.IntegerType()),
    ]
)

ORDER_LINES = T.StructType(
    [
        T.StructField("l_orderkey", T.LongType()),
        T.StructField("l_linenumber", T.IntegerType()),
        T.StructField("l_extendedprice", T.DoubleType()),
    ]
)

ORDERS = T.StructType(
    [
        T.StructField("o_orderkey", T.LongType()),
        T.StructField("o_totalprice", T.DoubleType()),
    ]
)

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)

PARTS = T.StructType(
    [
        T.StructField("p_partkey", T.LongType()),
        T.StructField("p_name", T.StringType()),
    ]
)

# What a finished record holds.
RECORD = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("round", T.IntegerType()),
        T.StructField("url", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("n_sections", T.LongType()),
        T.StructField("url_no", T.LongType()),
        T.StructField("body_text", T.StringType()),
    ]
)


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read Parquet under a declared schema; columns left out are not read.

    A declared column that the file lacks raises; read under the schema alone it
    would be null in every row.
    """
    absent = set(schema.names) - set(spark.read.parquet(path).columns)
    if absent:
        raise ValueError(f"{path} has no column {', '.join(sorted(absent))}")
    return spark.read.schema(schema).parquet(path)

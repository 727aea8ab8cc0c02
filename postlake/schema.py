"""Table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

JOBS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("external_id", T.StringType()),
        T.StructField("company_name", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("hash", T.StringType()),
        T.StructField("first_seen_at", T.TimestampNTZType()),
        T.StructField("last_seen_at", T.TimestampNTZType()),
        T.StructField("expired_at", T.TimestampNTZType()),
        T.StructField("created_at", T.TimestampNTZType()),
        T.StructField("updated_at", T.TimestampNTZType()),
    ]
)

REFS = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("source_key", T.StringType()),
        T.StructField("external_id", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("company_name", T.StringType()),
    ]
)

RESPONSES = T.StructType(
    [
        T.StructField("source_key", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("status_code", T.IntegerType()),
        T.StructField("body", T.StringType()),
        T.StructField("fetched_at", T.TimestampNTZType()),
    ]
)

RESULTS = T.StructType(
    [
        T.StructField("external_id", T.StringType()),
        T.StructField("company_name", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("processing_ms", T.DoubleType()),
        T.StructField("ts", T.TimestampNTZType()),
    ]
)

SOURCES = T.StructType(
    [
        T.StructField("source_key", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("fetch_type", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("id_pattern", T.StringType()),
        T.StructField("link_selector", T.StringType()),
        T.StructField("method", T.StringType()),
        T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
        T.StructField("request_body", T.StringType()),
        T.StructField("jobs_path", T.StringType()),
        T.StructField("id_field", T.StringType()),
        T.StructField("url_template", T.StringType()),
        T.StructField("enabled", T.BooleanType()),
    ]
)

SELECTORS = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("description", T.StringType()),
    ]
)

SCRAPERS = T.StructType(
    [
        T.StructField("scraper_key", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("url_patterns", T.ArrayType(T.StringType())),
        T.StructField("selectors", SELECTORS),
        T.StructField("enabled", T.BooleanType()),
    ]
)

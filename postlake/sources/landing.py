"""Landed HTTP responses, as a batch or as a stream of new files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postlake.schema import JOBS, REFS, RESPONSES


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    """The postings table, with its schema given and not inferred."""
    return spark.read.schema(JOBS).parquet(path)


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RESPONSES).parquet(path)


def latest_per_url(responses: DataFrame, order: str = "fetched_at") -> DataFrame:
    """The last response of every URL. The rank filter also runs in each task
    before the shuffle, so a URL fetched very often leaves a task once."""
    # Ties are settled by the row's content, so a task that runs again takes the same one.
    content = F.xxhash64(*[F.col(c).cast("string") for c in responses.columns if c != "url"])
    rank = F.row_number().over(Window.partitionBy("url").orderBy(F.col(order).desc_nulls_last(), content))
    return responses.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")


def read_refs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REFS).parquet(path)


def stream_responses(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    return _stream(spark, path, RESPONSES, files_per_batch)


def stream_refs(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """New reference files in the order they land; this is the hand-off queue."""
    return _stream(spark, path, REFS, files_per_batch)


def _stream(spark: SparkSession, path: str, schema, files_per_batch: int | None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)

"""Postings stored for two ways of reading: one by its id, and a page of the listing at any depth.

Both are a table cut into ranges of a number, which is the id for the one and the place in the listing for the other. A
read works out the range that it needs, so it opens the files of that range alone, however large the table is.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlake.operators.filters import DETAIL, LIGHT, filter_jobs
from postlake.operators.ids import number_in_order
from postlake.operators.listing import Page, newest_first
from postlake.operators.versions import Versions

WIDTH = 100_000


def _write(rows: DataFrame, root: str, by: str, width: int, **settings) -> None:
    """The next version of a table, cut into ranges of ``width`` numbers of the column ``by``."""
    versions = Versions(rows.sparkSession, root)
    number = versions.newest() + 1
    cut = rows.withColumn("slot", F.floor(F.col(by) / width).cast("bigint"))
    # A range is one task's, sorted, so a range is one file and its row groups have narrow bounds.
    cut.repartitionByRange("slot").sortWithinPartitions("slot", by).write.mode("overwrite").partitionBy("slot").parquet(f"{root}/rows/v={number}")
    versions.commit(number, {"schema": rows.schema.json(), "width": width, "v": number} | settings)
    versions.forget(2, lambda state: [f"rows/v={state['v']}"])


def _open(spark: SparkSession, root: str) -> tuple[DataFrame, dict]:
    state = Versions(spark, root).read()
    schema = T.StructType.fromJson(json.loads(state["schema"])).add("slot", T.LongType())
    return spark.read.schema(schema).parquet(f"{root}/rows/v={state['v']}"), state


def write_by_id(jobs: DataFrame, root: str, width: int = WIDTH) -> None:
    """All postings, expired ones included, in ranges of ``width`` ids. Rows without an id are left out."""
    _write(jobs.where("id IS NOT NULL"), root, "id", width)


def lookup_stored(spark: SparkSession, root: str, job_id: int, columns: list[str] | None = None) -> DataFrame:
    """Zero or one row, as :func:`postlake.operators.filters.lookup_by_id`, from the files of one range."""
    rows, state = _open(spark, root)
    return rows.where((F.col("slot") == job_id // state["width"]) & (F.col("id") == job_id)).select(*(columns or DETAIL))


def write_listing(jobs: DataFrame, root: str, width: int = WIDTH) -> None:
    """The active postings with their place in the listing, from 0, newest first."""
    light = filter_jobs(jobs).select(*LIGHT, "last_seen_at")
    placed, last = number_in_order(light, *newest_first("last_seen_at"), start=0, name="place")
    _write(placed, root, "place", width, total=last + 1)


def stored_page(spark: SparkSession, root: str, page: Page) -> DataFrame:
    """A page of the whole listing, as :func:`postlake.operators.listing.list_page`, from the one or two ranges it lies in."""
    rows, state = _open(spark, root)
    low, high = page.offset, page.offset + page.page_size - 1
    slots = range(low // state["width"], high // state["width"] + 1)
    found = rows.where(F.col("slot").isin(*slots) & F.col("place").between(low, high)).orderBy("place")
    total = state["total"]
    return found.select(
        *LIGHT,
        F.lit(total).cast("bigint").alias("total"),
        F.lit(page.page).cast("bigint").alias("page"),
        F.lit(page.page_size).cast("bigint").alias("page_size"),
        F.lit(-(-total // page.page_size)).cast("bigint").alias("total_pages"),
    )

"""When a posting is gone: what each source listed, and when its crawls were whole.

A source is known by the key of its settings, which is also the name that references carry; the name that a stored
posting carries may be another, so expiry goes by source and id alone.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.functions.scalars import non_empty, ntz


def crawl_log(responses: DataFrame, errors: DataFrame) -> DataFrame:
    """``(source_key, crawled_at, complete)`` of one crawl, from its responses and the errors of reading them.

    A crawl is complete if the source answered and every one of its responses could be read. It counts as of its first
    response, as a posting may have come up after that.
    """
    failed = errors.select("source_key").distinct().withColumn("failed", F.lit(True))
    crawls = responses.groupBy("source_key").agg(F.min("fetched_at").alias("crawled_at")).join(failed, "source_key", "left")
    return crawls.select("source_key", "crawled_at", F.col("failed").isNull().alias("complete"))


def listing_intervals(log: DataFrame | None, refs: DataFrame) -> DataFrame:
    """``(source_key, external_id, first_at, last_at)``: when a source listed an id first and last.

    ``refs (source_key, external_id, fetched_at)`` is the newest crawl, whole or not. References that repeat meet as sums.
    """
    new = refs.where(non_empty("external_id")).select("source_key", "external_id", F.col("fetched_at").alias("first_at"), F.col("fetched_at").alias("last_at"))
    rows = new if log is None else log.select(*new.columns).unionByName(new)
    return rows.groupBy("source_key", "external_id").agg(F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))


def unlisted(log: DataFrame, crawls: DataFrame) -> DataFrame:
    """``external_id`` of those that every source that ever listed them has left out of a later complete crawl."""
    whole = crawls.where("complete").groupBy("source_key").agg(F.max("crawled_at").alias("crawled_at"))
    judged = log.join(whole, "source_key", "left")
    gone = F.coalesce(F.col("crawled_at") > F.col("last_at"), F.lit(False))
    return judged.groupBy("external_id").agg(F.bool_and(gone).alias("gone")).where("gone").select("external_id")


def expire_unlisted(stored: DataFrame, log: DataFrame, crawls: DataFrame, now: dt.datetime | Column) -> DataFrame:
    """Set ``expired_at`` of active postings that are :func:`unlisted`; a crawl that broke off expires nothing."""
    now = ntz(now) if isinstance(now, dt.datetime) else now
    gone = unlisted(log, crawls).select(F.col("external_id").alias("gone_id"))
    joined = stored.join(gone, F.col("external_id") == F.col("gone_id"), "left")
    ends = F.when(F.col("gone_id").isNotNull() & F.col("expired_at").isNull(), now).otherwise(F.col("expired_at"))
    return joined.select(*[ends.alias(c) if c == "expired_at" else F.col(c) for c in stored.columns])

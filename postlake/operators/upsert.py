"""Writes to the postings table.

The table is a folder of Parquet snapshots. An upsert reads one snapshot and
writes the next, never the path it reads. On a repeated ``external_id`` only
``last_seen_at`` moves; every other column stays as first written.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlake.functions.scalars import content_hash, ntz, valid_details
from postlake.operators.ids import number_in_order

WRITTEN = ["external_id", "company_name", "url", "title", "location", "description"]


class InvalidBatch(ValueError):
    """A batch with a row that lacks a required field."""


class DuplicateKey(ValueError):
    """An insert of an ``external_id`` that is stored, or given twice."""


def check_batch(batch: DataFrame, mode: str = "fail") -> tuple[DataFrame, DataFrame | None]:
    """Split a batch into good and bad rows.

    ``fail`` rejects the whole batch when one row is bad; ``quarantine`` hands
    the bad rows back. An empty batch passes.
    """
    good, bad = batch.where(valid_details()), batch.where(~valid_details())
    if mode == "quarantine":
        return good, bad
    if mode != "fail":
        raise ValueError(f"unknown mode: {mode}")
    row = bad.select("external_id").first()
    if row is not None:
        raise InvalidBatch(f"invalid job details in batch: missing required fields for job {row[0]}")
    return batch, None


def accepted(batch: DataFrame) -> DataFrame:
    """The rows of an all-or-nothing batch: all of them, or none.

    The verdict is a scalar subquery over one aggregated row, so the check
    stays lazy and costs one extra pass over four columns.
    """
    bad = batch.agg(F.count_if(~valid_details()).alias("bad")).scalar()
    return batch.where(bad == 0)


def first_per_key(batch: DataFrame, *order: str) -> DataFrame:
    """One row per ``external_id``, the lowest by ``order`` (``seq`` if none is given).

    The rank filter is applied per task before the shuffle as well, so a hot key
    leaves each task as one row.
    """
    rank = F.row_number().over(Window.partitionBy("external_id").orderBy(*(order or ("seq",))))
    return batch.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")


def incoming_columns(schema: T.StructType, now: Column) -> list[Column]:
    """The columns of a new posting; what a batch doesn't bring is null."""
    out = []
    for field in schema.fields:
        name = field.name
        if name in WRITTEN:
            out.append(F.col(name))
        elif name in ("first_seen_at", "last_seen_at", "created_at", "updated_at"):
            out.append(now.alias(name))
        else:
            out.append(F.lit(None).cast(field.dataType).alias(name))
    return out


def upsert(stored: DataFrame, incoming: DataFrame, now: dt.datetime | Column) -> DataFrame:
    """The next snapshot. Of incoming rows that repeat an ``external_id`` the first counts,
    by ``seq`` if there is one, else by url and title.

    Written as a left join of the stored rows with the incoming keys, plus an
    anti join for the new rows. Unlike a full outer join, both can broadcast
    the small side when its measured size allows it, so a small batch moves no
    stored row. The stored side of the anti join reads the key column alone.
    If there is an ``id``, new rows get those behind the greatest stored one, in
    order of ``external_id``; for a table that is written again and again,
    :class:`postlake.operators.store.PostingStore` keeps the greatest.
    """
    now = ntz(now) if isinstance(now, dt.datetime) else now
    incoming = first_per_key(incoming, *(["seq"] if "seq" in incoming.columns else ["url", "title"]))
    keys = incoming.select("external_id", F.lit(True).alias("_seen"))
    touched = stored.join(keys, "external_id", "left")
    kept = touched.select(
        *[
            F.when(F.col("_seen"), now).otherwise(F.col("last_seen_at")).alias("last_seen_at")
            if c == "last_seen_at"
            else F.col(c)
            for c in stored.columns
        ]
    )
    new = incoming.join(stored.select("external_id"), "external_id", "left_anti")
    new = new.select(*incoming_columns(stored.schema, now))
    if "id" in stored.columns:
        high = stored.agg(F.max("id")).first()[0] or 0
        new, _ = number_in_order(new, "external_id", start=high + 1)
    return kept.unionByName(new)


def upsert_keys(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """What an upsert would do with each key: ``insert``, ``touch`` or ``keep``."""
    a = stored.select("external_id", F.lit(True).alias("_old"))
    b = incoming.select("external_id", F.lit(True).alias("_new"))
    both = a.join(b, "external_id", "full_outer")
    action = (
        F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "keep").otherwise("touch")
    )
    return both.select("external_id", action.alias("action"))


def merge_upsert(incoming: DataFrame, table: str, now: dt.datetime) -> None:
    """The same upsert as one MERGE, for catalog tables whose format has it.

    Parquet tables do not; for those write the result of :func:`upsert`.
    """
    stamped = ("first_seen_at", "last_seen_at", "created_at", "updated_at")
    new_row = {}
    for field in incoming.sparkSession.table(table).schema.fields:
        if field.name in WRITTEN:
            new_row[field.name] = F.col(f"incoming.{field.name}")
        elif field.name in stamped:
            new_row[field.name] = ntz(now)
    same = F.col(f"{table}.external_id") == F.col("incoming.external_id")
    merge = incoming.alias("incoming").mergeInto(table, same)
    merge = merge.whenMatched().update({"last_seen_at": ntz(now)})
    merge.whenNotMatched().insert(new_row).merge()


def clashing_keys(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Keys that stop an insert: stored already, or twice in the batch."""
    twice = batch.groupBy("external_id").agg(F.count(F.lit(1)).alias("n"))
    held = twice.join(stored.select("external_id"), "external_id", "left_semi")
    return (
        held.select("external_id", F.lit("stored").alias("reason"))
        .unionByName(twice.where("n > 1").select("external_id", F.lit("repeated").alias("reason")))
    )


def insert(path: str, batch: DataFrame, stored: DataFrame) -> None:
    """Append; any clash refuses the whole batch."""
    row = clashing_keys(stored, batch).first()
    if row is not None:
        raise DuplicateKey(f"external_id {row['external_id']} is {row['reason']}")
    batch.select(*stored.columns).write.mode("append").parquet(path)


def expire_missing(stored: DataFrame, crawled: DataFrame, now: dt.datetime | Column) -> DataFrame:
    """Set ``expired_at`` on active postings that the latest crawl of their
    company did not list. Companies without a crawl are left alone."""
    now = ntz(now) if isinstance(now, dt.datetime) else now
    listed = crawled.select("external_id").distinct().withColumn("_listed", F.lit(True))
    companies = crawled.select("company_name").distinct().withColumn("_crawled", F.lit(True))
    joined = stored.join(listed, "external_id", "left").join(companies, "company_name", "left")
    gone = F.col("_crawled").isNotNull() & F.col("_listed").isNull() & F.col("expired_at").isNull()
    return joined.select(
        *[
            F.when(gone, now).otherwise(F.col("expired_at")).alias(c) if c == "expired_at" else F.col(c)
            for c in stored.columns
        ]
    )


def changed_content(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored postings whose content hash differs from the incoming one."""
    a = stored.select("external_id", content_hash().alias("old_hash"))
    b = incoming.select("external_id", content_hash().alias("new_hash"))
    return a.join(b, "external_id").where(F.col("old_hash") != F.col("new_hash"))

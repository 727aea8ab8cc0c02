"""The stored table of postings, written batch by batch.

A posting never changes but for the time it was last seen, and its expiry. So a batch adds files and rewrites none: new
postings go to ``rows``, the ids of known ones with their new times to ``marks``. Both lie by buckets of the id's hash, so
a batch that touches few buckets reads few. A state names the folders that count; ``merge`` folds the marks of buckets that
hold any into their rows, and leaves the other buckets' files alone.

Ids are numbers without a gap, in order of arrival and, within a batch, of ``external_id``. The state keeps the greatest.
"""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlake.functions.scalars import non_empty, ntz
from postlake.operators.ids import number_in_order
from postlake.operators.upsert import first_per_key, incoming_columns
from postlake.operators.versions import Versions
from postlake.session import cut_lineage

BUCKETS = 64
_MARKS = "external_id string, id bigint, seen_at timestamp_ntz, expired_at timestamp_ntz, bucket int, v bigint"


class PostingStore:
    """A table below ``root``; ``schema`` has ``id``, ``external_id``, ``last_seen_at`` and ``expired_at``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.versions = spark, root.rstrip("/"), Versions(spark, root)
        self.refresh()

    @classmethod
    def create(cls, first: DataFrame, root: str, buckets: int = BUCKETS) -> PostingStore:
        """A table that holds ``first``, whose ids stay. A table that is there is opened as it is."""
        spark, versions = first.sparkSession, Versions(first.sparkSession, root)
        if versions.newest() < 0:
            state = {"schema": first.schema.json(), "buckets": buckets, "rows": {}, "marks": [], "high": 0, "batches": {}}
            rows = first.withColumn("bucket", bucket_of(buckets))
            rows.hint("rebalance", F.col("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/rows/v=0")
            written = spark.read.schema(first.schema).parquet(f"{root}/rows/v=0")
            state["rows"] = {"0": None}
            state["high"] = written.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
            versions.commit(0, state)
        return cls(spark, root)

    def refresh(self) -> None:
        self.state = self.versions.read()
        self.schema = T.StructType.fromJson(json.loads(self.state["schema"]))

    def _rows(self, columns: list[str] | None = None, state: dict | None = None) -> DataFrame:
        """Postings as first written, with ``bucket`` and the version ``v`` that wrote them.

        A folder that a later merge replaced in some buckets counts in the others only.
        """
        state = state or self.state
        schema = T.StructType([*self.schema.fields, T.StructField("v", T.LongType()), T.StructField("bucket", T.IntegerType())])
        paths = [f"{self.root}/rows/v={v}" for v in state["rows"]]
        rows = self.spark.read.schema(schema).option("basePath", f"{self.root}/rows").parquet(*paths)
        for v, replaced in state["rows"].items():
            if replaced:
                rows = rows.where((F.col("v") != int(v)) | ~F.col("bucket").isin(*replaced))
        return rows.select(*(columns or schema.names))

    def _marks(self, state: dict | None = None) -> DataFrame | None:
        """The latest times of each id that a batch has marked since its bucket was merged."""
        state = state or self.state
        if not state["marks"]:
            return None
        paths = [f"{self.root}/marks/v={v}" for v in state["marks"]]
        rows = self.spark.read.schema(_MARKS).option("basePath", f"{self.root}/marks").parquet(*paths)
        return rows.groupBy("external_id", "bucket").agg(
            F.max_by("seen_at", "v").alias("seen_at"), F.max_by("expired_at", "v").alias("gone_at")
        )

    def table(self, number: int | None = None) -> DataFrame:
        """All postings, at the newest state or an earlier one that is kept."""
        state = self.state if number is None else self.versions.read(number)
        return _with_marks(self._rows(state=state), self._marks(state)).select(*self.schema.names)

    def apply(self, batch: DataFrame, now: dt.datetime, label: str | None = None) -> None:
        """Upsert a batch: unknown ids are added, known ones only marked as seen at ``now``.

        ``label`` names the batch; one that was applied already is left out, so a batch may be handed in again. Rows
        without an ``external_id`` are left out; of rows that repeat one, the first counts.
        """
        self.refresh()
        if label is not None and label in self.state["batches"]:
            return
        number = self.versions.newest() + 1
        order = ["seq"] if "seq" in batch.columns else ["url", "title"]
        batch = first_per_key(batch.where(non_empty("external_id")), *order).withColumn("bucket", bucket_of(self.state["buckets"]))
        batch = cut_lineage(batch, "store-batch")
        # The buckets of the batch are few where the batch is small: the scan of the ids prunes to them.
        touched = [r.bucket for r in batch.select("bucket").distinct().collect()]
        known = self._rows(["external_id", "id", "bucket"]).where(F.col("bucket").isin(*touched))
        new = batch.join(known.select("external_id"), "external_id", "left_anti")
        added = cut_lineage(new.select(*incoming_columns(self.schema, ntz(now)), "bucket"), "store-new")
        numbered, high = number_in_order(added, "external_id", start=self.state["high"] + 1)
        numbered.select(*self.schema.names, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/rows/v={number}")
        seen = known.join(batch.select("external_id"), "external_id", "left_semi")
        if self.state["marks"]:
            # An expiry that an earlier batch has marked stays.
            gone = self._marks().select("external_id", "gone_at")
            seen = seen.join(gone, "external_id", "left")
        else:
            seen = seen.withColumn("gone_at", F.lit(None).cast("timestamp_ntz"))
        marks = seen.select("external_id", "id", ntz(now).alias("seen_at"), F.col("gone_at").alias("expired_at"), "bucket")
        self._write_marks(marks, number)
        batches = self.state["batches"] | ({label: number} if label is not None else {})
        self._commit(number, rows=self.state["rows"] | {str(number): None}, marks=[*self.state["marks"], number], high=high, batches=batches)

    def expire(self, ids: DataFrame, now: dt.datetime) -> None:
        """Set ``expired_at`` of the active postings among ``ids`` (column external_id)."""
        self.refresh()
        number = self.versions.newest() + 1
        active = self.table().where("expired_at IS NULL").select("external_id", "id", "last_seen_at")
        gone = active.join(ids.select("external_id"), "external_id", "left_semi").withColumn("bucket", bucket_of(self.state["buckets"]))
        self._write_marks(gone.select("external_id", "id", F.col("last_seen_at").alias("seen_at"), ntz(now).alias("expired_at"), "bucket"), number)
        self._commit(number, marks=[*self.state["marks"], number])

    def _write_marks(self, marks: DataFrame, number: int) -> None:
        marks.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/marks/v={number}")

    def merge(self, keep: int = 1) -> None:
        """Fold the marks into the rows of their buckets; states but the last ``keep`` go, with files that none names."""
        self.refresh()
        marks, number = self._marks(), self.versions.newest() + 1
        touched = [] if marks is None else sorted(r.bucket for r in marks.select("bucket").distinct().collect())
        rows = self.state["rows"]
        if touched:
            live = self._rows().where(F.col("bucket").isin(*touched))
            merged = _with_marks(live, marks).select(*self.schema.names, "bucket")
            merged.hint("rebalance", F.col("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/rows/v={number}")
            rows = {v: sorted({*(replaced or []), *touched}) for v, replaced in rows.items()}
            rows = {v: r for v, r in rows.items() if len(r) < self.state["buckets"]} | {str(number): None}
        self._commit(number, rows=rows, marks=[])
        self.versions.forget(keep, _folders)

    def _commit(self, number: int, **changed) -> None:
        state = self.state | changed
        self.versions.commit(number, state)
        self.state = state


def _folders(state: dict) -> list[str]:
    return [f"rows/v={v}" for v in state["rows"]] + [f"marks/v={v}" for v in state["marks"]]


def bucket_of(buckets: int):
    return F.pmod(F.xxhash64("external_id"), F.lit(buckets)).cast("int")


def _with_marks(rows: DataFrame, marks: DataFrame | None) -> DataFrame:
    if marks is None:
        return rows
    last = marks.select(F.col("external_id").alias("marked"), "seen_at", "gone_at")
    joined = rows.join(last, F.col("external_id") == F.col("marked"), "left")
    new = {"last_seen_at": F.coalesce("seen_at", "last_seen_at"), "expired_at": F.coalesce("gone_at", "expired_at")}
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in rows.columns])

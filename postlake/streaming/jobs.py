"""The continuous path: references in, labels, postings and counters out.

What is known of an id lives in the state store. What a micro-batch writes is
named after its number, so a batch that is run again replaces it.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from postlake.functions.scalars import non_empty
from postlake.operators.dedup import first_arrivals
from postlake.operators.store import BUCKETS, PostingStore
from postlake.operators.versions import Versions
from postlake.streaming.ttl_state import ROCKSDB, TtlState

SALTS = 8


def start(
    stream: DataFrame,
    checkpoint: str,
    each_batch: Callable[[DataFrame, int], None] | None = None,
    out: str | None = None,
    every: str | None = None,
    output_mode: str = "append",
) -> StreamingQuery:
    """Start a query at once and then ``every`` interval; with none given, run
    through what is there and stop.

    :class:`Labels` and its kin add their own stateful part to the stream.
    """
    settings: dict[str, str] = {}
    if isinstance(each_batch, Labels):
        stream, settings = each_batch.marked(stream), each_batch.settings
    writer = stream.writeStream.option("checkpointLocation", checkpoint).outputMode(output_mode)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    writer = writer.foreachBatch(each_batch) if each_batch is not None else writer.format("parquet").option("path", out)
    conf = stream.sparkSession.conf
    before = {k: conf.get(k, None) for k in settings}
    try:  # a query keeps the settings that it is started with
        for key, value in settings.items():
            conf.set(key, value)
        return writer.start()
    finally:
        for key, value in before.items():
            conf.unset(key) if value is None else conf.set(key, value)


def _dedup_key() -> Column:
    """The id; an arrival without one is its own key and so passes."""
    return F.when(non_empty("external_id"), F.col("external_id")).otherwise(
        F.concat(F.lit("\u0000"), F.col("seq").cast("string"))
    )


def stream_dedup(refs: DataFrame, salts: int = SALTS) -> DataFrame:
    """The first row of every non-empty id, for ever; rows with no id pass.

    Two stages: the first drops repeats per (id, salt), so a hot id is spread
    over ``salts`` tasks; the second then sees it ``salts`` times at most.
    """
    keyed = refs.withColumn("_key", _dedup_key())
    if salts > 1:
        salt = F.pmod(F.xxhash64("seq"), F.lit(salts))
        keyed = keyed.withColumn("_salt", salt).dropDuplicates(["_key", "_salt"]).drop("_salt")
    return keyed.dropDuplicates(["_key"]).drop("_key")


def stream_dedup_within(refs: DataFrame, ts: str = "ts", ttl: str = "24 hours") -> DataFrame:
    """Dedup with state that is dropped: repeats within ``ttl`` are surely
    removed, later ones may be; rows with no id pass. For an exact period use
    :class:`TtlLabels`."""
    keyed = refs.withColumn("_key", _dedup_key()).withWatermark(ts, ttl)
    return keyed.dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def stream_status_counts(results: DataFrame) -> DataFrame:
    """Running counts per status; write in ``complete`` mode."""
    return results.groupBy("status").agg(
        F.count(F.lit(1)).alias("n"), F.sum("processing_ms").alias("total_processing_ms")
    )


class Labels:
    """Label each reference as first or duplicate without dropping any.

    Which ids are known is keyed state of the stream: beside the rows themselves
    a stateful branch lets the rows of new ids through, and a batch is labelled
    by joining the two. No batch reads what earlier ones wrote. A batch that is
    run again finds the state it started from, and replaces its labels.
    """

    settings: dict[str, str] = {}

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def marks(self, refs: DataFrame) -> DataFrame:
        """``(external_id, seq)`` of a row of each id that no earlier batch had."""
        return stream_dedup(refs.where(non_empty("external_id"))).select("external_id", "seq")

    def marked(self, refs: DataFrame) -> DataFrame:
        """The stream of the rows and, beside them, of the marks."""
        rows = refs.select(F.struct(*refs.columns).alias("row"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("bigint").alias("at"))
        empty = F.lit(None).cast(rows.schema["row"].dataType).alias("row")
        return rows.unionByName(self.marks(refs).select(empty, F.col("external_id").alias("id"), F.col("seq").cast("bigint").alias("at")))

    def firsts(self, rows: DataFrame, marks: DataFrame) -> DataFrame:
        """``(external_id, seq)`` of the batch's rows that are no duplicates: of a new id, its earliest."""
        return first_arrivals(rows).join(marks.select(F.col("id").alias("external_id")), "external_id", "left_semi")

    def may_repeat(self) -> Column:
        """Whether a row can be a duplicate at all."""
        return non_empty("external_id")

    def __call__(self, batch: DataFrame, number: int) -> None:
        path = f"{self.root}/landed/batch={number}"
        # One pass through the stream's state; the labels are made from what it wrote.
        batch.withColumn("is_mark", F.col("row").isNull()).write.mode("overwrite").partitionBy("is_mark").parquet(path)
        landed = self.spark.read.schema(T.StructType([*batch.schema.fields, T.StructField("is_mark", T.BooleanType())])).parquet(path)
        rows = landed.where("NOT is_mark").select("row.*")
        first = self.firsts(rows, landed.where("is_mark").select("id", "at")).select(
            F.col("external_id").alias("id"), F.col("seq").alias("at"), F.lit(True).alias("is_first")
        )
        joined = rows.join(first, (F.col("external_id") == F.col("id")) & (F.col("seq") == F.col("at")), "left")
        flag = self.may_repeat() & F.col("is_first").isNull()
        labelled = joined.select(*rows.columns, flag.alias("is_duplicate"))
        labelled.write.mode("overwrite").parquet(f"{self.root}/labels/batch={number}")
        Versions(self.spark, self.root).drop(f"landed/batch={number}")

    def result(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/labels").drop("batch")


class TtlLabels(Labels):
    """As :class:`Labels`, but an id counts as seen for ``ttl`` after it was
    accepted, and not for ever. Needs the event time ``ts``.

    Each id's state is when it was last accepted; a timer drops it once the
    watermark, ``late`` behind the newest row, has passed the end of ``ttl``.
    Rows that come later than that are labelled as duplicates; rows without a
    time pass, and bar nothing.
    """

    settings = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB}

    def __init__(self, spark: SparkSession, root: str, ttl: dt.timedelta = dt.timedelta(hours=24), late: str = "1 hour"):
        super().__init__(spark, root)
        self.ttl, self.late = ttl, late

    def marks(self, refs: DataFrame) -> DataFrame:
        rows = refs.where(non_empty("external_id") & F.col("ts").isNotNull())
        time = F.col("ts").cast("timestamp")
        rows = rows.select("external_id", F.col("seq").cast("bigint").alias("seq"), F.unix_micros(time).alias("us"), time.alias("event_time"))
        keyed = rows.withWatermark("event_time", self.late).groupBy("external_id")
        schema = "external_id string, seq bigint"
        return keyed.transformWithStateInPandas(TtlState(self.ttl // dt.timedelta(microseconds=1)), schema, "Append", "EventTime")

    def firsts(self, rows: DataFrame, marks: DataFrame) -> DataFrame:
        return marks.select(F.col("id").alias("external_id"), F.col("at").alias("seq"))

    def may_repeat(self) -> Column:
        return non_empty("external_id") & F.col("ts").isNotNull()


class Upserts:
    """Upsert each batch of postings into a :class:`PostingStore` below ``root``.

    A batch writes its own rows and marks. It is named by its number, so one
    that is run again changes nothing; ``now`` is a function of the number. The
    marks are merged into the rows every ``merge_every`` batches.
    """

    def __init__(
        self, spark: SparkSession, root: str, first: DataFrame, now: Callable[[int], dt.datetime], merge_every: int = 50, buckets: int = BUCKETS
    ):
        self.now, self.merge_every = now, merge_every
        self.store = PostingStore.create(first, root, buckets)

    def __call__(self, batch: DataFrame, number: int) -> None:
        self.store.apply(batch, self.now(number), f"batch-{number}")
        if number % self.merge_every == self.merge_every - 1:
            self.store.merge()

    def result(self) -> DataFrame:
        self.store.refresh()
        return self.store.table()

"""Dedup that forgets: an id may pass again once ``ttl`` has gone by."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlake.functions.scalars import non_empty, ntz
from postlake.session import cut_lineage, scratch_path

STATE = "external_id string, accepted_at timestamp_ntz"


def _no_rows(spark: SparkSession, schema: str) -> DataFrame:
    """An empty relation that the optimizer sees through."""
    columns = ", ".join(f"CAST(NULL AS {t}) AS {c}" for c, t in (f.split() for f in schema.split(", ")))
    return spark.sql(f"SELECT {columns} WHERE false")


def _stretch(low: dt.datetime, ttl: dt.timedelta) -> Column:
    """Whole periods of ``ttl`` from ``low`` to ``ts``."""
    since = F.col("ts") - ntz(low)
    part = lambda unit: F.extract(F.lit(unit), since).cast("long")
    seconds = ((part("DAY") * 24 + part("HOUR")) * 60 + part("MINUTE")) * 60
    micros = seconds * 1_000_000 + (F.extract(F.lit("SECOND"), since) * 1_000_000).cast("long")
    return F.call_function("div", micros, F.lit(ttl // dt.timedelta(microseconds=1)).cast("long"))


def accept_with_ttl(
    refs: DataFrame, state: DataFrame | None, ttl: dt.timedelta
) -> tuple[DataFrame, DataFrame]:
    """Label ``refs(external_id, seq, ts, ...)`` and return the new state.

    A row is accepted when its id was never accepted, or last ``ttl`` or more
    ago; the period runs from the accepted row, and repeats do not extend it.

    Time is cut into stretches of one ``ttl``. Within one an id is accepted once
    at most, namely at its earliest row that is late enough, which is a minimum
    with partial sums; so a hot id is no load on any one task. Only rows of the
    stretch before can still bar a row, so each step reads what the last one
    wrote and nothing older. Only stretches that have rows are visited, each
    reading its own part of the written rows. A micro-batch spans one or two.
    """
    spark = refs.sparkSession
    first = state if state is not None else _no_rows(spark, STATE)
    keyed = refs.where(non_empty("external_id") & F.col("ts").isNotNull()).select("external_id", "seq", "ts")
    low = keyed.agg(F.min("ts")).first()[0]
    period = F.make_dt_interval(secs=F.lit(ttl.total_seconds()))
    taken: list[DataFrame] = []
    if low is not None:
        path = scratch_path(spark, "ttl-stretches")
        keyed.withColumn("stretch", _stretch(low, ttl)).write.partitionBy("stretch").parquet(path)
        keyed = spark.read.schema(T.StructType([*keyed.schema, T.StructField("stretch", T.LongType())])).parquet(path)
        before = None
        for (stretch,) in keyed.select("stretch").distinct().orderBy("stretch").collect():
            part = keyed.where(F.col("stretch") == stretch)
            bars = first.where(F.col("accepted_at") > ntz(low + stretch * ttl) - period)
            if before == stretch - 1:
                bars = bars.unionByName(taken[-1].select("external_id", F.col("ts").alias("accepted_at")))
            last = bars.groupBy("external_id").agg(F.max("accepted_at").alias("accepted_at"))
            known = part.join(last, "external_id", "left")
            free = known.where(F.col("accepted_at").isNull() | (F.col("ts") >= F.col("accepted_at") + period))
            found = free.groupBy("external_id").agg(F.min(F.struct("ts", "seq")).alias("m"))
            taken.append(cut_lineage(found.select("external_id", "m.ts", "m.seq"), "ttl-accepted"))
            before = stretch
    accepted = _no_rows(spark, "external_id string, ts timestamp_ntz, seq bigint")
    for t in taken:
        accepted = accepted.unionByName(t)
    marks = accepted.select("external_id", "seq", F.lit(True).alias("_ok"))
    joined = refs.join(marks, ["external_id", "seq"], "left")
    # A row without a time can't be placed; it passes, and bars nothing.
    flag = non_empty("external_id") & F.col("ts").isNotNull() & F.col("_ok").isNull()
    labelled = joined.select(*[joined[c] for c in refs.columns], flag.alias("is_duplicate"))
    every = first.unionByName(accepted.select("external_id", F.col("ts").alias("accepted_at")))
    return labelled, every.groupBy("external_id").agg(F.max("accepted_at").alias("accepted_at"))

"""What a log of fetch attempts amounts to."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlake.functions.scalars import classify_error

# Fixed value: attempts made before giving up.
MAX_ATTEMPTS = 3


def with_error(log: DataFrame) -> DataFrame:
    """Adds ``error``, null for HTTP 200."""
    message = F.concat(F.lit("received non-OK status code: "), F.col("status_code").cast("string"))
    return log.withColumn("error", F.when(F.col("status_code") != 200, message))


def split_status(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Responses that go on, and those that failed with their error."""
    marked = with_error(responses)
    return marked.where("error IS NULL").drop("error"), marked.where("error IS NOT NULL")


def resolve_attempts(log: DataFrame, key: str = "job_key", order: str = "attempt_seq") -> DataFrame:
    """The outcome per key: at most three attempts, ended by the first success
    or by an error that no attempt can mend.

    The rank filter runs in each task before the shuffle, so what is grouped is
    three rows per key and task, however long a key's log is.
    """
    w = Window.partitionBy(key).orderBy(order)
    made = (
        log.select(key, order, "error")
        .withColumn("attempt", F.row_number().over(w))
        .where(F.col("attempt") <= MAX_ATTEMPTS)
    )
    ends = F.col("error").isNull() | (classify_error("error") == "final")
    before = F.max(ends).over(w.rowsBetween(Window.unboundedPreceding, -1))
    used = made.withColumn("_done", F.coalesce(before, F.lit(False))).where(~F.col("_done"))
    out = used.groupBy(key).agg(
        F.count(F.lit(1)).alias("attempts"),
        F.max_by(F.struct("error"), F.col("attempt")).alias("last"),
    )
    error = F.col("last.error")
    return out.select(
        key,
        "attempts",
        F.when(error.isNull(), "success").otherwise("failed").alias("status"),
        F.when(
            error.isNotNull(), F.concat(F.lit(f"failed after {MAX_ATTEMPTS} attempts: "), error)
        ).alias("error"),
    )

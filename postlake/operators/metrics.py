"""Counters over processing results, discovery cycles, fetches and scrapes.

Every one is a plain aggregate with partial sums in front of the shuffle, so a
company that holds a third of the rows sends one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _percent(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(100.0 * part, whole), F.lit(0.0))


def _rate_columns() -> list[Column]:
    n = F.col("jobs_processed")
    total = F.col("total_processing_ms")
    return [
        F.coalesce(F.try_divide(total, n), F.lit(0.0)).alias("average_processing_ms"),
        _percent(F.col("jobs_successful"), n).alias("success_rate"),
        _percent(F.col("jobs_failed"), n).alias("error_rate"),
        F.coalesce(F.try_divide(n, total / 60000.0), F.lit(0.0)).alias("processing_rate"),
    ]


def processing_metrics(results: DataFrame, *by: str) -> DataFrame:
    """Counts, times and rates over all results, or per ``by`` columns.

    Duplicates count as processed. The rate is per minute of busy time.
    """
    status = F.col("status")
    counts = results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("jobs_processed"),
        F.count_if(status == "success").alias("jobs_successful"),
        F.count_if(status == "failed").alias("jobs_failed"),
        F.count_if(status == "duplicate").alias("jobs_duplicate"),
        F.coalesce(F.sum("processing_ms"), F.lit(0.0)).alias("total_processing_ms"),
        F.max("ts").alias("last_processed_at"),
    )
    return counts.select("*", *_rate_columns())


def success_rate(results: DataFrame) -> DataFrame:
    return processing_metrics(results).select("success_rate")


def processing_rate(results: DataFrame) -> DataFrame:
    return processing_metrics(results).select("processing_rate")


def discovery_metrics(refs: DataFrame) -> DataFrame:
    """Over discovered references with ``cycle_id`` and ``discovered_at``."""
    per_cycle = refs.groupBy("cycle_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("discovered_at").alias("at")
    )
    return per_cycle.agg(
        F.count(F.lit(1)).alias("discovery_cycles"),
        F.max("at").alias("last_discovery_at"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_discovered"),
    )


def discovered_by_company(refs: DataFrame) -> DataFrame:
    return refs.groupBy("company_name").agg(F.count(F.lit(1)).alias("discovered"))


def fetch_metrics(fetches: DataFrame) -> DataFrame:
    """Per company and fetch type; duration and jobs found are last values.

    Expects ``company_name, fetch_type, error_type, duration_ms, jobs_found,
    seq``; ``error_type`` is null for a fetch that went well.
    """
    ok = F.col("error_type").isNull()
    return fetches.groupBy("company_name", "fetch_type").agg(
        F.count(F.lit(1)).alias("fetch_total"),
        F.count_if(~ok).alias("fetch_errors"),
        F.max_by("duration_ms", "seq").alias("last_duration_ms"),
        F.max_by(F.when(ok, F.col("jobs_found")), F.when(ok, F.col("seq"))).alias("jobs_found"),
    )


def scrape_metrics(scrapes: DataFrame) -> DataFrame:
    """Per company: attempts, failures, last duration."""
    return scrapes.groupBy("company_name").agg(
        F.count(F.lit(1)).alias("scrape_total"),
        F.count_if(F.col("error_type").isNotNull()).alias("scrape_errors"),
        F.max_by("duration_ms", "seq").alias("last_duration_ms"),
    )


def errors_by_type(log: DataFrame, *by: str) -> DataFrame:
    return (
        log.where(F.col("error_type").isNotNull())
        .groupBy(*by, "error_type")
        .agg(F.count(F.lit(1)).alias("errors"))
    )


def queue_size(refs: DataFrame, processed: DataFrame) -> DataFrame:
    """References that wait: discovered rows without a processed row."""
    waiting = refs.join(processed.select("seq"), "seq", "left_anti")
    return waiting.agg(F.count(F.lit(1)).alias("queue_size"))

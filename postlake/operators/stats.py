"""Per-company aggregates and the dashboard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.operators.filters import active
from postlake.operators.listing import recent_jobs
from postlake.operators.metrics import processing_metrics


def company_stats(jobs: DataFrame) -> DataFrame:
    """Counts per company, busiest first. Partial sums run before the shuffle."""
    return (
        jobs.groupBy("company_name")
        .agg(
            F.count(F.lit(1)).alias("job_count"),
            F.max("last_seen_at").alias("last_updated"),
            F.count_if(active()).alias("active_jobs"),
            F.count_if(~active()).alias("expired_jobs"),
        )
        .orderBy(F.desc("active_jobs"), F.desc("job_count"), F.asc("company_name"))
    )


def count_by_company(jobs: DataFrame) -> DataFrame:
    return jobs.where(active()).groupBy("company_name").agg(F.count(F.lit(1)).alias("job_count"))


def total_active(jobs: DataFrame) -> DataFrame:
    return jobs.where(active()).agg(F.count(F.lit(1)).alias("total"))


def dashboard_summary(jobs: DataFrame, results: DataFrame, recent: int = 10) -> DataFrame:
    """The dashboard as rows: ``section`` says which part a row belongs to.

    One document would have to gather every company into one value; rows keep
    the company part as wide as it is. The total is summed from the company
    part, so the postings are scanned once for both.
    """
    stats = company_stats(jobs)
    none_text = F.lit(None).cast("string")
    none_long = F.lit(None).cast("bigint")
    none_time = F.lit(None).cast("timestamp_ntz")
    none_real = F.lit(None).cast("double")

    def rows(df: DataFrame, section: str, **given) -> DataFrame:
        blank = {
            "company_name": none_text,
            "job_id": none_long,
            "title": none_text,
            "location": none_text,
            "at": none_time,
            "job_count": none_long,
            "active_jobs": none_long,
            "expired_jobs": none_long,
            "value": none_real,
        }
        cols = [given.get(name, default).alias(name) for name, default in blank.items()]
        return df.select(F.lit(section).alias("section"), *cols)

    total = stats.agg(F.coalesce(F.sum("active_jobs"), F.lit(0)).alias("n"))
    rate = processing_metrics(results)
    parts = [
        rows(total, "total_jobs", value=F.col("n").cast("double")),
        rows(rate, "success_rate", value=F.col("success_rate")),
        rows(
            recent_jobs(jobs, recent),
            "recent_jobs",
            company_name=F.col("company_name"),
            job_id=F.col("id"),
            title=F.col("title"),
            location=F.col("location"),
            at=F.col("first_seen_at"),
        ),
        rows(
            stats,
            "company_stats",
            company_name=F.col("company_name"),
            at=F.col("last_updated"),
            job_count=F.col("job_count"),
            active_jobs=F.col("active_jobs"),
            expired_jobs=F.col("expired_jobs"),
        ),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out

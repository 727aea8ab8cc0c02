"""Pages, top-k lists and counts over the postings table."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.functions.scalars import ntz
from postlake.operators.filters import JobFilters, filter_jobs, project_light


@dataclass(frozen=True)
class Page:
    page: int
    page_size: int

    @property
    def offset(self) -> int:
        return (self.page - 1) * self.page_size


def page_params(page: object = None, page_size: object = None) -> Page:
    """Numbers below 1 fall back to page 1 and 20 rows, and so do sizes over 100."""

    def number(value: object) -> int:
        try:
            return int(str(value))
        except ValueError:
            return 0

    p, size = number(page), number(page_size)
    return Page(max(p, 1), size if 1 <= size <= 100 else 20)


def total_pages(total: Column, page_size: int) -> Column:
    return F.ceil(total / F.lit(page_size))


def newest_first(column: str) -> list[Column]:
    """Descending with unknown times on top; the id makes pages stable."""
    return [F.col(column).desc_nulls_first(), F.col("id").asc()]


def count_rows(df: DataFrame, name: str = "total") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def with_totals(page_rows: DataFrame, counted: DataFrame, page: Page) -> DataFrame:
    """Attach the count as an uncorrelated scalar subquery, with no join."""
    total = count_rows(counted).scalar()
    return page_rows.select(
        "*",
        total.alias("total"),
        F.lit(page.page).cast("bigint").alias("page"),
        F.lit(page.page_size).cast("bigint").alias("page_size"),
        total_pages(total, page.page_size).cast("bigint").alias("total_pages"),
    )


def list_page(
    jobs: DataFrame, filters: JobFilters | None = None, page: Page = Page(1, 20), analyzer: str = "english", postings=None
) -> DataFrame:
    """One page of the filtered listing with the total on every row.

    With a ``search`` among the filters it is the page of that search, best
    first, and no other filter counts; ``analyzer`` and ``postings`` are then as
    for :func:`postlake.operators.search.search_page`.

    The sort is a top-(offset + size) per task, merged at the end. Walk deep
    with :func:`list_after`, or read a stored listing
    (:func:`postlake.operators.stored_listing.stored_page`).
    """
    if filters is not None and filters.search:
        from postlake.operators.search import search_page

        return search_page(jobs, filters.search, page, analyzer, postings).drop("rank")
    kept = filter_jobs(jobs, filters)
    rows = kept.orderBy(*newest_first("last_seen_at")).offset(page.offset).limit(page.page_size)
    return with_totals(project_light(rows), kept, page)


def list_after(
    jobs: DataFrame,
    last_seen_at: dt.datetime | None,
    job_id: int,
    filters: JobFilters | None = None,
    page_size: int = 20,
) -> DataFrame:
    """The page behind a given row of the listing (keyset paging)."""
    if last_seen_at is None:
        behind = F.col("last_seen_at").isNotNull() | (F.col("id") > job_id)
    else:
        mark = ntz(last_seen_at)
        behind = (F.col("last_seen_at") < mark) | ((F.col("last_seen_at") == mark) & (F.col("id") > job_id))
    rows = filter_jobs(jobs, filters).where(behind).orderBy(*newest_first("last_seen_at")).limit(page_size)
    return rows.select("id", "company_name", "title", "location", "first_seen_at", "last_seen_at")


def company_jobs(jobs: DataFrame, company: str, page: Page = Page(1, 20)) -> DataFrame:
    """Postings of one company, matched as a substring of its name."""
    return list_page(jobs, JobFilters(company=company), page)


def recent_jobs(jobs: DataFrame, limit: int = 10) -> DataFrame:
    rows = filter_jobs(jobs).orderBy(*newest_first("first_seen_at")).limit(limit)
    return project_light(rows)

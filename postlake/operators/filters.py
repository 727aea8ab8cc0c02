"""Predicates of the listing API, composed into one Column."""

from __future__ import annotations

import functools
import operator
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.functions.scalars import day_or_none, ntz

LIGHT = ["id", "company_name", "title", "location", "first_seen_at"]
DETAIL = [
    "id",
    "external_id",
    "company_name",
    "url",
    "title",
    "location",
    "description",
    "first_seen_at",
    "last_seen_at",
]
STORED = ["id", "title", "description", "company_name", "external_id", "location", "url"]


@dataclass(frozen=True)
class JobFilters:
    """Query parameters of a listing; empty strings switch a filter off."""

    company: str = ""
    location: str = ""
    title: str = ""
    date_from: str = ""
    date_to: str = ""
    search: str = ""


def active() -> Column:
    return F.col("expired_at").isNull()


def holds(column: str, text: str) -> Column:
    """Case-blind substring; ``%`` and ``_`` in the text stay wildcards.

    A backslash that escapes neither of them nor itself is a plain character.
    """
    plain = re.sub(r"\\([%_\\])|\\", lambda m: m[0] if m[1] else r"\\", text)
    return F.col(column).ilike(f"%{plain}%")


def seen_from(day: str) -> Column | None:
    value = day_or_none(day)
    return None if value is None else F.col("first_seen_at") >= ntz(value)


def seen_to(day: str) -> Column | None:
    """Inclusive of the day, and of the midnight that ends it."""
    value = day_or_none(day)
    return None if value is None else F.col("first_seen_at") <= ntz(value) + F.expr("INTERVAL 1 DAY")


def predicate(filters: JobFilters) -> Column:
    """AND of the filters that are set, plus "not expired"."""
    parts: list[Column | None] = [
        holds("company_name", filters.company) if filters.company else None,
        holds("location", filters.location) if filters.location else None,
        holds("title", filters.title) if filters.title else None,
        seen_from(filters.date_from),
        seen_to(filters.date_to),
        active(),
    ]
    return functools.reduce(operator.and_, [p for p in parts if p is not None])


def filter_jobs(jobs: DataFrame, filters: JobFilters | None = None) -> DataFrame:
    return jobs.where(predicate(filters or JobFilters()))


def project_light(jobs: DataFrame) -> DataFrame:
    return jobs.select(*LIGHT)


def project_detail(jobs: DataFrame) -> DataFrame:
    return jobs.select(*DETAIL)


def lookup_by_id(jobs: DataFrame, job_id: int, columns: list[str] | None = None) -> DataFrame:
    """Zero or one row; expired postings are found too."""
    return jobs.where(F.col("id") == F.lit(job_id)).select(*(columns or DETAIL))


def get_job(jobs: DataFrame, job_id: int) -> dict:
    """The one posting as a dict; ``LookupError`` when there is none."""
    row = lookup_by_id(jobs, job_id).first()
    if row is None:
        raise LookupError("job not found")
    return row.asDict()

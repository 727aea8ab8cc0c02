import datetime as dt
import random

import pytest

from postlake.operators import filters, listing
from postlake.operators.filters import JobFilters
from postlake.operators.listing import Page


def _jobs(spark):
    rnd = random.Random(2)
    day = lambda k: dt.datetime(2024, 1, 1) + dt.timedelta(days=k)
    rows = [
        (i, "C_%d" % (i % 3), f"t{i}", "L", day(i % 7), None if i % 10 == 0 else day(rnd.randint(0, 5)), day(1) if i % 9 == 0 else None)
        for i in range(60)
    ]
    return spark.createDataFrame(
        rows,
        "id bigint, company_name string, title string, location string, first_seen_at timestamp_ntz, "
        "last_seen_at timestamp_ntz, expired_at timestamp_ntz",
    )


def test_pages_join_up(spark):
    jobs = _jobs(spark)
    every = listing.list_page(jobs, None, Page(1, 100)).collect()
    pages = [listing.list_page(jobs, None, Page(p, 13)).collect() for p in range(1, 6)]
    assert [r["id"] for page in pages for r in page] == [r["id"] for r in every]
    assert {(r["total"], r["total_pages"]) for page in pages for r in page} == {(len(every), 5)}
    walked, mark = [], (dt.datetime(9999, 1, 1), -1)
    first = listing.list_after(jobs, None, -1, page_size=13).collect()
    while first:
        walked += [r["id"] for r in first]
        mark = (first[-1]["last_seen_at"], first[-1]["id"])
        first = listing.list_after(jobs, *mark, page_size=13).collect()
    assert walked == [r["id"] for r in every]


def test_wildcards_and_dates(spark):
    jobs = _jobs(spark)
    n = lambda f: filters.filter_jobs(jobs, f).count()
    assert n(JobFilters(company="c_1")) == n(JobFilters(company="C%1")) > 0
    assert n(JobFilters(company=r"c\_1")) == n(JobFilters(company="c_1"))
    assert n(JobFilters(date_from="bad")) == n(JobFilters())
    # The midnight that ends the day belongs to it.
    upto = filters.filter_jobs(jobs, JobFilters(date_to="2024-01-02"))
    assert {r["first_seen_at"].day for r in upto.collect()} == {1, 2, 3}
    with pytest.raises(LookupError):
        filters.get_job(jobs.selectExpr("*", "'' external_id", "'' url", "'' description"), 999)


def test_top_k_plan(spark):
    plan = listing.recent_jobs(_jobs(spark), 5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_odd_filter_texts(spark):
    """User input never ends a query; a stray backslash is a plain character."""
    jobs = spark.createDataFrame([("a\\b",), ("100%",), ("x_y",), ("end\\",)], "title string")
    found = lambda text: sorted(r[0] for r in jobs.where(filters.holds("title", text)).collect())
    assert found("a\\b") == ["a\\b"] and found("\\") == ["a\\b", "end\\"] and found("0\\%") == ["100%"]
    assert found("d\\") == ["end\\"] and found("\\_") == ["x_y"] and found("\\\\") == ["a\\b", "end\\"]

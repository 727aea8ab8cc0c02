"""Listing, lookup, counting and dashboard queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from postlake.functions import scalars
from postlake.operators import filters, listing, stats, stored_listing
from postlake.operators.filters import JobFilters
from postlake.operators.listing import Page
from postlake.plans import views
from postlake.plans.registry import query
from postlake.plans.sql import JOBS, LIGHT, RESULTS, with_
from postlake.session import scratch_path

J = with_(JOBS)
ACTIVE = "expired_at IS NULL"


@query("scan_jobs", J + "SELECT id, external_id, company_name, url, title, location, description, "
       "first_seen_at, last_seen_at, expired_at FROM jobs")
def scan_jobs(spark, d):
    return views.jobs(spark, d)


@query("project_light", J + f"SELECT {LIGHT} FROM jobs")
def project_light(spark, d):
    return filters.project_light(views.jobs(spark, d))


@query("project_detail", J + "SELECT id, external_id, company_name, url, title, location, description, "
       "first_seen_at, last_seen_at FROM jobs")
def project_detail(spark, d):
    return filters.project_detail(views.jobs(spark, d))


@query("filter_active", J + f"SELECT {LIGHT} FROM jobs WHERE {ACTIVE}")
def filter_active(spark, d):
    return filters.project_light(filters.filter_jobs(views.jobs(spark, d)))


def _filter_query(name: str, given: JobFilters, where: str) -> None:
    @query(name, J + f"SELECT {LIGHT} FROM jobs WHERE {ACTIVE} AND {where}")
    def run(spark, d):
        return filters.project_light(filters.filter_jobs(views.jobs(spark, d), given))


_filter_query("filter_company", JobFilters(company="SRC1"), r"company_name ILIKE '%SRC1%' ESCAPE '\'")
_filter_query("filter_company_wildcard", JobFilters(company="s_c1%"), r"company_name ILIKE '%s_c1%%' ESCAPE '\'")
_filter_query("filter_location", JobFilters(location="E"), r"location ILIKE '%E%' ESCAPE '\'")
_filter_query("filter_title", JobFilters(title="the"), r"title ILIKE '%the%' ESCAPE '\'")
_filter_query("filter_date_from", JobFilters(date_from="2024-01-15"), "first_seen_at >= TIMESTAMP '2024-01-15'")
_filter_query("filter_date_to", JobFilters(date_to="2024-01-15"), "first_seen_at <= TIMESTAMP '2024-01-16'")
_filter_query("filter_date_ignored", JobFilters(date_from="2024-1-15", date_to="x"), "true")
_filter_query(
    "filter_compose",
    JobFilters(company="src", location="en", title="an", date_from="2024-01-03", date_to="2024-02-01"),
    r"company_name ILIKE '%src%' ESCAPE '\' AND location ILIKE '%en%' ESCAPE '\' "
    r"AND title ILIKE '%an%' ESCAPE '\' AND first_seen_at >= TIMESTAMP '2024-01-03' "
    "AND first_seen_at <= TIMESTAMP '2024-02-02'",
)


@query("lookup_by_id", J + "SELECT id, external_id, company_name, url, title, location, description, "
       "first_seen_at, last_seen_at FROM jobs WHERE id = 8")
def lookup_by_id(spark, d):
    return filters.lookup_by_id(views.jobs(spark, d), 8)


@query("find_by_id", J + "SELECT id, title, description, company_name, external_id, location, url "
       "FROM jobs WHERE id = 8")
def find_by_id(spark, d):
    return filters.lookup_by_id(views.jobs(spark, d), 8, filters.STORED)


def _page_sql(where: str, size: int, offset: int) -> str:
    page = offset // size + 1
    return J + f""", kept AS (SELECT * FROM jobs WHERE {where})
SELECT {LIGHT}, (SELECT count(*) FROM kept) AS total, CAST({page} AS BIGINT) AS page,
  CAST({size} AS BIGINT) AS page_size,
  CAST(ceil((SELECT count(*) FROM kept) / {size}.0) AS BIGINT) AS total_pages
FROM kept ORDER BY last_seen_at DESC NULLS FIRST, id LIMIT {size} OFFSET {offset}"""


@query("list_page", _page_sql(ACTIVE, 20, 20))
def list_page(spark, d):
    return listing.list_page(views.jobs(spark, d), None, Page(2, 20))


@query("list_page_deep", _page_sql(ACTIVE, 20, 600))
def list_page_deep(spark, d):
    """The 31st page, out of the stored listing: one range of places is read."""
    root = scratch_path(spark, "stored-listing")
    stored_listing.write_listing(views.jobs(spark, d), root, width=500)
    return stored_listing.stored_page(spark, root, Page(31, 20))


@query("lookup_by_id_stored", J + "SELECT id, external_id, company_name, url, title, location, description, first_seen_at, last_seen_at FROM jobs WHERE id = 8")
def lookup_by_id_stored(spark, d):
    """Out of the table that is stored by id: one range of ids is read."""
    root = scratch_path(spark, "stored-by-id")
    stored_listing.write_by_id(views.jobs(spark, d), root, width=500)
    return stored_listing.lookup_stored(spark, root, 8)


@query("list_page_filtered", _page_sql(f"{ACTIVE} AND location = 'en'", 50, 50))
def list_page_filtered(spark, d):
    return listing.list_page(views.jobs(spark, d), JobFilters(location="en"), Page(2, 50))


@query("list_after", J + f"""SELECT {LIGHT}, last_seen_at FROM jobs WHERE {ACTIVE}
  AND (last_seen_at < TIMESTAMP '2024-02-01' OR (last_seen_at = TIMESTAMP '2024-02-01' AND id > 100))
  ORDER BY last_seen_at DESC NULLS FIRST, id LIMIT 20""")
def list_after(spark, d):
    return listing.list_after(views.jobs(spark, d), dt.datetime(2024, 2, 1), 100)


@query("filter_company_jobs", _page_sql(f"{ACTIVE} AND company_name ILIKE '%src1%'", 20, 0))
def filter_company_jobs(spark, d):
    return listing.company_jobs(views.jobs(spark, d), "src1")


@query("recent_jobs", J + f"SELECT {LIGHT} FROM jobs WHERE {ACTIVE} "
       "ORDER BY first_seen_at DESC NULLS FIRST, id LIMIT 10")
def recent_jobs(spark, d):
    return listing.recent_jobs(views.jobs(spark, d), 10)


@query("count_filtered", J + f"SELECT count(*) AS total FROM jobs WHERE {ACTIVE} AND location ILIKE '%en%'")
def count_filtered(spark, d):
    return listing.count_rows(filters.filter_jobs(views.jobs(spark, d), JobFilters(location="en")))


@query("total_pages", J + f"SELECT location, CAST(ceil(count(*) / 20.0) AS BIGINT) AS total_pages "
       f"FROM jobs WHERE {ACTIVE} GROUP BY location")
def total_pages(spark, d):
    kept = filters.filter_jobs(views.jobs(spark, d)).groupBy("location").agg(F.count(F.lit(1)).alias("n"))
    return kept.select("location", listing.total_pages(F.col("n"), 20).alias("total_pages"))


STATS = """SELECT company_name, count(*) AS job_count, max(last_seen_at) AS last_updated,
  count(*) FILTER (WHERE expired_at IS NULL) AS active_jobs,
  count(*) FILTER (WHERE expired_at IS NOT NULL) AS expired_jobs
FROM jobs GROUP BY company_name"""


@query("company_stats", J + STATS)
def company_stats(spark, d):
    return stats.company_stats(views.jobs(spark, d))


@query("count_by_company", J + f"SELECT company_name, count(*) AS job_count FROM jobs WHERE {ACTIVE} GROUP BY 1")
def count_by_company(spark, d):
    return stats.count_by_company(views.jobs(spark, d))


@query("total_active", J + f"SELECT count(*) AS total FROM jobs WHERE {ACTIVE}")
def total_active(spark, d):
    return stats.total_active(views.jobs(spark, d))


@query("dashboard_summary", with_(JOBS, RESULTS) + f""", stats AS ({STATS}), recent AS (
  SELECT * FROM jobs WHERE {ACTIVE} ORDER BY first_seen_at DESC NULLS FIRST, id LIMIT 10)
SELECT 'total_jobs' AS section, CAST(NULL AS VARCHAR) AS company_name, CAST(NULL AS BIGINT) AS job_id,
  CAST(NULL AS VARCHAR) AS title, CAST(NULL AS VARCHAR) AS location, CAST(NULL AS TIMESTAMP) AS at,
  CAST(NULL AS BIGINT) AS job_count, CAST(NULL AS BIGINT) AS active_jobs, CAST(NULL AS BIGINT) AS expired_jobs,
  CAST(count(*) AS DOUBLE) AS value FROM jobs WHERE {ACTIVE}
UNION ALL SELECT 'success_rate', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
  round(100.0 * count(*) FILTER (WHERE status = 'success') / count(*), 6) FROM results
UNION ALL SELECT 'recent_jobs', company_name, id, title, location, first_seen_at, NULL, NULL, NULL, NULL FROM recent
UNION ALL SELECT 'company_stats', company_name, NULL, NULL, NULL, last_updated, job_count, active_jobs,
  expired_jobs, NULL FROM stats""")
def dashboard_summary(spark, d):
    out = stats.dashboard_summary(views.jobs(spark, d), views.results(spark, d))
    return out.withColumn("value", F.round("value", 6))


@query("age_label", J + r""", aged AS (
  SELECT id, first_seen_at, CAST(ceil(abs(epoch_us(TIMESTAMP '2024-06-01 12:00:00') - epoch_us(first_seen_at))
    / 86400000000.0) AS BIGINT) AS n FROM jobs)
SELECT id, CASE WHEN n = 1 THEN 'yesterday' WHEN n < 7 THEN n || ' days ago'
  WHEN n < 30 THEN CAST(ceil(n / 7.0) AS BIGINT) || ' weeks ago'
  WHEN n < 365 THEN CAST(ceil(n / 30.0) AS BIGINT) || ' months ago'
  ELSE strftime(first_seen_at, '%Y-%m-%d') END AS age FROM aged""")
def age_label(spark, d):
    as_of = scalars.ntz(dt.datetime(2024, 6, 1, 12))
    return views.jobs(spark, d).select("id", scalars.age_label("first_seen_at", as_of).alias("age"))


@query("trim_ws", r"""SELECT doc_id, regexp_replace(regexp_replace(
    chr(160) || chr(9) || text || chr(8195) || chr(10), '^[\s\p{Z}]+', ''), '[\s\p{Z}]+$', '') AS text FROM documents""")
def trim_ws(spark, d):
    docs = views.table(spark, d, "documents")
    padded = F.concat(F.lit("\u00a0\t"), "text", F.lit("\u2003\n"))
    return docs.select("doc_id", scalars.trim_ws(padded).alias("text"))


@query("parse_date", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN date_trunc('day', ts) END AS day FROM events""")
def parse_date(spark, d):
    """Days are written in three ways, of which one is the accepted form."""
    events = views.table(spark, d, "events")
    text = (
        F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd"))
        .when(F.col("event_id") % 3 == 1, F.date_format("ts", "yyyy-M-d'x'"))
        .otherwise(F.date_format("ts", "dd.MM.yyyy"))
    )
    return events.select("event_id", scalars.parse_day(text).alias("day"))


@query("content_hash", J + """SELECT external_id,
  sha256(title || chr(1) || location || chr(1) || description) AS hash FROM jobs""")
def content_hash(spark, d):
    return views.jobs(spark, d).select("external_id", scalars.content_hash().alias("hash"))

"""Queries over results, discovery, fetch, scrape and request logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlake.operators import attempts, metrics, requestlog
from postlake.plans import views
from postlake.plans.registry import query
from postlake.plans.sql import ATTEMPTS, REFS, RESULTS, with_

R = with_(RESULTS)


def _aggregates(by: str = "") -> str:
    return f"""SELECT {by}count(*) AS jobs_processed,
  count(*) FILTER (WHERE status = 'success') AS jobs_successful,
  count(*) FILTER (WHERE status = 'failed') AS jobs_failed,
  count(*) FILTER (WHERE status = 'duplicate') AS jobs_duplicate,
  round(sum(processing_ms), 4) AS total_processing_ms, max(ts) AS last_processed_at,
  round(avg(processing_ms), 6) AS average_processing_ms,
  round(100.0 * count(*) FILTER (WHERE status = 'success') / count(*), 6) AS success_rate,
  round(100.0 * count(*) FILTER (WHERE status = 'failed') / count(*), 6) AS error_rate,
  round(count(*) / (sum(processing_ms) / 60000.0), 6) AS processing_rate FROM results"""


def _rounded(df):
    for name, digits in (
        ("total_processing_ms", 4),
        ("average_processing_ms", 6),
        ("success_rate", 6),
        ("error_rate", 6),
        ("processing_rate", 6),
    ):
        if name in df.columns:
            df = df.withColumn(name, F.round(name, digits))
    return df


@query("pipeline_metrics", R + _aggregates())
@query("processing_metrics", R + _aggregates())
def processing_metrics(spark, d):
    return _rounded(metrics.processing_metrics(views.results(spark, d)))


@query("processing_metrics_by_company", R + _aggregates("company_name, ") + " GROUP BY company_name")
def processing_metrics_by_company(spark, d):
    return _rounded(metrics.processing_metrics(views.results(spark, d), "company_name"))


@query("success_rate", R + "SELECT round(100.0 * count(*) FILTER (WHERE status = 'success') / count(*), 6) "
       "AS success_rate FROM results")
def success_rate(spark, d):
    return _rounded(metrics.success_rate(views.results(spark, d)))


@query("processing_rate", R + "SELECT round(count(*) / (sum(processing_ms) / 60000.0), 6) AS processing_rate FROM results")
def processing_rate(spark, d):
    return _rounded(metrics.processing_rate(views.results(spark, d)))


def _discovered(spark, d):
    found = views.results(spark, d)
    return found.select("company_name", F.to_date("ts").alias("cycle_id"), F.col("ts").alias("discovered_at"))


@query("discovery_metrics", R + "SELECT count(DISTINCT CAST(ts AS DATE)) AS discovery_cycles, "
       "max(ts) AS last_discovery_at, count(*) AS total_discovered FROM results")
def discovery_metrics(spark, d):
    return metrics.discovery_metrics(_discovered(spark, d))


@query("discovered_by_company", with_(REFS) + "SELECT company_name, count(*) AS discovered FROM refs GROUP BY 1")
def discovered_by_company(spark, d):
    return metrics.discovered_by_company(views.refs(spark, d))


FETCHES = """fetches AS (
  SELECT 'company' || CAST(user_id % 7 AS VARCHAR) AS company_name, event_id AS seq, value AS duration_ms,
    CASE WHEN user_id % 3 = 0 THEN 'sitemap' WHEN user_id % 3 = 1 THEN 'html' ELSE 'api' END AS fetch_type,
    CASE WHEN event_type = 'error' THEN 'fetch_error' END AS error_type,
    CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS jobs_found FROM events)"""


def _fetches(spark, d):
    kind = F.when(F.col("user_id") % 3 == 0, "sitemap").when(F.col("user_id") % 3 == 1, "html").otherwise("api")
    return views.table(spark, d, "events").select(
        F.concat(F.lit("company"), (F.col("user_id") % 7).cast("string")).alias("company_name"),
        F.col("event_id").alias("seq"),
        F.col("value").alias("duration_ms"),
        kind.alias("fetch_type"),
        F.when(F.col("event_type") == "error", "fetch_error").alias("error_type"),
        F.get_json_object("props", "$.k").cast("bigint").alias("jobs_found"),
    )


@query("fetch_metrics", with_(FETCHES) + """SELECT company_name, fetch_type, count(*) AS fetch_total,
  count(error_type) AS fetch_errors, arg_max(duration_ms, seq) AS last_duration_ms,
  arg_max(jobs_found, seq) FILTER (WHERE error_type IS NULL) AS jobs_found FROM fetches GROUP BY 1, 2""")
def fetch_metrics(spark, d):
    return metrics.fetch_metrics(_fetches(spark, d))


@query("scrape_metrics", with_(FETCHES) + """SELECT company_name, count(*) AS scrape_total,
  count(error_type) AS scrape_errors, arg_max(duration_ms, seq) AS last_duration_ms FROM fetches GROUP BY 1""")
def scrape_metrics(spark, d):
    return metrics.scrape_metrics(_fetches(spark, d))


@query("errors_by_type", with_(FETCHES) + """SELECT company_name, fetch_type, error_type, count(*) AS errors
FROM fetches WHERE error_type IS NOT NULL GROUP BY 1, 2, 3""")
def errors_by_type(spark, d):
    return metrics.errors_by_type(_fetches(spark, d), "company_name", "fetch_type")


@query("queue_size", with_(REFS) + "SELECT count(*) AS queue_size FROM refs WHERE seq NOT IN (SELECT doc_id FROM labels)")
def queue_size(spark, d):
    processed = views.table(spark, d, "labels").select(F.col("doc_id").alias("seq"))
    return metrics.queue_size(views.refs(spark, d), processed)


@query("classify_error", with_(ATTEMPTS) + """SELECT attempt_seq, CASE WHEN status_code = 200 THEN NULL
  WHEN status_code IN (403, 404) THEN 'final' ELSE 'retry' END AS kind FROM attempts""")
def classify_error(spark, d):
    log = attempts.with_error(views.attempts(spark, d))
    return log.select("attempt_seq", attempts.classify_error("error").alias("kind"))


@query("filter_status_ok", with_(ATTEMPTS) + "SELECT job_key, attempt_seq, status_code FROM attempts WHERE status_code = 200")
def filter_status_ok(spark, d):
    return attempts.split_status(views.attempts(spark, d))[0]


@query("filter_status_failed", with_(ATTEMPTS) + """SELECT job_key, attempt_seq, status_code,
  'received non-OK status code: ' || status_code AS error FROM attempts WHERE status_code <> 200""")
def filter_status_failed(spark, d):
    return attempts.split_status(views.attempts(spark, d))[1]


@query("resolve_attempts", with_(ATTEMPTS) + """, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY job_key ORDER BY attempt_seq) AS attempt FROM attempts),
tried AS (SELECT * FROM ranked WHERE attempt <= 3),
stops AS (
  SELECT job_key, coalesce(min(attempt) FILTER (WHERE status_code IN (200, 403, 404)), max(attempt)) AS last
  FROM tried GROUP BY job_key)
SELECT t.job_key, t.attempt AS attempts, CASE WHEN status_code = 200 THEN 'success' ELSE 'failed' END AS status,
  CASE WHEN status_code <> 200 THEN 'failed after 3 attempts: received non-OK status code: ' || status_code END AS error
FROM tried t JOIN stops s ON t.job_key = s.job_key AND t.attempt = s.last""")
def resolve_attempts(spark, d):
    return attempts.resolve_attempts(attempts.with_error(views.attempts(spark, d)))


@query("log_level", with_(ATTEMPTS) + """SELECT attempt_seq AS request_id,
  CASE WHEN status_code >= 500 THEN 'error' WHEN status_code >= 400 THEN 'warn' ELSE 'info' END AS level FROM attempts""")
def log_level(spark, d):
    return views.requests(spark, d).select("request_id", requestlog.level("status_code").alias("level"))


@query("log_redact", """SELECT event_id AS request_id, 'Accept,X-Forwarded-For' AS kept, event_type AS accept FROM events""")
def log_redact(spark, d):
    kept = requestlog.redact("headers")
    return views.requests(spark, d).select(
        "request_id",
        F.array_join(F.sort_array(F.map_keys(kept)), ",").alias("kept"),
        F.try_element_at(kept, F.lit("Accept")).alias("accept"),
    )


@query("log_client_ip", """SELECT event_id AS request_id, CASE WHEN event_id % 3 = 0
  THEN '10.0.0.' || CAST(event_id % 250 AS VARCHAR) ELSE '192.0.2.1:80' END AS ip FROM events""")
def log_client_ip(spark, d):
    return views.requests(spark, d).select("request_id", requestlog.client_ip("headers", "remote").alias("ip"))


@query("log_truncate", with_(ATTEMPTS, """bodies AS (SELECT event_id, event_type, repeat(props, CAST(event_id % 300 AS INTEGER)) AS body FROM events)""") + """
SELECT event_id AS request_id,
  CASE WHEN event_id % 2 <> 0 THEN '' WHEN strlen(body) <= 2048 THEN body
    ELSE '[Request body too large: ' || strlen(body) || ' bytes]' END AS request_body,
  CASE WHEN status_code >= 400 THEN '' WHEN strlen(body) <= 1024 THEN body
    ELSE '[Response body too large]' END AS response_body
FROM bodies b JOIN attempts a ON b.event_id = a.attempt_seq""")
def log_truncate(spark, d):
    return views.requests(spark, d).select(
        "request_id",
        requestlog.logged_request_body("method", "body").alias("request_body"),
        requestlog.logged_response_body("status_code", "path", "body").alias("response_body"),
    )

"""SQL of the derived views, for the comparison queries."""

from __future__ import annotations

JOBS = r"""jobs AS (
  SELECT d.doc_id + 1 AS id, 'doc-' || d.doc_id AS external_id, d.source AS company_name,
    'https://' || d.source || '.example.com/jobs/' || d.doc_id AS url,
    coalesce(nullif(trim(regexp_extract(d.text, '^([^.\n]*)', 1)), ''), 'untitled') AS title,
    d.lang AS location, d.text AS description,
    TIMESTAMP '2024-01-01 00:00:00' + to_hours(d.doc_id) AS first_seen_at,
    TIMESTAMP '2024-01-01 00:00:00' + to_hours(d.doc_id + d.n_chars % 720) AS last_seen_at,
    CASE WHEN l.quality = 0
         THEN TIMESTAMP '2024-01-01 00:00:00' + to_hours(d.doc_id + d.n_chars % 720 + 24) END AS expired_at
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

REFS = r"""refs AS (
  SELECT page_id AS seq, regexp_extract(url, 'https?://([^/?#]+)', 1) AS source_key,
    regexp_extract(url, '/[a-z]{2}/([0-9]+)', 1) AS external_id, url,
    regexp_extract(url, 'https?://([^/?#]+)', 1) AS company_name
  FROM pages)"""

RESULTS = """results AS (
  SELECT event_id, CAST(user_id AS VARCHAR) AS external_id,
    'company' || CAST(user_id % 7 AS VARCHAR) AS company_name,
    CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'duplicate' ELSE 'success' END AS status,
    value AS processing_ms, ts
  FROM events)"""

ATTEMPTS = """attempts AS (
  SELECT user_id AS job_key, event_id AS attempt_seq,
    CAST(CASE WHEN event_type = 'error' THEN 500 WHEN event_id % 11 = 0 THEN 404
         WHEN event_id % 13 = 0 THEN 403 ELSE 200 END AS INTEGER) AS status_code
  FROM events)"""

STORED = """stored AS (
  SELECT * FROM jobs WHERE location IN ('en', 'fr') OR id IN (SELECT doc_id + 1 FROM labels)),
incoming AS (
  SELECT id AS seq, external_id, company_name, url, 'NEW ' || title AS title, location, description
  FROM jobs WHERE location IS DISTINCT FROM 'fr')"""

LIGHT = "id, company_name, title, location, first_seen_at"


def with_(*views: str) -> str:
    return "WITH " + ",\n".join(views) + "\n"

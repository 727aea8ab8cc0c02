"""Discovery, dedup, enrichment and write queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from postlake.functions import scalars
from postlake.functions.html import select_html
from postlake.operators import dedup, dedup_ttl, enrich, expiry, ids, upsert
from postlake.plans import views
from postlake.plans.registry import query
from postlake.plans.sql import JOBS, REFS, RESULTS, STORED, with_
from postlake.session import at_least_parallel, scratch_path
from postlake.sources import config, extract

NOW = dt.datetime(2025, 1, 1)
UNESCAPED = "replace(replace(replace({0}, '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"


def _values(cols: str, rows: str) -> str:
    return f"(SELECT * FROM (VALUES {rows.replace('array(', 'list_value(')}) AS t({cols}))"


SOURCES = "sources AS " + _values(
    "source_key, name, fetch_type, url, id_pattern, link_selector, jobs_path, id_field, url_template, enabled",
    views.SOURCE_ROWS.replace("CAST(NULL AS STRING)", "CAST(NULL AS VARCHAR)"),
)
SCRAPERS = "scrapers AS " + _values("scraper_key, name, url_patterns, enabled", views.SCRAPER_ROWS)

# --- sources -----------------------------------------------------------------

SITEMAP_ROWS = """site AS (
  SELECT page_id, url, 'src' || length(regexp_extract(url, 'https?://([^/?#]+)', 1)) % 5 AS source_key,
    page_id // 50 AS part FROM pages),
bodies AS (
  SELECT source_key, part, source_key || '/' || part AS response_url, CASE WHEN part % 5 = 4 THEN 503 ELSE 200 END AS status_code,
    count(*) AS urls FROM site GROUP BY source_key, part)"""

SITEMAP_REFS = """sitemap_refs AS (
  SELECT s.source_key, s.source_key AS company_name, s.source_key || '/' || part AS response_url,
    row_number() OVER (PARTITION BY s.source_key, part ORDER BY page_id) - 1 AS pos,
    CASE s.source_key WHEN 'src0' THEN regexp_extract(s.url, '/[a-z]{2}/([0-9]+)', 1)
      WHEN 'src1' THEN regexp_extract(s.url, '([0-9]+)', 1) ELSE '' END AS external_id, s.url
  FROM site s WHERE part % 5 <> 4 AND s.source_key IN ('src0', 'src1', 'src2'))"""

HTML_REFS = r"""anchors AS (
  SELECT url, unnest(hrefs) AS href, generate_subscripts(hrefs, 1) - 1 AS pos FROM (
    SELECT url, regexp_extract_all(html, '<li><a href="([^"]*)"', 1) AS hrefs FROM pages)),
html_refs AS (
  SELECT 'html' || length(url) % 2 AS source_key, 'html' || length(url) % 2 AS company_name, url AS response_url, CAST(pos AS BIGINT) AS pos,
    regexp_extract(replace(href, '&amp;', '&'), '/([A-Za-z]+)', 1) AS external_id, replace(href, '&amp;', '&') AS url
  FROM anchors)"""

API_REFS = """api_refs AS (
  SELECT 'api' || user_id % 2 AS source_key, 'api' || user_id % 2 AS company_name, 'u' || user_id || '/' || (event_id // 500) AS response_url,
    row_number() OVER (PARTITION BY user_id, event_id // 500 ORDER BY event_id) - 1 AS pos,
    CAST(event_id AS VARCHAR) AS external_id, 'https://a/jobs/' || event_id AS url FROM events)"""


@query("src_responses", with_(SITEMAP_ROWS) + "SELECT source_key, response_url AS url, "
       "CAST(status_code AS INTEGER) AS status_code, urls FROM bodies")
def src_responses(spark, d):
    landed = views.sitemap_responses(spark, d)
    urls = F.size(F.regexp_extract_all("body", F.lit("(<loc>)"), F.lit(1))).cast("bigint")
    return landed.select("source_key", "url", "status_code", urls.alias("urls"))


@query("join_source_config", with_(SITEMAP_ROWS) + """SELECT source_key, response_url,
  CASE WHEN source_key NOT IN ('src0', 'src1', 'src2') THEN 'company ' || source_key || ' not registered'
    WHEN status_code <> 200 THEN 'received non-OK status code: ' || status_code END AS error FROM bodies""")
def join_source_config(spark, d):
    ready = extract.join_source_config(views.sitemap_responses(spark, d), views.sources(spark))
    return ready.select("source_key", F.col("url").alias("response_url"), "error")


@query("src_sitemap", with_(SITEMAP_ROWS, SITEMAP_REFS) + "SELECT * FROM sitemap_refs WHERE external_id <> ''")
def src_sitemap(spark, d):
    ready = extract.join_source_config(views.sitemap_responses(spark, d), views.sources(spark))
    return extract.refs_from_sitemaps(ready)[0]


@query("src_html_links", with_(HTML_REFS) + "SELECT * FROM html_refs WHERE external_id <> ''")
def src_html_links(spark, d):
    responses = at_least_parallel(views.html_responses(spark, d), "url")
    return extract.refs_from_html(extract.join_source_config(responses, views.sources(spark)))


@query("src_api_json", with_(API_REFS) + "SELECT * FROM api_refs")
def src_api_json(spark, d):
    ready = extract.join_source_config(views.api_responses(spark, d), views.sources(spark))
    return extract.refs_from_api(ready)[0]


def _all_responses(spark, d):
    out = views.sitemap_responses(spark, d).unionByName(views.html_responses(spark, d))
    return out.unionByName(views.api_responses(spark, d))


@query("union_sources", with_(SITEMAP_ROWS, SITEMAP_REFS, HTML_REFS, API_REFS) + """
SELECT * FROM sitemap_refs WHERE external_id <> '' UNION ALL SELECT * FROM html_refs WHERE external_id <> ''
UNION ALL SELECT * FROM api_refs""")
def union_sources(spark, d):
    return extract.union_sources(_all_responses(spark, d), views.sources(spark))[0]


ARRIVALS = """refs_in AS (SELECT * FROM sitemap_refs WHERE external_id <> '' UNION ALL SELECT * FROM html_refs WHERE external_id <> ''
  UNION ALL SELECT * FROM api_refs),
arrived AS (SELECT *, TIMESTAMP '2024-01-01' + to_minutes(length(response_url) * 7 % 60) AS fetched_at FROM refs_in)"""


@query("dedup_arrival", with_(SITEMAP_ROWS, SITEMAP_REFS, HTML_REFS, API_REFS, ARRIVALS) + """
SELECT source_key, response_url, pos, external_id, url, fetched_at,
  row_number() OVER (PARTITION BY external_id ORDER BY fetched_at, source_key, response_url, pos) > 1 AS is_duplicate FROM arrived""")
def dedup_arrival(spark, d):
    """From landed responses to labelled references: the order is that of arrival, over all responses."""
    refs = extract.union_sources(views.landed(spark, d), views.sources(spark))[0]
    labelled = dedup.label_first(refs)
    return labelled.select("source_key", "response_url", "pos", "external_id", "url", "fetched_at", "is_duplicate")


@query("union_sources_errors", with_(SITEMAP_ROWS) + """SELECT source_key, response_url,
  CASE WHEN source_key NOT IN ('src0', 'src1', 'src2') THEN 'company ' || source_key || ' not registered'
    ELSE 'received non-OK status code: ' || status_code END AS error
FROM bodies WHERE source_key NOT IN ('src0', 'src1', 'src2') OR status_code <> 200""")
def union_sources_errors(spark, d):
    return extract.union_sources(_all_responses(spark, d), views.sources(spark))[1]


@query("discover_company", with_(SITEMAP_ROWS, SITEMAP_REFS) + """SELECT * FROM sitemap_refs
WHERE external_id <> '' AND source_key = 'src1'""")
def discover_company(spark, d):
    return extract.discover_company(views.sitemap_responses(spark, d), views.sources(spark), "src1")


# --- settings ----------------------------------------------------------------

SETTINGS = """settings AS (
  SELECT host, host AS name, CASE WHEN length(host) % 4 = 0 THEN '' ELSE 'https://' || host END AS url,
    CASE length(host) % 5 WHEN 0 THEN 'sitemap' WHEN 1 THEN 'html' WHEN 2 THEN 'api' WHEN 3 THEN 'rss' ELSE 'html' END AS fetch_type,
    CASE WHEN length(host) % 5 = 4 THEN 'a' ELSE '' END AS link_selector,
    CASE WHEN length(host) % 3 = 0 THEN 'GET' ELSE '' END AS method,
    CASE length(host) % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE NULL END AS enabled
  FROM (SELECT DISTINCT regexp_extract(url, 'https?://([^/?#]+)', 1) AS host FROM pages))"""


def _settings(spark, d):
    """One source per host of the pages, with flaws that depend on its name."""
    n = F.length("host")
    fetch = F.get(F.array(*map(F.lit, ("sitemap", "html", "api", "rss", "html"))), n % 5)
    return views.refs(spark, d).select(F.col("source_key").alias("host")).distinct().select(
        "host",
        F.col("host").alias("name"),
        F.when(n % 4 == 0, "").otherwise(F.concat(F.lit("https://"), "host")).alias("url"),
        fetch.alias("fetch_type"),
        F.when(n % 5 == 4, "a").otherwise("").alias("link_selector"),
        F.when(n % 3 == 0, "GET").otherwise("").alias("method"),
        F.when(n % 3 == 0, True).when(n % 3 == 1, False).alias("enabled"),
    )


@query("validate_sources", with_(SETTINGS) + """SELECT host, CASE WHEN name = '' THEN 'company name is required'
  WHEN url = '' THEN 'company URL is required'
  WHEN fetch_type NOT IN ('sitemap', 'html', 'api') THEN 'invalid fetch type: ' || fetch_type
  WHEN fetch_type = 'html' AND link_selector = '' THEN 'link_selector is required for HTML fetch type'
  WHEN fetch_type = 'api' AND method = '' THEN 'method is required for API fetch type' END AS error FROM settings""")
def validate_sources(spark, d):
    return _settings(spark, d).select("host", config.source_error().alias("error"))


@query("filter_enabled", with_(SETTINGS) + "SELECT host, fetch_type FROM settings WHERE coalesce(enabled, false)")
def filter_enabled(spark, d):
    return _settings(spark, d).where(config.enabled()).select("host", "fetch_type")


@query("validate_scrapers", with_(SETTINGS) + """SELECT host, CASE WHEN length(host) % 5 = 3 THEN 'at least one URL pattern is required'
  WHEN link_selector = '' THEN 'title selector is required'
  WHEN method = '' THEN 'location selector is required'
  WHEN url = '' THEN 'description selector is required' END AS error FROM settings""")
def validate_scrapers(spark, d):
    rows = _settings(spark, d).select(
        "host",
        "name",
        F.when(F.col("fetch_type") == "rss", F.array().cast("array<string>")).otherwise(F.array("host")).alias("url_patterns"),
        F.struct(
            F.col("link_selector").alias("title"), F.col("method").alias("location"), F.col("url").alias("description")
        ).alias("selectors"),
    )
    return rows.select("host", config.scraper_error().alias("error"))


@query("registered_companies", with_(SETTINGS) + "SELECT host AS source_key FROM settings WHERE coalesce(enabled, false)")
def registered_companies(spark, d):
    return config.registered_sources(_settings(spark, d).withColumnRenamed("host", "source_key"))


def _gap_sides(spark, d):
    discover = _settings(spark, d).withColumnRenamed("host", "source_key")
    rich = views.table(spark, d, "documents").select("source").distinct()
    pages = views.refs(spark, d).where(scalars.non_empty("external_id")).groupBy("source_key").agg(F.count("*").alias("n"))
    names = pages.where("n > 2").select(F.col("source_key").alias("scraper_key")).union(rich)
    return discover, names.withColumn("enabled", F.lit(True))


GAP = """gap AS (SELECT coalesce(a.k, b.k) AS company_key, a.k IS NOT NULL AS discoverable, b.k IS NOT NULL AS enrichable
  FROM (SELECT host AS k FROM settings WHERE coalesce(enabled, false)) a FULL OUTER JOIN
    (SELECT source_key AS k FROM refs WHERE external_id <> '' GROUP BY 1 HAVING count(*) > 2
     UNION ALL SELECT DISTINCT source FROM documents) b ON a.k = b.k)"""


@query("coverage_gap", with_(SETTINGS, REFS, GAP) + "SELECT * FROM gap")
def coverage_gap(spark, d):
    return config.coverage_gap(*_gap_sides(spark, d))


@query("coverage_counts", with_(SETTINGS, REFS, GAP) + """SELECT count(*) FILTER (WHERE discoverable) AS discovery_companies,
  count(*) FILTER (WHERE enrichable) AS enrichment_companies FROM gap""")
def coverage_counts(spark, d):
    return config.coverage_counts(*_gap_sides(spark, d))


# --- references --------------------------------------------------------------


@query("valid_ref", with_(REFS) + "SELECT seq, url <> '' AND external_id <> '' AND company_name <> '' AS valid FROM refs")
def valid_ref(spark, d):
    return views.refs(spark, d).select("seq", scalars.valid_ref().alias("valid"))


@query("extract_id", with_(REFS) + """SELECT seq, CASE seq % 4 WHEN 0 THEN regexp_extract(url, '/([0-9]+)', 1)
  WHEN 1 THEN regexp_extract(url, '//([a-z]+)[.]', 1) ELSE '' END AS id FROM refs""")
def extract_id(spark, d):
    """The pattern differs from row to row: two with a group, one without, one null."""
    n = F.col("seq") % 4
    pattern = F.when(n == 0, "/([0-9]+)").when(n == 1, "//([a-z]+)[.]").when(n == 2, r"\([a-z]+[(]")
    return views.refs(spark, d).select("seq", scalars.extract_id("url", pattern).alias("id"))


@query("url_template", with_(REFS) + """SELECT seq, CASE WHEN seq % 5 = 0 THEN ''
  ELSE 'https://x/' || external_id || '?id=' || external_id END AS url FROM refs""")
def url_template(spark, d):
    template = F.when(F.col("seq") % 5 != 0, "https://x/{id}?id={id}")
    return views.refs(spark, d).select("seq", scalars.url_from_template(template, F.col("external_id")).alias("url"))


@query("num_to_id", "SELECT event_id, CAST(CAST(trunc(value - 20) AS BIGINT) AS VARCHAR) AS id FROM events")
def num_to_id(spark, d):
    return views.table(spark, d, "events").select("event_id", scalars.num_to_id(F.col("value") - 20).alias("id"))


@query("json_path", "SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events")
def json_path(spark, d):
    body = F.concat(F.lit('{"a b":{"c":'), "props", F.lit("}}"))
    rows = views.table(spark, d, "events").select(
        "event_id", F.try_parse_json(body).alias("v"), extract.json_path(F.lit("a b.c.k")).alias("path")
    )
    return rows.select("event_id", F.expr("try_variant_get(v, path, 'bigint')").alias("k"))


@query("url_matches", with_(REFS) + """SELECT seq, contains(url, 'example.org') OR contains(url, '/de/') AS matches FROM refs""")
def url_matches(spark, d):
    patterns = F.array(F.lit("example.org"), F.lit("/de/"))
    return views.refs(spark, d).select("seq", scalars.url_matches("url", patterns).alias("matches"))


MATCH = """matched AS (
  SELECT r.seq, min(s.scraper_key) AS scraper_key FROM refs r LEFT JOIN (
    SELECT scraper_key, unnest(url_patterns) AS pattern FROM scrapers WHERE enabled) s ON contains(r.url, s.pattern)
  GROUP BY r.seq)"""
MATCH_SQL = with_(REFS, SCRAPERS, MATCH) + """SELECT m.seq, m.scraper_key, s.name AS scraper_name
FROM matched m LEFT JOIN scrapers s ON m.scraper_key = s.scraper_key"""


@query("join_scraper_by_url", MATCH_SQL)
def join_scraper_by_url(spark, d):
    return enrich.with_scraper(views.refs(spark, d), views.scrapers(spark)).select("seq", "scraper_key", "scraper_name")


@query("join_scraper_by_url_many", with_(REFS, SCRAPERS, MATCH) + "SELECT * FROM matched")
def join_scraper_by_url_many(spark, d):
    """The join alone, without the names."""
    return enrich.match_scraper(views.refs(spark, d), views.scrapers(spark)).select("seq", "scraper_key")


@query("company_naming", with_(REFS, SCRAPERS, MATCH) + """SELECT r.seq, r.company_name AS ref_name, s.name AS details_name
FROM refs r JOIN matched m ON r.seq = m.seq JOIN scrapers s ON m.scraper_key = s.scraper_key""")
def company_naming(spark, d):
    named = enrich.with_scraper(views.refs(spark, d), views.scrapers(spark)).where("scraper_name IS NOT NULL")
    return named.select("seq", F.col("company_name").alias("ref_name"), F.col("scraper_name").alias("details_name"))


FIRST = "external_id <> '' AND row_number() OVER (PARTITION BY external_id ORDER BY seq) > 1 AS is_duplicate"


@query("dedup_first", with_(REFS) + f"SELECT *, {FIRST} FROM refs")
def dedup_first(spark, d):
    return dedup.label_first(views.refs(spark, d))


@query("dedup_first_results", with_(RESULTS) + f"""SELECT event_id AS seq, external_id,
  {FIRST.replace("ORDER BY seq", "ORDER BY event_id")} FROM results""")
def dedup_first_results(spark, d):
    rows = views.results(spark, d).select(F.col("event_id").alias("seq"), "external_id")
    return dedup.label_first(rows)


def _processed(spark, d):
    return views.results(spark, d).select("external_id")


@query("anti_processed", with_(REFS) + "SELECT * FROM refs WHERE external_id NOT IN (SELECT CAST(user_id AS VARCHAR) FROM events)")
def anti_processed(spark, d):
    return dedup.drop_processed(views.refs(spark, d), _processed(spark, d))


@query("semi_processed", with_(REFS) + "SELECT * FROM refs WHERE external_id IN (SELECT CAST(user_id AS VARCHAR) FROM events)")
def semi_processed(spark, d):
    return dedup.only_processed(views.refs(spark, d), _processed(spark, d))


@query("dedup_against_processed", with_(REFS) + """SELECT *, external_id <> '' AND (
  row_number() OVER (PARTITION BY external_id ORDER BY seq) > 1
  OR external_id IN (SELECT CAST(user_id AS VARCHAR) FROM events)) AS is_duplicate FROM refs""")
def dedup_against_processed(spark, d):
    return dedup.label_against(views.refs(spark, d), _processed(spark, d))


TTL_SQL = with_(RESULTS).replace("WITH", "WITH RECURSIVE") + """, accepted(external_id, ts) AS (
  SELECT external_id, min(ts) FROM results GROUP BY external_id
  UNION ALL
  SELECT a.external_id, n.ts FROM accepted a, LATERAL (
    SELECT min(r.ts) AS ts FROM results r WHERE r.external_id = a.external_id AND r.ts >= a.ts + INTERVAL 24 HOUR) n
  WHERE n.ts IS NOT NULL)
SELECT r.event_id AS seq, r.external_id, a.ts IS NULL AS is_duplicate
FROM results r LEFT JOIN accepted a ON r.external_id = a.external_id AND r.ts = a.ts"""


@query("dedup_ttl", TTL_SQL)
def dedup_within_ttl(spark, d):
    rows = views.results(spark, d).select(F.col("event_id").alias("seq"), "external_id", "ts")
    return dedup_ttl.accept_with_ttl(rows, None, dt.timedelta(hours=24))[0].select("seq", "external_id", "is_duplicate")


# --- enrichment --------------------------------------------------------------


@query("select_html", f"""SELECT page_id, {UNESCAPED.format("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")} AS h1,
  {UNESCAPED.format("regexp_extract(html, '<article><h1>([^<]*)</h1>', 1)")} AS article_h1,
  {UNESCAPED.format("array_to_string(regexp_extract_all(html, '<li><a href=\"[^\"]*\">([^<]*)</a>', 1), '|')")} AS nav,
  {UNESCAPED.format("regexp_extract(html, '<div class=\"ad\">([^<]*)</div>', 1)")} AS ad,
  {UNESCAPED.format("regexp_extract(html, '<footer>([^<]*)</footer>', 1)")} AS footer,
  len(regexp_extract_all(html, '<a [^>]*href=')) AS links FROM pages""")
def select_page_html(spark, d):
    pages = at_least_parallel(views.table(spark, d, "pages"), "page_id")
    found = select_html(
        "html",
        {
            "h1": ("h1", "text"),
            "article_h1": ("article > h1", "text"),
            "nav": ("nav li a", "texts"),
            "ad": (".ad", "text"),
            "footer": ("footer", "text"),
            "links": ("a", "attr:href"),
        },
    )
    rows = pages.select("page_id", found.alias("f")).select("page_id", "f.*")
    return rows.withColumn("nav", F.array_join("nav", "|")).withColumn("links", F.size("links").cast("bigint"))


@query("enrich_details", f"""SELECT page_id, trim({UNESCAPED.format("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")}) AS title,
  trim({UNESCAPED.format("regexp_extract(html, '<div class=\"ad\">([^<]*)</div>', 1)")}) AS location,
  trim(replace(replace(replace(replace(regexp_extract(html, '<footer>([^<]*)</footer>', 1), '&copy;', '©'),
    '&middot;', '·'), '''', '&#39;'), '"', '&#34;')) AS description_text FROM pages""")
def enrich_details(spark, d):
    pages = at_least_parallel(views.table(spark, d, "pages"), "page_id")
    selectors = F.struct(
        F.lit("article > h1").alias("title"), F.lit("div.ad").alias("location"), F.lit("footer").alias("description")
    )
    found = enrich.enrich_details(pages.withColumn("selectors", selectors))
    # Style tags left open in the article are opened again in the footer.
    text = F.regexp_replace("description", "<[^>]*>", "")
    return found.select("page_id", "title", "location", text.alias("description_text"))


OUTCOMES = f"""labelled AS (SELECT *, {FIRST} FROM refs),
page AS (SELECT url, CASE WHEN page_id % 17 = 0 THEN 404 WHEN page_id % 19 = 0 THEN 500 ELSE 200 END AS status_code,
  trim({UNESCAPED.format("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")}) AS h1 FROM pages),
staged AS (
  SELECT r.*, s.name, p.status_code, p.h1 FROM labelled r LEFT JOIN matched m ON r.seq = m.seq
  LEFT JOIN scrapers s ON m.scraper_key = s.scraper_key LEFT JOIN page p ON r.url = p.url),
outcome AS (
  SELECT seq, external_id, company_name, url, CASE WHEN is_duplicate THEN NULL
    WHEN external_id = '' OR url = '' OR company_name = '' THEN 'invalid job reference: missing required fields'
    WHEN name IS NULL THEN 'failed to enrich job reference ' || external_id || ': no scraper configuration found for URL: ' || url
    WHEN status_code <> 200 THEN 'failed to enrich job reference ' || external_id || ': failed to scrape job from '
      || name || ': failed after 3 attempts: received non-OK status code: ' || status_code
    WHEN h1 = '' THEN 'failed to enrich job reference ' || external_id || ': failed to scrape job from '
      || name || ': failed after 3 attempts: could not extract job title using selector: article > h1' END AS error,
    is_duplicate, h1 FROM staged)"""


@query("process_refs", with_(REFS, SCRAPERS, MATCH, OUTCOMES) + """SELECT seq, external_id, company_name, url,
  CASE WHEN is_duplicate THEN 'duplicate' WHEN error IS NOT NULL THEN 'failed' ELSE 'success' END AS status, error,
  CASE WHEN NOT is_duplicate AND error IS NULL THEN h1 END AS title FROM outcome""")
def process_refs(spark, d):
    done = enrich.process_refs(views.refs(spark, d), views.pages(spark, d), views.scrapers(spark))
    return done.select("seq", "external_id", "company_name", "url", "status", "error", "title")


@query("sink_results_log", with_(RESULTS) + "SELECT * FROM results")
def sink_results_log(spark, d):
    """Outcomes written as JSON lines and read back."""
    path = scratch_path(spark, "results-log")
    results = views.results(spark, d)
    enrich.write_results_log(results, path)
    return enrich.read_results_log(spark, path, results.schema)


# --- writes ------------------------------------------------------------------

S = with_(JOBS, STORED)


@query("valid_details", with_(JOBS) + """SELECT external_id, CASE WHEN id % 9 = 0 THEN '' ELSE title END <> '' AND url <> ''
  AND company_name <> '' AND external_id <> '' AS valid FROM jobs""")
def valid_details(spark, d):
    """Every posting; every ninth has lost its title."""
    title = F.when(F.col("id") % 9 == 0, "").otherwise(F.col("title"))
    return views.jobs(spark, d).withColumn("title", title).select("external_id", scalars.valid_details().alias("valid"))


@query("join_upsert", S + """SELECT coalesce(s.external_id, i.external_id) AS external_id,
  CASE WHEN s.external_id IS NULL THEN 'insert' WHEN i.external_id IS NULL THEN 'keep' ELSE 'touch' END AS action
FROM stored s FULL OUTER JOIN incoming i ON s.external_id = i.external_id""")
def join_upsert(spark, d):
    return upsert.upsert_keys(*views.stored_and_incoming(spark, d))


UPSERT_SQL = S + """SELECT s.id, s.external_id, s.company_name, s.url, s.title, s.location, s.description, s.first_seen_at,
  CASE WHEN i.external_id IS NOT NULL THEN TIMESTAMP '2025-01-01' ELSE s.last_seen_at END AS last_seen_at, s.expired_at
FROM stored s LEFT JOIN incoming i ON s.external_id = i.external_id
UNION ALL
SELECT (SELECT max(id) FROM stored) + row_number() OVER (ORDER BY external_id), external_id, company_name, url, title, location,
  description, TIMESTAMP '2025-01-01', TIMESTAMP '2025-01-01', NULL
FROM incoming WHERE external_id NOT IN (SELECT external_id FROM stored)"""


@query("sink_upsert", UPSERT_SQL)
def sink_upsert(spark, d):
    stored, incoming = views.stored_and_incoming(spark, d)
    return upsert.upsert(stored, incoming, NOW)


@query("sink_bulk_upsert", UPSERT_SQL)
def sink_bulk_upsert(spark, d):
    """The batch holds every posting twice; the first one counts."""
    stored, incoming = views.stored_and_incoming(spark, d)
    again = incoming.withColumn("seq", F.col("seq") + 10**12).withColumn("title", F.lit("later"))
    return upsert.upsert(stored, upsert.first_per_key(incoming.unionByName(again)), NOW)


@query("sink_validate_batch", with_(JOBS) + """SELECT id, external_id, url FROM (
  SELECT id, external_id, CASE WHEN location = 'es' AND title LIKE '%e%' THEN '' ELSE url END AS url FROM jobs) WHERE url <> '' """)
def sink_validate_batch(spark, d):
    """Quarantine mode over every posting: the good part of a batch with bad rows."""
    bad = (F.col("location") == "es") & F.col("title").contains("e")
    batch = views.jobs(spark, d).withColumn("url", F.when(bad, "").otherwise(F.col("url")))
    return upsert.check_batch(batch, "quarantine")[0].select("id", "external_id", "url")


@query("sink_validate_all", with_(JOBS) + """, batch AS (
  SELECT id, id % 2 AS half, external_id, CASE WHEN id % 2 = 0 AND title LIKE '%e%' THEN '' ELSE url END AS url FROM jobs)
SELECT id, external_id, url FROM batch b WHERE NOT EXISTS (SELECT 1 FROM batch x WHERE x.half = b.half AND x.url = '')""")
def sink_validate_all(spark, d):
    """All-or-nothing mode over two batches that hold every posting: one bad row empties its batch, and no other."""
    jobs = views.jobs(spark, d)
    bad = (F.col("id") % 2 == 0) & F.col("title").contains("e")
    jobs = jobs.withColumn("url", F.when(bad, "").otherwise(F.col("url")))
    halves = [upsert.accepted(jobs.where(F.col("id") % 2 == half)) for half in (0, 1)]
    return halves[0].unionByName(halves[1]).select("id", "external_id", "url")


@query("sink_insert", S + """SELECT count(*) AS n, count(DISTINCT external_id) AS ids FROM (
  SELECT external_id FROM stored UNION ALL
  SELECT external_id FROM incoming WHERE external_id NOT IN (SELECT external_id FROM stored))""")
def sink_insert(spark, d):
    stored, incoming = views.stored_and_incoming(spark, d)
    path = scratch_path(spark, "jobs")
    columns = ["external_id", "company_name", "url", "title", "location", "description"]
    stored.select(*columns).write.parquet(path)
    table = spark.read.schema(stored.select(*columns).schema).parquet(path)
    new = incoming.select(*columns).join(table.select("external_id"), "external_id", "left_anti")
    upsert.insert(path, new.select(*columns), table)
    after = spark.read.schema(table.schema).parquet(path)
    return after.agg(F.count("*").alias("n"), F.count_distinct("external_id").alias("ids"))


@query("assign_ids", "SELECT count(*) AS n, count(*) AS ids, CAST(101 AS BIGINT) AS low, 100 + count(*) AS high FROM documents")
def assign_ids(spark, d):
    numbered = ids.assign_ids(views.jobs(spark, d).select("external_id"), start=101)
    return numbered.agg(
        F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.min("id").alias("low"), F.max("id").alias("high")
    )


@query("change_tracking", S + """SELECT s.external_id FROM stored s JOIN incoming i ON s.external_id = i.external_id
WHERE s.title <> i.title OR s.description <> i.description OR s.location <> i.location""")
def change_tracking(spark, d):
    return upsert.changed_content(*views.stored_and_incoming(spark, d)).select("external_id")


@query("expire_missing", S + """SELECT id, CASE WHEN expired_at IS NULL
  AND company_name IN (SELECT company_name FROM incoming) AND external_id NOT IN (SELECT external_id FROM incoming)
  THEN TIMESTAMP '2025-01-01' ELSE expired_at END AS expired_at FROM stored""")
def expire_missing(spark, d):
    stored, incoming = views.stored_and_incoming(spark, d)
    return upsert.expire_missing(stored, incoming, NOW).select("id", "expired_at")


@query("expire_unlisted", with_(JOBS) + """SELECT id, CASE WHEN expired_at IS NULL AND (id - 1) % 3 = 0
  AND right(company_name, 1) NOT IN ('1', '4') THEN TIMESTAMP '2025-01-01' ELSE expired_at END AS expired_at FROM jobs""")
def expire_unlisted(spark, d):
    """Two crawls; the second broke off at the sources whose name ends in 1 or 4, which expire nothing."""
    listed = views.crawls(spark, d)
    second = F.expr(views.EPOCH) + F.make_dt_interval(F.lit(0), F.lit(36))
    log = expiry.listing_intervals(expiry.listing_intervals(None, listed.where(F.col("fetched_at") < second)), listed.where(F.col("fetched_at") >= second))
    responses = views.table(spark, d, "documents").select(F.col("source").alias("source_key"))
    responses = responses.withColumn("fetched_at", F.expr(views.EPOCH) + F.make_dt_interval(F.lit(2)))
    crawls = expiry.crawl_log(responses, responses.where(F.substring("source_key", -1, 1).isin("1", "4")))
    return expiry.expire_unlisted(views.jobs(spark, d), log, crawls, NOW).select("id", "expired_at")

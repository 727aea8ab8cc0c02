"""The data model, derived from the provided tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.session import at_least_parallel

EPOCH = "timestamp_ntz'2024-01-01 00:00:00'"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _hours(n: Column | str) -> Column:
    n = F.col(n) if isinstance(n, str) else n
    return F.expr(EPOCH) + F.make_dt_interval(F.lit(0), n)


def jobs(spark: SparkSession, d: str, spread: bool = False, docs: DataFrame | None = None) -> DataFrame:
    """``spread`` is for searches, which do heavy work on every text; ``docs``
    replaces the documents, by a stream of them for one."""
    docs = docs if docs is not None else table(spark, d, "documents")
    if spread:
        docs = at_least_parallel(docs, "doc_id")
    docs = docs.join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    title = F.nullif(F.trim(F.regexp_extract("text", r"^([^.\n]*)", 1)), F.lit(""))
    seen_last = F.col("doc_id") + F.col("n_chars") % 720
    return docs.select(
        (F.col("doc_id") + 1).alias("id"),
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("external_id"),
        F.col("source").alias("company_name"),
        F.concat(
            F.lit("https://"), "source", F.lit(".example.com/jobs/"), F.col("doc_id").cast("string")
        ).alias("url"),
        F.coalesce(title, F.lit("untitled")).alias("title"),
        F.col("lang").alias("location"),
        F.col("text").alias("description"),
        _hours("doc_id").alias("first_seen_at"),
        _hours(seen_last).alias("last_seen_at"),
        F.when(F.col("quality") == 0, _hours(seen_last + 24)).alias("expired_at"),
    )


def refs(spark: SparkSession, d: str) -> DataFrame:
    host = F.regexp_extract("url", r"https?://([^/?#]+)", 1)
    return table(spark, d, "pages").select(
        F.col("page_id").alias("seq"),
        host.alias("source_key"),
        F.regexp_extract("url", "/[a-z]{2}/([0-9]+)", 1).alias("external_id"),
        "url",
        host.alias("company_name"),
    )


def _ts(c: str) -> Column:
    return F.col(c).cast("timestamp_ntz")


def results(spark: SparkSession, d: str) -> DataFrame:
    status = (
        F.when(F.col("event_type") == "error", "failed")
        .when(F.col("event_type") == "click", "duplicate")
        .otherwise("success")
    )
    return table(spark, d, "events").select(
        "event_id",
        F.col("user_id").cast("string").alias("external_id"),
        F.concat(F.lit("company"), (F.col("user_id") % 7).cast("string")).alias("company_name"),
        status.alias("status"),
        F.col("value").alias("processing_ms"),
        _ts("ts").alias("ts"),
    )


def attempts(spark: SparkSession, d: str) -> DataFrame:
    status = (
        F.when(F.col("event_type") == "error", 500)
        .when(F.col("event_id") % 11 == 0, 404)
        .when(F.col("event_id") % 13 == 0, 403)
        .otherwise(200)
    )
    return table(spark, d, "events").select(
        F.col("user_id").alias("job_key"),
        F.col("event_id").alias("attempt_seq"),
        status.cast("int").alias("status_code"),
    )


# Fixed settings for the derived references: keys, patterns and selectors.
SCRAPER_ROWS = """
    ('alpha', 'Alpha', array('example.com'), true),
    ('beta', 'Beta', array('tionsh.example.net', 'example.org'), true),
    ('delta', 'Delta', array('example.net/en/'), true),
    ('gamma', 'Gamma', array('example.net/de/', '/es/'), false),
    ('omega', 'Omega', array('ththan.example.net'), true)
"""


def scrapers(spark: SparkSession, title: str = "article > h1") -> DataFrame:
    rows = spark.sql(
        f"SELECT * FROM VALUES {SCRAPER_ROWS} AS t(scraper_key, name, url_patterns, enabled)"
    )
    selectors = F.struct(
        F.lit(title).alias("title"), F.lit("div.ad").alias("location"), F.lit("footer").alias("description")
    )
    return rows.select("scraper_key", "name", "url_patterns", selectors.alias("selectors"), "enabled")


def stored_and_incoming(spark: SparkSession, d: str, docs: DataFrame | None = None):
    """A stored table and a batch that overlap, and hold every posting between
    them: labelled, English and French ones are stored, and the batch has new
    titles for all that are not French."""
    labelled = table(spark, d, "labels").select((F.col("doc_id") + 1).alias("id"), F.lit(True).alias("has"))
    all_jobs = jobs(spark, d).join(labelled, "id", "left")
    is_french = F.col("location").eqNullSafe("fr")
    stored = all_jobs.where(F.col("has").isNotNull() | F.col("location").eqNullSafe("en") | is_french).drop("has")
    batch = jobs(spark, d, docs=docs).where(~is_french)
    incoming = batch.select(
        F.col("id").alias("seq"),
        "external_id",
        "company_name",
        "url",
        F.concat(F.lit("NEW "), "title").alias("title"),
        "location",
        "description",
    )
    return stored, incoming


def pages(spark: SparkSession, d: str) -> DataFrame:
    """Posting pages with a status: every 17th is gone, every 19th failed."""
    status = F.when(F.col("page_id") % 17 == 0, 404).when(F.col("page_id") % 19 == 0, 500).otherwise(200)
    return table(spark, d, "pages").select("page_id", "url", status.cast("int").alias("status_code"), "html")


# One sitemap or API source per third of the hosts, by the length of the name.
def source_of(host: Column) -> Column:
    return F.concat(F.lit("src"), (F.length(host) % 5).cast("string"))


SOURCE_ROWS = """
    ('src0', 'Zero', 'sitemap', 'https://s0', '/[a-z]{2}/([0-9]+)', CAST(NULL AS STRING), '', '', '', true),
    ('src1', 'One', 'sitemap', 'https://s1', '([0-9]+)', NULL, '', '', '', true),
    ('src2', 'Two', 'sitemap', 'https://s2', 'no-group', NULL, '', '', '', true),
    ('src3', 'Three', 'sitemap', 'https://s3', '/en/([0-9]+)', NULL, '', '', '', false),
    ('html0', 'Html 0', 'html', 'https://h0', '/([A-Za-z]+)', 'nav li a', '', '', '', true),
    ('html1', 'Html 1', 'html', 'https://h1', '/([A-Za-z]+)', 'li > a', '', '', '', true),
    ('api0', 'Api 0', 'api', 'https://a0', NULL, NULL, 'data.jobs', 'id', 'https://a/jobs/{id}', true),
    ('api1', 'Api 1', 'api', 'https://a1', NULL, NULL, 'data.jobs', '', 'https://a/jobs/{id}', true)
"""


def sources(spark: SparkSession) -> DataFrame:
    cols = "source_key, name, fetch_type, url, id_pattern, link_selector, jobs_path, id_field, url_template, enabled"
    rows = spark.sql(f"SELECT * FROM VALUES {SOURCE_ROWS} AS t({cols})")
    method = F.when(F.col("fetch_type") == "api", "GET").otherwise("")
    return rows.withColumn("method", method)


def sitemap_responses(spark: SparkSession, d: str) -> DataFrame:
    """Sitemap bodies of up to 50 URLs each, by host class."""
    host = F.regexp_extract("url", r"https?://([^/?#]+)", 1)
    rows = table(spark, d, "pages").select("page_id", "url", source_of(host).alias("source_key"))
    loc = F.concat(F.lit("<url><loc>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</loc></url>"))
    part = F.floor(F.col("page_id") / 50)
    bodies = rows.groupBy("source_key", part.alias("part")).agg(
        F.sort_array(F.collect_list(F.struct("page_id", loc.alias("loc")))).alias("locs")
    )
    text = F.array_join(F.transform("locs", lambda s: s["loc"]), "")
    return bodies.select(
        "source_key",
        F.concat("source_key", F.lit("/"), F.col("part").cast("string")).alias("url"),
        F.when(F.col("part") % 5 == 4, 503).otherwise(200).cast("int").alias("status_code"),
        F.concat(F.lit('<?xml version="1.0"?><urlset>'), text, F.lit("</urlset>")).alias("body"),
    )


def html_responses(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select(
        F.concat(F.lit("html"), (F.length("url") % 2).cast("string")).alias("source_key"),
        "url",
        F.lit(200).alias("status_code"),
        F.col("html").alias("body"),
    )


def api_responses(spark: SparkSession, d: str) -> DataFrame:
    """API bodies per user and stretch of 500 events, so none grows with the data."""
    rows = table(spark, d, "events").select("event_id", "user_id", F.floor(F.col("event_id") / 500).alias("part"))
    bodies = rows.groupBy("user_id", "part").agg(F.sort_array(F.collect_list("event_id")).alias("ids"))
    items = F.transform("ids", lambda i: F.concat(F.lit('{"id":'), i.cast("string"), F.lit("}")))
    return bodies.select(
        F.concat(F.lit("api"), (F.col("user_id") % 2).cast("string")).alias("source_key"),
        F.concat(F.lit("u"), "user_id", F.lit("/"), "part").alias("url"),
        F.lit(200).alias("status_code"),
        F.concat(F.lit('{"data":{"jobs":['), F.array_join(items, ","), F.lit("]}}")).alias("body"),
    )


def requests(spark: SparkSession, d: str) -> DataFrame:
    status = (
        F.when(F.col("event_type") == "error", 500)
        .when(F.col("event_id") % 11 == 0, 404)
        .when(F.col("event_id") % 13 == 0, 403)
        .otherwise(200)
    )
    text = F.col("event_id").cast("string")
    headers = F.create_map(
        F.lit("Cookie"),
        F.concat(F.lit("c"), text),
        F.lit("AUTHORIZATION"),
        F.lit("secret"),
        F.lit("Accept"),
        F.col("event_type"),
        F.lit("X-Forwarded-For"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("10.0.0."), (F.col("event_id") % 250).cast("string"), F.lit(", 10.9.9.9"))).otherwise(""),
    )
    return table(spark, d, "events").select(
        F.col("event_id").alias("request_id"),
        F.when(F.col("event_id") % 2 == 0, "POST").otherwise("GET").alias("method"),
        F.concat(F.lit("/api/"), "event_type").alias("path"),
        status.cast("int").alias("status_code"),
        headers.alias("headers"),
        F.lit("192.0.2.1:80").alias("remote"),
        F.repeat("props", (F.col("event_id") % 300).cast("int")).alias("body"),
    )


def landed(spark: SparkSession, d: str) -> DataFrame:
    """Responses of every type, as they landed one after the other."""
    every = sitemap_responses(spark, d).unionByName(html_responses(spark, d)).unionByName(api_responses(spark, d))
    minutes = F.length("url") * 7 % 60
    return every.withColumn("fetched_at", F.expr(EPOCH) + F.make_dt_interval(mins=minutes))


def crawls(spark: SparkSession, d: str) -> DataFrame:
    """Two crawls of the documents' sources: the second lists two of three, and broke off at some sources."""
    docs = table(spark, d, "documents").select(F.col("source").alias("source_key"), "doc_id")
    day = lambda n: F.expr(EPOCH) + F.make_dt_interval(F.lit(n))
    first = docs.withColumn("fetched_at", day(1))
    second = docs.where("doc_id % 3 <> 0").withColumn("fetched_at", day(2))
    both = first.unionByName(second).withColumn("external_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")))
    return both.select("source_key", "external_id", "fetched_at")

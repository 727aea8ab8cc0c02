"""From a reference and its page to a posting, with one status per reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.functions.html import select_html
from postlake.functions.settle import settle
from postlake.functions.scalars import non_empty, trim_ws, valid_details, valid_ref
from postlake.operators.attempts import MAX_ATTEMPTS
from postlake.operators.dedup import drop_processed, label_against, label_first
from postlake.sources.config import enabled
from postlake.sources.landing import latest_per_url


def match_scraper(refs: DataFrame, scrapers: DataFrame) -> DataFrame:
    """Adds ``scraper_key``: of the scrapers with a pattern in the URL, the lowest key.

    An equi-join on whole patterns: distinct URLs are cut into pieces of each length
    that a pattern has, so a piece meets only the patterns that it is equal to. The
    empty pattern is in every URL. A null URL has no scraper.
    """
    patterns = scrapers.where(enabled()).select("scraper_key", F.explode("url_patterns").alias("pattern"))
    patterns = patterns.where("pattern IS NOT NULL").groupBy("pattern").agg(F.min("scraper_key").alias("scraper_key"))
    lengths = patterns.agg(F.sort_array(F.collect_set(F.length("pattern"))).alias("sizes"))
    pieces = "flatten(transform(sizes, n -> if(length(url) >= n, transform(sequence(1, length(url) - n + 1), i -> substring(url, i, n)), array())))"
    urls = refs.where("url IS NOT NULL").select("url").distinct()
    cut = urls.withColumn("sizes", lengths.scalar()).select("url", F.explode(F.expr(f"array_distinct({pieces})")).alias("pattern"))
    best = cut.join(patterns, "pattern").groupBy("url").agg(F.min("scraper_key").alias("scraper_key"))
    return refs.join(best, "url", "left").select(*refs.columns, "scraper_key")


def with_scraper(refs: DataFrame, scrapers: DataFrame) -> DataFrame:
    """Adds ``scraper_key``, ``scraper_name`` and ``selectors``."""
    chosen = scrapers.select("scraper_key", F.col("name").alias("scraper_name"), "selectors")
    return match_scraper(refs, scrapers).join(chosen, "scraper_key", "left")


def enrich_details(pages: DataFrame) -> DataFrame:
    """Adds ``title``, ``location`` and ``description`` from ``html`` by ``selectors``.

    Title and location are the text of the first match, description its inner
    HTML; all are trimmed.
    """
    found = select_html(
        "html",
        {
            "title": (F.col("selectors.title"), "text"),
            "location": (F.col("selectors.location"), "text"),
            "description": (F.col("selectors.description"), "html"),
        },
    )
    # Settled, so that a filter on the texts does not parse the page once more.
    parsed = settle(pages, "_found", found)
    names = ("title", "location", "description")
    return parsed.select(
        *[c for c in pages.columns if c not in names],
        *[trim_ws(F.col(f"_found.{n}")).alias(n) for n in names],
    )


def _attempt(refs: DataFrame, pages: DataFrame, scrapers: DataFrame) -> DataFrame:
    """Runs references through checks in order; the first error found stays."""
    checked = refs.withColumn(
        "error", F.when(~valid_ref(), "invalid job reference: missing required fields")
    )
    matched = with_scraper(checked, scrapers)
    none = F.concat(F.lit("no scraper configuration found for URL: "), F.coalesce("url", F.lit("")))
    if "fetched_at" in pages.columns:
        # A page that landed again must not give a second outcome.
        pages = latest_per_url(pages)
    fetched = matched.join(pages.select("url", "status_code", "html"), "url", "left")
    status = F.concat(F.lit("received non-OK status code: "), F.col("status_code").cast("string"))
    scrape = F.coalesce(
        F.when(F.col("status_code").isNull(), "failed to fetch URL"),
        F.when(F.col("status_code") != 200, status),
    )

    def scrape_failed(reason: Column) -> Column:
        return F.concat(
            F.lit("failed to scrape job from "),
            "scraper_name",
            F.lit(f": failed after {MAX_ATTEMPTS} attempts: "),
            reason,
        )

    early = F.coalesce("error", F.when(F.col("scraper_key").isNull(), none), scrape_failed(scrape))
    ready = fetched.withColumn("error", early)
    # Pages of failed references are not parsed.
    ready = ready.withColumn("html", F.when(F.col("error").isNull(), F.col("html")))
    parsed = enrich_details(ready)
    untitled = F.concat(F.lit("could not extract job title using selector: "), "selectors.title")
    late = F.coalesce(
        "error",
        F.when(~non_empty("title"), scrape_failed(untitled)),
        F.when(
            ~valid_details(company="scraper_name"), "invalid job details: missing required fields"
        ),
    )
    return parsed.withColumn("error", late)


# Times keep their microseconds.
LOG_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"

OUTCOME = [
    "seq",
    "external_id",
    "company_name",
    "scraper_name",
    "url",
    "status",
    "error",
    "title",
    "location",
    "description",
]


def process_refs(
    refs: DataFrame,
    pages: DataFrame,
    scrapers: DataFrame,
    processed: DataFrame | None = None,
    mark_on: str = "attempt",
) -> DataFrame:
    """One outcome per reference: ``duplicate``, ``failed`` or ``success``.

    ``mark_on='attempt'`` takes an id as processed once it was tried, so a failed
    one is not tried again; ``'success'`` keeps trying its later rows. References
    come before pages: duplicates never meet a page or the HTML parser.
    """
    if mark_on not in ("attempt", "success"):
        raise ValueError(f"unknown mark_on: {mark_on}")
    first_try = mark_on == "attempt"
    if first_try:
        labelled = label_first(refs) if processed is None else label_against(refs, processed)
    else:
        fresh = refs if processed is None else drop_processed(refs, processed)
        known = refs.join(fresh.select("seq", F.lit(True).alias("_new")), "seq", "left")
        labelled = known.select(*refs.columns, F.col("_new").isNull().alias("is_duplicate"))
    blank = [F.lit(None).cast("string").alias(c) for c in ("scraper_name", "error", "title", "location", "description")]
    duplicates = labelled.where("is_duplicate").select(*refs.columns, F.lit("duplicate").alias("status"), *blank)
    tried = _attempt(labelled.where("NOT is_duplicate").drop("is_duplicate"), pages, scrapers)
    tried = tried.withColumn("status", F.when(F.col("error").isNull(), "success").otherwise("failed"))
    if not first_try:
        done = tried.where((F.col("status") == "success") & non_empty("external_id"))
        first = done.groupBy("external_id").agg(F.min("seq").alias("_first"))
        tried = tried.join(first, "external_id", "left")
        later = F.coalesce(F.col("seq") > F.col("_first"), F.lit(False))
        tried = tried.withColumn("status", F.when(later, "duplicate").otherwise(F.col("status")))
        tried = tried.withColumn("error", F.when(~later, F.col("error")))
    wrapped = F.when(
        F.col("error").startswith("failed to scrape")
        | F.col("error").startswith("no scraper")
        | F.col("error").startswith("invalid job reference"),
        F.when(F.col("error").startswith("invalid job reference"), F.col("error")).otherwise(
            F.concat(F.lit("failed to enrich job reference "), "external_id", F.lit(": "), "error")
        ),
    ).otherwise(F.col("error"))
    ok = F.col("status") == "success"
    texts = [F.when(ok, F.col(c)).alias(c) for c in ("title", "location", "description")]
    tried = tried.select(*refs.columns, "status", "scraper_name", wrapped.alias("error"), *texts)
    return duplicates.unionByName(tried).select(*OUTCOME)


def details_of(outcomes: DataFrame) -> DataFrame:
    """The postings to store: successes, named after their scraper."""
    return outcomes.where("status = 'success'").select(
        "seq",
        "external_id",
        F.col("scraper_name").alias("company_name"),
        "url",
        "title",
        "location",
        "description",
    )


def results_of(outcomes: DataFrame) -> DataFrame:
    return outcomes.select("external_id", "company_name", "status", "error")


def write_results_log(results: DataFrame, path: str) -> None:
    """Outcomes as JSON lines, one file per task, appended."""
    results.write.mode("append").option("timestampNTZFormat", LOG_TIME).json(path)


def read_results_log(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("timestampNTZFormat", LOG_TIME).json(path)

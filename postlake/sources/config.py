"""Source and scraper settings from YAML, checked as DataFrames.

Settings are read by whoever starts the job, and small by nature: they are
written by hand. Large tables of settings work as well, as nothing here asks
for a broadcast; Spark measures and decides.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.functions.html import compile_selector
from postlake.functions.scalars import non_empty
from postlake.schema import SCRAPERS, SOURCES


class InvalidConfig(ValueError):
    pass


def _yaml(path: str) -> dict:
    try:
        import yaml
    except ImportError as e:  # pragma: no cover
        raise RuntimeError("reading YAML settings needs PyYAML") from e
    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def _rows(entries: dict, key_name: str, schema) -> list[tuple]:
    out = []
    for key in sorted(entries):
        given = {**(entries[key] or {}), key_name: key}
        out.append(tuple(given.get(f) for f in schema.fieldNames()))
    return out


def source_error() -> Column:
    """The first rule a source breaks, or null."""
    fetch = F.coalesce("fetch_type", F.lit(""))
    return F.coalesce(
        F.when(~non_empty("name"), "company name is required"),
        F.when(~non_empty("url"), "company URL is required"),
        F.when(
            ~fetch.isin("sitemap", "html", "api"), F.concat(F.lit("invalid fetch type: "), fetch)
        ),
        F.when((fetch == "html") & ~non_empty("link_selector"), "link_selector is required for HTML fetch type"),
        F.when((fetch == "api") & ~non_empty("method"), "method is required for API fetch type"),
    )


def scraper_error() -> Column:
    return F.coalesce(
        F.when(~non_empty("name"), "scraper name is required"),
        F.when(F.coalesce(F.size("url_patterns"), F.lit(0)) < 1, "at least one URL pattern is required"),
        F.when(~non_empty("selectors.title"), "title selector is required"),
        F.when(~non_empty("selectors.location"), "location selector is required"),
        F.when(~non_empty("selectors.description"), "description selector is required"),
    )


def enabled() -> Column:
    """A missing flag means off."""
    return F.coalesce("enabled", F.lit(False))


def _refuse(rows: DataFrame, key: str, error: Column, what: str) -> None:
    bad = rows.select(key, error.alias("e")).where("e IS NOT NULL").orderBy(key).first()
    if bad is not None:
        raise InvalidConfig(f"invalid {what} for {bad[0]}: {bad[1]}")


def load_sources(spark: SparkSession, path: str) -> DataFrame:
    """All sources of a YAML file; the first invalid one stops the load."""
    rows = _rows(_yaml(path).get("companies") or {}, "source_key", SOURCES)
    at = SOURCES.fieldNames().index("id_pattern")
    for row in rows:
        try:
            re.compile(row[at] or "")
        except re.error as e:
            raise InvalidConfig(f"invalid regex pattern for company {row[0]}: {e}") from e
    sources = spark.createDataFrame(rows, SOURCES)
    _refuse(sources, "source_key", source_error(), "config")
    return sources


def load_scrapers(spark: SparkSession, path: str) -> DataFrame:
    rows = []
    for key, entry in sorted((_yaml(path).get("scrapers") or {}).items()):
        chosen = entry.get("selectors") or {}
        selectors = tuple(chosen.get(c) for c in ("title", "location", "description"))
        rows.append((key, entry.get("name"), entry.get("url_patterns"), selectors, entry.get("enabled")))
        for selector in filter(None, selectors):
            compile_selector(selector)
    scrapers = spark.createDataFrame(rows, SCRAPERS)
    _refuse(scrapers, "scraper_key", scraper_error(), "scraper config")
    return scrapers


def registered_sources(sources: DataFrame) -> DataFrame:
    return sources.where(enabled()).select("source_key")


def registered_scrapers(scrapers: DataFrame) -> DataFrame:
    return scrapers.where(enabled()).select("name")


def coverage_gap(sources: DataFrame, scrapers: DataFrame) -> DataFrame:
    """Which keys can be discovered, which enriched, and which only one of both."""
    a = registered_sources(sources).select(F.col("source_key").alias("company_key"), F.lit(True).alias("a"))
    b = scrapers.where(enabled()).select(F.col("scraper_key").alias("company_key"), F.lit(True).alias("b"))
    return a.join(b, "company_key", "full_outer").select(
        "company_key",
        F.coalesce("a", F.lit(False)).alias("discoverable"),
        F.coalesce("b", F.lit(False)).alias("enrichable"),
    )


def coverage_counts(sources: DataFrame, scrapers: DataFrame) -> DataFrame:
    return coverage_gap(sources, scrapers).agg(
        F.count_if("discoverable").alias("discovery_companies"),
        F.count_if("enrichable").alias("enrichment_companies"),
    )

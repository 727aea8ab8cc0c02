"""References out of landed responses: sitemap XML, listing HTML, JSON APIs.

A response takes one of three ways by the ``fetch_type`` of its source. Each
yields rows of references; a response that cannot be read yields one row in the
error table and does not disturb the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.functions.html import select_html
from postlake.functions.scalars import extract_id, non_empty, url_from_template
from postlake.functions.settle import settle
from postlake.sources.config import enabled

SITEMAP_TYPE = "url array<struct<loc string>>, _corrupt_record string"
FOUND = ["source_key", "company_name", "response_url", "pos", "external_id", "url"]


def join_source_config(responses: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds the settings of each response's source, and ``error`` where it has none.

    No broadcast is asked for: the settings are small and Spark sees their size.
    """
    config = sources.where(enabled()).select(
        F.col("source_key"),
        *[
            F.col(c).alias(f"cfg_{c}")
            for c in ("fetch_type", "id_pattern", "link_selector", "jobs_path", "id_field", "url_template")
        ],
    )
    joined = responses.join(config, "source_key", "left")
    missing = F.concat(F.lit("company "), "source_key", F.lit(" not registered"))
    not_ok = F.concat(F.lit("received non-OK status code: "), F.col("status_code").cast("string"))
    return joined.withColumn(
        "error",
        F.coalesce(F.when(F.col("cfg_fetch_type").isNull(), missing), F.when(F.col("status_code") != 200, not_ok)),
    )


def _of(ready: DataFrame, fetch_type: str) -> DataFrame:
    return ready.where(F.col("error").isNull() & (F.col("cfg_fetch_type") == fetch_type))


def _refs(items: DataFrame, external_id: Column, url: Column) -> DataFrame:
    return items.select(
        "source_key",
        # References are named after the settings key.
        F.col("source_key").alias("company_name"),
        "response_url",
        F.col("pos").cast("bigint").alias("pos"),
        external_id.alias("external_id"),
        url.alias("url"),
    )


def parse_sitemaps(ready: DataFrame) -> DataFrame:
    """Adds ``locs`` (the ``url/loc`` texts below the root) and the parse error."""
    doc = F.from_xml(
        "body",
        SITEMAP_TYPE,
        {"ignoreSurroundingSpaces": "false"},
    )
    parsed = settle(ready, "doc", doc)
    bad = F.col("doc").isNull() | F.col("doc._corrupt_record").isNotNull()
    return parsed.withColumn("error", F.when(bad, "failed to parse sitemap")).withColumn(
        "locs", F.col("doc.url.loc")
    )


def refs_from_sitemaps(ready: DataFrame) -> tuple[DataFrame, DataFrame]:
    parsed = parse_sitemaps(_of(ready, "sitemap"))
    good = parsed.where("error IS NULL")
    items = good.select(
        "source_key", F.col("url").alias("response_url"), "cfg_id_pattern", F.posexplode("locs").alias("pos", "loc")
    )
    refs = _refs(items, extract_id("loc", "cfg_id_pattern"), F.col("loc")).where("external_id != ''")
    return refs, parsed.where("error IS NOT NULL").select("source_key", F.col("url").alias("response_url"), "error")


def refs_from_html(ready: DataFrame) -> DataFrame:
    """All matches of the link selector that have an ``href``, kept verbatim."""
    pages = _of(ready, "html")
    found = select_html("body", {"hrefs": (F.col("cfg_link_selector"), "attr:href")})
    items = settle(pages, "found", found).select(
        "source_key",
        F.col("url").alias("response_url"),
        "cfg_id_pattern",
        F.posexplode("found.hrefs").alias("pos", "href"),
    )
    return _refs(items, extract_id("href", "cfg_id_pattern"), F.col("href")).where("external_id != ''")


def json_path(path: Column) -> Column:
    """``a.b`` as a variant path that takes any character in a key (see :func:`_key`)."""
    return F.concat(F.lit("$"), F.aggregate(F.split(path, r"\."), F.lit(""), lambda done, k: F.concat(done, _key(k))))


def _key(name: Column) -> Column:
    """One step of a variant path, in the quotes that the key does not hold.

    A path has no way to write a key with both kinds of quotes; null then, and nothing is found.
    """
    single, double = F.contains(name, F.lit("'")), F.contains(name, F.lit('"'))
    return F.when(~double, F.concat(F.lit('["'), name, F.lit('"]'))).when(
        ~single, F.concat(F.lit("['"), name, F.lit("']"))
    )


def parse_api(ready: DataFrame) -> DataFrame:
    """Adds ``jobs array<variant>`` and the reason when there is none."""
    has_path = F.coalesce(F.col("cfg_jobs_path") != "", F.lit(False))
    parsed = settle(ready, "v", F.try_parse_json("body")).withColumn(
        "path", F.when(has_path, json_path(F.col("cfg_jobs_path"))).otherwise("$")
    )
    parsed = settle(parsed, "jobs", F.expr("try_variant_get(v, path, 'array<variant>')"))
    at = F.expr("try_variant_get(v, path, 'variant')")
    error = (
        F.when(F.col("v").isNull(), "failed to parse API response")
        .when(at.isNull(), F.concat(F.lit("failed to find jobs at path "), "cfg_jobs_path"))
        .when(
            F.col("jobs").isNull(),
            F.when(
                has_path, F.concat(F.lit("jobs data at path "), "cfg_jobs_path", F.lit(" is not an array"))
            ).otherwise("response is not an array and no jobs_path specified"),
        )
    )
    return parsed.withColumn("error", error)


def variant_id(v: str) -> Column:
    return F.expr(variant_id_sql(v))


def variant_id_sql(v: str) -> str:
    """A string as it is, a number cut to an integer; null for anything else.

    Whole numbers stay exact up to 38 digits; one with a fraction or an exponent is null beyond 64 bits.
    """
    kind = f"schema_of_variant({v})"
    return f"""CASE WHEN {kind} = 'STRING' THEN try_variant_get({v}, '$', 'string')
                 WHEN {kind} = 'BIGINT' THEN CAST(try_variant_get({v}, '$', 'bigint') AS string)
                 WHEN {kind} RLIKE '^DECIMAL.[0-9]+,0.$'
                 THEN CAST(try_variant_get({v}, '$', 'decimal(38,0)') AS string)
                 WHEN {kind} RLIKE '^(DECIMAL|DOUBLE|FLOAT)'
                 THEN CAST(try_cast(try_variant_get({v}, '$', 'double') AS bigint) AS string) END"""


def _id_field() -> Column:
    return F.when(F.coalesce(F.col("cfg_id_field"), F.lit("")) == "", "id").otherwise(F.col("cfg_id_field"))


def refs_from_api(ready: DataFrame) -> tuple[DataFrame, DataFrame]:
    parsed = parse_api(_of(ready, "api"))
    good = parsed.where("error IS NULL")
    # A field name is one key, dots included.
    key = F.concat(F.lit("$"), _key(_id_field()))
    items = good.select(
        "source_key",
        F.col("url").alias("response_url"),
        "cfg_url_template",
        key.alias("key"),
        F.posexplode("jobs").alias("pos", "item"),
    )
    items = settle(items, "id_value", F.expr("try_variant_get(item, key, 'variant')"))
    items = settle(items, "external_id", variant_id("id_value")).where("external_id IS NOT NULL")
    refs = _refs(items, F.col("external_id"), url_from_template("cfg_url_template", "external_id"))
    return refs, parsed.where("error IS NOT NULL").select("source_key", F.col("url").alias("response_url"), "error")


def read_responses_once(ready: DataFrame) -> DataFrame:
    """``items array<struct<pos, external_id, url>>`` and ``error`` of every response, whatever its source's type.

    Each reader sees the bodies of its own type and null for the others, so one pass over the responses does for all.
    """

    def body_of(fetch_type: str) -> Column:
        return F.when(F.col("error").isNull() & (F.col("cfg_fetch_type") == fetch_type), F.col("body"))

    def item(pos: Column, external_id: Column, url: Column) -> Column:
        return F.struct(pos.cast("bigint").alias("pos"), external_id.alias("external_id"), url.alias("url"))

    early = ready.withColumn("early", F.col("error"))
    found = settle(early, "found", select_html(body_of("html"), {"hrefs": (F.col("cfg_link_selector"), "attr:href")}))
    doc = F.from_xml(body_of("sitemap"), SITEMAP_TYPE, {"ignoreSurroundingSpaces": "false"})
    parsed = parse_api(settle(found, "doc", doc).withColumn("body", body_of("api"))).withColumnRenamed("error", "api_error")
    bad_sitemap = F.when(F.col("doc").isNull() | F.col("doc._corrupt_record").isNotNull(), "failed to parse sitemap")
    kind = F.col("cfg_fetch_type")
    late = F.when(kind == "sitemap", bad_sitemap).when(kind == "api", F.col("api_error"))
    pattern, key = F.col("cfg_id_pattern"), F.concat(F.lit("$"), _key(_id_field()))
    sitemap = F.transform("doc.url.loc", lambda x, i: item(i, extract_id(x, pattern), x))
    html = F.transform("found.hrefs", lambda x, i: item(i, extract_id(x, pattern), x))
    ids = settle(parsed.withColumn("key", key), "ids", F.expr("transform(jobs, j -> try_variant_get(j, key, 'variant'))"))
    names = settle(ids, "names", F.expr(f"transform(ids, x -> {variant_id_sql('x')})"))
    api = F.transform("names", lambda x, i: item(i, x, url_from_template("cfg_url_template", x)))
    items = F.when(kind == "sitemap", sitemap).when(kind == "html", html).when(kind == "api", api)
    return names.withColumn("items", items).withColumn("error", F.coalesce("early", late))


def union_sources(responses: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """References of every source, and ``(source_key, response_url, error)`` of
    the responses that gave none because something was wrong with them.

    If the responses have ``fetched_at``, so do the references, and ``seq``: an
    order of arrival over all responses that no two rows share.
    """
    done = read_responses_once(join_source_config(responses, sources))
    timed = ["fetched_at"] if "fetched_at" in responses.columns else []
    rows = done.where("error IS NULL").select("source_key", F.col("url").alias("response_url"), *timed, F.explode("items").alias("item"))
    rows = rows.select("source_key", F.col("source_key").alias("company_name"), "response_url", "item.*", *timed)
    refs = rows.where(non_empty("external_id")).select(*FOUND, *timed)
    if timed:
        refs = refs.withColumn("seq", arrival())
    return refs, done.where("error IS NOT NULL").select("source_key", F.col("url").alias("response_url"), "error")


def arrival() -> Column:
    """When and where a reference came in: compares by time, then source, response and place in it."""
    return F.struct("fetched_at", "source_key", "response_url", "pos")


def discover_company(responses: DataFrame, sources: DataFrame, source_key: str) -> DataFrame:
    """References of one source; the filter reaches the scan of the responses."""
    if sources.where(enabled() & (F.col("source_key") == source_key)).first() is None:
        raise LookupError(f"company {source_key} not registered")
    return union_sources(responses.where(F.col("source_key") == source_key), sources)[0]

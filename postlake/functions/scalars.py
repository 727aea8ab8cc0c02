"""Column helpers shared by the operators. All of them stay inside codegen."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_ws(c: Column | str) -> Column:
    """Strip every kind of Unicode white space; SQL ``trim`` strips only blanks."""
    return F.regexp_replace(_col(c), r"^[\s\p{Z}\x{85}]+|[\s\p{Z}\x{85}]+$", "")


def non_empty(c: Column | str) -> Column:
    return F.coalesce(_col(c) != "", F.lit(False))


def extract_id(url: Column | str, pattern: Column | str) -> Column:
    """Group 1 of a per-row pattern; ``''`` with no pattern, no group or no match.

    ``regexp_extract`` raises for a pattern that has no group, so the pattern is
    only used when it holds an unescaped, capturing parenthesis.
    """
    pattern = _col(pattern)
    bare = F.regexp_replace(pattern, r"\\.|\[(?:\\.|[^\]\\])*\]", "")
    usable = F.coalesce(bare.rlike(r"\((?:[^?]|\?P?<[A-Za-z])"), F.lit(False))
    safe = F.when(usable, F.regexp_replace(pattern, r"\(\?P<", "(?<")).otherwise(F.lit("()"))
    return F.coalesce(F.call_function("regexp_extract", _col(url), safe, F.lit(1)), F.lit(""))


def url_from_template(template: Column | str, external_id: Column | str) -> Column:
    """Put the id in every ``{id}``; a missing template gives ``''``."""
    return F.coalesce(F.replace(_col(template), F.lit("{id}"), _col(external_id)), F.lit(""))


def num_to_id(c: Column | str) -> Column:
    """A number as an id: fraction cut off toward zero; null beyond 64 bits."""
    return _col(c).try_cast("bigint").cast("string")


def url_matches(url: Column | str, patterns: Column | str) -> Column:
    """True when the URL holds any of the patterns as a plain substring."""
    url = _col(url)
    return F.coalesce(F.exists(_col(patterns), lambda p: F.contains(url, p)), F.lit(False))


def valid_ref(url: str = "url", external_id: str = "external_id", company: str = "company_name") -> Column:
    return non_empty(url) & non_empty(external_id) & non_empty(company)


def valid_details(
    external_id: str = "external_id",
    company: str = "company_name",
    url: str = "url",
    title: str = "title",
) -> Column:
    """Location and description may be empty."""
    return non_empty(external_id) & non_empty(company) & non_empty(url) & non_empty(title)


def parse_day(c: Column | str) -> Column:
    """A column of ``YYYY-MM-DD`` strings as timestamps; anything else is null."""
    c = _col(c)
    good = c.rlike(r"^\d{4}-\d{2}-\d{2}$")
    return F.when(good, F.try_to_timestamp(c, F.lit("yyyy-MM-dd"))).cast("timestamp_ntz")


def day_or_none(text: str | None) -> dt.datetime | None:
    """The same rule for a parameter of a query."""
    if not text or not re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", text):
        return None
    try:
        return dt.datetime.fromisoformat(text)
    except ValueError:
        return None


def ntz(value: dt.datetime) -> Column:
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def age_label(ts: Column | str, as_of: Column) -> Column:
    """How long ago, in words; dates a year or more away are printed as dates."""
    ts = _col(ts)
    micros = F.abs(F.timestamp_diff("MICROSECOND", ts, as_of))
    days = F.ceil(micros / F.lit(86_400_000_000))

    def ago(n: Column, unit: str) -> Column:
        return F.concat(n.cast("string"), F.lit(f" {unit} ago"))

    return (
        F.when(days == 1, F.lit("yesterday"))
        .when(days < 7, ago(days, "days"))
        .when(days < 30, ago(F.ceil(days / 7), "weeks"))
        .when(days < 365, ago(F.ceil(days / 30), "months"))
        .when(days.isNotNull(), F.date_format(ts, "yyyy-MM-dd"))
        .otherwise(F.lit("recently"))
    )


def content_hash(title: str = "title", location: str = "location", description: str = "description") -> Column:
    parts = [F.coalesce(_col(c), F.lit("")) for c in (title, location, description)]
    return F.sha2(F.concat_ws("\u0001", *parts), 256)


def classify_error(error: Column | str) -> Column:
    """``final`` for errors that a new attempt cannot mend, ``retry`` otherwise."""
    # The message parts that end the attempts.
    final = [
        "no scraper configuration",
        "could not extract job title",
        "status code: 404",
        "status code: 403",
    ]
    error = _col(error)
    hit = F.lit(False)
    for part in final:
        hit = hit | F.contains(error, F.lit(part))
    return F.when(error.isNull(), F.lit(None)).when(hit, F.lit("final")).otherwise(F.lit("retry"))

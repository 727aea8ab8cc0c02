"""URL verdicts from rules and from a tree of path templates, for each host.

Rules label the URLs they fit. For the rest, each host's paths grow a tree of templates, level by level: variable
segments become wildcards, sibling branches whose labels don't differ statistically are merged, and a template is
judged by the smoothed share of blocked labels below it, with that of its host's tree, of the same template on all
hosts, and of all labels behind it where labels are few.

All counting is over distinct (host, path), pre-aggregated before each shuffle: how variable a segment is, and how labels
are spread, doesn't depend on how often a page was crawled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.llm.common import ascii_lower, unfold, whole_row
from postlake.session import cut_lineage

#: Levels of a template at most; the tree ends where no path goes deeper. Beyond, the rest of a path is one segment.
LEVELS = 24
#: A node with this many children or more, most of them seen once, has variable segments.
VARIABLE_FROM, VARIABLE_SHARE = 20, 0.5
#: Branches closer than this many standard errors to the labels of their siblings are merged with them.
MERGE_BELOW = 1.0
#: Labels that the share behind a template counts as.
SMOOTHING = 2.0

Rule = tuple[str, str]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path as they stand in the text; empty for null or without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url)))
    host = ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def fitting_rules(urls: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(host, path, rule, label) of the rows of ``urls`` (host, path; distinct) that a rule fits.

    A rule is (verdict, text), its text a host and a path from the first ``/``. It fits the host and its subdomains, if
    the path starts with its path. Of several the longest text wins, then the longest host, then the text itself.
    """
    if not rules:
        return urls.select("host", "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("label")).where("false")
    listed = urls.sparkSession.createDataFrame(
        [(v, t, t.partition("/")[0].lower(), "/" + t.partition("/")[2] if "/" in t else "") for v, t in dict.fromkeys(rules)],
        "label string, rule string, on string, below string",
    )
    ends = F.expr("transform(sequence(1, size(p)), i -> array_join(slice(p, i, size(p) - i + 1), '.'))")
    own = urls.withColumn("p", F.split("host", r"\.")).select("host", "path", F.explode(ends).alias("on"))
    fits = own.join(listed, "on").where(F.startswith("path", "below"))
    best = F.max(F.struct(F.char_length("rule").alias("n"), F.char_length("on").alias("m"), "rule", "label")).alias("b")
    return fits.groupBy("host", "path").agg(best).select("host", "path", "b.rule", "b.label")


def _shape(segment: Column) -> Column:
    """A segment with what is variable by its form alone replaced: ids, dates, hex keys, numbers in names."""
    hexed = F.regexp_replace(segment, r"(?<![0-9A-Za-z])[0-9A-Fa-f-]{16,}(?![0-9A-Za-z])", "{h}")
    return F.regexp_replace(hexed, r"[0-9]+", "{n}")


def _templates(urls: DataFrame) -> DataFrame:
    """``urls`` (host, path, blocked, labelled), distinct, with ``template``."""
    pieces = F.split("path", "/", LEVELS + 1)
    rows = urls.withColumn("segments", F.transform(pieces, _shape)).withColumn("template", F.lit(""))
    deepest = rows.agg(F.coalesce(F.max(F.size("segments")), F.lit(1))).first()[0]
    for level in range(1, deepest):
        rows = rows.withColumn("child", F.coalesce(F.get("segments", F.lit(level)), F.lit("")))
        children = rows.groupBy("host", "template", "child").agg(
            F.count(F.lit(1)).alias("n"), F.sum("blocked").alias("blocked"), F.sum("labelled").alias("labelled")
        )
        children = cut_lineage(children, "branches")
        nodes = children.groupBy("host", "template").agg(
            F.count(F.lit(1)).alias("kinds"),
            F.count_if(F.col("n") == 1).alias("rare"),
            F.sum("blocked").alias("all_blocked"),
            F.sum("labelled").alias("all_labelled"),
        )
        nodes = cut_lineage(nodes, "nodes")
        both = children.join(nodes, ["host", "template"])
        variable = (F.col("kinds") >= VARIABLE_FROM) & (F.col("rare") >= VARIABLE_SHARE * F.col("kinds"))
        # Two-proportion test of a branch against its siblings together; unlabelled branches show no difference.
        others, others_blocked = F.col("all_labelled") - F.col("labelled"), F.col("all_blocked") - F.col("blocked")
        pooled = (F.col("all_blocked") + 0.5) / (F.col("all_labelled") + 1.0)
        error = F.sqrt(pooled * (1 - pooled) * (1 / F.greatest("labelled", F.lit(1)) + 1 / F.greatest(others, F.lit(1))))
        gap = F.abs(F.col("blocked") / F.greatest("labelled", F.lit(1)) - others_blocked / F.greatest(others, F.lit(1)))
        alike = (F.col("kinds") > 1) & ((F.col("labelled") == 0) | ((others > 0) & (gap <= MERGE_BELOW * error)))
        named = both.select(
            "host", "template", "child", F.when(F.col("child") == "", "").when(variable | alike, "{*}").otherwise(F.col("child")).alias("symbol")
        )
        named = cut_lineage(named, "symbols")
        rows = rows.join(named, ["host", "template", "child"])
        longer = F.when(F.get("segments", F.lit(level)).isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), "symbol"))
        rows = cut_lineage(rows.withColumn("template", longer).drop("child", "symbol"), "templates")
    return rows.drop("segments")


def _share(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.sum("blocked").alias(f"{name}_b"), F.sum("labelled").alias(f"{name}_l"))


def judge_urls(pages: DataFrame, rules: Sequence[Rule], url_col: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``template``, ``block_share`` and ``verdict``; such columns are replaced.

    Where a rule fits, the verdict is its own; else ``block`` if the template's smoothed share is above one half.

    * Null urls, and urls without ``://``, have an empty host and path; they are judged together as one template.
    * Without a fitting rule anywhere every share is one half and all is allowed. Repeated rows get equal results.
    * ``rules`` are a list in the program, sent with the plan as a table; the engine decides how to join it.
    """
    host, path = host_and_path(F.col(f"`{url_col}`"))
    rows = pages.select(whole_row(pages).alias("row"), host.alias("host"), path.alias("path"))
    urls = cut_lineage(rows.select("host", "path").distinct(), "urls")
    fits = cut_lineage(fitting_rules(urls.select("host", "path"), rules), "fits")
    urls = urls.join(fits, ["host", "path"], "left")
    urls = urls.withColumn("labelled", F.col("label").isNotNull().cast("long"))
    urls = urls.withColumn("blocked", F.coalesce(F.col("label") == "block", F.lit(False)).cast("long"))
    grown = _templates(cut_lineage(urls, "labelled-urls"))
    leaves = cut_lineage(_share(grown, ["host", "template"], "leaf"), "leaves")
    leaves = leaves.withColumns({"blocked": F.col("leaf_b"), "labelled": F.col("leaf_l")})
    for by, name in ((["host"], "host"), (["template"], "same")):
        leaves = leaves.join(cut_lineage(_share(leaves, by, name), f"{name}-shares"), by)
    total = leaves.agg(F.coalesce(F.sum("blocked"), F.lit(0)), F.coalesce(F.sum("labelled"), F.lit(0))).first()
    share = F.lit((total[0] + 0.5 * SMOOTHING) / (total[1] + SMOOTHING))
    for name in ("same", "host", "leaf"):
        share = (F.col(f"{name}_b") + SMOOTHING * share) / (F.col(f"{name}_l") + SMOOTHING)
    judged = leaves.select("host", "template", share.alias("block_share"))
    judged = grown.select("host", "path", "rule", "label", "template").join(judged, ["host", "template"])
    judged = judged.withColumn("verdict", F.coalesce("label", F.when(F.col("block_share") > 0.5, "block").otherwise("allow")))
    judged = cut_lineage(judged, "judged-urls")
    out = rows.join(judged, ["host", "path"])
    names = ("host", "path", "rule", "template", "block_share", "verdict")
    return unfold(out, "row", pages.columns, **{c: F.col(c) for c in names})

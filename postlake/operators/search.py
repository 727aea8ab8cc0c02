"""Ranked full-text search over the postings table.

Two ways to the same hits:

* with an index (:mod:`postlake.operators.index`, or a table of postings), only
  the postings of the query's lexemes are read, and grouped by document;
* without one, the text is scanned. For ``simple`` this happens inside each row
  with no shuffle at all; a plain substring test in front skips documents that
  cannot match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.functions import rank as ranking
from postlake.functions import websearch
from postlake.functions.settle import settle
from postlake.operators.filters import active, holds
from postlake.operators.listing import Page, list_page
from postlake.functions.analyze import MAX_FIELD_POSITIONS, MAX_POS
from postlake.operators.index import SearchIndex
from postlake.operators.postings import IndexMismatch, build_postings, capped, document_words, in_fields

SHOWN = ["id", "company_name", "title", "location", "first_seen_at"]
_CARRIED = [*SHOWN, "last_seen_at"]


def _numbers(terms: list[str]) -> Column:
    return F.create_map(*[F.lit(x) for i, t in enumerate(terms) for x in (t, i)])


def _may_match(tree) -> Column | None:
    """A cheap necessary condition on the lower-case text ``_text``, or None."""
    kind, body = tree

    def holds_word(w: str) -> Column:
        return F.contains("_text", F.lit(w))

    if kind == "term":
        return holds_word(body)
    if kind == "not":
        return None
    if kind == "phrase":
        conds = [holds_word(w) for w, _ in body]
    else:
        conds = [_may_match(n) for n in body]
    if kind == "or":
        if any(c is None for c in conds):
            return None
        out = conds[0]
        for c in conds[1:]:
            out = out | c
        return out
    known = [c for c in conds if c is not None]
    if not known:
        return None
    out = known[0]
    for c in known[1:]:
        out = out & c
    return out


def scan_hits(jobs: DataFrame, tree, keep: list[str], limits: bool = False) -> DataFrame:
    """``keep`` plus ``hits``, for the ``simple`` analyzer, row by row; ``limits`` as for stored positions."""
    terms = websearch.terms(tree)
    guard = _may_match(tree)
    if guard is not None:
        text = F.lower(F.concat_ws(" ", "title", "location", "description"))
        jobs = settle(jobs, "_text", text).where(guard).drop("_text")
    docs = document_words(jobs, "simple", keep)
    number = " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(terms))
    listed = ", ".join(f"'{t}'" for t in terms)
    entry = f"IF(t IN ({listed}), named_struct('p', {{p}}, 't', CASE t {number} END, 'w', {{w}}), NULL)"
    near = settle(docs, "near", F.expr(in_fields(entry))).select(*keep, "near")
    if not limits:
        return near.select(*keep, F.array_sort("near").alias("hits"))
    # The limits of stored positions apply per term; few documents come near.
    of_term = "transform(filter(near, s -> s.t = t), s -> named_struct('p', s.p, 'w', s.w))"
    limited = f"transform(array({of_term}), found -> {capped('found')})[0]"
    tagged = f"transform({limited}, s -> named_struct('p', s.p, 't', t, 'w', s.w))"
    every = f"sort_array(flatten(transform(sequence(0, {len(terms) - 1}), t -> {tagged})))"
    short = f"size(near) <= {MAX_FIELD_POSITIONS} AND coalesce(get(near, size(near) - 1).p, 0) < {MAX_POS}"
    return settle(near, "hits", F.expr(f"IF({short}, near, {every})"))


def posting_hits(postings: DataFrame, tree) -> DataFrame:
    """``(id, hits)`` from an index; reads the query's lexemes only."""
    terms = websearch.terms(tree)
    held = getattr(postings, "only_lexemes", None)
    if held is not None and not held.issuperset(terms):
        raise IndexMismatch(f"the postings were read without {sorted(set(terms) - held)}")
    number = _numbers(terms)
    found = postings.where(F.col("lexeme").isin(*terms))
    placed = found.select(
        "id",
        F.transform(
            "positions",
            lambda s: F.struct(s["p"].alias("p"), number[F.col("lexeme")].alias("t"), s["w"].alias("w")),
        ).alias("h"),
    )
    return placed.groupBy("id").agg(F.sort_array(F.flatten(F.collect_list("h"))).alias("hits"))


def _narrow(jobs: DataFrame, company: str, location: str) -> DataFrame:
    jobs = jobs.where(active())
    if company:
        jobs = jobs.where(holds("company_name", company))
    if location:
        jobs = jobs.where(holds("location", location))
    return jobs


def matched(
    jobs: DataFrame,
    tree,
    analyzer: str = "english",
    postings: DataFrame | SearchIndex | None = None,
    company: str = "",
    location: str = "",
    limits: bool = False,
) -> DataFrame:
    """Active documents that match, with their ``hits``.

    Of a :class:`SearchIndex`, the buckets of the query's lexemes are read.
    ``limits`` holds for texts that are read here; an index has its own.
    """
    if isinstance(postings, SearchIndex):
        if postings.analyzer != analyzer:
            raise IndexMismatch(f"the index is {postings.analyzer}, not {analyzer}")
        postings = postings.postings(websearch.terms(tree))
    kept = _narrow(jobs, company, location)
    if tree is None:
        empty = kept.where(F.lit(False)).select(*_CARRIED, F.array().cast(ranking.HITS).alias("hits"))
        return ranking.with_places(empty, tree)
    if postings is None and analyzer == "simple":
        found = ranking.with_places(scan_hits(kept, tree, _CARRIED, limits), tree)
        return found.where(ranking.matches(tree))
    if postings is None:
        initials = sorted({t[0] for t in websearch.terms(tree)})
        postings = build_postings(kept, analyzer, initials, limits)
    hits = ranking.with_places(posting_hits(postings, tree), tree)
    if not websearch.matches_empty(tree):
        # Match before the join, so that only matching ids meet the postings table.
        return kept.select(*_CARRIED).join(hits.where(ranking.matches(tree)), "id")
    found = kept.select(*_CARRIED).join(hits, "id", "left")
    found = ranking.fill_places(found, tree)
    return found.where(ranking.matches(tree))


def _total(found: DataFrame) -> DataFrame:
    return found.agg(F.count(F.lit(1)).alias("total"))


def search_matches(
    jobs: DataFrame, query: str, analyzer: str = "english", postings: DataFrame | SearchIndex | None = None, limits: bool = False
) -> DataFrame:
    """All matching active postings, unranked."""
    tree = websearch.parse(jobs.sparkSession, query, analyzer)
    return matched(jobs, tree, analyzer, postings, limits=limits).select(*SHOWN)


def search_total(
    jobs: DataFrame, query: str, analyzer: str = "english", postings: DataFrame | SearchIndex | None = None, limits: bool = False
) -> DataFrame:
    return _total(search_matches(jobs, query, analyzer, postings, limits))


def _ranked(found: DataFrame, tree) -> DataFrame:
    scored = ranking.with_rank(found, tree, "rank")
    return scored.select(*_CARRIED, F.col("rank").cast("float").alias("rank"))


def search_ranked(
    jobs: DataFrame,
    query: str,
    analyzer: str = "english",
    postings: DataFrame | SearchIndex | None = None,
    company: str = "",
    location: str = "",
    limits: bool = False,
) -> DataFrame:
    """All matching active postings with their rank."""
    tree = websearch.parse(jobs.sparkSession, query, analyzer)
    return _ranked(matched(jobs, tree, analyzer, postings, company, location, limits), tree)


def _page(ranked: DataFrame, limit: int, offset: int) -> DataFrame:
    """Best first: a top-(offset + limit) per task, merged at the end."""
    order = [F.desc("rank"), F.col("last_seen_at").desc_nulls_first(), F.asc("id")]
    return ranked.orderBy(*order).offset(offset).limit(limit).select(*SHOWN, "rank")


def search_simple(
    jobs: DataFrame,
    query: str,
    page_limit: int = 20,
    page_offset: int = 0,
    analyzer: str = "english",
    postings: DataFrame | SearchIndex | None = None,
    company: str = "",
    location: str = "",
    limits: bool = False,
) -> DataFrame:
    """One page, best first, without the total."""
    return _page(search_ranked(jobs, query, analyzer, postings, company, location, limits), page_limit, page_offset)


def search_optimized(
    jobs: DataFrame,
    query: str,
    page_limit: int = 20,
    page_offset: int = 0,
    analyzer: str = "english",
    postings: DataFrame | SearchIndex | None = None,
    limits: bool = False,
) -> DataFrame:
    """One page, best first, with the number of all matches on every row.

    Over an index the hits of a document meet in one exchange, which the page
    and the total share. The total is a scalar subquery that does not rank.
    """
    tree = websearch.parse(jobs.sparkSession, query, analyzer)
    found = matched(jobs, tree, analyzer, postings, limits=limits)
    total = _total(found).scalar()
    return _page(_ranked(found, tree), page_limit, page_offset).select("*", total.alias("total_count"))


def search_page(
    jobs: DataFrame,
    query: str,
    page: Page = Page(1, 20),
    analyzer: str = "english",
    postings: DataFrame | SearchIndex | None = None,
    limits: bool = False,
) -> DataFrame:
    """The search of the listing service: an empty query is the plain listing."""
    if query == "":
        return list_page(jobs, None, page)
    rows = search_optimized(jobs, query, page.page_size, page.offset, analyzer, postings, limits)
    return rows.select(
        *SHOWN,
        "rank",
        F.col("total_count").alias("total"),
        F.lit(page.page).cast("bigint").alias("page"),
        F.lit(page.page_size).cast("bigint").alias("page_size"),
        F.ceil(F.col("total_count") / page.page_size).cast("bigint").alias("total_pages"),
    )


def require_query(query: str) -> str:
    """The search endpoint refuses an empty query."""
    if query == "":
        raise ValueError("search query is required")
    return query


def typeahead(
    jobs: DataFrame, query: str, analyzer: str = "english", postings: DataFrame | SearchIndex | None = None, limits: bool = False
) -> DataFrame:
    """Top five while typing; fewer than two characters give nothing."""
    text = query.strip()
    found = search_simple(jobs, text, 5, 0, analyzer, postings, limits=limits)
    return found if len(text) >= 2 else found.where(F.lit(False))

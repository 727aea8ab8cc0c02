"""Full-text queries.

The SQL side builds the positions of every word of every text anew and ranks by
window functions; it shares nothing with the Spark plans but the definition.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from postlake.functions.analyze import stop_list
from postlake.operators import postings, search
from postlake.operators.filters import active
from postlake.operators.index import SearchIndex
from postlake.operators.listing import Page
from postlake.plans import views
from postlake.plans.registry import query
from postlake.plans.sql import JOBS, LIGHT, with_
from postlake.plans.stem_sql import stem_ctes
from postlake.session import scratch_path

ARRAYS = r"""fields AS (
  SELECT id, 0 AS f, title AS t FROM jobs UNION ALL SELECT id, 1, location FROM jobs
  UNION ALL SELECT id, 2, regexp_replace(description, '</?[A-Za-z!][^<>]*>|&#?[A-Za-z0-9]+;', ' ', 'g') FROM jobs),
arrays AS (
  SELECT id, f, [x FOR x IN regexp_split_to_array(lower(t), '[^\p{L}\p{N}]+') IF x <> ''] AS a FROM fields)"""

SIMPLE = """offsets AS (
  SELECT id, CAST(sum(CASE WHEN f = 0 THEN len(a) ELSE 0 END) AS BIGINT) AS o1,
    CAST(sum(CASE WHEN f <= 1 THEN len(a) ELSE 0 END) AS BIGINT) AS o2 FROM arrays GROUP BY id),
tokens AS (SELECT id, f, unnest(a) AS lexeme, generate_subscripts(a, 1) AS p FROM arrays)"""

# Stop words keep their places, but take no room at the end of a field.
ENGLISH = f"""every_word AS (SELECT id, f, unnest(a) AS word, generate_subscripts(a, 1) AS p FROM arrays),
kept_words AS MATERIALIZED (SELECT * FROM every_word WHERE word NOT IN ({stop_list()})),
vocabulary AS (SELECT DISTINCT word FROM kept_words),
{stem_ctes("vocabulary", "stems")},
tokens AS MATERIALIZED (SELECT k.id, k.f, s.stem AS lexeme, k.p FROM kept_words k JOIN stems s ON k.word = s.word),
offsets AS (
  SELECT id, coalesce(max(p) FILTER (WHERE f = 0), 0) AS o1,
    coalesce(max(p) FILTER (WHERE f = 0), 0) + coalesce(max(p) FILTER (WHERE f = 1), 0) AS o2 FROM tokens GROUP BY id)"""

HITS = """first_of_field AS (
  SELECT *, row_number() OVER (PARTITION BY id, f, lexeme ORDER BY p) AS n FROM tokens),
placed AS (
  SELECT t.id, lexeme, f, least(least(p, 16383) + CASE f WHEN 0 THEN 0 WHEN 1 THEN o1 ELSE o2 END, 16383) AS p,
    CAST(CASE f WHEN 0 THEN 1.0 WHEN 1 THEN 0.4 ELSE 0.2 END AS DOUBLE) AS w
  FROM first_of_field t JOIN offsets o ON t.id = o.id WHERE n <= 255),
hits AS (
  SELECT * FROM placed QUALIFY row_number() OVER (PARTITION BY id, lexeme ORDER BY p, f) <= 256)"""

BASE = with_(JOBS, ARRAYS, SIMPLE, HITS)
BASE_ENGLISH = with_(JOBS, ARRAYS, ENGLISH, HITS)


def _search_ctes(terms: list[str], match: str, begin: str, phrase: tuple[str, str] | None = None) -> str:
    """``found(id, rank)``. ``match`` is a condition over ``h0, h1, ...`` (term
    present) and ``ph`` (phrase present); ``begin`` is the latest start of a
    stretch over ``l0, l1, ...`` and ``lp``."""
    words = ", ".join(f"'{t}'" for t in terms)
    has = ", ".join(f"bool_or(lexeme = '{t}') AS h{i}" for i, t in enumerate(terms))
    run = "OVER (PARTITION BY id ORDER BY p, w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    last = ", ".join(f"max(CASE WHEN h{i} THEN p END) {run} AS l{i}" for i in range(len(terms)))
    if phrase:
        a, b = phrase
        pairs = f"""SELECT y.id, y.p, x.p AS s FROM hits x JOIN hits y ON x.id = y.id AND y.p = x.p + 1
          WHERE x.lexeme = '{a}' AND y.lexeme = '{b}'"""
    else:
        pairs = "SELECT CAST(-1 AS BIGINT) AS id, CAST(0 AS BIGINT) AS p, CAST(0 AS BIGINT) AS s"
    return f""",
pairs AS ({pairs}),
entries AS (SELECT id, p, w, {has} FROM hits WHERE lexeme IN ({words}) GROUP BY id, p, w),
entries2 AS (SELECT e.*, q.s FROM entries e LEFT JOIN pairs q ON e.id = q.id AND e.p = q.p),
present AS (
  SELECT j.id, {", ".join(f"coalesce(bool_or(h{i}), false) AS h{i}" for i in range(len(terms)))},
    coalesce(bool_or(s IS NOT NULL), false) AS ph
  FROM jobs j LEFT JOIN entries2 e ON j.id = e.id WHERE j.expired_at IS NULL GROUP BY j.id),
matching AS (SELECT id FROM present WHERE {match}),
running AS (
  SELECT *, count(*) {run} AS c, sum(1 / w) {run} AS v, {last}, max(s) {run} AS lp FROM entries2),
started AS (SELECT *, {begin} AS b FROM running),
moved AS (
  SELECT *, max(b) OVER (PARTITION BY id ORDER BY p, w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pb
  FROM started),
extents AS (
  SELECT e.id, e.p AS q, e.b, e.c - s.c + 1 AS n, e.v - s.v + 1 / s.w AS inv
  FROM moved e JOIN running s ON e.id = s.id AND e.b = s.p WHERE e.b IS NOT NULL AND (e.pb IS NULL OR e.b > e.pb)),
scores AS (
  SELECT id, sum((n / inv) / (1 + CASE WHEN q - b - (n - 1) < 0 THEN (n - 1) // 2 ELSE q - b - (n - 1) END)) AS s
  FROM extents GROUP BY id),
found AS (
  SELECT m.id, CAST(coalesce(s.s, 0) AS FLOAT) AS rank FROM matching m LEFT JOIN scores s ON m.id = s.id)
"""


def _walk_ctes(terms: list[str], tree: str) -> str:
    """``found(id, rank)`` for any ``tree`` over ``{0}, {1}, ...`` (term present), NOT below OR included.

    Every start of a stretch gets its end and its begin; the starts that count are then reached one from the other.
    """
    words, k = ", ".join(f"'{t}'" for t in terms), range(len(terms))
    has = ", ".join(f"bool_or(lexeme = '{t}') AS h{i}" for i, t in enumerate(terms))
    ahead = "OVER (PARTITION BY id ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    back = "OVER (PARTITION BY id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    nexts = ", ".join(f"min(CASE WHEN h{i} THEN p END) {ahead} AS n{i}" for i in k)
    lasts = ", ".join(f"max(CASE WHEN h{i} THEN p END) {back} AS r{i}" for i in k)
    to_end = tree.format(*[f"coalesce(n{i} <= c, false)" for i in k])
    to_begin = tree.format(*[f"coalesce(r{i} >= c, false)" for i in k])
    present = ", ".join(f"coalesce(bool_or(h{i}), false) AS h{i}" for i in k)
    return f""",
spots AS MATERIALIZED (
  SELECT id, p, count(DISTINCT w) AS k, sum(DISTINCT 1 / w) AS v, {has} FROM hits WHERE lexeme IN ({words}) GROUP BY id, p),
matching AS (
  SELECT j.id FROM jobs j LEFT JOIN (SELECT id, {present} FROM spots GROUP BY id) s ON j.id = s.id
  WHERE j.expired_at IS NULL AND ({tree.format(*[f"coalesce(h{i}, false)" for i in k])})),
around AS MATERIALIZED (
  SELECT *, {nexts}, {lasts}, lead(p) OVER (PARTITION BY id ORDER BY p) AS after,
    sum(k) {back} AS ck, sum(v) {back} AS cv FROM spots),
ended AS (
  SELECT id, p AS q, list_min(list_filter([p, {", ".join(f"n{i}" for i in k)}], lambda c: c IS NOT NULL AND ({to_end}))) AS e FROM around),
begun AS MATERIALIZED (
  SELECT x.id, x.q, x.e, list_max(list_filter([x.e, {", ".join(f"r{i}" for i in k)}], lambda c: c >= x.q AND ({to_begin}))) AS b
  FROM ended x JOIN around y ON x.id = y.id AND x.e = y.p),
linked AS MATERIALIZED (SELECT s.*, y.after FROM begun s JOIN around y ON s.id = y.id AND s.b = y.p),
reached(id, q) AS (
  SELECT id, min(p) FROM spots GROUP BY id
  UNION ALL
  SELECT r.id, s.after FROM reached r JOIN linked s ON r.id = s.id AND r.q = s.q WHERE s.after IS NOT NULL),
extents AS (
  SELECT r.id, s.e, s.b, z.ck - a.ck + a.k AS n, z.cv - a.cv + a.v AS inv FROM reached r JOIN linked s ON r.id = s.id AND r.q = s.q
  JOIN around z ON s.id = z.id AND s.e = z.p JOIN around a ON s.id = a.id AND s.b = a.p),
scores AS (
  SELECT id, sum((n / inv) / (1 + CASE WHEN e - b - (n - 1) < 0 THEN (n - 1) // 2 ELSE e - b - (n - 1) END)) AS s FROM extents GROUP BY id),
found AS (
  SELECT m.id, CAST(coalesce(s.s, 0) AS FLOAT) AS rank FROM matching m LEFT JOIN scores s ON m.id = s.id)
"""


def _recursive(sql: str) -> str:
    return sql.replace("WITH", "WITH RECURSIVE", 1)


RANK = "round(CAST(rank AS DOUBLE), 6) AS rank"
ORDER = "ORDER BY f.rank DESC, j.last_seen_at DESC NULLS FIRST, j.id"
SHOWN = "j.id, j.company_name, j.title, j.location, j.first_seen_at"
AND2 = "CASE WHEN l0 IS NOT NULL AND l1 IS NOT NULL THEN least(l0, l1) END"


def _rounded(df):
    return df.withColumn("rank", F.round(F.col("rank").cast("double"), 6))


def _jobs(spark, d):
    return views.jobs(spark, d, spread=True)


def _ranked_query(name, text, terms, match, begin, phrase=None):
    """All matches of a query with their rank."""
    sql = BASE + _search_ctes(terms, match, begin, phrase) + f"SELECT id, {RANK} FROM found"

    @query(name, sql)
    def run(spark, d):
        return _rounded(search.search_ranked(_jobs(spark, d), text, "simple", limits=True)).select("id", "rank")


_ranked_query("search_match", "the of", ["the", "of"], "h0 AND h1", AND2)
_ranked_query("search_or", "of or la", ["of", "la"], "h0 OR h1", "greatest(l0, l1)")
_ranked_query("search_not", "the -of", ["the", "of"], "h0 AND NOT h1", "l0")
_ranked_query("search_only_not", "-the", ["the"], "NOT h0", "CAST(NULL AS BIGINT)")
_ranked_query("search_phrase", '"of the"', ["of", "the"], "ph", "lp", ("of", "the"))
_ranked_query(
    "rank_cd",
    '"of the" and is or der',
    ["of", "the", "and", "is", "der"],
    "(ph AND h2 AND h3) OR h4",
    "greatest(CASE WHEN lp IS NOT NULL AND l2 IS NOT NULL AND l3 IS NOT NULL THEN least(lp, l2, l3) END, l4)",
    ("of", "the"),
)


@query("rank_not_in_or", _recursive(BASE) + _walk_ctes(["la", "the"], "{0} OR NOT {1}") + f"SELECT id, {RANK} FROM found")
def rank_not_in_or(spark, d):
    return _rounded(search.search_ranked(_jobs(spark, d), "la or -the", "simple", limits=True)).select("id", "rank")


@query("tsvector_build", BASE + """SELECT id, lexeme, string_agg(p || CASE f WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END,
  ',' ORDER BY p, f) AS positions FROM hits GROUP BY id, lexeme""")
def tsvector_build(spark, d):
    return postings.tsvector_rows(postings.build_postings(_jobs(spark, d), "simple", limits=True))


POSITIONS = """string_agg(p || CASE f WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END, ',' ORDER BY p, f) AS positions"""


@query("tsvector_english", BASE_ENGLISH + f"SELECT id, lexeme, {POSITIONS} FROM hits GROUP BY id, lexeme")
def tsvector_english(spark, d):
    return postings.tsvector_rows(postings.build_postings(_jobs(spark, d), "english", limits=True))


def _english_index(spark, jobs):
    index = SearchIndex.create(spark, scratch_path(spark, "english-index"), "english", buckets=8, limits=True)
    index.add(jobs)
    return index


@query("tsvector_upkeep", BASE + f"""SELECT id, lexeme, {POSITIONS} FROM hits
WHERE id IN (SELECT id FROM jobs WHERE expired_at IS NULL) AND id % 11 <> 0 GROUP BY id, lexeme""")
def tsvector_upkeep(spark, d):
    """An index that is written in two batches, corrected by a third, thinned out and merged."""
    jobs = _jobs(spark, d)
    index = SearchIndex.create(spark, scratch_path(spark, "kept-index"), "simple", buckets=8, limits=True)
    index.add(jobs.where("id % 3 = 0").withColumn("title", F.concat(F.lit("old "), "title")))
    index.add(jobs.where("id % 3 <> 0").withColumn("expired_at", F.lit(None).cast("timestamp_ntz")))
    index.add(jobs.where((F.col("id") % 3 == 0) | ~active()))
    index.delete(jobs.where("id % 11 = 0"))
    index.compact()
    return postings.tsvector_rows(index.postings(packed=True))


@query("join_terms", BASE + "SELECT id, lexeme, count(*) AS n FROM hits WHERE lexeme IN ('the', 'la', 'und') GROUP BY 1, 2")
def join_terms(spark, d):
    """The index is built, written by lexeme bucket, and read for three lexemes."""
    path = scratch_path(spark, "postings")
    postings.write_postings(postings.build_postings(_jobs(spark, d), "simple", limits=True, packed=True), path, buckets=8)
    found = postings.read_postings(spark, path, ["the", "la", "und"], buckets=8)
    return found.select("id", "lexeme", F.size("positions").cast("bigint").alias("n"))


_THE_OF = BASE + _search_ctes(["the", "of"], "h0 AND h1", AND2)


@query("search_total", _THE_OF + "SELECT count(*) AS total FROM found")
def search_total(spark, d):
    return search.search_total(_jobs(spark, d), "the of", "simple", limits=True)


@query("search_optimized", _THE_OF + f"""SELECT {SHOWN}, {RANK}, (SELECT count(*) FROM found) AS total_count
FROM found f JOIN jobs j ON f.id = j.id {ORDER} LIMIT 20 OFFSET 0""")
def search_optimized(spark, d):
    return _rounded(search.search_optimized(_jobs(spark, d), "the of", analyzer="simple", limits=True))


@query("search_simple", _THE_OF + f"SELECT {SHOWN}, {RANK} FROM found f JOIN jobs j ON f.id = j.id {ORDER} LIMIT 20")
def search_simple(spark, d):
    return _rounded(search.search_simple(_jobs(spark, d), "the of", analyzer="simple", limits=True))


@query("search_page", _THE_OF + f"""SELECT {SHOWN}, {RANK}, (SELECT count(*) FROM found) AS total,
  CAST(3 AS BIGINT) AS page, CAST(10 AS BIGINT) AS page_size,
  CAST(ceil((SELECT count(*) FROM found) / 10.0) AS BIGINT) AS total_pages
FROM found f JOIN jobs j ON f.id = j.id {ORDER} LIMIT 10 OFFSET 20""")
def search_page(spark, d):
    return _rounded(search.search_page(_jobs(spark, d), "the of", Page(3, 10), "simple", limits=True))


@query("search_empty", with_(JOBS) + f"""SELECT {LIGHT}, (SELECT count(*) FROM jobs WHERE expired_at IS NULL) AS total,
  CAST(1 AS BIGINT) AS page, CAST(20 AS BIGINT) AS page_size,
  CAST(ceil((SELECT count(*) FROM jobs WHERE expired_at IS NULL) / 20.0) AS BIGINT) AS total_pages
FROM jobs WHERE expired_at IS NULL ORDER BY last_seen_at DESC NULLS FIRST, id LIMIT 20""")
def search_empty(spark, d):
    return search.search_page(views.jobs(spark, d), "", Page(1, 20), "simple")


@query("search_company", _THE_OF + f"""SELECT {SHOWN}, {RANK} FROM found f JOIN jobs j ON f.id = j.id
WHERE j.company_name ILIKE '%src1%' {ORDER} LIMIT 20""")
def search_company(spark, d):
    return _rounded(search.search_simple(_jobs(spark, d), "the of", analyzer="simple", company="src1", limits=True))


@query("search_location", _THE_OF + f"""SELECT {SHOWN}, {RANK} FROM found f JOIN jobs j ON f.id = j.id
WHERE j.location ILIKE '%EN%' {ORDER} LIMIT 20""")
def search_location(spark, d):
    return _rounded(search.search_simple(_jobs(spark, d), "the of", analyzer="simple", location="EN", limits=True))


@query("typeahead", BASE + _search_ctes(["der"], "h0", "l0") + f"""SELECT {SHOWN}, {RANK}
FROM found f JOIN jobs j ON f.id = j.id {ORDER} LIMIT 5""")
def typeahead(spark, d):
    return _rounded(search.typeahead(_jobs(spark, d), "  der ", "simple", limits=True))


@query("search_indexed", _THE_OF + f"""SELECT {SHOWN}, {RANK}, (SELECT count(*) FROM found) AS total_count
FROM found f JOIN jobs j ON f.id = j.id {ORDER} LIMIT 20""")
def search_indexed(spark, d):
    """``search_optimized`` over a written index."""
    jobs = _jobs(spark, d)
    path = scratch_path(spark, "postings")
    postings.write_postings(postings.build_postings(jobs, "simple", limits=True, packed=True), path, buckets=8)
    index = postings.read_postings(spark, path, ["the", "of"], buckets=8)
    return _rounded(search.search_optimized(jobs, "the of", analyzer="simple", postings=index))


_THINGS = _recursive(BASE_ENGLISH) + _walk_ctes(["thing", "bench", "der"], "{0} OR ({1} AND NOT {2})")


@query("search_english", _THINGS + f"""SELECT {SHOWN}, {RANK}, (SELECT count(*) FROM found) AS total_count
FROM found f JOIN jobs j ON f.id = j.id {ORDER} LIMIT 20""")
def search_english(spark, d):
    """Stemmed search over the stored index."""
    jobs = _jobs(spark, d)
    index = _english_index(spark, jobs)
    return _rounded(search.search_optimized(jobs, "things or benching -der", postings=index))


_ENGLISH_ALL = BASE_ENGLISH + _search_ctes(["thing", "der"], "h0 OR h1", "greatest(l0, l1)")


@query("search_english_page", _ENGLISH_ALL + f"""SELECT {SHOWN}, {RANK}, (SELECT count(*) FROM found) AS total,
  CAST(2 AS BIGINT) AS page, CAST(15 AS BIGINT) AS page_size,
  CAST(ceil((SELECT count(*) FROM found) / 15.0) AS BIGINT) AS total_pages
FROM found f JOIN jobs j ON f.id = j.id {ORDER} LIMIT 15 OFFSET 15""")
def search_english_page(spark, d):
    jobs = _jobs(spark, d)
    return _rounded(search.search_page(jobs, "things or der", Page(2, 15), postings=_english_index(spark, jobs)))


@query("search_english_ranked", _ENGLISH_ALL + f"SELECT id, {RANK} FROM found")
def search_english_ranked(spark, d):
    """Every match with its rank; stop words of the query count for nothing."""
    jobs = _jobs(spark, d)
    found = search.search_ranked(jobs, "the things or der of", postings=_english_index(spark, jobs))
    return _rounded(found).select("id", "rank")


@query("typeahead_terms", BASE + """SELECT lexeme, count(DISTINCT id) AS documents FROM hits
WHERE lexeme LIKE 'th%' AND id IN (SELECT id FROM jobs WHERE expired_at IS NULL) GROUP BY lexeme ORDER BY documents DESC, lexeme LIMIT 10""")
def typeahead_terms(spark, d):
    """Terms to offer while typing, from the sorted term dictionary."""
    index = SearchIndex.create(spark, scratch_path(spark, "terms-index"), "simple", buckets=8)
    index.add(_jobs(spark, d))
    return index.completions("th", 10)

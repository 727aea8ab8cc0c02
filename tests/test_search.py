import datetime as dt
import random

import pytest

from postlake.functions import websearch
from postlake.operators import postings, search
from postlake.operators.listing import Page
from postlake.session import scratch_path

T = lambda w: ("term", w)

GRAMMAR = {
    "foo bar": ("and", (T("foo"), T("bar"))),
    "foo or bar baz": ("or", (T("foo"), ("and", (T("bar"), T("baz"))))),
    "foo OR": ("and", (T("foo"), T("or"))),
    "or foo": ("and", (T("or"), T("foo"))),
    "-foo": ("not", T("foo")),
    "--foo": T("foo"),
    'a -"b c"': ("and", (T("a"), ("not", ("phrase", (("b", 0), ("c", 1)))))),
    '"a b': ("phrase", (("a", 0), ("b", 1))),
    "well-known": ("phrase", (("well", 0), ("known", 1))),
    "+foo !&|( bar": ("and", (T("foo"), T("bar"))),
    "": None,
    "?!": None,
}


@pytest.mark.parametrize("text", GRAMMAR)
def test_grammar(spark, text):
    assert websearch.parse(spark, text, "simple") == GRAMMAR[text]


def test_english_query(spark):
    parse = lambda q: websearch.parse(spark, q, "english")
    assert parse('"head of data"') == ("phrase", (("head", 0), ("data", 2)))
    assert parse("the of") is None
    assert parse("the engineers or -of running") == ("or", (T("engin"), T("run")))


def _jobs(spark, rows):
    full = [
        (i, "c", t, loc, text, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1), None)
        for i, (t, loc, text) in enumerate(rows)
    ]
    return spark.createDataFrame(
        full,
        "id bigint, company_name string, title string, location string, description string, "
        "first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, expired_at timestamp_ntz",
    )


def _random_jobs(spark, n=60, seed=5):
    rnd = random.Random(seed)
    words = ["aa", "bb", "cc", "dd", "ee"]
    text = lambda k: " ".join(rnd.choice(words) for _ in range(rnd.randint(0, k)))
    return [(text(3), text(2), text(14)) for _ in range(n)]


QUERIES = [
    "aa", "aa bb", "aa bb cc", "aa or bb", "aa bb or cc dd", '"aa bb"', '"aa bb" cc', '"aa bb" or "cc dd"',
    '"aa aa"', '"aa bb cc" or dd', "aa -bb", "-aa", '-"aa bb" cc', "aa or -bb", "aa bb or -cc dd", "aa aa", 'aa -"bb cc" or dd', '-aa or -"bb cc" dd', '-"aa aa" bb or cc -dd',
]


def scan_extents(hits, tree):
    """The rank by direct search, for any tree (NOT below OR included).

    From each start, move right to the first hit that makes the stretch true,
    then left to the last hit that keeps it true; go on behind that hit.
    """
    number = {w: i for i, w in enumerate(websearch.terms(tree))}
    entries = {}
    for p, t, w in hits:
        entries.setdefault((p, w), set()).add(t)
    order = sorted(entries)

    def true_in(part):
        places = {}
        for key in part:
            for t in entries[key]:
                places.setdefault(t, set()).add(key[0])

        def present(leaf):
            kind, body = leaf
            if kind == "term":
                return number[body] in places
            sets = [(places.get(number[w], set()), d) for w, d in body]
            return any(all(p + d in s for s, d in sets) for p in sets[0][0])

        return websearch.holds(tree, present)

    score, at = 0.0, 0
    while at < len(order):
        end = next((j for j in range(at, len(order)) if true_in(order[at : j + 1])), None)
        if end is None:
            break
        begin = next((i for i in range(end, at - 1, -1) if true_in(order[i : end + 1])), None)
        if begin is None:
            at += 1
            continue
        n = end - begin + 1
        inverse = sum(1.0 / w for _, w in order[begin : end + 1])
        noise = (order[end][0] - order[begin][0]) - (n - 1)
        if noise < 0:
            noise = (n - 1) // 2
        score += (n / inverse) / (1 + noise)
        at = begin + 1
    return score


def _by_hand(rows, tree):
    number = {w: i for i, w in enumerate(websearch.terms(tree))}
    out = {}
    for i, fields in enumerate(rows):
        hits, at = [], 0
        for text, w in zip(fields, (1.0, 0.4, 0.2)):
            split = text.split()
            hits += [(at + k + 1, number[x], w) for k, x in enumerate(split) if x in number]
            at += len(split)
        where = {}
        for p, t, _ in hits:
            where.setdefault(t, set()).add(p)

        def present(leaf):
            if leaf[0] == "term":
                return number[leaf[1]] in where
            sets = [(where.get(number[w], set()), d) for w, d in leaf[1]]
            return any(all(p + d in s for s, d in sets) for p in sets[0][0])

        if websearch.holds(tree, present):
            out[i] = scan_extents(hits, tree)
    return out


@pytest.mark.parametrize("text", QUERIES)
def test_rank_against_direct_search(spark, text):
    """Scan, index and the general ranking agree with a search by hand."""
    rows = _random_jobs(spark)
    jobs = _jobs(spark, rows)
    tree = websearch.parse(spark, text, "simple")
    want = _by_hand(rows, tree)
    got = {r["id"]: r["rank"] for r in search.search_ranked(jobs, text, "simple").collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[i] - want[i]) < 1e-5 for i in want)
    index = postings.build_postings(jobs, "simple")
    again = {r["id"]: r["rank"] for r in search.search_ranked(jobs, text, "simple", index).collect()}
    assert again == got


def test_rank_of_known_texts(spark):
    jobs = _jobs(spark, [("alpha beta", "", ""), ("alpha x beta", "", ""), ("", "", "beta alpha")])
    got = {r["id"]: round(r["rank"], 6) for r in search.search_ranked(jobs, "alpha beta", "simple").collect()}
    # n / sum(1/w) over 1 + words between: 2/2, 2/2/2, and 2/(5+5).
    assert got == {0: 1.0, 1: 0.5, 2: 0.2}


def test_positions_have_limits(spark):
    jobs = _jobs(spark, [("w " * 300, "w", "w " * 300), ("", "", "a " * 16380 + "b c d e c")])
    rows = {(r["id"], r["lexeme"]): r["positions"] for r in postings.build_postings(jobs, "simple", limits=True).collect()}
    assert len(rows[0, "w"]) == 256
    assert [p["p"] for p in rows[0, "w"]][:3] == [1, 2, 3]
    assert rows[0, "w"][255]["p"] == 301 and rows[0, "w"][255]["w"] == 0.4
    assert len(rows[1, "a"]) == 255
    assert [p["p"] for p in rows[1, "c"]] == [16382, 16383]
    assert [p["p"] for p in rows[1, "d"]] == [16383]
    scanned = search.search_ranked(jobs, "w", "simple", limits=True).collect()
    assert abs(scanned[0]["rank"] - (255 * 1.0 + 0.4)) < 1e-3
    # Without the limits, which no search sets by itself, the end of a long text is found too.
    assert [r["id"] for r in search.search_ranked(jobs, '"e c"', "simple").collect()] == [1]
    assert search.search_ranked(jobs, '"e c"', "simple", limits=True).collect() == []
    free = search.search_ranked(jobs, '"e c"', "simple", postings.build_postings(jobs, "simple")).collect()
    assert [r["id"] for r in free] == [1]


def test_english_index(spark):
    jobs = _jobs(spark, [("Head of the", "of", "<p class='x'>Running engineers &amp; the runs</p>")])
    got = {r["lexeme"]: r["positions"] for r in postings.tsvector_rows(postings.build_postings(jobs, "english")).collect()}
    # Stop words at the end of the title take no room; markup is not indexed.
    assert got == {"head": "1A", "run": "2C,5C", "engin": "3C"}
    found = search.search_optimized(jobs, "run engineer", analyzer="english").collect()
    assert [(r["id"], r["total_count"]) for r in found] == [(0, 1)]
    assert search.search_optimized(jobs, "the of", analyzer="english").collect() == []


def test_written_index(spark):
    rows = _random_jobs(spark, 40, 9)
    jobs = _jobs(spark, rows)
    path = scratch_path(spark, "index")
    built = postings.build_postings(jobs, "simple")
    half = built.where("id < 20"), built.where("id >= 20")
    for part in half:
        postings.write_postings(part, path, buckets=4)
    assert postings.read_postings(spark, path, buckets=4).count() == built.count()
    index = postings.read_postings(spark, path, ["aa", "bb"], buckets=4)
    plan = index._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan and "In(lexeme" in plan
    a = search.search_optimized(jobs, "aa bb", analyzer="simple", postings=index).collect()
    assert a == search.search_optimized(jobs, "aa bb", analyzer="simple").collect()


def test_pages_and_guards(spark):
    jobs = _jobs(spark, _random_jobs(spark, 30, 3))
    every = [r["id"] for r in search.search_simple(jobs, "aa", 1000, 0, "simple").collect()]
    parts = [search.search_page(jobs, "aa", Page(p, 7), "simple").collect() for p in range(1, 7)]
    assert [r["id"] for part in parts for r in part] == every
    assert {r["total"] for part in parts for r in part} == {len(every)}
    assert search.typeahead(jobs, " a ", "simple").collect() == []
    assert len(search.typeahead(jobs, "aa", "simple").collect()) == 5
    with pytest.raises(ValueError):
        search.require_query("")


def test_scan_has_no_shuffle(spark):
    jobs = _jobs(spark, [("a", "b", "c")])
    plan = search.search_ranked(jobs, "a b", "simple")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan

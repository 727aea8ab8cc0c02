from collections import Counter

import pytest

from postlake.llm.queries import URL_RULES
from postlake.llm.url_filter import judge_urls

SCHEMA = "page_id long, url string, host string, n long, template long, row string"


@pytest.fixture
def judge(spark):
    def run(rows, rules=URL_RULES):
        df = spark.createDataFrame([(i, u, "h", 1, 2, "r") for i, u in rows], SCHEMA)
        out = judge_urls(df, rules)
        assert out.columns == [*df.columns, "path", "rule", "block_share", "verdict"]
        return out.collect()

    return run


def brute(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut : min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    best = None
    for verdict, text in rules:
        on, slash, below = text.partition("/")
        if (host == on or host.endswith("." + on)) and path.startswith(slash + below):
            best = max(best or (0, 0, ""), (len(text), len(on), text, verdict))
    return host, path, best[2] if best else None, best[3] if best else None


ODD = [
    None, "", "no scheme", "http://", "http://Example.ORG", "http://example.org/", "https://www.example.org/es/1?x=1", "http://notexample.org/es/1",
    "http://example.org/en/12", "http://example.org/en/2#a", "http://a.com/fr/1", "http://a.com/de/1", "http://b.net/de/1", "x://É.com/de/É ü\n/1",
    "http://com/de/", "http://a.com?u=http://b/c", "http://a.com#/de/", "a://b://c.com/de/", "http://a.com//de/", "http://a.com/" + "x/" * 3000,
]


def test_odd_rows(judge):
    rows = [(i, u) for i, u in enumerate(ODD)] + [(3, ODD[3]), (3, ODD[3]), (None, ODD[7])]
    got = judge(rows)
    want = Counter((i, *brute(u, URL_RULES)[:3]) for i, u in rows)
    assert Counter((r.page_id, r.host, r.path, r.rule) for r in got) == want
    for r in got:
        ruled = brute(r.url, URL_RULES)[3]
        assert r.verdict == ruled if ruled else r.verdict in ("allow", "block")
        assert r.row == "r" and 0 <= r.block_share <= 1


def test_templates_learn_from_labels(judge):
    """Below the labelled templates of a host, unlabelled paths get the verdict of theirs; ids become wildcards."""
    rules = [("block", "s.com/ads/1"), ("allow", "s.com/news/1")]
    rows = [(i, f"http://s.com/{'ads' if i % 2 else 'news'}/{i % 3}{i:04d}.html") for i in range(300)]
    got = judge(rows, rules)
    for r in got:
        assert r.verdict == ("block" if "/ads/" in r.path else "allow"), r
    assert len({r.template for r in got}) == 2
    assert {r.template for r in got if r.verdict == "block"} == {"/ads/{n}.html"} or all("ads" in r.template or "news" in r.template for r in got)


def test_variable_segments(judge):
    got = judge([(i, f"http://s.com/item-{chr(97 + i % 26)}{chr(97 + i // 26)}/view") for i in range(300)], [])
    assert {r.template for r in got} == {"/{*}/view"} and {r.verdict for r in got} == {"allow"}


def test_pages_crawled_twice(judge):
    """Templates and verdicts depend on which URLs there are, not on how often."""
    rows = [(i, f"http://s.com/item-{chr(97 + i % 26)}{chr(97 + i // 26)}/view") for i in range(60)]
    once, twice = judge(rows), judge(rows + rows + rows[:7] * 5)
    assert {r.template for r in once} == {r.template for r in twice} == {"/{*}/view"}


def test_deep_paths(judge):
    """Segments below the fourth level are generalised and learned from as any other."""
    rules = [("block", "s.com/a/b/c/d/ads/1"), ("allow", "s.com/a/b/c/d/news/1")]
    rows = [(i, f"http://s.com/a/b/c/d/{'ads' if i % 2 else 'news'}/{i % 3}{i:04d}/end") for i in range(200)]
    got = judge(rows, rules)
    assert all(r.verdict == ("block" if "/ads/" in r.path else "allow") for r in got)
    assert {r.template for r in got} == {"/a/b/c/d/ads/{n}/end", "/a/b/c/d/news/{n}/end"}


def smoothed(rows, rules):
    """Verdicts by hand where every path is a template of its own: one level, few children, differing labels."""
    counts = {}
    for _, url in rows:
        host, path, _, verdict = brute(url, rules)
        counts[host, path] = verdict
    total = [sum(v == "block" for v in counts.values()), sum(v is not None for v in counts.values())]
    out = {}
    for (host, path), verdict in counts.items():
        share = (total[0] + 1.0) / (total[1] + 2.0)
        for same in (lambda h, p: p == path, lambda h, p: h == host, lambda h, p: (h, p) == (host, path)):
            mine = [v for (h, p), v in counts.items() if same(h, p)]
            share = (sum(v == "block" for v in mine) + 2.0 * share) / (sum(v is not None for v in mine) + 2.0)
        out[host, path] = (verdict or ("block" if share > 0.5 else "allow"), share)
    return out


def test_free_verdicts_against_brute_force(judge):
    """Paths without a segment: each host is one template, judged by its own, all hosts' and all labels."""
    rules = [("block", "bad.org"), ("allow", "good.org"), ("block", "mixed.org")]
    rows = [(i, f"http://{h}") for i, h in enumerate(["bad.org", "a.bad.org", "b.bad.org", "good.org", "mixed.org", "free.net", "free.net", "other.net"])]
    want = smoothed(rows, rules)
    for r in judge(rows, rules):
        verdict, share = want[r.host, r.path]
        assert r.verdict == verdict and abs(r.block_share - share) < 1e-9


def test_empty(judge):
    assert judge([]) == [] and judge([], []) == []

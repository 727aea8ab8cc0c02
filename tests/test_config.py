import pytest
from pyspark.sql import functions as F

from postlake.functions.scalars import url_matches
from postlake.schema import SCRAPERS, SOURCES
from postlake.sources import config


def _source(**given):
    return tuple(given.get(f) for f in SOURCES.fieldNames())


# A complete source of each kind, and for each rule what must be missing for it to speak.
WHOLE = {
    "sitemap": {"name": "Brunnen AG", "url": "https://brunnen.test/map.xml", "fetch_type": "sitemap"},
    "html": {"name": "Quince", "url": "https://quince.test", "fetch_type": "html", "link_selector": "li > a"},
    "api": {"name": "Ostrich", "url": "https://ostrich.test/v3", "fetch_type": "api", "method": "PUT"},
}
BROKEN = [
    ("html", {"name": None}, "company name is required"),
    ("api", {"url": ""}, "company URL is required"),
    ("sitemap", {"fetch_type": "gopher"}, "invalid fetch type: gopher"),
    ("sitemap", {"fetch_type": None}, "invalid fetch type: "),
    ("html", {"link_selector": None}, "link_selector is required for HTML fetch type"),
    ("api", {"method": ""}, "method is required for API fetch type"),
    # Two rules broken: the earlier one speaks.
    ("api", {"url": None, "method": None}, "company URL is required"),
    ("html", {"name": "", "fetch_type": "ftp"}, "company name is required"),
]


def test_first_broken_rule_of_a_source(spark):
    given = [(kind, {}, None) for kind in WHOLE] + BROKEN
    rows = [_source(**{**WHOLE[kind], **change, "source_key": str(i)}) for i, (kind, change, _) in enumerate(given)]
    found = spark.createDataFrame(rows, SOURCES).select("source_key", config.source_error().alias("e")).collect()
    assert {int(r[0]): r[1] for r in found} == {i: e for i, (_, _, e) in enumerate(given)}


@pytest.mark.parametrize(
    ("name", "patterns", "selectors", "want"),
    [
        ("Heron", ["/vacancy/"], ("h2", "em", "article"), None),
        (None, ["/vacancy/"], ("h2", "em", "article"), "scraper name is required"),
        ("Heron", None, ("h2", "em", "article"), "at least one URL pattern is required"),
        ("Heron", ["/vacancy/"], ("h2", "", "article"), "location selector is required"),
        ("Heron", ["/vacancy/"], ("h2", "em", None), "description selector is required"),
        ("Heron", [], ("", "em", None), "at least one URL pattern is required"),
    ],
)
def test_first_broken_rule_of_a_scraper(spark, name, patterns, selectors, want):
    df = spark.createDataFrame([("key", name, patterns, selectors, True)], SCRAPERS)
    assert df.select(config.scraper_error()).first()[0] == want


def test_patterns_are_plain_substrings(spark):
    urls = ["ftp://heron.test/vacancy/9", "https://x/?q=.test", "https://xytest/", "", None]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    patterns = F.array(F.lit("/vacancy/"), F.lit(".test"))
    assert [r[0] for r in df.select(url_matches("url", patterns)).collect()] == [True, True, False, False, False]


YAML = """
companies:
  one: {name: One, fetch_type: sitemap, url: "https://one", id_pattern: "/j/([0-9]+)", enabled: true}
  two: {name: Two, fetch_type: api, url: "https://two", method: GET, headers: {A: b}}
"""
SCRAPER_YAML = """
scrapers:
  one: {name: Uno, url_patterns: [one], selectors: {title: h1, location: .l, description: "div > .d"}, enabled: true}
  six: {name: Six, url_patterns: [six], selectors: {title: h1, location: .l, description: "[data-qa='x']"}, enabled: true}
"""


def test_yaml(spark, tmp_path):
    (tmp_path / "s.yaml").write_text(YAML)
    (tmp_path / "c.yaml").write_text(SCRAPER_YAML)
    sources = config.load_sources(spark, str(tmp_path / "s.yaml"))
    scrapers = config.load_scrapers(spark, str(tmp_path / "c.yaml"))
    assert [r[0] for r in config.registered_sources(sources).collect()] == ["one"]
    assert sorted(r[0] for r in config.registered_scrapers(scrapers).collect()) == ["Six", "Uno"]
    assert sources.where("source_key = 'two'").first()["headers"] == {"A": "b"}
    gap = {r[0]: (r[1], r[2]) for r in config.coverage_gap(sources, scrapers).collect()}
    assert gap == {"one": (True, True), "six": (False, True)}
    (tmp_path / "bad.yaml").write_text(YAML.replace("method: GET", "method: ''"))
    with pytest.raises(config.InvalidConfig, match="invalid config for two: method is required"):
        config.load_sources(spark, str(tmp_path / "bad.yaml"))
    (tmp_path / "re.yaml").write_text(YAML.replace("/j/([0-9]+)", "(("))
    with pytest.raises(config.InvalidConfig, match="invalid regex pattern for company one"):
        config.load_sources(spark, str(tmp_path / "re.yaml"))

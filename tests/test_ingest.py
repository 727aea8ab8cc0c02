import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from postlake.operators import attempts, dedup, dedup_ttl, enrich, ids, upsert
from postlake.operators.postings import IndexMismatch, read_postings, write_postings
from postlake.plans import views
from postlake.schema import JOBS
from postlake.session import scratch_path
from postlake.sources import extract, landing
from postlake.streaming import jobs as streams

API = [
    ('[{"id": 1}, {"id": "x"}, {"id": ""}]', "", "id", ["1", "x", ""], None),
    ('{"a": {"b": [{"id": 7.9}, {"id": -7.9}, {"id": 1e3}]}}', "a.b", "", ["7", "-7", "1000"], None),
    ('[{"id": true}, {"id": null}, {"id": {}}, {"id": []}, 3, "s", null, {"x": 1}, {"id": 2}]', "", "id", ["2"], None),
    ('[{"id": 9007199254740993}]', "", "id", ["9007199254740993"], None),
    ('{"a.b": [1]}', "a.b", "id", [], "failed to find jobs at path a.b"),
    ('{"a": [1]}', "a.b", "id", [], "failed to find jobs at path a.b"),
    ('{"a": {"b": {}}}', "a.b", "id", [], "jobs data at path a.b is not an array"),
    ('{"id": 1}', "", "id", [], "response is not an array and no jobs_path specified"),
    ("{oops", "", "id", [], "failed to parse API response"),
    ('[{"job.id": 5}]', "", "job.id", ["5"], None),
]


def test_api_rules(spark):
    rows = [(f"s{i}", f"u{i}", 200, body, path, field) for i, (body, path, field, _, _) in enumerate(API)]
    df = spark.createDataFrame(rows, "source_key string, url string, status_code int, body string, p string, f string")
    ready = df.selectExpr(
        "source_key", "url", "status_code", "body", "'api' AS cfg_fetch_type", "CAST(NULL AS string) AS cfg_id_pattern",
        "'' AS cfg_link_selector", "p AS cfg_jobs_path", "f AS cfg_id_field", "'j/{id}' AS cfg_url_template",
        "CAST(NULL AS string) AS error",
    )
    refs, errors = extract.refs_from_api(ready)
    found = {}
    for r in refs.orderBy("source_key", "pos").collect():
        found.setdefault(r["source_key"], []).append(r["external_id"])
        assert r["url"] == f"j/{r['external_id']}"
    failed = {r["source_key"]: r["error"] for r in errors.collect()}
    for i, (_, _, _, want, error) in enumerate(API):
        assert found.get(f"s{i}", []) == want, API[i]
        assert failed.get(f"s{i}") == error, API[i]


def test_sitemaps(spark):
    ns = '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>https://x/job/1?a&amp;b</loc></url></urlset>'
    bodies = [
        ns,
        "<urlset><url><loc>https://x/job/2</loc></url><url><loc>https://x/no</loc></url></urlset>",
        "<sitemapindex><sitemap><loc>https://x/job/3</loc></sitemap></sitemapindex>",
        "<urlset><url><loc>https://x/job/4</loc></url>",
    ]
    rows = [("src0", f"u{i}", 200, b) for i, b in enumerate(bodies)] + [("none", "u8", 200, ns), ("src0", "u9", 500, ns)]
    landed = spark.createDataFrame(rows, "source_key string, url string, status_code int, body string")
    sources = views.sources(spark).withColumn("id_pattern", F.lit(r"/job/(\d+)"))
    refs, errors = extract.union_sources(landed, sources)
    assert sorted((r["external_id"], r["url"]) for r in refs.collect()) == [
        ("1", "https://x/job/1?a&b"), ("2", "https://x/job/2")
    ]
    assert {r["response_url"]: r["error"] for r in errors.collect()} == {
        "u3": "failed to parse sitemap",
        "u8": "company none not registered",
        "u9": "received non-OK status code: 500",
    }
    with pytest.raises(LookupError, match="company nonexistent not registered"):
        extract.discover_company(landed, sources, "nonexistent")


def _hot_refs(spark, n=900, seed=1):
    """A third of all rows share one id; some have none."""
    rnd = random.Random(seed)
    ids_ = ["hot" if rnd.random() < 0.33 else "" if rnd.random() < 0.1 else f"i{rnd.randint(0, 120)}" for _ in range(n)]
    base = dt.datetime(2024, 1, 1)
    rows = [(i, x, base + dt.timedelta(minutes=11 * i)) for i, x in enumerate(ids_)]
    return rows, spark.createDataFrame(rows, "seq bigint, external_id string, ts timestamp_ntz")


def _labels(rows, ttl=None):
    last, out = {}, {}
    for seq, key, ts in rows:
        dup = key != "" and key in last and (ttl is None or ts < last[key] + ttl)
        out[seq] = dup
        if key != "" and not dup:
            last[key] = ts
    return out


def test_labels_with_a_hot_id(spark):
    rows, refs = _hot_refs(spark)
    got = {r["seq"]: r["is_duplicate"] for r in dedup.label_first(refs).collect()}
    assert got == _labels(rows)
    shuffles = dedup.label_first(refs)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(external_id" in shuffles and "Window" not in shuffles


def test_ttl_labels(spark):
    rows, refs = _hot_refs(spark)
    ttl = dt.timedelta(hours=24)
    labelled, _ = dedup_ttl.accept_with_ttl(refs, None, ttl)
    assert {r["seq"]: r["is_duplicate"] for r in labelled.collect()} == _labels(rows, ttl)


def test_streams_over_many_batches(spark):
    """Four landed files, one per micro-batch, give the batch answer."""
    rows, refs = _hot_refs(spark, 400)
    folder = scratch_path(spark, "land")
    for part in range(4):
        refs.where(f"seq DIV 100 = {part}").coalesce(1).write.mode("append").parquet(folder)
    schema = refs.schema

    def stream():
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)

    labels = streams.Labels(spark, scratch_path(spark, "labels"))
    streams.start(stream(), scratch_path(spark, "check"), labels).awaitTermination()
    assert {r["seq"]: r["is_duplicate"] for r in labels.result().collect()} == _labels(rows)

    ttl = dt.timedelta(hours=24)
    timed = streams.TtlLabels(spark, scratch_path(spark, "ttl"), ttl)
    streams.start(stream(), scratch_path(spark, "check"), timed).awaitTermination()
    assert {r["seq"]: r["is_duplicate"] for r in timed.result().collect()} == _labels(rows, ttl)
    # Nothing of the session changes for the state store that a query needs.
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass")

    out = scratch_path(spark, "dedup")
    streams.start(streams.stream_dedup(stream()), scratch_path(spark, "check"), out=out).awaitTermination()
    kept = spark.read.parquet(out)
    assert sorted(r[0] for r in kept.where("external_id != ''").select("external_id").collect()) == sorted(
        {k for _, k, _ in rows if k}
    )
    assert kept.where("external_id = ''").count() == sum(k == "" for _, k, _ in rows)


NOW = dt.datetime(2025, 1, 1)
OLD = dt.datetime(2024, 1, 1)


def _stored(spark):
    rows = [(i, f"e{i}", "c", "u", f"t{i}", "l", "d", None, OLD, OLD, OLD if i == 2 else None, OLD, OLD) for i in (1, 2, 3)]
    return spark.createDataFrame(rows, JOBS)


def _batch(spark, *keys):
    rows = [(n, k, "c", "u", f"new {k}", "l2", "d2") for n, k in enumerate(keys)]
    return spark.createDataFrame(
        rows, "seq bigint, external_id string, company_name string, url string, title string, location string, description string"
    )


def test_upsert(spark):
    batch = upsert.first_per_key(_batch(spark, "e2", "e9", "e2"))
    once = upsert.upsert(_stored(spark), batch, NOW)
    got = {r["external_id"]: r for r in once.collect()}
    assert got.keys() == {"e1", "e2", "e3", "e9"}
    assert (got["e2"]["title"], got["e2"]["last_seen_at"], got["e2"]["expired_at"]) == ("t2", NOW, OLD)
    assert got["e2"]["updated_at"] == OLD and got["e1"]["last_seen_at"] == OLD
    assert (got["e9"]["id"], got["e9"]["title"], got["e9"]["first_seen_at"]) == (4, "new e9", NOW)
    twice = upsert.upsert(once, batch, NOW)
    assert sorted(map(str, twice.collect())) == sorted(map(str, once.collect()))


def test_insert_and_batches(spark):
    stored = _stored(spark).select("external_id", "title")
    path = scratch_path(spark, "jobs")
    stored.write.parquet(path)
    table = spark.read.schema(stored.schema).parquet(path)
    upsert.insert(path, _batch(spark, "e7"), table)
    assert spark.read.parquet(path).count() == 4
    with pytest.raises(upsert.DuplicateKey):
        upsert.insert(path, _batch(spark, "e1"), table)
    with pytest.raises(upsert.DuplicateKey):
        upsert.insert(path, _batch(spark, "n", "n"), table)
    bad = _batch(spark, "a", "b").withColumn("url", F.when(F.col("external_id") == "b", "").otherwise("u"))
    with pytest.raises(upsert.InvalidBatch, match="job b"):
        upsert.check_batch(bad)
    good, rest = upsert.check_batch(bad, "quarantine")
    assert [r["external_id"] for r in good.collect()] == ["a"] and [r["external_id"] for r in rest.collect()] == ["b"]
    assert upsert.accepted(bad).count() == 0 and upsert.accepted(_batch(spark, "a")).count() == 1


def test_expire(spark):
    after = upsert.expire_missing(_stored(spark), _batch(spark, "e3"), NOW)
    assert {r["external_id"]: r["expired_at"] for r in after.collect()} == {"e1": NOW, "e2": OLD, "e3": None}
    other = _batch(spark, "e3").withColumn("company_name", F.lit("z"))
    assert upsert.expire_missing(_stored(spark), other, NOW).where("expired_at IS NULL").count() == 2


def test_ids_are_dense_and_stable(spark):
    rows = spark.range(1000).selectExpr("concat('k', id) AS external_id")
    a = {r["external_id"]: r["id"] for r in ids.assign_ids(rows, start=11, parts=7).collect()}
    assert sorted(a.values()) == list(range(11, 1011))
    again = ids.assign_ids(rows.repartition(13).orderBy(F.rand()), start=11, parts=7)
    assert {r["external_id"]: r["id"] for r in again.collect()} == a


def test_attempts(spark):
    logs = {1: [200], 2: [500, 200], 3: [500, 500, 500, 200], 4: [404, 200], 5: [500, 403, 200], 6: [500, 500]}
    rows = [(k, i, s) for k, log in logs.items() for i, s in enumerate(log)]
    df = spark.createDataFrame(rows, "job_key bigint, attempt_seq bigint, status_code int")
    out = attempts.resolve_attempts(attempts.with_error(df))
    got = {r["job_key"]: (r["attempts"], r["status"]) for r in out.collect()}
    assert got == {1: (1, "success"), 2: (2, "success"), 3: (3, "failed"), 4: (1, "failed"), 5: (2, "failed"), 6: (2, "failed")}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.index("WindowGroupLimit") < plan.index("Exchange hashpartitioning(job_key")


def test_process_refs(spark):
    refs = spark.createDataFrame(
        [
            (1, "a", "https://www.example.com/1", "c"),
            (2, "a", "https://www.example.com/2", "c"),
            (3, "", "https://www.example.com/1", "c"),
            (4, "b", "https://nowhere/1", "c"),
            (5, "d", "https://www.example.com/404", "c"),
            (6, "d", "https://www.example.com/1", "c"),
            (7, "e", "https://example.org/blank", "c"),
            (8, "old", "https://www.example.com/1", "c"),
        ],
        "seq bigint, external_id string, url string, company_name string",
    )
    html = "<article><h1> T </h1></article><div class='ad'>L</div><footer><i>D</i></footer>"
    pages = spark.createDataFrame(
        [
            ("https://www.example.com/1", 200, html),
            ("https://www.example.com/2", 200, html),
            ("https://www.example.com/404", 404, ""),
            ("https://example.org/blank", 200, "<article><h1> </h1></article>"),
        ],
        "url string, status_code int, html string",
    )
    seen = spark.createDataFrame([("old",)], "external_id string")
    scrapers = views.scrapers(spark)
    done = enrich.process_refs(refs, pages, scrapers, seen)
    got = {r["seq"]: (r["status"], r["error"]) for r in done.collect()}
    scrape = "failed to scrape job from {}: failed after 3 attempts: "
    assert got == {
        1: ("success", None),
        2: ("duplicate", None),
        3: ("failed", "invalid job reference: missing required fields"),
        4: ("failed", "failed to enrich job reference b: no scraper configuration found for URL: https://nowhere/1"),
        5: ("failed", "failed to enrich job reference d: " + scrape.format("Alpha") + "received non-OK status code: 404"),
        6: ("duplicate", None),
        7: (
            "failed",
            "failed to enrich job reference e: "
            + scrape.format("Beta")
            + "could not extract job title using selector: article > h1",
        ),
        8: ("duplicate", None),
    }
    row = enrich.details_of(done).first()
    assert (row["company_name"], row["title"], row["location"], row["description"]) == ("Alpha", "T", "L", "<i>D</i>")
    again = enrich.process_refs(refs, pages, scrapers, seen, mark_on="success")
    assert {r["seq"]: r["status"] for r in again.collect()} == {
        1: "success", 2: "duplicate", 3: "failed", 4: "failed", 5: "failed", 6: "success", 7: "failed", 8: "duplicate"
    }


def test_end_to_end(spark):
    """Landed responses to a searchable table."""
    land, page_dir = scratch_path(spark, "land"), scratch_path(spark, "pages")
    body = "<urlset>" + "".join(f"<url><loc>https://www.example.com/en/{i}</loc></url>" for i in (1, 2, 2)) + "</urlset>"
    spark.createDataFrame(
        [("src0", "u", 200, body, OLD)], "source_key string, url string, status_code int, body string, fetched_at timestamp_ntz"
    ).write.parquet(land)
    found, errors = extract.union_sources(landing.read_responses(spark, land), views.sources(spark))
    refs = found.withColumn("seq", F.col("pos"))
    rows = [(f"https://www.example.com/en/{i}", 200, f"<article><h1>Job {i}</h1></article>") for i in (1, 2)]
    spark.createDataFrame(rows, "url string, status_code int, html string").write.parquet(page_dir)
    done = enrich.process_refs(refs, spark.read.parquet(page_dir), views.scrapers(spark))
    empty = spark.createDataFrame([], JOBS)
    table = upsert.upsert(empty, upsert.first_per_key(enrich.details_of(done)), NOW)
    table = ids.assign_ids(table.drop("id"), parts=3).select(*JOBS.fieldNames())
    assert errors.count() == 0
    assert sorted((r["id"] > 0, r["title"]) for r in table.collect()) == [(True, "Job 1"), (True, "Job 2")]


def test_latest_per_url(spark):
    rows = [("u", i, OLD + dt.timedelta(hours=i)) for i in range(50)] + [("v", 0, None)]
    df = spark.createDataFrame(rows, "url string, n int, fetched_at timestamp_ntz")
    assert sorted((r["url"], r["n"]) for r in landing.latest_per_url(df).collect()) == [("u", 49), ("v", 0)]


def test_streamed_upserts_are_repeatable(spark):
    sink = streams.Upserts(spark, scratch_path(spark, "snap"), _stored(spark), lambda n: NOW + dt.timedelta(days=n))
    sink(_batch(spark, "e1", "x"), 0)
    sink(_batch(spark, "x", "y"), 1)
    want = sorted(map(str, sink.result().collect()))
    sink(_batch(spark, "x", "y"), 1)
    assert sorted(map(str, sink.result().collect())) == want
    seen = {r["external_id"]: r["last_seen_at"] for r in sink.result().collect()}
    assert seen == {"e1": NOW, "e2": OLD, "e3": OLD, "x": NOW + dt.timedelta(days=1), "y": NOW + dt.timedelta(days=1)}


def test_patterns_of_any_length_and_number(spark):
    """The lowest key whose pattern is in the URL, for many patterns and for empty ones."""
    refs = spark.createDataFrame([(i, f"https://h{i}.x/{i % 7}") for i in range(200)] + [(999, "z")], "seq int, url string")
    rows = [(f"k{i:03}", f"K{i}", [f"h{i}.", f"/{i % 9}"], i % 4 != 0) for i in range(40)]
    scrapers = spark.createDataFrame(rows, "scraper_key string, name string, url_patterns array<string>, enabled boolean")
    joined = {r["seq"]: r["scraper_key"] for r in enrich.match_scraper(refs, scrapers).collect()}
    fits = lambda url: min((k for k, _, ps, on in rows if on and any(p in url for p in ps)), default=None)
    assert joined == {r["seq"]: fits(r["url"]) for r in refs.collect()} and len(set(joined.values())) > 5
    rows = [("k2", "a", [""], True), ("k1", "b", ["/es/"], True), ("k0", "c", ["", "x"], False)]
    scrapers = spark.createDataFrame(rows, scrapers.schema)
    refs = spark.createDataFrame([(1, "https://a/es/1"), (2, "b"), (3, ""), (4, None)], "seq int, url string")
    assert dict(tuple(r)[::2] for r in enrich.match_scraper(refs, scrapers).collect()) == {1: "k1", 2: "k2", 3: "k2", 4: None}


def test_an_index_keeps_its_bucket_count(spark, tmp_path):
    path = str(tmp_path / "index")
    postings = spark.createDataFrame(
        [("ab", 1, [(1, 1.0)]), ("cd", 2, [(2, 0.1)])], "lexeme string, id long, positions array<struct<p:int,w:double>>"
    )
    write_postings(postings, path, buckets=8)
    assert read_postings(spark, path, ["ab"]).count() == 1 and read_postings(spark, path).count() == 2
    with pytest.raises(IndexMismatch):
        read_postings(spark, path, ["ab"], buckets=16)
    with pytest.raises(IndexMismatch):
        write_postings(postings, path, buckets=16)
    write_postings(postings.where("id = 2"), path, buckets=8)
    assert read_postings(spark, path, ["cd"]).count() == 2


def test_a_row_without_a_time_passes(spark):
    refs = spark.createDataFrame([("a", 1, None), ("a", 2, NOW)], "external_id string, seq long, ts timestamp_ntz")
    labelled, _ = dedup_ttl.accept_with_ttl(refs, None, dt.timedelta(hours=24))
    assert {r.seq: r.is_duplicate for r in labelled.collect()} == {1: False, 2: False}


def test_upsert_takes_the_first_of_repeated_keys(spark):
    stored = _stored(spark)
    once, twice = _batch(spark, "x", "e1"), _batch(spark, "x", "e1", "x", "e1")
    after = upsert.upsert(stored, twice, NOW)
    assert after.count() == upsert.upsert(stored, once, NOW).count() == stored.count() + 1


def test_snapshots_are_found_after_a_restart(spark):
    root = scratch_path(spark, "restart")
    first = streams.Upserts(spark, root, _stored(spark), lambda n: NOW)
    first(_batch(spark, "x"), 0)
    again = streams.Upserts(spark, root, _stored(spark), lambda n: NOW)
    assert again.result().count() == first.result().count() == _stored(spark).count() + 1

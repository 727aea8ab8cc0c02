"""The stored tables: index segments, the posting store, listings by place and by id, versions."""

import datetime as dt
import glob
import os
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from postlake.operators import expiry, postings, search, stored_listing
from postlake.operators import index as index_module
from postlake.operators.filters import JobFilters, lookup_by_id
from postlake.operators.ids import number_in_order
from postlake.operators.index import SearchIndex
from postlake.operators.listing import Page, list_page
from postlake.operators.postings import IndexMismatch
from postlake.operators.store import PostingStore
from postlake.operators.versions import Versions, VersionTaken
from postlake.schema import JOBS
from postlake.session import scratch_path
from postlake.streaming.ttl_state import TtlState, accepted

OLD, NOW = dt.datetime(2024, 1, 1), dt.datetime(2025, 1, 1)


def _jobs(spark, ids, word="", gone=()):
    rnd = random.Random(3)
    words = ["running", "runs", "engineer", "the", "data", "things", "house"]
    rows = []
    for i in range(max(ids, default=0) + 1):
        text = " ".join(rnd.choice(words) for _ in range(12))
        if i in ids:
            rows.append((i, f"e{i}", "c", "u", f"{word} title {i}", "here", text, None, OLD, OLD, NOW if i in gone else None, OLD, OLD))
    return spark.createDataFrame(rows, JOBS)


def _files(root):
    return sorted(f for f in glob.glob(f"{root}/**/*.parquet", recursive=True))


def _same(index, jobs):
    """The index holds what a fresh build of the active postings would."""
    fresh = postings.build_postings(jobs.where("expired_at IS NULL"), index.analyzer)
    want = sorted(map(str, postings.tsvector_rows(fresh).collect()))
    assert sorted(map(str, postings.tsvector_rows(index.postings()).collect())) == want


@pytest.mark.parametrize("analyzer", ["simple", "english"])
def test_index_is_kept_up(spark, analyzer):
    """Written twice, corrected, thinned out and merged, it equals a fresh build after each step."""
    root = scratch_path(spark, "kept")
    index = SearchIndex.create(spark, root, analyzer, buckets=4)
    _same(index, _jobs(spark, []))
    index.add(_jobs(spark, range(20)))
    _same(index, _jobs(spark, range(20)))
    before = _files(root)
    index.add(_jobs(spark, range(15, 30), "novel", gone=[18]))
    now = _jobs(spark, range(15)).unionByName(_jobs(spark, range(15, 30), "novel", gone=[18]))
    _same(index, now)
    assert set(before) <= set(_files(root))
    index.delete(_jobs(spark, [3, 4, 29, 99]))
    now = now.where("id NOT IN (3, 4, 29)")
    _same(index, now)
    index.add(_jobs(spark, [3], "back"))
    now = now.unionByName(_jobs(spark, [3], "back"))
    _same(index, now)
    _same(SearchIndex(spark, root), now)
    index.compact()
    _same(index, now)
    assert len(index.state["segments"]) == 1 and not index.state["gone"] and not set(before) & set(_files(root))
    assert sum(r.documents for r in index.completions("titl").collect()) == now.where("expired_at IS NULL").count()


def test_words_carry_no_document(spark):
    """A word's row holds its own places, packed, and not those of its whole document."""
    jobs = _jobs(spark, range(3))
    found = postings.word_positions(jobs, "simple")
    assert dict(found.dtypes)["places"] == "array<int>"
    plan = found._jdf.queryExecution().executedPlan().toString()
    carried = re.findall(r"Generate explode\(.*\), \[([^\[\]]*)\], false, \[", plan)
    assert carried and all(re.fullmatch(r"id#\d+L?", c) for c in carried)
    path = scratch_path(spark, "packed")
    postings.write_postings(postings.build_postings(jobs, "simple", packed=True), path, 2)
    want = sorted(map(str, postings.tsvector_rows(postings.build_postings(jobs, "simple")).collect()))
    assert sorted(map(str, postings.tsvector_rows(postings.read_postings(spark, path)).collect())) == want


def test_stems_meet_in_one_shuffle(spark, monkeypatch):
    """Words of one stem meet where their bucket is written, in slices by id where it is large."""
    monkeypatch.setattr(postings, "DEALT_ROWS", 20)
    jobs = _jobs(spark, range(60), gone=[7])
    index = SearchIndex.create(spark, scratch_path(spark, "sliced"), "english", buckets=2)
    index.add(jobs)
    _same(index, jobs)
    assert len(glob.glob(f"{index._segment(1).removeprefix('file:')}/bucket=*/*.parquet")) > 4
    assert index.postings().groupBy("lexeme", "id").count().where("count > 1").isEmpty()
    found = postings.word_positions(jobs, "english")
    counts = found.groupBy("word").count().withColumnRenamed("count", "n")
    merged = postings._merged_stems(found, index._words(index.state["words"]), counts, 2)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 1 and not re.search(r"hashpartitioning\((id|lexeme)#", plan)


def _shuffle_files(spark):
    disks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {f for f in disks.getAllFiles().mkString("\n").split("\n") if re.search(r"shuffle_.*data$", f)}


@pytest.mark.parametrize("analyzer", ["simple", "english"])
def test_index_leaves_no_shuffle(spark, analyzer):
    """What a write has shuffled is gone from the disks after it, and the session's settings are as before."""
    settings = {n: spark.conf.get(n) for n in ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.requireAllClusterKeysForCoPartition")}
    index = SearchIndex.create(spark, scratch_path(spark, "tidy"), analyzer, buckets=2)
    steps = [lambda: index.add(_jobs(spark, range(20))), lambda: index.add(_jobs(spark, range(9, 30), "new")), lambda: index.delete(_jobs(spark, [1])), index.compact]
    for step in steps:
        before = _shuffle_files(spark)
        step()
        until = time.time() + 20  # they are deleted in the background
        while _shuffle_files(spark) - before and time.time() < until:
            time.sleep(0.2)
        assert not _shuffle_files(spark) - before
    assert settings == {n: spark.conf.get(n) for n in settings}


@pytest.mark.parametrize("buckets", [1, 3, 20])
def test_index_is_merged_in_passes(spark, monkeypatch, buckets):
    """Many rows are added by parts of the batch, and merged by parts of the buckets; each posting is shuffled once."""
    monkeypatch.setattr(postings, "DEALT_ROWS", 5)
    monkeypatch.setattr(index_module, "ADDED_AT_ONCE", 1)
    written, write = [], postings._write

    def spied(rows, path, *args):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        written.append((path, plan))
        write(rows, path, *args)

    monkeypatch.setattr(postings, "_write", spied)
    index = SearchIndex.create(spark, scratch_path(spark, "passes"), "simple", buckets=buckets)
    index.add(_jobs(spark, range(40)))
    assert len(written) == index_module.ADD_PASSES
    index.add(_jobs(spark, range(30, 60), "novel", gone=[31]))
    index.delete(_jobs(spark, [2, 33, 59]))
    index.add(_jobs(spark, [2], "back"))
    now = _jobs(spark, range(30)).where("id <> 2").unionByName(_jobs(spark, range(30, 59), "novel", gone=[31]).where("id <> 33")).unionByName(_jobs(spark, [2], "back"))
    _same(index, now)
    written.clear()
    index.compact()
    _same(index, now)
    assert len(written) == min(buckets, postings.MERGE_PASSES)
    # The two sides meet as they are dealt out; only the ids are gathered before.
    assert all(p.count("REPARTITION_BY_NUM") == 2 and "ShuffledHashJoin" in p and p.count("ENSURE_REQUIREMENTS") == 1 for _, p in written)
    assert index.postings().groupBy("lexeme", "id").count().where("count > 1").isEmpty()


def test_an_empty_index_is_merged(spark):
    index = SearchIndex.create(spark, scratch_path(spark, "none"), "simple", buckets=4)
    index.compact()
    index.add(_jobs(spark, range(3), gone=range(3)))
    index.add(_jobs(spark, range(2), gone=range(2)))
    index.compact()
    _same(index, _jobs(spark, []))
    index.add(_jobs(spark, range(5)))
    index.delete(_jobs(spark, range(5)))
    index.compact()
    _same(index, _jobs(spark, []))
    index.add(_jobs(spark, range(5)))
    index.compact()
    _same(index, _jobs(spark, range(5)))


def test_packed_and_unpacked_texts_are_one(spark):
    index = SearchIndex.create(spark, scratch_path(spark, "texts"), "simple", buckets=2)
    index.add(_jobs(spark, range(5)))
    texts = [sorted(map(str, postings.tsvector_rows(index.postings(packed=p)).collect())) for p in (True, False)]
    assert texts[0] == texts[1] and any("A" in t for t in texts[0]) and dict(index.postings(packed=True).dtypes)["places"] == "array<int>"


def test_old_indexes_are_refused(spark):
    root = scratch_path(spark, "earlier")
    Versions(spark, root).commit(0, {"analyzer": "simple", "buckets": 2, "limits": False, "segments": [], "gone": [], "words": []})
    with pytest.raises(IndexMismatch):
        SearchIndex(spark, root)


def test_words_are_stemmed_once(spark):
    index = SearchIndex.create(spark, scratch_path(spark, "once"), "english", buckets=2)
    for word in ("alpha", "alpha", "beta"):
        index.add(_jobs(spark, range(5), word))
    words = [r.word for r in index._words(index.state["words"]).collect()]
    assert len(words) == len(set(words)) and {"alpha", "beta", "running"} <= set(words) and "the" not in words


def test_search_over_the_stored_index(spark):
    jobs = _jobs(spark, range(40), gone=[5])
    index = SearchIndex.create(spark, scratch_path(spark, "pruned"), "english", buckets=16)
    index.add(jobs)
    found = search.search_optimized(jobs, "engineers run", postings=index)
    assert found.collect() == search.search_optimized(jobs, "engineers run").collect() and found.count()
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan and "In(lexeme" in plan
    # The page and the total take the hits from one exchange.
    found.collect()
    final = found._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in final or final.count("PartitionFilters: [bucket") == 1
    page = search.search_page(jobs, "run", Page(2, 7), postings=index).collect()
    assert page == search.search_page(jobs, "run", Page(2, 7)).collect()
    listed = list_page(jobs, JobFilters(search="run"), Page(2, 7), postings=index)
    assert "rank" not in listed.columns and [r.id for r in listed.collect()] == [r.id for r in page]
    assert search.typeahead(jobs, " eng ", postings=index).collect() == search.typeahead(jobs, "eng").collect()
    # What a replaced posting said is not found, and a word of NOT alone needs no postings.
    index.add(_jobs(spark, [1], "zebra"))
    assert [r.id for r in search.search_matches(jobs, "zebra", postings=index).collect()] == [1]
    assert search.search_matches(jobs, "-zebra", postings=index).count() == 38
    assert search.search_matches(jobs, "the", postings=index).count() == 0


def test_index_mismatches(spark):
    root, jobs = scratch_path(spark, "other"), _jobs(spark, range(3))
    with pytest.raises(IndexMismatch):
        SearchIndex(spark, root)
    index = SearchIndex.create(spark, root, "simple", buckets=2)
    with pytest.raises(IndexMismatch):
        search.search_matches(jobs, "run", postings=index)
    with pytest.raises(VersionTaken):
        SearchIndex.create(spark, root, "english")
    path = scratch_path(spark, "table")
    postings.write_postings(postings.build_postings(jobs, "simple"), path, 2)
    held = postings.read_postings(spark, path, ["data"])
    assert search.search_matches(jobs, "data", "simple", held).count() == search.search_matches(jobs, "data", "simple").count()
    with pytest.raises(IndexMismatch):
        search.search_matches(jobs, "data house", "simple", held)


def test_versions(spark):
    versions = Versions(spark, scratch_path(spark, "versions"))
    assert versions.newest() == -1
    for n in range(4):
        versions.commit(n, {"n": n, "text": 'a "b"\n'})
    with pytest.raises(VersionTaken):
        versions.commit(2, {})
    assert versions.read() == {"n": 3, "text": 'a "b"\n'} and versions.read(1)["n"] == 1
    # A manifest that was not written to its end is not there, and can be written.
    os.makedirs(f"{versions.root}/states/00000004".removeprefix("file:"))
    assert versions.newest() == 3
    versions.commit(4, {"n": 4})
    assert versions.forget(2, lambda s: [f"x{s['n']}"]) == ["x0", "x1", "x2"] and versions.numbers() == [3, 4]


def _batch(spark, *keys):
    rows = [(n, k, "c", "u", f"new {k}", "l2", "d2") for n, k in enumerate(keys)]
    return spark.createDataFrame(
        rows, "seq bigint, external_id string, company_name string, url string, title string, location string, description string"
    )


def test_store_over_batches(spark):
    """Ids stay and have no gap; a batch writes its own rows; a restart and a repeated batch change nothing."""
    root = scratch_path(spark, "store")
    store = PostingStore.create(_jobs(spark, range(1, 41)), root, buckets=4)
    first = {r.external_id: r.id for r in store.table().collect()}
    days = [NOW + dt.timedelta(days=n) for n in range(6)]
    before = _files(root)
    store.apply(_batch(spark, "e1", "x", "a", "x", None, ""), days[0], "one")
    assert set(before) <= set(_files(root))
    store.apply(_batch(spark, "b", "x", "e2"), days[1], "two")
    want = {r.external_id: (r.id, r.last_seen_at) for r in store.table().collect()}
    assert {k: i for k, (i, _) in want.items() if k in first} == first
    assert [want[k][0] for k in ("a", "x", "b")] == [41, 42, 43]
    assert [want[k][1] for k in ("e1", "e2", "e3", "x", "a")] == [days[0], days[1], OLD, days[1], days[0]]
    PostingStore(spark, root).apply(_batch(spark, "b", "zz"), days[5], "two")
    again = PostingStore.create(_jobs(spark, []), root, buckets=9)
    assert {r.external_id: (r.id, r.last_seen_at) for r in again.table().collect()} == want
    titles = {r.external_id: r.title for r in again.table().collect()}
    assert titles["x"] == "new x" and titles["e1"].endswith("title 1")

    again.expire(spark.createDataFrame([("e1",), ("a",), ("nobody",)], "external_id string"), days[2])
    again.apply(_batch(spark, "e1"), days[3], "three")
    gone = {r.external_id: r.expired_at for r in again.table().where("expired_at IS NOT NULL").collect()}
    assert gone == {"e1": days[2], "a": days[2]}
    whole = sorted(map(str, again.table().collect()))
    earlier = again.versions.numbers()[-2]
    assert again.table(earlier).where("external_id = 'e1'").first().last_seen_at == days[0]
    again.merge()
    assert sorted(map(str, again.table().collect())) == whole and again.state["marks"] == []
    assert again.versions.numbers() == [again.versions.newest()] and len(glob.glob(f"{root}/marks/*")) == 0
    again.apply(_batch(spark, "c"), days[4])
    assert {r.external_id: r.id for r in again.table().collect()}["c"] == 44


def test_store_rewrites_only_touched_buckets(spark):
    root = scratch_path(spark, "touched")
    store = PostingStore.create(_jobs(spark, range(1, 200)), root, buckets=16)
    before = set(_files(f"{root}/rows"))
    store.apply(_batch(spark, "e7"), NOW)
    known = store._rows(["external_id"]).where(F.col("bucket").isin(3))
    assert "PartitionFilters: [isnotnull(bucket" in known._jdf.queryExecution().toString()
    store.merge(keep=5)
    new = set(_files(f"{root}/rows")) - before
    assert before <= set(_files(f"{root}/rows")) and len({os.path.dirname(f) for f in new}) == 1
    assert store.table().count() == 199 and store.table().where("last_seen_at > '2024-06-01'").count() == 1
    empty = PostingStore.create(_jobs(spark, []), scratch_path(spark, "empty"), buckets=2)
    empty.apply(_batch(spark, "k"), NOW)
    empty.apply(_batch(spark).limit(0), NOW)
    assert [(r.id, r.external_id) for r in empty.table().collect()] == [(1, "k")]


def test_numbers_in_order(spark):
    rows = spark.range(500).selectExpr("concat('k', lpad(id * 7919 % 500, 3, '0')) AS external_id", "id % 3 AS other")
    numbered, last = number_in_order(rows, "external_id", start=11)
    got = numbered.orderBy("id").collect()
    assert [r.external_id for r in got] == sorted(r.external_id for r in got) and [r.id for r in got] == list(range(11, 511))
    assert last == 510 and number_in_order(rows.limit(0), "external_id", start=5)[1] == 4


def test_pages_at_any_depth(spark):
    rows = [(i, f"e{i}", "c", "u", f"t{i}", "l", "d", None, OLD, None if i % 17 == 0 else OLD + dt.timedelta(days=i * 37 % 50), NOW if i % 9 == 0 else None, OLD, OLD) for i in range(300)]
    jobs, root = spark.createDataFrame(rows, JOBS), scratch_path(spark, "listing")
    stored_listing.write_listing(jobs, root, width=40)
    for page in (Page(1, 20), Page(3, 30), Page(9, 30), Page(50, 20)):
        assert stored_listing.stored_page(spark, root, page).collect() == list_page(jobs, None, page).collect()
    plan = stored_listing.stored_page(spark, root, Page(9, 30))._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[isnotnull\(slot#\d+L\), \(slot#\d+L = 6\)\]", plan)
    slots = glob.glob(f"{root}/rows/v=0/slot=*")
    assert len(slots) == 7 and all(len(glob.glob(f"{s}/*.parquet")) == 1 for s in slots)
    stored_listing.write_listing(jobs.where("id < 50"), root, width=40)
    assert stored_listing.stored_page(spark, root, Page(1, 20)).first().total == 44

    root = scratch_path(spark, "by-id")
    stored_listing.write_by_id(jobs, root, width=40)
    found = stored_listing.lookup_stored(spark, root, 99)
    assert found.collect() == lookup_by_id(jobs, 99).collect()
    plan = found._jdf.queryExecution().toString()
    assert "EqualTo(id,99)" in plan and "PartitionFilters: [isnotnull(slot" in plan
    assert stored_listing.lookup_stored(spark, root, 5000).collect() == []


def test_expiry_by_complete_crawls(spark):
    day = [OLD + dt.timedelta(days=n) for n in range(4)]
    rows = [("s", "e1", day[0]), ("s", "e2", day[0]), ("t", "e2", day[0]), ("t", "e3", day[0]), ("s", "", day[0])]
    log = expiry.listing_intervals(None, spark.createDataFrame(rows, "source_key string, external_id string, fetched_at timestamp_ntz"))
    log = expiry.listing_intervals(log, spark.createDataFrame([("s", "e4", day[1])], "source_key string, external_id string, fetched_at timestamp_ntz"))
    responses = spark.createDataFrame([("s", day[1]), ("s", day[2]), ("t", day[1])], "source_key string, fetched_at timestamp_ntz")
    errors = spark.createDataFrame([("t",)], "source_key string")
    crawls = expiry.crawl_log(responses, errors)
    assert {r.source_key: (r.crawled_at, r.complete) for r in crawls.collect()} == {"s": (day[1], True), "t": (day[1], False)}
    stored = _jobs(spark, range(1, 6), gone=[5])
    gone = lambda c: {r.external_id for r in expiry.expire_unlisted(stored, log, c, NOW).where("expired_at IS NOT NULL").collect()}
    # e2 is still in a source whose crawl broke off; e4 was listed in that very crawl; e5 was gone before.
    assert gone(crawls) == {"e1", "e5"}
    assert gone(crawls.withColumn("complete", F.lit(True))) == {"e1", "e2", "e3", "e5"}
    assert gone(crawls.withColumn("complete", F.lit(False))) == {"e5"}


class _Value:
    def __init__(self):
        self.held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value

    def clear(self):
        self.held = None


class _Handle:
    def __init__(self):
        self.value, self.timers = _Value(), []

    def getValueState(self, name, schema):
        return self.value

    def listTimers(self):
        return list(self.timers)

    def deleteTimer(self, t):
        self.timers.remove(t)

    def registerTimer(self, t):
        self.timers.append(t)


def test_ttl_state():
    import numpy as np
    import pandas as pd

    handle, state = _Handle(), TtlState(100_000)
    state.init(handle)
    run = lambda *rows: [int(s) for p in state.handleInputRows(("k",), iter([pd.DataFrame(rows, columns=["us", "seq"])]), None) for s in p["seq"]]
    assert run((5_000, 2), (5_000, 1), (104_999, 3), (105_000, 4), (300_000, 5)) == [1, 4, 5]
    assert handle.timers == [400]
    assert run((399_999, 6)) == [] and run((400_000, 7)) == [7] and handle.timers == [500]
    assert list(state.handleExpiredTimer(("k",), None, None)) == [] and not handle.value.exists()
    assert accepted(np.array([1, 2, 3]), None, 10) == [0] and accepted(np.array([], np.int64), None, 10) == []

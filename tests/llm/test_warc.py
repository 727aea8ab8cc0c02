import base64
import gzip
import hashlib
import os
import shutil
from collections import Counter
from glob import glob

import pytest

from postlake.llm.warc import deduplicated_archives, read_archives, resolve_revisits, write_archives

SCHEMA = "page_id long, url string, html string, file string, at long, payload string, digest string"


@pytest.fixture
def pages(spark):
    def make(rows):
        return spark.createDataFrame([(i, u, h, "f", 1, "p", "d") for i, u, h in rows], SCHEMA)

    return make


ROWS = [
    (1, "http://a/1", "<p>é same</p>"), (2, "http://a/2", "<p>é same</p>"), (9, None, "<p>é same</p>"), (3, "http://a/3", None),
    (4, "http://a/4", ""), (5, "x\r\nWARC-Type: revisit", "WARC/1.1\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n"), (None, "http://n", "<p>é same</p>"),
    (6, "http://a/6", "z" * 300000), (7, "http://a/7", "alone"), (7, "http://a/7", "alone"), (None, None, "only null"),
]


def test_odd_rows(pages):
    out = deduplicated_archives(pages(ROWS)).collect()
    assert len(out) == len(ROWS)
    groups = {}
    for i, _, html in ROWS:
        groups.setdefault(html or "", []).append(i)
    want = []
    for payload, ids in groups.items():
        first = max((i for i in ids if i is not None), default=None)
        rest = list(ids)
        rest.remove(first)
        data = payload.encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        want += [(first, len(data), digest, "response", None)] + [(i, len(data), digest, "revisit", first) for i in rest]
    assert Counter((r.page_id, r.payload_bytes, r.digest, r.record_type, r.refers_to) for r in out) == Counter(want)
    uris = {r.page_id: r.uri for r in out}
    assert uris[5] == "x%0D%0AWARC-Type: revisit" and uris[9] is None


def test_least_size(pages):
    out = deduplicated_archives(pages([(1, None, "ab"), (2, None, "ab"), (3, None, "abc"), (4, None, "abc")]), min_bytes=3).collect()
    assert {(r.page_id, r.record_type, r.refers_to) for r in out} == {(1, "response", None), (2, "response", None), (3, "revisit", 4), (4, "response", None)}


def test_archives_round_trip(spark, pages, tmp_path):
    raw, target = str(tmp_path / "raw"), str(tmp_path / "new")
    write_archives(pages(ROWS), raw)
    back = read_archives(spark, raw, with_payload=True).collect()
    assert Counter((r.page_id, bytes(r.payload).decode()) for r in back) == Counter((i, h or "") for i, _, h in ROWS)
    resolve_revisits(spark, raw, target, date="2020-02-02T00:00:00Z")
    data = b"".join(gzip.open(f).read() for f in sorted(glob(target + "/*.gz")))
    assert data.count(b"WARC-Date: 2020-02-02T00:00:00Z\r\n") == len(ROWS)
    assert data.count(b"\r\nWARC-Type: revisit\r\n") == data.count(b"WARC-Profile: ") == data.count(b"WARC-Refers-To: <urn:uuid:") > 0
    kept = {r.record_id for r in read_archives(spark, target).collect() if r.record_type == "response"}
    for line in data.split(b"\r\n"):
        if line.startswith(b"WARC-Refers-To: "):
            assert line.split(b": ", 1)[1].decode() in kept


def test_empty(pages):
    assert deduplicated_archives(pages([])).count() == 0


def _merged(spark, *folders):
    """All payloads by digest, and the records, of archives read together."""
    records = [r for f in folders for r in read_archives(spark, f, with_payload=True).collect()]
    return {r.digest: bytes(r.payload) for r in records if r.record_type == "response"}, records


@pytest.mark.parametrize("later", [9, 0])
def test_archives_that_hold_revisits(spark, pages, tmp_path, later):
    """A revisit has no payload to give: whatever its page id, the response that is there stays one, and no payload is lost."""
    raw, once, more, both, twice = (str(tmp_path / n) for n in ("raw", "once", "more", "both", "twice"))
    write_archives(pages([(1, "http://a", "same"), (2, "http://b", "same"), (later, "http://c", "same"), (5, "http://d", "other")]), raw)
    resolve_revisits(spark, raw, once)
    write_archives(pages([(7, "http://e", "same"), (8, "http://f", "new")]), more)
    os.makedirs(both)
    for n, f in enumerate(glob(once + "/*.gz") + glob(more + "/*.gz")):
        shutil.copy(f, f"{both}/{n}.gz")
    resolve_revisits(spark, both, twice)
    payloads, records = _merged(spark, twice)
    assert sorted(payloads.values()) == [b"new", b"other", b"same"]
    responses = {r.record_id: r for r in records if r.record_type == "response"}
    assert len(records) == 6 and len(responses) == 3
    same = [r for r in responses.values() if bytes(r.payload) == b"same"][0]
    # The responses are pages 7 and the largest of the first three.
    assert same.page_id == max(7, later) if later else same.page_id == 7
    for r in records:
        if r.record_type == "revisit":
            assert (r.refers_to, r.refers_id, r.payload_bytes) == (same.page_id, same.record_id, 4)


def test_foreign_records(spark, tmp_path):
    """Other versions and kinds pass through; bytes that are no text survive; a revisit of what isn't there stays."""
    payload = b"\xff\xfe\x00 raw \r\n\r\n bytes"
    http = b"HTTP/1.0 200 OK\r\ncontent-type: x\r\n\r\n"
    record = lambda head, block: b"WARC/1.0\r\n" + head + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"
    data = record(b"WARC-Type: warcinfo\r\nWARC-Record-ID: <urn:i>\r\n", b"software: x\r\n")
    data += record(b"warc-type: response\r\nWARC-Record-ID: <urn:1>\r\nWARC-Date: 2011-01-01T00:00:00Z\r\n", http + payload)
    data += record(b"WARC-Type: response\r\nWARC-Record-ID: <urn:2>\r\nWARC-Date: 2012-01-01T00:00:00Z\r\n", http + payload)
    data += record(b"WARC-Type: revisit\r\nWARC-Record-ID: <urn:3>\r\nWARC-Refers-To: <urn:gone>\r\nWARC-Payload-Digest: sha1:ABC\r\n", b"")
    data += record(b"WARC-Type: request\r\nWARC-Record-ID: <urn:4>\r\n", b"GET / HTTP/1.0\r\n\r\n")
    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    (source / "a.warc.gz").write_bytes(gzip.compress(data[:200]) + gzip.compress(data[200:]))
    resolve_revisits(spark, str(source), str(target))
    found = {r.record_id: r for r in read_archives(spark, str(target), with_payload=True).collect()}
    assert len(found) == 5 and {r.record_type for r in found.values()} == {"warcinfo", "response", "revisit", "request"}
    whole = [r for r in found.values() if r.record_type == "response"]
    assert [bytes(r.payload) for r in whole] == [payload] and whole[0].date in ("2011-01-01T00:00:00Z", "2012-01-01T00:00:00Z")
    assert (found["<urn:3>"].refers_id, found["<urn:3>"].digest) == ("<urn:gone>", "ABC")
    assert bytes(found["<urn:i>"].payload).endswith(b"software: x\r\n") and b"GET / HTTP/1.0" in bytes(found["<urn:4>"].payload)

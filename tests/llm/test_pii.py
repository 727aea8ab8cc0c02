import hashlib
import random
import re
from collections import Counter

from postlake.llm.pii import KINDS, _posterior, find_personal_data, span_digest


def luhn(digits):
    return sum(int(c) if k % 2 == 0 else int(c) * 2 - (9 if c > "4" else 0) for k, c in enumerate(reversed(digits))) % 10 == 0


def base(text):
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", m))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", m))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        if 13 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d):
            out.append(("card", m))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", m))
    return [(k, m.start(), m.end()) for k, m in out]


def written(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def check(docs, rows):
    got = span_digest(find_personal_data(docs)).collect()
    want = Counter((i, *[sum(k == x for k, _, _ in base(t)) for x in KINDS], hashlib.sha256(written(base(t)).encode()).hexdigest()) for i, t in rows)
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == want
    return got


def test_base_spans_of_odd_rows(make_docs, odd_rows):
    draw = random.Random(3)
    parts = ["1", "2", "4", "25", ".", "-", " ", "+", "a@b", "@", "c.d", "(", ")", "é", "😀", "\n", "x", "tel: 555-123-4567", "card 4111 1111 1111 1111", "v1.2.3.4", "joe [at] ex [dot] com"]
    rows = [(1000 + i, "".join(draw.choice(parts) for _ in range(40))) for i in range(600)]
    rows += [*odd_rows, (60, "a@b.c_d@e.f"), (61, "1.2.3.4.5.6.7.8 256.1.1.1 007.0.0.255 1.1.1.99999999999999999999")]
    rows += [(62, "a@b.c"), (62, "a@b.c"), (62, "other"), (None, "a@b.c")]
    for row in check(make_docs(rows), rows):
        spans = [s.split(":") for s in row.spans.split(",") if s]
        places = [(KINDS.index(k), int(a), int(b)) for k, a, b in spans]
        assert places == sorted(places) and all(a < b for _, a, b in places)


def test_long_runs(make_docs):
    rows = [(1, "1" * 5000), (2, "a" * 6000 + "@" + "b." * 20000 + "c"), (3, "1-" * 3000 + "1"), (4, "+" + "1 " * 5000), (5, "1." * 3000), (6, "a" * 5000)]
    check(make_docs(rows), rows)
    # The plain patterns take quadratic time here, so only the outcome is known: an address takes four numbers.
    rows = [(1, "a" * 2000000), (2, "1" * 500000), (3, "1." * 500000)]
    assert {r.doc_id: len(r.spans) for r in find_personal_data(make_docs(rows)).collect()} == {1: 0, 2: 0, 3: 500000 // 4}


def test_method_adds_spans_and_leaves_clean_texts(make_docs):
    rows = [(i, f"some words {i} mail ann{i}@site.org and call +1 (555) 555-0{i:03d} or card 4111 1111 1111 1111 today") for i in range(60)]
    rows += [(100, "please call (555) 123-4567 soon"), (101, "phone: 555.123.4567"), (102, "token = 9999999999999999 and version 10.2"), (103, "nothing here 2024-01-01 12:30")]
    got = {r.doc_id: r.spans for r in check(make_docs(rows), rows)}
    assert got[100] == "phone:12:26" and got[101] == "phone:7:19"
    assert got[102] == got[103] == ""


def test_empty(make_docs):
    assert find_personal_data(make_docs([])).count() == 0
    assert [r.spans for r in find_personal_data(make_docs([(1, None)])).collect()] == [[]]


def test_reliabilities():
    """A labeler that is mostly against the others loses its say."""
    rows = [{"votes": (1, 1, 1, 0, -1, 0), "n": 90}, {"votes": (-1, -1, -1, 0, 1, 0), "n": 90}, {"votes": (1, 1, 1, 0, 1, 0), "n": 5}, {"votes": (0, 0, 0, 0, 1, 0), "n": 10}]
    soft, _ = _posterior(rows)
    assert soft[0] > 0.9 and soft[1] < 0.1 and soft[2] > 0.9 and soft[3] < 0.5

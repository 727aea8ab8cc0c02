import re
import string
from collections import Counter

import pytest

from postlake.llm.decontaminate import contamination, contamination_digest, drop_contaminated

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, window=10):
    wanted = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1)) if w else ():
            wanted.setdefault(tuple(w[i : i + window]), set()).add(item)
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for size in {len(k) for k in wanted}:
            for at in range(len(w) - size + 1):
                if tuple(w[at : at + size]) in wanted:
                    hit |= set(range(at, at + size))
                    found |= wanted[tuple(w[at : at + size])]
        out.append((i, len(w), len(hit), tuple(sorted(str(x) for x in found if x is not None)), bool(hit)))
    return Counter(out)


@pytest.fixture
def make_items(spark):
    return lambda rows: spark.createDataFrame(rows, "item_id long, text string")


def run(docs, items):
    return Counter((r.doc_id, r.n_words, r.n_hit, tuple(r.items), r.contaminated) for r in contamination(docs, items).collect())


def test_odd_rows(make_docs, make_items, odd_rows):
    long = odd_rows[0][1].split()
    items = [(1, " ".join(long[20:50])), (2, " ".join(long[20:31])), (2, " ".join(long[20:31])), (3, None), (4, ""), (5, "two-WORDS"), (6, "word"), (7, "word word"), (None, " ".join(long[60:75])), (10, " ".join(long[20:30]).upper()), (11, "not anywhere at all"), (12, "word word word word")]
    assert run(make_docs(odd_rows), make_items(items)) == brute(odd_rows, items)


def test_no_items_or_documents(make_docs, make_items, odd_rows):
    assert run(make_docs(odd_rows), make_items([])) == brute(odd_rows, [])
    assert run(make_docs(odd_rows), make_items([(1, None)])) == brute(odd_rows, [])
    assert run(make_docs([]), make_items([(1, "some words")])) == Counter()


def test_drop_and_digest(make_docs, make_items):
    docs = make_docs([(1, "one two three"), (2, "one two"), (None, "one two three"), (3, None)])
    items = make_items([(7, "two three")])
    out = drop_contaminated(docs, items)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == {2, 3}
    row = contamination_digest(contamination(docs, items)).where("doc_id = 1").first()
    assert (row.n_words, row.n_hit, row.n_items, row.contaminated) == (3, 2, 1, True)
    assert row.items_sha256 == "7902699be42c8a8e46fbbb4501726517e86b22c56a189f7625a6da49081b2451"

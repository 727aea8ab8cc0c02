import string
from collections import Counter, defaultdict

from postlake.llm.line_dedup import drop_repeated_lines

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(rows, min_chars=20, min_docs=3):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if i is not None and len(key(line)) >= min_chars:
                holders[key(line)].add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if i is None or len(key(x)) < min_chars or len(holders[key(x)]) < min_docs or max(holders[key(x)]) == i]
        out.append((i, "\n".join(stay), len(lines), len(lines) - len(stay)))
    return Counter(out)


def test_odd_rows(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    out = drop_repeated_lines(docs)
    assert out.columns == [*docs.columns, "n_dropped"]
    assert Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out.collect()) == brute(odd_rows)
    assert {r.body for r in out.collect()} == {"b"}


def test_thresholds(make_docs):
    rows = [(i, "x" * 20 + f"\n{'y' * 19}\n{'z' * 20 if i < 2 else ''}") for i in range(4)]
    out = {r.doc_id: r.n_dropped for r in drop_repeated_lines(make_docs(rows)).collect()}
    assert out == {0: 1, 1: 1, 2: 1, 3: 0}


def test_empty(make_docs):
    assert drop_repeated_lines(make_docs([])).count() == 0

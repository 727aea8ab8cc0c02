import random
import string
from collections import Counter

from postlake.llm.components import components
from postlake.llm import minhash
from postlake.llm.minhash import drop_near_duplicates, near_duplicates

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def shingles(text, k):
    words = (text or "").translate(LOWER).encode().split()
    if len(words) < k:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def brute(rows, k):
    sets = [shingles(t, k) for _, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, _) in enumerate(rows):
        for b, (j, _) in enumerate(rows[:a]):
            both = len(sets[a] & sets[b])
            if i is not None and j is not None and both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return Counter((i, len(s), find(i) if i is not None else None, i is None or find(i) == i) for (i, _), s in zip(rows, sets, strict=True))


def run(docs, **options):
    return Counter(tuple(r) for r in near_duplicates(docs, **options).collect())


def test_odd_rows(make_docs, odd_rows):
    rows = [(i, t) for i, t in odd_rows if t is None or len(t) < 50000]
    assert run(make_docs(rows), shingle=2) == brute(rows, 2)


def test_families_near_the_threshold(make_docs):
    """Copies that differ so much that a family holds many groups and single documents, over several blocks."""
    draw = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for size, copies in ((40, 90), (120, 60), (60, 8)):
        first = [draw.choice(words) for _ in range(size)]
        for _ in range(copies):
            own = list(first)
            for _ in range(draw.randrange(0, size // 7)):
                own[draw.randrange(size)] = draw.choice(words)
            rows.append((len(rows), " ".join(own)))
    want = brute(rows, 2)
    assert len({r[2] for r in want}) > 10
    assert run(make_docs(rows), shingle=2) == want


def test_groups_of_one_mould_meet_in_few_pairs(make_docs, monkeypatch):
    """Documents of one mould share bands and are no links; the positional bound keeps them from meeting in pairs."""
    draw = random.Random(12)
    mould = [f"m{i}" for i in range(100)]
    rows = []
    for d in range(120):
        own = [f"o{d}x{i}" for i in range(13 if d % 2 else 14)]
        rows.append((d, " ".join(mould + own)))
    for d in range(120, 140):  # of these, some are links to what others of the mould are
        own = rows[draw.randrange(120)][1].split()
        rows.append((d, " ".join(own[:-3] + [f"n{d}a", f"n{d}b", f"n{d}c"])))
    met = []
    across = minhash._across

    def counted(*args):
        pairs = across(*args)
        met.append(0 if pairs is None else pairs.count())
        return pairs

    monkeypatch.setattr(minhash, "_across", counted)
    assert run(make_docs(rows), shingle=2) == brute(rows, 2)
    assert met[0] < 400


def test_drop(make_docs):
    text = " ".join(f"w{i}" for i in range(50))
    docs = make_docs([(5, text), (2, text + " more"), (9, "short"), (None, text), (7, None)])
    out = drop_near_duplicates(docs)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} == {2, 9, None, 7}


def test_empty(make_docs):
    assert run(make_docs([])) == Counter()


def test_components(spark):
    draw = random.Random(2)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2000 + i) for i in range(50)] + [(7, 7)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    want = {x: find(x) for a, b in edges if a != b for x in (a, b)}
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == want and len(got) == len(want)

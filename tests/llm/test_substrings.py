import random
from collections import Counter

import numpy as np
import pytest

from postlake.llm import substrings
from postlake.llm.fm_index import FMIndex, WaveletTree
from postlake.llm.substrings import remove_repeats


def mark_order(rows, hashes):
    """Documents in order of precedence: id, then hash of the text; repeats are one document."""
    return sorted({(i, hashes[t or ""], t or "") for i, t in rows if i is not None})


def brute(rows, hashes, window):
    seen, gone = set(), {}
    for i, h, text in mark_order(rows, hashes):
        words = text.encode().split()
        out = gone[i, text] = set()
        for at in range(len(words) - window + 1):
            key = tuple(words[at : at + window])
            if key in seen:
                out |= set(range(at, at + window))
            seen.add(key)
    result = []
    for i, t in rows:
        words = (t or "").encode().split()
        out = gone[i, t or ""] if i is not None else set()
        result.append((i, len(words), len(out), b" ".join(w for k, w in enumerate(words) if k not in out).decode()))
    return Counter(result)


def run(spark, docs, rows, window):
    from pyspark.sql import functions as F

    texts = spark.createDataFrame([(t or "",) for _, t in rows] or [("",)], "t string")
    hashes = {r.t: r.h for r in texts.select("t", F.xxhash64("t").alias("h")).collect()}
    got = Counter(tuple(r) for r in remove_repeats(docs, window).collect())
    assert got == brute(rows, hashes, window)


def test_odd_rows(spark, make_docs, odd_rows):
    run(spark, make_docs(odd_rows), odd_rows, 20)


@pytest.mark.parametrize("hot", [3, 10**6])
def test_random_passages(spark, make_docs, monkeypatch, hot):
    """Periodic texts, passages at all offsets, near copies; with anchors taken singly and not."""
    monkeypatch.setattr(substrings, "HOT", hot)
    monkeypatch.setattr(substrings, "SHARD", 20)
    draw = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    passages = [[draw.choice(words) for _ in range(draw.randrange(5, 25))] for _ in range(5)] + [["a", "b"] * 12, ["x"] * 30]
    rows = []
    for i in range(50):
        text = []
        for _ in range(draw.randrange(1, 6)):
            text += [draw.choice(words) for _ in range(draw.randrange(0, 12))] + draw.choice(passages)
        rows.append((draw.randrange(40), " ".join(text)))
    run(spark, make_docs(rows), rows, 8)


def test_empty(spark, make_docs):
    run(spark, make_docs([]), [], 20)


def test_matching_statistics():
    draw = np.random.default_rng(2)
    codes = np.append(draw.integers(1, 4, 400), 0)
    index = FMIndex(codes, 5, 12)
    ends = np.arange(1, 401)
    length, low, high = index.matching_statistics(codes, ends, 12)
    text = codes.tolist()
    for end, n, lo, hi in zip(ends, length, low, high, strict=True):
        count = lambda m: sum(text[i : i + m] == text[end - m : end] for i in range(401 - m + 1))  # noqa: B023, E731
        assert n == max(m for m in range(min(12, end) + 1) if m == 0 or count(m) >= 2)
        if n:
            assert hi - lo == count(n)
    absent = np.array([4, 4, 1])
    assert index.matching_statistics(absent, np.array([2]), 2)[0].tolist() == [0]


def test_wavelet_rank():
    draw = np.random.default_rng(1)
    values = draw.integers(0, 37, 500)
    tree = WaveletTree(values, 37)
    at, symbol = draw.integers(0, 501, 300), draw.integers(0, 37, 300)
    assert tree.rank(symbol, at).tolist() == [int((values[:a] == s).sum()) for a, s in zip(at, symbol, strict=True)]

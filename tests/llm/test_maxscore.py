import random

import numpy as np
from pyspark.sql import functions as F

from postlake.llm import maxscore
from postlake.llm.maxscore import quantized, top_k


def brute(rows, queries, k):
    held = {}
    for i, v in rows:
        if i is not None and v is not None:
            held[i] = min(held.get(i, v), v)
    out = set()
    for q in queries:
        if q not in held:
            continue
        scored = sorted((-sum(a * b for a, b in zip(held[q], v, strict=False)), i) for i, v in held.items() if i != q)[:k]
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)}
    return out


def run(df, k=10):
    return {tuple(r) for r in top_k(df, df.where("id % 10 = 0"), k).collect()}


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(maxscore, "SHARD_ROWS", 90)
    monkeypatch.setattr(maxscore, "BLOCK_ROWS", 13)
    draw = random.Random(6)
    rows = []
    for i in range(400):
        centre = i % 5
        v = [draw.randrange(-30, 31) + (200 if d % 5 == centre else 0) if draw.random() < 0.8 else 0 for d in range(16)]
        rows.append((i, v))
    rows += [(500, rows[3][1]), (510, rows[3][1]), (520, [0] * 16), (530, [-9] * 16), (540, None), (None, [1] * 16), (3, rows[3][1]), (30, [-1000] * 16), (550, [5]), (560, [])]
    df = spark.createDataFrame([(i, v, "x", 3) for i, v in rows], "id long, v array<int>, q string, w long")
    ids = {i for i, _ in rows if i is not None and i % 10 == 0}
    assert run(df) == brute(rows, ids, 10)


def test_fewer_candidates_than_k(spark):
    df = spark.createDataFrame([(0, [1, -2]), (1, [-3, 4]), (10, [1, 1])], "id long, v array<int>")
    assert run(df) == brute([(0, [1, -2]), (1, [-3, 4]), (10, [1, 1])], [0, 10], 10)
    assert run(df.limit(0)) == set()


def test_quantized(spark):
    rows = [([0.5, -0.001, 1.0],), (None,), ([0.1, None],), ([float("nan")],), ([float("inf")],), ([],), ([3e38],)]
    got = [r[0] for r in spark.createDataFrame(rows, "v array<float>").select(quantized(F.col("v"))).collect()]
    assert got == [[512, -2, 1024], None, None, None, None, [], [1024 * float(np.float32(3e38))]]


def test_values_beyond_a_word_are_told_apart(spark):
    """Sums at the end of 64 bits, and products far beyond them, which only lose."""
    rows = [(0, [2.0**20, 1.0]), (1, [70000.0, 3.0]), (2, [90000.0, -5.0]), (3, [-(2.0**100), 2.0]), (4, [2.0**20 + 1, 7.0]), (10, [0.0, 2.0**52 - 1])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    whole = [(i, [int(x) for x in v]) for i, v in rows]
    assert run(df, 3) == brute(whole, [0, 10], 3)


def test_weak_terms_are_skipped():
    """A strong component and a very good first list leave most rows untouched; the result is exact all the same."""
    draw = np.random.default_rng(0)
    matrix = draw.integers(0, 3, (2000, 8))
    matrix[:40, 0] = 1000 + np.arange(40)
    shard = maxscore.Shard(np.arange(2000), matrix)
    query = np.array([900, 1, 1, 1, 1, 1, 1, 1])
    ids, score = shard.search(5, query, 10)
    exact = matrix @ query
    exact[5] = -1
    want = np.lexsort((np.arange(2000), -exact))[:10]
    assert ids.tolist() == want.tolist() and score.tolist() == exact[want].tolist()

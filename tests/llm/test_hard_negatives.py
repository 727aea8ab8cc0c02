import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlake.llm import hard_negatives
from postlake.llm.hard_negatives import bit_planes, lookup_index, mine, scores, subset_sums


def brute(rows, every=10, positives=5, negatives=5, scale=256):
    held = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        new = (str(label), [int(np.floor(np.float64(x) * scale)) for x in v])
        if i not in held or new < held[i]:
            held[i] = new

    def score(a, b):
        return sum(x * y for x, y in zip(held[a][1], held[b][1], strict=False))

    out = set()
    for a in held:
        if a % every:
            continue
        ranked = sorted((-score(a, b), b) for b in held if b != a)
        same = [(b, -s) for s, b in ranked if held[b][0] == held[a][0]][:positives]
        for p, reached in same:
            fit = [(b, -s) for s, b in ranked if held[b][0] != held[a][0] and 80 * reached <= 100 * -s <= 100 * reached]
            out |= {(a, p, n + 1, b, reached, s) for n, (b, s) in enumerate(fit[:negatives])}
    return out


def run(spark, rows, every=10, schema="id long, label int, v array<float>, score string, block int, shard int"):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], schema)
    found = mine(df, F.expr(f"id % {every} = 0")).collect()
    assert len(found) == len(set(found))
    return {tuple(r) for r in found}


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(hard_negatives, "SHARD_ROWS", 70)
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 7)


def test_against_brute_force(spark, small):
    """A label with a third of all rows, ties, copies, repeated ids, odd values and widths."""
    draw = random.Random(4)
    rows = []
    for i in range(300):
        label = 0 if i % 3 == 0 else i % 6
        rows.append((i, label, [round(draw.gauss(0.3, 0.3) + 0.2 * (label == d), 2) for d in range(13)]))
    rows += [(400 + i, 1 + i % 2, rows[30][2]) for i in range(25)]
    rows += [(500, 9, rows[1][2]), (510, 0, [-5.0] * 13), (520, 1, [0.0] * 13), (530, 1, []), (540, 2, [1.5, -0.25])]
    rows += [(550, None, rows[0][2]), (560, 1, None), (None, 1, rows[0][2]), (570, 1, [float("nan")] * 13)]
    rows += [(580, 1, [float("inf")] * 13), (590, 1, [None] * 13), (10, 5, rows[10][2]), (20, rows[20][1], rows[20][2])]
    found = run(spark, rows)
    assert found == brute(rows) and len(found) > 100


def test_large_values_are_exact(spark, small):
    """Integers that fill the 64 bits of a score, and others far beyond that only lose."""
    rows = [(0, 1, [2.0**21, -3.0]), (1, 1, [2.0**21 + 0.5, 7.0]), (2, 2, [2.0**21, 9.0]), (3, 2, [2.0**21 - 0.25, 1.0]), (4, 3, [-3e38, 3e38])]
    got = run(spark, rows, schema="id long, label int, v array<double>, score string, block int, shard int")
    assert got == brute(rows) and got


def test_empty_and_lonely(spark):
    assert run(spark, []) == set()
    assert run(spark, [(10, 1, [1.0])]) == set()
    assert run(spark, [(10, 1, [1.0]), (11, 2, [1.0])]) == set()
    assert run(spark, [(11, 1, [1.0]), (12, 2, [1.0])]) == set()


def test_lookups_equal_products():
    draw = np.random.default_rng(3)
    for width, largest in ((1, 1), (8, 3), (20, 1000), (64, 1 << 20)):
        values = draw.integers(-largest, largest + 1, (50, width))
        anchor = draw.integers(-largest, largest + 1, width)
        planes = bit_planes(values)
        assert scores(subset_sums(anchor, planes.shape[1]), lookup_index(planes)).tolist() == (values @ anchor).tolist()

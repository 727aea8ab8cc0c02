import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlake.llm import queries
from postlake.llm.vector_codes import encode, exact_products, learn, limbs, nearest, with_group_sum

SCHEMA = "vec_id long, embedding array<double>, label int, row string, code string, _sum int"


def brute(rows, parts=4, size=256, rounds=4, scale=1024):
    """{place in rows: (code, error)} and the digest, with Python's integers alone."""
    kept = [(i, v, at) for at, (i, v, _) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return {}, None
    step = -(-max(len(v) for _, v, _ in kept) // parts)
    whole = {at: [math.floor(x * scale) for x in v] + [0] * (step * parts - len(v)) for _, v, at in kept}
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:size]
    books = [[whole[at][p * step : (p + 1) * step] for _, _, at in first] for p in range(parts)]

    def assign(x, p):
        part = x[p * step : (p + 1) * step]
        return min((sum((a - b) ** 2 for a, b in zip(part, c, strict=True)), k) for k, c in enumerate(books[p]))

    for _ in range(rounds):
        new = [[list(c) for c in b] for b in books]
        for p in range(parts):
            held = {}
            for x in whole.values():
                held.setdefault(assign(x, p)[1], []).append(x[p * step : (p + 1) * step])
            for k, some in held.items():
                new[p][k] = [sum(c) // len(some) for c in zip(*some, strict=True)]
        books = new
    out = {}
    for at, x in whole.items():
        found = [assign(x, p) for p in range(parts)]
        out[at] = ("".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found))
    return out, hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, label, str(at), "old", 1) for at, (i, v, label) in enumerate(rows)], SCHEMA)
    books = learn(df, id_col="vec_id", vector_col="embedding", **kw)
    coded = encode(df, books, "embedding")
    assert coded.columns == [*df.columns, "error"]
    summed = with_group_sum(coded, "label", "error", "label_error", F.col("row")).collect()
    assert len(summed) == coded.count()
    return {int(r.row): (r.code, r.error) for r in summed}, books and books.digest(), {int(r.row): r.label_error for r in summed}


def some_rows(n, width, seed=2):
    draw = random.Random(seed)
    rows = [(i, [draw.gauss(0.5 * (i % 7 == d % 7), 0.2) for d in range(width)], None if i % 5 == 0 else i % 3) for i in range(n)]
    rows += [(n + 1, rows[3][1], 1), (n + 2, rows[3][1], 1), (3, rows[3][1], 1), (4, rows[5][1], 2), (None, rows[6][1], 2)]
    rows += [(900, None, 1), (901, [None] * width, 1), (902, [math.nan] * width, 1), (903, [math.inf] * width, None)]
    return rows


def check(spark, rows, **kw):
    found, digest, sums = run(spark, rows, **kw)
    names = {"entries": "size"}
    want, want_digest = brute(rows, **{names.get(k, k): v for k, v in kw.items()})
    assert found == want and digest == want_digest
    by_label = {}
    for at, (_, error) in want.items():
        by_label[rows[at][2]] = by_label.get(rows[at][2], 0) + error
    assert sums == {at: by_label[rows[at][2]] for at in want}


def test_against_brute_force(spark):
    check(spark, some_rows(90, 8), entries=16, rounds=3)


def test_fewer_rows_than_entries_and_odd_widths(spark):
    rows = some_rows(30, 10)
    check(spark, [*rows, (800, [], 1), (801, [0.25], 2)])


def test_values_beyond_a_limb(spark):
    """Limbs of both sides, and sums of distances near the end of 64 bits."""
    draw = random.Random(8)
    check(spark, [(i, [draw.uniform(-1, 1) * 2.0**18 for _ in range(4)], i % 2) for i in range(40)], entries=5, rounds=2)


def test_values_beyond_64_bits(spark):
    """Codes stay exact; a distance that no long holds is null."""
    rows = [(i, [(-1) ** i * 3e38 * (i % 5 + 1), float(i % 4)], 0) for i in range(20)]
    found, digest, _ = run(spark, rows, parts=2, entries=4, rounds=2)
    want, want_digest = brute(rows, parts=2, size=4, rounds=2)
    assert digest == want_digest
    assert found == {at: (code, error if error < 1 << 63 else None) for at, (code, error) in want.items()}


def test_empty(spark):
    assert run(spark, []) == ({}, None, {})
    assert run(spark, [(1, None, 1), (2, [math.nan], 2)]) == ({}, None, {})


def test_products_are_exact():
    draw = np.random.default_rng(1)
    for width, a, b in ((1, 1, 1), (16, 700, 700), (16, 1 << 26, 1 << 30), (64, 1 << 40, 1 << 55)):
        x = draw.integers(-a, a + 1, (20, width))
        y = draw.integers(-b, b + 1, (9, width))
        want = x.astype(object) @ y.astype(object).T
        assert (exact_products(x, y) == want).all()
        index, far = nearest(x, y)
        full = ((x.astype(object)[:, None] - y.astype(object)[None]) ** 2).sum(axis=2)
        assert [int(f) for f in far] == [int(r.min()) for r in full] and index.tolist() == [int(np.argmin(r)) for r in full]
    assert sum(int(v[0]) << 24 * i for i, v in enumerate(limbs(np.array([-(1 << 50) - 3]), 24))) == -(1 << 50) - 3


def test_first_of_equal_entries():
    x = np.array([[1, 1], [5, 5]])
    assert nearest(x, np.array([[0, 1], [1, 0], [5, 5], [5, 5]]))[0].tolist() == [0, 2]


@pytest.mark.parametrize("rounds", [4])
def test_query_sql_has_all_rounds(rounds):
    assert f"a{rounds} AS" in queries.ORACLES["op13_vector_codes"] and f"k{rounds + 1} AS" not in queries.ORACLES["op13_vector_codes"]

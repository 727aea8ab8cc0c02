"""Shared input: odd rows, and columns whose names clash with the operators' own."""

import random

import pytest

CLASH = "doc_id long, text string, lang string, source string, n_chars long, id long, row string, body string, mark string, n_lines string, score string"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None, 7, "r", "b", "m", "n", "s") for i, t in rows], CLASH)


@pytest.fixture
def make_docs(spark):
    return lambda rows: _docs(spark, rows)


@pytest.fixture(scope="session")
def vocabulary():
    draw = random.Random(11)
    return ["".join(draw.choice("abcdefghijklmnoprstuvwxyzéñß") for _ in range(draw.randrange(2, 8))) for _ in range(600)]


@pytest.fixture
def odd_rows(vocabulary):
    """Null and empty texts, blanks alone, a long text, ties, repeated rows, and a row without an id."""
    draw = random.Random(5)
    text = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    shared = text(45)
    rows = [(i, f"{text(30)} {shared} {text(25)}\n{shared}\nA line that many documents hold.\n") for i in range(12)]
    rows += [(20, None), (21, ""), (22, " \n\t\n"), (23, text(20000)), (24, "word " * 3000), (25, "word"), (26, "Two words")]
    rows += [(30, rows[0][1]), (31, rows[0][1]), (32, rows[0][1].upper()), (3, rows[3][1]), (3, rows[3][1])]
    rows += [(None, shared), (None, None), (40, "İ ǅ \x1c ß"), (41, "A LINE that many documents hold. \x0b")]
    return rows

"""Every catalogue query against its SQL on the smallest tables."""

import os
import re

import pytest

DATA = "/root/testdata/sf0.001"

if not os.path.isdir(DATA):
    pytest.skip("no test tables", allow_module_level=True)

import __spark_entry__ as entry  # noqa: E402

# The pipeline, and numbered operators without SQL, have tests of their own.
NAMES = sorted(n for n in entry.queries() if not re.match(r"op\d+_|pipeline$", n) or n in entry.oracle_sql())


@pytest.fixture(scope="module")
def con():
    import compare

    return compare.duck(DATA)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    import compare

    ok, text = compare.compare(spark, con, DATA, name)
    assert ok, text


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    without = {n for n in set(entry.queries()) - entry.oracle_sql().keys() if not re.match(r"op\d+_|pipeline$", n)}
    assert without == set()

"""Compute an expensive column once.

The optimizer copies a column's expression into every filter placed above it.
For a cheap column that is what lets filters reach the scan; for a long chain of
projections the copies multiply. The output of ``explode`` is not copied, and
over a one-element array it yields exactly one row per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settle(df: DataFrame, name: str, value: Column) -> DataFrame:
    others = [F.col(c) for c in df.columns if c != name]
    return df.select(*others, F.explode(F.array(value)).alias(name))


"""Which reference came first, and which were seen before.

``seq`` is the arrival number and unique per row. A single id may hold a third
of all rows, so no step gathers the rows of an id: the earliest ``seq`` of each
id is a hash aggregate with partial minima, and the join that brings the answer
back runs on ``(external_id, seq)``, which no two rows share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.functions.scalars import non_empty


def first_arrivals(refs: DataFrame) -> DataFrame:
    """``(external_id, seq)`` of the first row of every non-empty id."""
    return (
        refs.where(non_empty("external_id"))
        .groupBy("external_id")
        .agg(F.min("seq").alias("seq"))
    )


def label_first(refs: DataFrame) -> DataFrame:
    """Adds ``is_duplicate``; later rows of an id are kept, and labelled.

    Rows with an empty id are never duplicates.
    """
    first = first_arrivals(refs).withColumn("is_first", F.lit(True))
    joined = refs.join(first, ["external_id", "seq"], "left")
    flag = non_empty("external_id") & F.col("is_first").isNull()
    return joined.select(*[joined[c] for c in refs.columns], flag.alias("is_duplicate"))


def drop_processed(refs: DataFrame, processed: DataFrame) -> DataFrame:
    """References whose id is not in ``processed``; empty ids always pass."""
    seen = processed.where(non_empty("external_id")).select("external_id").distinct()
    return refs.join(seen, "external_id", "left_anti").select(*refs.columns)


def only_processed(refs: DataFrame, processed: DataFrame) -> DataFrame:
    seen = processed.where(non_empty("external_id")).select("external_id").distinct()
    return refs.join(seen, "external_id", "left_semi").select(*refs.columns)


def label_against(refs: DataFrame, processed: DataFrame) -> DataFrame:
    """``is_duplicate`` against earlier rows here and against ``processed``.

    Only the first row of each id can be new, so the lookup in ``processed``
    runs on the distinct ids and never on the repeated rows.
    """
    fresh = drop_processed(first_arrivals(refs), processed).withColumn("is_first", F.lit(True))
    joined = refs.join(fresh, ["external_id", "seq"], "left")
    flag = non_empty("external_id") & F.col("is_first").isNull()
    return joined.select(*[joined[c] for c in refs.columns], flag.alias("is_duplicate"))

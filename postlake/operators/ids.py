"""Dense surrogate ids without a global sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlake.session import cut_lineage


def assign_ids(
    rows: DataFrame, key: str = "external_id", start: int = 1, parts: int | None = None, name: str = "id"
) -> DataFrame:
    """Number rows ``start, start + 1, ...`` with no gap.

    ``key`` is unique. Rows are cut into ``parts`` by a hash of the key; a part
    gets its offset from the counts before it, and a row its rank within the
    part. Both depend on the data alone, so a re-run task hands out the same
    numbers. The driver sees ``parts`` counts and nothing else.
    """
    if parts is None:
        parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.pmod(F.xxhash64(F.col(key)), F.lit(parts)).cast("int")
    counts = dict(rows.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, total = [], start
    for p in range(parts):
        offsets.append(total)
        total += counts.get(p, 0)
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(key))
    table = F.array(*[F.lit(o).cast("bigint") for o in offsets])
    numbered = rows.withColumn("_part", part).withColumn("_rank", rank)
    value = F.get(table, F.col("_part")) + F.col("_rank") - 1
    keep = [c for c in rows.columns if c != name]
    return numbered.select(value.alias(name), *keep)


def number_in_order(rows: DataFrame, *order: str | Column, start: int = 1, name: str = "id") -> tuple[DataFrame, int]:
    """Number rows ``start, start + 1, ...`` in ``order``, and the greatest number given (``start - 1`` if none).

    Ranges of the order are sorted apart and written; the driver gets the size of each range, and a row its place behind
    the ranges before it. Rows that tie are numbered in any order.
    """
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    written = cut_lineage(sorted_rows, "numbered")
    part, inside = F.shiftright("_at", 33).cast("int"), F.col("_at").bitwiseAND((1 << 33) - 1)
    counts = {r.p: r.n for r in written.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets, total = [], start
    for p in range(max(counts, default=0) + 1):
        offsets.append(total)
        total += counts.get(p, 0)
    table = F.array(*[F.lit(o).cast("bigint") for o in offsets])
    value = F.get(table, part) + inside
    keep = [c for c in rows.columns if c != name]
    return written.select(value.alias(name), *keep), total - 1

"""Lines that repeat across documents are dropped.

Lines are exploded with their position, hashed by their normalised key (128 bits), counted by distinct document,
and joined back; each document is put together again from the positions that stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.llm.common import BLANKS, ascii_lower, unfold, whole_row
from postlake.session import cut_lineage


def drop_repeated_lines(
    docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with ``text`` rewritten, and ``n_lines`` and ``n_dropped``; input columns of those names are replaced.

    A line whose key (stripped of blanks, A-Z lower-cased) has ``min_chars`` code points or more and occurs in
    ``min_docs`` documents or more stays only in the document of the largest id that holds it.

    * Null or empty text is one empty line. Lines end at ``\\n`` alone.
    * Rows of one id count as one document; each row is rewritten by itself.
    * Rows without an id come back whole (with text ``""`` for null) and are not counted.
    * Repeats inside one document stay or go together.
    """
    frame = docs.select(
        whole_row(docs).alias("row"),
        F.col(f"`{id_col}`").alias("id"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("body"),
    ).withColumn("mark", F.xxhash64("body"))
    key = ascii_lower(F.btrim(F.col("line"), F.lit(BLANKS)))
    lines = (
        frame.where("id is not null")
        .select("id", "mark", F.posexplode(F.split("body", "\n", -1)).alias("at", "line"))
        .where(F.char_length("line") >= min_chars)
        .select("id", "mark", "at", key.alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select("id", "mark", "at", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))
    )
    common = (
        lines.select("h1", "h2", "id")
        .distinct()
        .groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keeper"))
        .where(F.col("n") >= min_docs)
        .select("h1", "h2", "keeper")
    )
    # A written table: the join then has a plain exchange on both sides, which the engine can split where a line is hot.
    common = cut_lineage(common, "common-lines")
    dropped = (
        lines.join(common, ["h1", "h2"])
        .where(F.col("id") != F.col("keeper"))
        .groupBy("id", "mark")
        .agg(F.collect_set("at").alias("gone"))
    )
    dropped = cut_lineage(dropped, "dropped-lines").select(F.col("id").alias("id2"), F.col("mark").alias("mark2"), "gone")
    both = frame.join(dropped, (F.col("id") == F.col("id2")) & (F.col("mark") == F.col("mark2")), "left")
    lines_of = F.split("body", "\n", -1)
    stay = F.expr("transform(array_except(sequence(0, size(lines) - 1), gone), i -> element_at(lines, i + 1))")
    both = both.select("row", "body", "gone", lines_of.alias("lines"))
    return unfold(
        both,
        "row",
        docs.columns,
        **{
            text_col: F.when(F.col("gone").isNull(), F.col("body")).otherwise(F.array_join(stay, "\n")),
            "n_lines": F.size("lines").cast("long"),
            "n_dropped": F.coalesce(F.size("gone"), F.lit(0)).cast("long"),
        },
    )

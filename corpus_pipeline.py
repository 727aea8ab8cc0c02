"""From raw documents to packed sequences, in five stages.

Each stage gets what the one before kept, as a table in the shared folder, and returns the rows it keeps with the
columns of ``documents``; line dedup also rewrites the text. The last stage returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.llm import language_id
from postlake.llm.common import read
from postlake.llm.decontaminate import drop_contaminated
from postlake.llm.line_dedup import drop_repeated_lines
from postlake.llm.minhash import drop_near_duplicates
from postlake.llm.packing import pack_documents
from postlake.llm.queries import tokenizer_path
from postlake.session import cut_lineage

#: No SQL: language identification is a trained model and packing a heuristic over a tokenizer's ids.
ORACLE_SQL = None


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go: null text, no letter, or a score below the calibrated threshold."""
    model = language_id.train(docs)
    return language_id.identify(docs, model).where("accepted").select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of three documents or more stay in the one of the largest id; ``n_chars`` follows the text.

    A document that is left without a word goes: all that it held is elsewhere. No other does.
    """
    out = drop_repeated_lines(docs).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.char_length("text").cast(kind))
    return out.select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at 0.8 or more, the one of the largest id stays.

    So does a repeated line in the stage before: a document that holds the last copy of a line is not dropped for an
    older one.
    """
    return drop_near_duplicates(docs, keep="largest")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of ten words of a benchmark item go."""
    return drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, tokenizer_path())


STAGES = [
    ("language ID", keep_known_languages),
    ("line dedup", drop_lines),
    ("near-duplicates", drop_copies),
    ("decontamination", drop_leaks),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

"""The stored search index: immutable segments of postings, kept up with every write.

A write adds one segment with the postings of its batch, and the ids whose older postings no longer count. Nothing that
is there is changed, so the bytes written follow the batch. A read takes the segments' buckets of the query's lexemes and
leaves out what later writes have replaced. ``compact`` merges the segments into one.

Only active postings are indexed: one that comes in expired is taken out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.functions.analyze import check_analyzer
from postlake.functions.stem import with_stem
from postlake.operators.filters import active
from postlake.operators.postings import (
    BUCKETS,
    IndexMismatch,
    as_postings,
    lexeme_bucket,
    unpacked,
    word_positions,
    write_merged,
    write_postings,
    write_stemmed,
)
from postlake.operators.versions import Versions
from postlake.session import cut_lineage, frees_shuffles

# Places stay packed in the files, so that a merge moves ints, and a read unpacks what it found.
_POSTINGS = "lexeme string, id bigint, places array<int>, seg bigint, bucket int"

ADD_PASSES = 4  # at most
ADDED_AT_ONCE = 10_000  # documents at least, to each core


class SearchIndex:
    """An index below ``root``. Its analyzer, buckets and limits are set once, and kept with it."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.versions = spark, root.rstrip("/"), Versions(spark, root)
        if self.versions.newest() < 0:
            raise IndexMismatch(f"there is no index at {root}")
        self.state = self.versions.read()
        if self.state.get("stored") != "places":
            raise IndexMismatch(f"the index at {root} was written by an earlier version")

    @classmethod
    def create(cls, spark: SparkSession, root: str, analyzer: str = "english", buckets: int = BUCKETS, limits: bool = False) -> SearchIndex:
        """An empty index. ``limits``: with the limits on positions of :func:`postlake.operators.postings.capped`."""
        settings = {"analyzer": check_analyzer(analyzer), "buckets": int(buckets), "limits": bool(limits), "stored": "places"}
        Versions(spark, root).commit(0, settings | {"segments": [], "gone": [], "words": []})
        return cls(spark, root)

    @property
    def analyzer(self) -> str:
        return self.state["analyzer"]

    def _commit(self, number: int, **changed) -> None:
        state = self.state | changed
        self.versions.commit(number, state)
        self.state = state

    @frees_shuffles
    def add(self, jobs: DataFrame) -> None:
        """Index a batch of postings (ids unique); those of ids that are indexed already replace them."""
        number = self.versions.newest() + 1
        words, path = self.state["words"], self._segment(number)
        if self.analyzer == "english":
            found = cut_lineage(word_positions(jobs.where(active()), self.analyzer), "index-words")
            counts = cut_lineage(found.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "index-counts")
            if self._learn(counts, number):
                words = [*words, number]
            write_stemmed(found, self._words(words), counts, path, self.state["buckets"], self.state["limits"])
        else:
            for n, part in enumerate(_parts(jobs.where(active()))):
                found = word_positions(part, self.analyzer).withColumnRenamed("word", "lexeme")
                found = as_postings(found, self.state["limits"], packed=True)
                write_postings(found, path, self.state["buckets"], "append" if n else "overwrite", stored="places")
        self._write_terms(number)
        gone = self.state["gone"]
        if self.state["segments"]:
            jobs.select("id").write.mode("overwrite").parquet(f"{self.root}/gone/v={number}")
            gone = [*gone, number]
        self._commit(number, segments=[*self.state["segments"], number], gone=gone, words=words)

    @frees_shuffles
    def delete(self, ids: DataFrame) -> None:
        """Take the postings of ``ids`` (column id) out."""
        number = self.versions.newest() + 1
        ids.select("id").write.mode("overwrite").parquet(f"{self.root}/gone/v={number}")
        self._commit(number, gone=[*self.state["gone"], number])

    def _words(self, numbers: list[int]) -> DataFrame:
        paths = [f"{self.root}/words/v={n}" for n in numbers]
        return self.spark.read.schema("word string, lexeme string").parquet(*paths)

    def _learn(self, counts: DataFrame, number: int) -> bool:
        """Stem the words that no earlier batch had, each once."""
        new = counts.select("word")
        if self.state["words"]:
            new = new.join(self._words(self.state["words"]).select("word"), "word", "left_anti")
        with_stem(new, "word", "lexeme").write.mode("overwrite").parquet(f"{self.root}/words/v={number}")
        return not self._words([number]).isEmpty()

    def _segment(self, number: int) -> str:
        return f"{self.root}/postings/seg={number}"

    def _write_terms(self, number: int) -> None:
        written = self.spark.read.schema("lexeme string, id bigint").parquet(self._segment(number))
        counts = written.groupBy("lexeme").agg(F.count(F.lit(1)).alias("n"))
        # In order of the term, so that a prefix is a range of few files and row groups.
        counts.repartitionByRange("lexeme").sortWithinPartitions("lexeme").write.mode("overwrite").parquet(f"{self.root}/terms/seg={number}")

    def _gone(self) -> DataFrame:
        """The last write that took each id out of the segments before it."""
        paths = [f"{self.root}/gone/v={n}" for n in self.state["gone"]]
        rows = self.spark.read.schema("id bigint, v bigint").option("basePath", f"{self.root}/gone").parquet(*paths)
        return rows.groupBy(F.col("id").alias("gone_id")).agg(F.max("v").alias("v"))

    def _segments(self, *numbers: int) -> DataFrame:
        paths = [self._segment(n) for n in numbers]
        return self.spark.read.schema(_POSTINGS).option("basePath", f"{self.root}/postings").parquet(*paths)

    def postings(self, lexemes: list[str] | None = None, packed: bool = False) -> DataFrame:
        """(lexeme, id, positions), or packed (lexeme, id, places), that count now: all, or those of some lexemes, from their buckets alone."""
        schema = "lexeme string, id bigint, " + ("places array<int>" if packed else "positions array<struct<p:int,w:double>>")
        if not self.state["segments"] or lexemes == []:
            return self.spark.createDataFrame([], schema)
        rows = self._segments(*self.state["segments"])
        if lexemes is not None:
            buckets = [lexeme_bucket(F.lit(x), self.state["buckets"]) for x in lexemes]
            rows = rows.where(F.col("bucket").isin(*buckets) & F.col("lexeme").isin(*lexemes))
        if self.state["gone"]:
            gone = self._gone()
            rows = rows.join(gone, (rows["id"] == gone["gone_id"]) & (rows["seg"] < gone["v"]), "left_anti")
        return rows.selectExpr("lexeme", "id", "places" if packed else f"{unpacked('places')} AS positions")

    @frees_shuffles
    def compact(self, keep: int = 1) -> None:
        """Merge all segments into one. States but the last ``keep`` go, and their files."""
        number = self.versions.newest() + 1
        if self.state["segments"]:
            gone = self._gone() if self.state["gone"] else None
            write_merged(self._segments(*self.state["segments"]), gone, self._segment(number), self.state["buckets"])
        else:
            write_postings(self.postings(packed=True), self._segment(number), self.state["buckets"], "overwrite", stored="places")
        self._write_terms(number)
        words = self.state["words"]
        if len(words) > 1:
            self._words(words).write.mode("overwrite").parquet(f"{self.root}/words/v={number}")
            words = [number]
        self._commit(number, segments=[number], gone=[], words=words)
        self.versions.forget(keep, _folders)

    def completions(self, prefix: str, k: int = 5) -> DataFrame:
        """(lexeme, documents): the ``k`` terms of most documents that begin with ``prefix``, ties by term.

        Reads the prefix' range of the term dictionaries, and no postings. Documents replaced since the last
        ``compact`` still count.
        """
        paths = [f"{self.root}/terms/seg={n}" for n in self.state["segments"]]
        if not paths:
            return self.spark.createDataFrame([], "lexeme string, documents bigint")
        rows = self.spark.read.schema("lexeme string, n bigint").parquet(*paths).where(F.col("lexeme").startswith(prefix))
        counts = rows.groupBy("lexeme").agg(F.sum("n").alias("documents"))
        return counts.orderBy(F.desc("documents"), "lexeme").limit(k)


def _parts(jobs: DataFrame) -> list[DataFrame]:
    """``jobs`` in a few parts by id, if there are many: what is shuffled at a time is then a part of the batch."""
    at_once = ADDED_AT_ONCE * jobs.sparkSession.sparkContext.defaultParallelism
    wanted = min(ADD_PASSES, -(-jobs.count() // at_once))
    if wanted < 2:
        return [jobs]
    return [jobs.where(F.pmod(F.xxhash64("id"), F.lit(wanted)) == n) for n in range(wanted)]


def _folders(state: dict) -> list[str]:
    named = [f"{kind}/seg={n}" for n in state["segments"] for kind in ("postings", "terms")]
    return named + [f"gone/v={n}" for n in state["gone"]] + [f"words/v={n}" for n in state["words"]]

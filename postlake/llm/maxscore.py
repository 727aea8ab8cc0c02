"""Exact top-k inner product search over sparse integer vectors by MaxScore.

The rows are dealt into shards of bounded size, the queries into blocks; each shard meets each block once. A shard is
an inverted index whose terms are a component and its sign, so that every impact is positive and has a maximum. For a
query, the terms of its own sign can raise a score and have a bound; those of the other sign only lower it. Terms are
split by bound: rows that are in no essential posting can't reach the k-th score. The essential postings are walked,
the other components probed for the rows that can still compete, and the shards' lists merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlake.session import cut_lineage

SHARD_ROWS = 8192
BLOCK_ROWS = 1024
#: Sums of products below this are left to 64-bit integers; Python's take over beyond.
SAFE = 1 << 62


def quantized(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component, as a whole double; null if the vector, or a component, is null or not finite."""

    def whole(x: Column) -> Column:
        value = x.cast("double") * scale
        # From 2 ** 52 on a double is whole, and beyond 2 ** 63 it would not fit an integer.
        return F.when(F.abs(value) < float(1 << 52), F.floor(value).cast("double")).otherwise(value)

    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(vector.isNotNull() & fine, F.transform(vector, whole))


def _integers(*matrices: np.ndarray) -> list[np.ndarray]:
    """Whole doubles as integers of one kind, wide enough for every product of a row of one with a row of another."""
    largest = [float(np.abs(m).max(initial=1)) for m in matrices]
    if max(largest) ** 2 * max(1, *[m.shape[1] for m in matrices]) < SAFE:
        return [m.astype(np.int64) for m in matrices]
    out = []
    for m in matrices:
        flat = np.empty(m.size, object)
        flat[:] = [int(v) for v in m.ravel()]
        out.append(flat.reshape(m.shape))
    return out


class Shard:
    """Inverted index of a bounded number of vectors."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray):
        # By id, so that of equal scores the first is the smallest.
        order = np.argsort(ids, kind="stable")
        self.ids, self.matrix = ids[order], matrix[order]
        self.postings = {}
        for d in range(matrix.shape[1]):
            column = self.matrix[:, d]
            for sign in (1, -1):
                rows = np.flatnonzero(column * sign > 0)
                impact = np.abs(column[rows])
                self.postings[d, sign] = (rows, impact, int(impact.max(initial=0)))

    def search(self, query_id, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the best ``k`` rows of other ids, best first."""
        terms = [d for d in np.flatnonzero(query) if d < self.matrix.shape[1]]
        bound = {d: abs(int(query[d])) * self.postings[d, 1 if query[d] > 0 else -1][2] for d in terms}
        terms.sort(key=lambda d: bound[d])
        other = self.ids != query_id
        least = self._seed(query, terms, other, k)
        summed = np.cumsum([bound[d] for d in terms]) if terms else np.zeros(0)
        weak = int(np.searchsorted(summed, least, side="left")) if least > 0 else 0
        essential, rest = terms[weak:], terms[:weak][::-1]
        score, seen = np.zeros(len(self.ids), self.matrix.dtype), np.zeros(len(self.ids), bool)
        for d in essential:
            sign, weight = (1 if query[d] > 0 else -1), abs(int(query[d]))
            rows, impact, _ = self.postings[d, sign]
            score[rows] += weight * impact
            seen[rows] = True
            rows, impact, _ = self.postings[d, -sign]
            score[rows] -= weight * impact
        # Where the bound of the weak terms says nothing (k-th score at or below zero), every row competes.
        rows = np.flatnonzero((seen | (least <= 0)) & other)
        got, ahead = score[rows], sum(bound[d] for d in rest)
        for d in rest:
            near = got + ahead >= least
            if not near.all():
                rows, got = rows[near], got[near]
            got = got + int(query[d]) * self.matrix[rows, d]
            ahead -= bound[d]
        best = np.argsort(-got, kind="stable")[:k]
        return self.ids[rows[best]], got[best]

    def _seed(self, query: np.ndarray, terms: list, other: np.ndarray, k: int) -> int:
        """A score that k rows reach: the k-th of those with the greatest impacts in the strongest term."""
        if not terms:
            return 0
        rows, impact, _ = self.postings[terms[-1], 1 if query[terms[-1]] > 0 else -1]
        keep = other[rows]
        rows, impact = rows[keep], impact[keep]
        if len(rows) < k:
            return -1
        some = rows[np.argpartition(-impact, min(8 * k, len(rows)) - 1)[: 8 * k]]
        width = min(len(query), self.matrix.shape[1])
        exact = np.sort(self.matrix[some][:, :width] @ query[:width])
        return int(exact[-k])


def _matrix(column: pa.ChunkedArray, width: int | None = None) -> np.ndarray:
    lists = column.combine_chunks()
    lengths = np.diff(np.frombuffer(lists.offsets.buffers()[1], np.int32)[lists.offsets.offset :][: len(lists) + 1])
    width = int(lengths.max(initial=0)) if width is None else width
    out = np.zeros((len(lists), width))
    rows = np.repeat(np.arange(len(lists)), lengths)
    at = np.arange(len(rows)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[rows, at] = lists.flatten().to_numpy()
    return out


def _searcher(k: int):
    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        queries, found, scores = [], [], []
        if left.num_rows and right.num_rows:
            rows, wanted = _integers(_matrix(left.column("v")), _matrix(right.column("w")))
            shard = Shard(left.column("id").to_numpy(), rows)
            for query_id, vector in zip(right.column("q").to_numpy(), wanted, strict=True):
                ids, score = shard.search(query_id, vector, k)
                queries.append(np.full(len(ids), query_id))
                found.append(ids)
                scores.append(score.astype(np.int64))
        empty = [np.zeros(0, np.int64)]
        return pa.table(
            {"query_id": np.concatenate(queries or empty), "vec_id": np.concatenate(found or empty), "score": np.concatenate(scores or empty)}
        )

    return search


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best rows of ``vectors`` (id, v) for each of ``queries`` (id, v).

    ``v`` is an array of whole numbers (``quantized``) of any size; shorter ones are filled up with zeros. A score of the
    result that no 64-bit integer holds is an error. A query's own id is no
    candidate; ties go to the smaller id; with fewer candidates than ``k`` all are returned, also those below zero.

    * Rows whose id or vector is null take no part.
    * Of rows that repeat an id, the smallest vector is taken.
    * Other columns are not read. Empty tables give no rows.
    """

    def clean(df: DataFrame) -> DataFrame:
        return df.where("id IS NOT NULL AND v IS NOT NULL").groupBy(F.col("id").cast("long").alias("id")).agg(F.min("v").alias("v"))

    vectors, queries = cut_lineage(clean(vectors), "vectors"), cut_lineage(clean(queries), "queries")
    shards = max(1, -(-vectors.count() // SHARD_ROWS))
    blocks = max(1, -(-queries.count() // BLOCK_ROWS))

    def cell(shard: Column, block: Column) -> Column:
        return shard.cast("long") * blocks + block

    own = F.pmod(F.xxhash64("id"), F.lit(shards))
    left = vectors.select("id", "v", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    left = left.select(cell(own, F.col("block")).alias("cell"), "id", "v")
    own = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks))
    right = queries.select("id", "v", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    right = right.select(cell(F.col("shard"), own).alias("cell2"), F.col("id").alias("q"), F.col("v").alias("w"))
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("query_id", "vec_id", "score")])
    found = left.groupBy("cell").cogroup(right.groupBy("cell2")).applyInArrow(_searcher(k), schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

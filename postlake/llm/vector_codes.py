"""Vector codes: each part of a vector becomes the number of its nearest codebook entry, all in whole numbers.

Inner products of parts and entries are matrix products of doubles that are exact: integers are split into limbs so short
that no sum of products reaches 2 ** 53. The limbs' products are shifted and added as 64-bit integers (as Python's where
those are too short), and the first of the least distances is taken. Codebooks are learned in rounds over all rows: a task
adds up its parts by entry, Spark adds up the tasks' sums, and the driver sees the sums of a codebook's entries.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlake.llm.common import unfold, whole_row
from postlake.llm.hard_negatives import finite

#: Rows whose distances to a codebook are worked out together.
TOGETHER = 4096
#: Magnitude below which 64-bit integers are used.
SAFE = 1 << 61
#: Bits of the pieces in which Spark adds up sums; 2 ** 31 tasks fit.
PIECE = 32
#: Parts into which a label's rows are dealt when its sum comes back to them.
SALTS = 32


def whole_numbers(vectors: pa.ListArray, width: int, scale: int) -> np.ndarray:
    """floor(scale * x) as (rows, width), filled up with zeros; Python's integers where 64 bits may be too short."""
    lengths = np.diff(vectors.offsets.to_numpy())
    real = np.zeros((len(vectors), width))
    rows = np.repeat(np.arange(len(vectors)), lengths)
    at = np.arange(len(rows)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    real[rows, at] = vectors.flatten().to_numpy()
    real = np.floor(real * scale)
    return real.astype(np.int64) if np.abs(real).max(initial=0) < SAFE else _unbounded(real)


def _unbounded(x: np.ndarray) -> np.ndarray:
    out = np.empty(x.size, object)
    out[:] = [int(v) for v in x.ravel()]
    return out.reshape(x.shape)


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """Doubles whose sum, each shifted by ``bits`` more than the one before, is ``x``; the last holds the sign."""
    most = int(np.abs(x).max(initial=0))
    out = []
    while most >> bits:
        out.append((x & ((1 << bits) - 1)).astype(float))
        x, most = x >> bits, (most >> bits) + 1
    return [*out, x.astype(float)]


def exact_products(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """``x @ entries.T`` without error, by products of doubles."""
    width = max(1, x.shape[1])
    bits = (52 - (width - 1).bit_length()) // 2
    most = width * int(np.abs(x).max(initial=0)) * int(np.abs(entries).max(initial=0))
    kind = np.int64 if most < SAFE else object
    total = np.zeros((len(x), len(entries)), kind)
    right = limbs(entries, bits)
    for i, a in enumerate(limbs(x, bits)):
        for j, b in enumerate(right):
            product = (a @ b.T).astype(np.int64)
            if i + j:
                product = product.astype(kind) * (1 << bits * (i + j))
            total = total + product
    return total


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of the nearest entries to each row, and the squared distance."""
    far = (int(np.abs(x).max(initial=0)) + int(np.abs(entries).max(initial=0))) ** 2 * max(1, x.shape[1])
    if far >= SAFE:
        x, entries = x.astype(object), entries.astype(object)
    # The square of the row itself is the same for all entries.
    ahead = (entries * entries).sum(axis=1)[None, :] - 2 * exact_products(x, entries)
    index = ahead.argmin(axis=1)
    return index, ahead[np.arange(len(x)), index] + (x * x).sum(axis=1)


@dataclass
class Codebooks:
    """By part: (entries, width of the part) integers."""

    books: list[np.ndarray]
    scale: int

    @property
    def width(self) -> int:
        return sum(b.shape[1] for b in self.books)

    def digest(self) -> str:
        """SHA-256 of all components by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(int(c)) for b in self.books for c in b.ravel()).encode()).hexdigest()

    def assign(self, vectors: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows x parts) numbers, distances summed over parts, and the integers themselves."""
        x = whole_numbers(vectors, self.width, self.scale)
        codes, error, at = np.zeros((len(x), len(self.books)), np.int64), 0, 0
        for p, book in enumerate(self.books):
            codes[:, p], far = nearest(x[:, at : at + book.shape[1]], book)
            error, at = error + far, at + book.shape[1]
        return codes, error, x


def _slices(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, TOGETHER):
            yield batch.slice(at, TOGETHER)


def _sums(books: Codebooks, pieces: int):
    """(part, entry, sums): how many parts chose an entry, then their components' sums in pieces, lowest first."""
    parts, size = len(books.books), len(books.books[0])

    def add_up(batches):
        step = books.books[0].shape[1]
        count = np.zeros((parts, size), np.int64)
        total = np.zeros((parts, size, step), object)
        for batch in _slices(batches):
            codes, _, x = books.assign(batch.column(0))
            for p in range(parts):
                order = np.argsort(codes[:, p], kind="stable")
                own = codes[order, p]
                starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                some = x[order, p * step : (p + 1) * step]
                total[p][own[starts]] += np.add.reduceat(some, starts, axis=0).astype(object)
                count[p] += np.bincount(own, minlength=size)
        rows = [(p, k) for p, k in np.argwhere(count)]
        sums = []
        for p, k in rows:
            flat = [int(count[p, k])]
            for value in total[p, k]:
                flat += [int(value >> PIECE * i & ((1 << PIECE) - 1)) for i in range(pieces - 1)] + [int(value >> PIECE * (pieces - 1))]
            sums.append(flat)
        yield pa.RecordBatch.from_arrays(
            [pa.array([int(p) for p, _ in rows], pa.int32()), pa.array([int(k) for _, k in rows], pa.int32()), pa.array(sums, pa.list_(pa.int64()))],
            ["part", "entry", "sums"],
        )

    return add_up


def learn(
    rows: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, id_col: str = "id", vector_col: str = "v"
) -> Codebooks | None:
    """Codebooks of all rows whose vector and components are there and finite; None if there is no such row.

    A component becomes floor(``scale`` * x). A vector is cut into ``parts`` equal consecutive parts; if the longest
    doesn't divide, and for shorter ones, zeros follow. A codebook starts as that part of the rows of the ``entries``
    smallest ids (ties by vector, null last), in order. Each of ``rounds`` takes every part to its nearest entry, ties to
    the first, and replaces an entry by the floor of the mean of its parts, componentwise; an unused entry stays.
    """
    kept = rows.where(finite(F.col(f"`{vector_col}`"))).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("v"))
    greatest = F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double")))))
    n, width, most = kept.agg(F.count(F.lit(1)), F.max(F.size("v")), greatest).first()
    if not n:
        return None
    step = -(-width // parts)
    first = kept.orderBy(F.asc_nulls_last("id"), "v").limit(entries).select("v").toArrow()["v"].combine_chunks()
    start = whole_numbers(first, step * parts, scale)
    books = Codebooks([start[:, p * step : (p + 1) * step] for p in range(parts)], scale)
    # A sum of n values of the greatest magnitude, and its sign.
    pieces = max(2, -(-((int(abs(most or 0) * scale) + 1) * n).bit_length() // PIECE) + 1)
    vectors = kept.select("v")
    for _ in range(rounds):
        sums = vectors.mapInArrow(_sums(books, pieces), "part int, entry int, sums array<long>")
        each = sums.select("part", "entry", F.posexplode("sums").alias("at", "s")).groupBy("part", "entry", "at").agg(F.sum("s").alias("s"))
        new = [b.astype(object) for b in books.books]
        found: dict[tuple, dict] = {}
        for part, entry, at, s in each.collect():  # bounded by the codebooks' size
            found.setdefault((part, entry), {})[at] = s
        for (part, entry), s in found.items():
            for j in range(step):
                value = sum(s[1 + j * pieces + i] << PIECE * i for i in range(pieces))
                new[part][entry, j] = value // s[0]
        books = Codebooks([_narrow(b) for b in new], scale)
    return books


def _narrow(book: np.ndarray) -> np.ndarray:
    return book.astype(np.int64) if all(abs(v) < SAFE for v in book.ravel()) else book


def encode(rows: DataFrame, books: Codebooks | None, vector_col: str = "v") -> DataFrame:
    """``rows`` with ``code`` and ``error``; input columns of these names are replaced.

    ``code`` has the entry numbers by part, in as many hex digits each as the largest needs; ``error`` is the sum of the
    squared distances. Rows whose vector is null, or holds a null or non-finite component, are left out. An error that no
    64-bit integer holds is null. Components beyond the codebooks' width are an error of the call.
    """
    kept = rows.where(finite(F.col(f"`{vector_col}`"))).select(whole_row(rows).alias("row"), F.col(f"`{vector_col}`").alias("v"))
    schema = T.StructType([kept.schema["row"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    if books is None:
        coded = kept.where(F.lit(False)).select("row", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    else:
        digits = max(2, len(f"{max(0, len(books.books[0]) - 1):x}"))
        names = pa.array([f"{k:0{digits}x}" for k in range(len(books.books[0]))])

        def code(batches):
            for batch in _slices(batches):
                codes, error, _ = books.assign(batch.column(1))
                text = pc.binary_join_element_wise(*[names.take(pa.array(codes[:, p])) for p in range(codes.shape[1])], "")
                held = pa.array([int(e) if e < 1 << 63 else None for e in error], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), text, held], ["row", "code", "error"])

        coded = kept.mapInArrow(code, schema)
    return unfold(coded, "row", rows.columns, code=F.col("code"), error=F.col("error"))


def with_group_sum(rows: DataFrame, group: str, value: str, name: str, spread: Column) -> DataFrame:
    """``rows`` with ``name``, the sum of ``value`` over rows of equal ``group``, nulls together.

    Sums are made before the shuffle, and come back to the rows dealt by ``spread`` as well, so a group that holds a third
    of all rows is met in many tasks.
    """
    salt = F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")
    dealt = rows.select(whole_row(rows).alias("row"), F.col(f"`{group}`").alias("mine"), salt.alias("salt"))
    sums = rows.groupBy(F.col(f"`{group}`").alias("theirs")).agg(F.sum(f"`{value}`").alias("total"))
    sums = sums.withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = dealt.join(sums, F.col("mine").eqNullSafe(F.col("theirs")) & (F.col("salt") == F.col("to")))
    return unfold(joined, "row", rows.columns, **{name: F.col("total")})

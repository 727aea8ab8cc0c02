"""What the operators share: column texts, batch hashing, and bounded groups."""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: \x20 and \x09 to \x0D.
BLANKS = " \t\n\x0b\x0c\r"

#: Bytes of text that one pass of array code takes at a time (a longer text alone).
CHUNK_BYTES = 1 << 20

U = np.uint64
_GOLD, _M1, _M2 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession, size: str = "4m") -> None:
    """Texts go to Python in batches bounded by bytes, unless the session was started with a bound of its own."""
    if spark.sparkContext.getConf().get(_BATCH) is None:
        spark.conf.set(_BATCH, size)


def slices(batches, rows: int = 256):
    """Batches cut further, so that only some rows at a time become Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def ascii_lower(text: Column) -> Column:
    """A-Z only; other letters keep their case. ``lower`` does that where all is ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def whole_row(df: DataFrame) -> Column:
    """All columns of the input as one struct, so that no name of theirs can clash."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def unfold(df: DataFrame, row: str, columns: list[str], **new: Column) -> DataFrame:
    """The input's columns back out of ``row``; a column of ``new`` replaces one of that name."""
    old = [F.col(row).getField(c).alias(c) if c not in new else new[c].alias(c) for c in columns]
    return df.select(*old, *[v.alias(k) for k, v in new.items() if k not in columns])


def hex_lines(parts: Column) -> Column:
    """SHA-256 of strings joined by commas."""
    return F.sha2(F.array_join(parts, ","), 256)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values; a bijection."""
    x = x + _GOLD
    x = (x ^ (x >> U(30))) * _M1
    x = (x ^ (x >> U(27))) * _M2
    return x ^ (x >> U(31))


_BYTE = np.concatenate([mix(np.arange(256, dtype=U))])
_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BYTE[_IS_BLANK] = 0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def text_chunks(texts: pa.Array, limit: int = CHUNK_BYTES):
    """(first row, number of rows, offsets, bytes) of runs of rows of about ``limit`` bytes; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), len(texts))
        yield first, last - first, offsets[first : last + 1] - offsets[first], raw[offsets[first] : offsets[last]]
        first = last


def split_words(offsets: np.ndarray, raw: np.ndarray, lower: bool):
    """Words of a chunk: 64-bit hash, row in the chunk, first byte and end."""
    if lower:
        raw = _LOWER[raw]
    word = ~_IS_BLANK[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(raw), bool)
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.zeros(len(raw), bool)
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    if not len(starts):
        return np.zeros(0, U), np.zeros(0, np.int64), starts, ends
    lengths = ends - starts
    at = np.arange(len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw)))) if starts[0] == 0 else None
    if at is None:
        at = np.zeros(len(raw), np.int64)
        at[starts[0] :] = np.arange(starts[0], len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw))))
    power = np.full(int(at.max()) + 1, U(0x9FB21C651E98DF25))
    power[0] = 1
    power = np.multiply.accumulate(power)
    hashes = np.add.reduceat(_BYTE[raw] * power[at], starts)
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return mix(hashes + lengths.astype(U) * _GOLD), rows, starts, ends


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` words, in order."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    h = np.zeros(n, U)
    for j in range(k):
        h = h * _M1 + hashes[j : n + j]
    return mix(h)

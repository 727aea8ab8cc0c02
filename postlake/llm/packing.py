"""Best-fit packing of tokenized documents into sequences of bounded size.

A piece's demand has three parts: tokens, one document, and attention cost (the square of its tokens). All follow from
its length, so the packing is worked out on counts of pieces by length: largest first, each length goes to the open
bins that fit it best under every capacity. The driver sees at most ``max_tokens`` counts, whatever the corpus. What
comes out are slots (a length, a range of ranks, where they go); each piece then finds its place by its rank among the
pieces of its length.
"""

from __future__ import annotations

import array
import json
import os
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlake.session import cut_lineage

#: Texts that are encoded together.
TOGETHER = 64
#: Pieces of one length that are ranked together.
RANKED = 100_000


#: Fixed value: how byte-level tokenizers of this kind cut a text before merging.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def merge_ranks(path: str) -> dict[bytes, int] | None:
    """Ids by bytes of a plain byte-level tokenizer, whose ids rise in order of its merges; None if it is not one.

    Merging by least id is then the same as merging by the list of merges.
    """
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    cut, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space")
    odd = [model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")]
    if model.get("type") != "BPE" or not plain or spec.get("normalizer") or any(odd):
        return None
    merged = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    ids = [model["vocab"].get("".join(m), -1) for m in merged]
    if ids != sorted(set(ids)) or -1 in ids:
        return None
    # Printable bytes stand for themselves, the others for the code points from 256 on.
    same = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in same} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in same)}
    ranks = {bytes(byte[c] for c in token): k for token, k in model["vocab"].items() if all(c in byte for c in token)}
    singles = [ranks.get(bytes([b]), len(ranks)) for b in range(256)]
    return ranks if len(ranks) == len(model["vocab"]) and max(singles) < min(ids, default=256) else None


class _Encoder:
    """Text to little-endian 32-bit ids.

    A plain byte-level tokenizer is run from its own vocabulary by a library that does it in a fifth of the time; any
    other, a text that holds a special token, and a text that the faster one fails on, by the tokenizer itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        ranks = merge_ranks(path)
        self.fast = None
        if ranks is not None:
            import tiktoken

            self.fast = tiktoken.Encoding("plain", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})

    def _one(self, text: str) -> bytes:
        if self.fast is not None and not any(s in text for s in self.special):
            try:
                return array.array("I", self.fast.encode_ordinary(text)).tobytes()
            except BaseException as failure:  # a panic of the library, as on a very long word, is no Exception
                if isinstance(failure, (KeyboardInterrupt, SystemExit, MemoryError)):
                    raise
        return array.array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        return [self._one(t) for t in texts]


_ENCODERS: dict[str, _Encoder] = {}


def _pieces(path: str, end_id: int, max_tokens: int, with_ids: bool):
    """(id, body) to pieces; only a document of more than ``max_tokens`` ids is cut, its first piece takes the rest."""

    def cut(batches):
        encoder = _ENCODERS.get(path) or _ENCODERS.setdefault(path, _Encoder(path))
        end = int(end_id).to_bytes(4, "little")
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                some = batch.slice(at, TOGETHER)
                texts = [t or "" for t in some.column(1).to_pylist()]
                rows, piece, start, length, crc, ids = [], [], [], [], [], []
                for row, data in enumerate(encoder.encode(texts)):
                    view = memoryview(data + end)
                    n = len(view) // 4
                    edge, k = 0, 0
                    while edge < n:
                        size = (n - 1) % max_tokens + 1 if not k else max_tokens
                        part = view[4 * edge : 4 * (edge + size)]
                        rows.append(row)
                        piece.append(k)
                        start.append(edge)
                        length.append(size)
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            ids.append(np.frombuffer(part, "<u4").astype(np.int32))
                        edge, k = edge + size, k + 1
                columns = [
                    some.column(0).take(pa.array(rows, pa.int64())),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                ]
                names = ["id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return cut


@dataclass
class Capacity:
    """What a sequence may hold; ``None`` does not bind."""

    tokens: int = 1024
    documents: int | None = None
    cost: int | None = None

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.documents or self.tokens, self.cost or self.tokens**2], float)


@dataclass
class _Bins:
    """Open bins of like content."""

    content: list[tuple[int, int]]
    left: np.ndarray
    number: int


def best_fit(
    counts: dict[int, int], capacity: Capacity, weights: tuple[float, float, float] = (1.0, 1e-6, 1e-6), select: str = "norm"
) -> list[tuple[list[tuple[int, int]], int]]:
    """(content as (length, times) in order, number of bins) of a best-fit-decreasing packing of ``counts``.

    A bin is open to a piece if each of the three residual capacities covers its demand. Of the open ones, ``norm``
    takes the least weighted norm of what would be left, ``dot`` the least weighted product of residual and demand;
    both in shares of the capacity.
    """
    full = capacity.vector()
    weigh = np.array(weights)
    bins: list[_Bins] = []
    done: list[_Bins] = []
    left = np.zeros((0, 3))
    for length in sorted(counts, reverse=True):
        n = counts[length]
        need = np.array([length, 1, length * length], float)
        if (need > full).any():
            raise ValueError(f"a piece of {length} tokens exceeds the capacity of a sequence")
        while n:
            fits = np.flatnonzero((left >= need).all(axis=1)) if len(bins) else np.zeros(0, int)
            if len(fits):
                rest, ask = left[fits] / full, need / full
                score = ((rest - ask) ** 2 @ weigh) if select == "norm" else (rest * ask) @ weigh
                at = int(fits[int(np.argmin(score))])
                chosen = bins[at]
            else:
                at, chosen = -1, _Bins([], full.copy(), n)
            times = min(int((chosen.left // need).min()), n)
            number = min(chosen.number, n // times)
            filled = _Bins([*chosen.content, (length, times)], chosen.left - times * need, number)
            n -= times * number
            if at >= 0:
                chosen.number -= number
                if not chosen.number:
                    bins[at], left[at] = filled, filled.left
                    continue
            bins.append(filled)
            left = np.vstack([left, filled.left])
        if len(bins) > 64:  # those that no shorter piece can enter leave the table
            keep = np.array([b.left[0] >= 1 and b.left[1] >= 1 for b in bins])
            done.extend(b for b, k in zip(bins, keep, strict=True) if not k)
            bins, left = [b for b, k in zip(bins, keep, strict=True) if k], left[keep]
    return [(b.content, b.number) for b in [*done, *bins] if b.number]


def slots(packing: list[tuple[list[tuple[int, int]], int]]) -> np.ndarray:
    """Rows (length, first rank, first bin, times a bin, offset), ordered: where the pieces of a length go by rank."""
    rows, used, first_bin = [], {}, 0
    for content, number in packing:
        offset = 0
        for length, times in content:
            rank = used.get(length, 0)
            rows.append((length, rank, first_bin, times, offset))
            used[length] = rank + times * number
            offset += length * times
        first_bin += number
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _placer(table: np.ndarray):
    def place(batches):
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            rank = batch.column(batch.schema.get_field_index("rank")).to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for value in np.unique(length):
                own = table[table[:, 0] == value]
                mine = np.flatnonzero(length == value)
                slot = own[np.searchsorted(own[:, 1], rank[mine], side="right") - 1]
                over = rank[mine] - slot[:, 1]
                sequence[mine] = slot[:, 2] + over // slot[:, 3]
                offset[mine] = slot[:, 4] + over % slot[:, 3] * value
            keep = [i for i, c in enumerate(batch.schema.names) if c != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in keep], pa.array(sequence), pa.array(offset)],
                [*[batch.schema.names[i] for i in keep], "sequence_id", "offset"],
            )

    return place


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    capacity: Capacity = Capacity(),  # noqa: B008
    end_id: int = 2,
    weights: tuple[float, float, float] = (1.0, 1e-6, 1e-6),
    select: str = "norm",
    with_ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces of the documents with their place: id, piece, start, length, ids_crc32, sequence_id, offset.

    ``tokenizer`` is the path of a byte-level tokenizer's JSON file, the same on all executors. A document is its ids
    and then ``end_id``. One of more than ``capacity.tokens`` is cut; all its pieces but the first are full. With
    ``with_ids`` the ids come along as an array, and ``sequences`` joins them.

    * Null or empty text is ``end_id`` alone. Each row counts, also repeats and rows without an id.
    * No other column is read. An empty table gives no pieces.
    """
    body = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("body"))
    schema = T.StructType(
        [
            body.schema["id"],
            T.StructField("piece", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids_crc32", T.LongType()),
        ]
        + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids
    )
    pieces = body.mapInArrow(_pieces(tokenizer, end_id, capacity.tokens, with_ids), schema)
    # Written: tokenizing is the dear part, and lengths and places both read it.
    pieces = cut_lineage(pieces, "pieces")
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    table = slots(best_fit(counts, capacity, weights, select))
    deals = 1 + sum(counts.values()) // RANKED
    dealt = pieces.withColumn("deal", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(deals)))
    before = Window.partitionBy("length").orderBy("deal").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("length", "deal").count().withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0)))
    within = Window.partitionBy("length", "deal").orderBy("id", "piece", "start", "ids_crc32")
    ranked = dealt.withColumn("place", F.row_number().over(within)).join(sums.select("length", "deal", "base"), ["length", "deal"])
    ranked = ranked.select(*pieces.columns, (F.col("base") + F.col("place") - 1).cast("long").alias("rank"))
    places = T.StructType([*schema, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(_placer(table), places).withColumnRenamed("id", id_col)


def sequences(packed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(sequence_id, doc_ids, ids) of pieces packed ``with_ids``; a sequence is bounded by its capacity."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", id_col, "ids"))).alias("parts"))
    return parts.select("sequence_id", F.col(f"parts.{id_col}").alias("doc_ids"), F.flatten("parts.ids").alias("ids"))

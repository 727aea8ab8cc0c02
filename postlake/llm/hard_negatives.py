"""Hard negatives of anchor vectors, scored exactly by the method of the Four Russians.

Candidates are cut into shards; a shard holds its vectors as bit planes, the bits of eight dimensions packed into one
byte. An anchor has, for each eight dimensions, the sums of its components over all 256 subsets. The score of a
candidate is then a lookup per byte, with the planes shifted and added, the plane of the sign subtracted.

Rows lie sorted by label, so a shard and a block of anchors know which labels they share. Cells that share one are scored
for positives first; cells that hold two different labels then for negatives, between the bounds that the positives set.
Each pair of rows is thus scored once, but for those in cells at a border of labels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlake.operators.ids import assign_ids
from postlake.session import cut_lineage

SHARD_ROWS = 8192
BLOCK_ROWS = 1024
#: Greatest magnitude for which sums of products are left to 64-bit integers.
SAFE = 1 << 62

_PACKED = "part long, labels array<string>, codes binary, ids binary, width int, depth int, body binary"
_FOUND = ["block", "anchor_id", "score", "id"]
_MINED = ["anchor_id", "positive_id", "positive_score", "score", "id"]


def finite(vector: Column) -> Column:
    """Whether a vector and all its components are there and finite."""
    return vector.isNotNull() & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    )


def _integers(x: np.ndarray) -> np.ndarray:
    """Integer-valued doubles as 64-bit integers, or as Python's where they are larger."""
    return x.astype(np.int64) if np.abs(x).max(initial=0) < SAFE else _python_integers(x)


def _python_integers(x: np.ndarray) -> np.ndarray:
    out = np.empty(x.size, object)
    out[:] = [int(v) for v in x.ravel()]
    return out.reshape(x.shape)


def bit_planes(values: np.ndarray) -> np.ndarray:
    """(planes, groups of eight dimensions, rows) bytes of two's complement; the last plane is the sign's."""
    n, width = values.shape
    groups = -(-width // 8)
    low, high = (int(values.min()), int(values.max())) if values.size else (0, 0)
    depth = max(high.bit_length(), (-low - 1).bit_length() if low < 0 else 0) + 1
    room = np.zeros((n, groups * 8), bool)
    planes = np.empty((depth, groups, n), np.uint8)
    for b in range(depth):
        room[:, :width] = (values >> b) & 1
        planes[b] = np.packbits(room, axis=1, bitorder="little").T
    return planes


def subset_sums(anchor: np.ndarray, groups: int) -> np.ndarray:
    """The sums of an anchor's components over every subset of each eight dimensions, flat (group, subset)."""
    padded = np.zeros(groups * 8, anchor.dtype)
    padded[: min(len(anchor), groups * 8)] = anchor[: groups * 8]
    sums = np.zeros((groups, 256), anchor.dtype)
    for bit in range(8):
        sums[:, 1 << bit : 2 << bit] = sums[:, : 1 << bit] + padded[bit::8, None]
    return sums.ravel()


def lookup_index(planes: np.ndarray) -> np.ndarray:
    """The bytes as places in :func:`subset_sums`."""
    return planes.astype(np.intp) + (np.arange(planes.shape[1], dtype=np.intp) * 256)[:, None]


def scores(sums: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Inner products of one anchor with all rows: from the highest plane down, double and add."""
    depth, _, n = index.shape
    total = np.zeros(n, sums.dtype)
    for b in range(depth - 1, -1, -1):
        found = sums.take(index[b]).sum(axis=0)
        total = -found if b == depth - 1 else total * 2 + found
    return total


def _matrix(lists: pa.ListArray) -> np.ndarray:
    """Rows of doubles, filled up with zeros to the longest."""
    lengths = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), int(lengths.max(initial=0))))
    rows = np.repeat(np.arange(len(lists)), lengths)
    at = np.arange(len(rows)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[rows, at] = lists.flatten().to_numpy()
    return out


def _runs(batches, size: int):
    """The rows of a partition as tables of ``size`` rows; the last may have fewer."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        while batch.num_rows:
            take = batch.slice(0, size - sum(b.num_rows for b in held))
            held, batch = [*held, take], batch.slice(take.num_rows)
            if sum(b.num_rows for b in held) == size:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _packer(scale: int, size: int, as_planes: bool):
    """Rows (label, id, v) to one row a shard, or a block of anchors."""

    def pack(batches):
        for n, table in enumerate(_runs(batches, size)):
            values = np.floor(_matrix(table["v"].chunk(0)) * scale)
            kinds, codes = np.unique(table["label"].to_numpy().astype(str), return_inverse=True)
            row = {
                # Unique in the job, and the same when the task runs again.
                "part": pa.array([TaskContext.get().partitionId() << 32 | n], pa.int64()),
                "labels": pa.array([kinds.tolist()], pa.list_(pa.string())),
                "codes": [codes.astype(np.int32).tobytes()],
                "ids": [table["id"].to_numpy().astype(np.int64).tobytes()],
                "width": pa.array([values.shape[1]], pa.int32()),
            }
            if as_planes:
                planes = bit_planes(_integers(values))
                row |= {"depth": pa.array([planes.shape[0]], pa.int32()), "body": [planes.tobytes()]}
            else:
                row |= {"depth": pa.array([0], pa.int32()), "body": [values.tobytes()]}
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.binary()) for c in row.values()], list(row))

    return pack


def _packed(rows: DataFrame, scale: int, size: int, as_planes: bool, name: str) -> DataFrame:
    """Shards or blocks of ``size`` rows at most, sorted by label and id, one row each, numbered from 0 as ``name``."""
    parts = max(1, -(-rows.count() // size))
    dealt = rows.select("label", "id", "v").repartitionByRange(parts, "label", "id").sortWithinPartitions("label", "id")
    packed = cut_lineage(dealt.mapInArrow(_packer(scale, size, as_planes), _PACKED), f"packed-{name}")
    return packed.join(assign_ids(packed.select("part"), "part", 0, name=name), "part").drop("part")


class _Cell:
    """One shard and one block of anchors."""

    def __init__(self, shard: dict, block: dict):
        groups = -(-shard["width"] // 8)
        self.ids = np.frombuffer(shard["ids"], np.int64)
        self.kinds, self.codes = shard["labels"], np.frombuffer(shard["codes"], np.int32)
        planes = np.frombuffer(shard["body"], np.uint8).reshape(shard["depth"], groups, len(self.ids))
        self.index, self.groups = lookup_index(planes), groups
        self.anchors = np.frombuffer(block["ids"], np.int64)
        self.anchor_kinds, self.anchor_codes = block["labels"], np.frombuffer(block["codes"], np.int32)
        values = np.frombuffer(block["body"]).reshape(len(self.anchors), block["width"])
        bound = max(1, values.shape[1]) * float(np.abs(values).max(initial=0)) * 2.0 ** (shard["depth"] + 1)
        self.values = values.astype(np.int64) if bound < SAFE else _python_integers(values)

    def score(self, a: int, rows: np.ndarray) -> np.ndarray:
        index = self.index if len(rows) == self.index.shape[2] else self.index[:, :, rows]
        return scores(subset_sums(self.values[a], self.groups), index)

    def code_of(self, a: int) -> int:
        """The number that the shard gives to the label of an anchor; -1 if it has no such row."""
        kind = self.anchor_kinds[self.anchor_codes[a]]
        return self.kinds.index(kind) if kind in self.kinds else -1


def _best(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties by smaller id."""
    if len(ids) > k and score.dtype != object:
        least = np.partition(score, len(score) - k)[len(score) - k]
        near = np.flatnonzero(score >= least)
    else:
        near = np.arange(len(ids))
    return near[sorted(range(len(near)), key=lambda i: (-int(score[near[i]]), int(ids[near[i]])))[:k]].astype(int)


def _only(table: pa.Table) -> dict | None:
    return table.slice(0, 1).to_pylist()[0] if table.num_rows else None


def _table(rows: list[tuple], names: list[str]) -> pa.Table:
    return pa.table({c: pa.array([r[i] for r in rows], pa.int64()) for i, c in enumerate(names)})


def _positives(k: int):
    """The best rows of each anchor's own label in a cell."""

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            block = right.to_pylist()[0]
            cell = _Cell(left.to_pylist()[0], block)
            for a, anchor in enumerate(cell.anchors):
                rows = np.flatnonzero((cell.codes == cell.code_of(a)) & (cell.ids != anchor))
                if len(rows):
                    score, ids = cell.score(a, rows), cell.ids[rows]
                    out += [(block["block"], int(anchor), int(score[i]), int(ids[i])) for i in _best(ids, score, k)]
        return _table(out, _FOUND)

    return find


def _negatives(k: int, least: int, most: int):
    """The best rows of other labels in a cell, within the bounds that each positive sets."""

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            block = right.to_pylist()[0]
            cell = _Cell(left.to_pylist()[0], block)
            wanted: dict[int, list] = {}
            for p in block["positives"]:
                low, high = -(-least * p["score"] // 100), most * p["score"] // 100
                if low <= high:
                    wanted.setdefault(p["anchor_id"], []).append((p["id"], p["score"], low, high))
            for a, anchor in enumerate(cell.anchors):
                bounds = wanted.get(int(anchor))
                if not bounds:
                    continue
                rows = np.flatnonzero(cell.codes != cell.code_of(a))
                score = cell.score(a, rows)
                near = np.flatnonzero((score >= min(b[2] for b in bounds)) & (score <= max(b[3] for b in bounds)))
                score, ids = score[near], cell.ids[rows[near]]
                for positive, reached, low, high in bounds:
                    fit = np.flatnonzero((score >= low) & (score <= high))
                    best = fit[_best(ids[fit], score[fit], k)]
                    out += [(int(anchor), positive, reached, int(score[i]), int(ids[i])) for i in best]
        return _table(out, _MINED)

    return find


def _meet(cells: DataFrame, shards: DataFrame, blocks: DataFrame, find, names: list[str]) -> DataFrame:
    """Bring each shard and block together that ``cells`` (shard, block) names; a cell is one group of one row a side."""
    cells = cut_lineage(cells, "cells")
    left = cells.join(shards, "shard").groupBy("shard", "block")
    right = cells.toDF("to", "at").join(blocks, F.col("at") == F.col("block")).groupBy("to", "at")
    return left.cogroup(right).applyInArrow(find, ", ".join(f"{c} long" for c in names))


def _first(df: DataFrame, k: int, *group: str) -> DataFrame:
    order = Window.partitionBy(*group).orderBy(F.desc("score"), "id")
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    rows: DataFrame, anchors: Column, scale: int = 256, positives: int = 5, negatives: int = 5, least: int = 80, most: int = 100
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) over ``rows`` (id, label, v).

    ``anchors`` says over ``id`` which rows are anchors. A component becomes floor(``scale`` * x); a row's score is its
    inner product with the anchor. Higher scores come first, ties by the smaller id. Positives are an anchor's first other
    rows of its label. For each, the first rows of other labels come whose score is ``least`` to ``most`` percent of the
    positive's; where the positive's is below zero there are none.

    * Rows whose id, label or vector is null, or that hold a null or non-finite component, take no part.
    * Of rows that repeat an id, the one of the smallest label (as text), then smallest vector, is taken.
    * Vectors of fewer components are filled up with zeros; an empty one scores 0 with all.
    * Values of any size are exact; a score of the result that no 64-bit integer holds is an error.
    * Other columns are not read. Empty tables give no rows.
    """
    kept = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & finite(F.col("v")))
    body = F.struct(F.col("label").cast("string").alias("label"), F.col("v").cast("array<double>").alias("v"))
    kept = kept.groupBy(F.col("id").cast("long").alias("id")).agg(F.min(body).alias("m"))
    kept = cut_lineage(kept.select("m.label", "id", "m.v"), "mined-rows")
    shards = cut_lineage(_packed(kept, scale, SHARD_ROWS, True, "shard"), "shards")
    blocks = cut_lineage(_packed(kept.where(anchors), scale, BLOCK_ROWS, False, "block"), "blocks")
    labels = shards.select("shard", F.explode("labels").alias("label")).join(blocks.select("block", F.explode("labels").alias("label")), "label")
    found = _meet(labels.select("shard", "block").distinct(), shards, blocks, _positives(positives), _FOUND)
    first = cut_lineage(_first(found, positives, "anchor_id").drop("rank"), "positives")
    reach = first.where("score >= 0").groupBy("block").agg(F.collect_list(F.struct("anchor_id", "score", "id")).alias("positives"))
    asked = blocks.join(reach, "block")
    # Every shard meets every block, but those that hold one label and the same.
    numbers = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(0, blocks.count() - 1)).cast("long"))).alias("block")
    cells = shards.select("shard", F.col("labels").alias("held"), numbers).join(asked.select("block", "labels"), "block")
    cells = cells.where((F.size("held") > 1) | (F.size("labels") > 1) | (F.col("held") != F.col("labels"))).select("shard", "block")
    mined = _first(_meet(cells, shards, asked, _negatives(negatives, least, most), _MINED), negatives, "anchor_id", "positive_id")
    return mined.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))

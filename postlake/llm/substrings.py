"""Passages that repeat are removed: windows of words that start earlier elsewhere.

To match every document against an index of every shard would grow with the square of the corpus. So windows are
routed by content: a window belongs to the smallest hash of the short word runs in it, its anchor, and equal windows
have equal anchors. Neighbouring windows of one anchor travel as one segment, and only segments of an anchor that
occurs more than once travel at all. Each shard of segments gets an FM-index; backward search over its wavelet tree
gives the matching statistics of the segments streamed through it, and windows whose statistics reach the threshold are
the repeats. Windows of equal words have the same interval of suffixes; the earliest stays.

Anchors of very many occurrences would fill one shard. Their segments are classes by a hash of 128 bits: every one but
the first of its class repeats as a whole, and only the first is cut into windows, which are settled by their hashes.
Copies of whole texts are settled by their hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlake.llm.common import U, grams, mix, slices, small_batches, split_words, text_chunks
from postlake.llm.fm_index import FMIndex
from postlake.session import cut_lineage

#: Words of the runs that anchors are chosen from.
GRAM = 6
#: Segments in a shard, about; and occurrences from which an anchor's windows are taken singly.
SHARD, HOT = 10_000, 2_000
_CHUNK = 512 << 10


def _anchors(hashes: np.ndarray, rows: np.ndarray, window: int):
    """(first window, number of windows, anchor) of each run of windows of one anchor; a window lies in one row."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U)
    size = min(GRAM, window)
    value = grams(hashes, size)
    place = np.arange(len(value))
    # Sliding minimum with its leftmost place, over spans that double.
    span, width = 1, window - size + 1
    while span < width:
        step = min(span, width - span)
        right = value[step:] < value[:-step]
        value, place = np.where(right, value[step:], value[:-step]), np.where(right, place[step:], place[:-step])
        span += step
    use = rows[:n] == rows[window - 1 :]
    new = np.ones(n, bool)
    new[1:] = (place[1:n] != place[: n - 1]) | ~use[:-1]
    first = np.flatnonzero(new & use)
    change = np.append(np.flatnonzero(new | ~use), n)
    last = change[np.searchsorted(change, first, side="right")]
    return first, last - first, value[first]


def _scan(window: int):
    """(id, mark, body) to (anchor, id, mark, start, n)."""

    def scan(batches):
        for batch in batches:
            for first, n, offsets, raw in text_chunks(batch.column(2), _CHUNK):
                hashes, rows, _, _ = split_words(offsets, raw, lower=False)
                at, many, anchor = _anchors(hashes, rows, window)
                owner = rows[at] if len(at) else at
                begins = np.searchsorted(rows, np.arange(n))
                pick = pa.array(owner + first)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(anchor.view(np.int64)),
                        batch.column(0).take(pick),
                        batch.column(1).take(pick),
                        pa.array((at - begins[owner]).astype(np.int32)),
                        pa.array(many.astype(np.int32)),
                    ],
                    ["anchor", "id", "mark", "start", "n"],
                )

    return scan


def _squeeze(batches):
    """(id, mark, body) with the body compressed, for its way through a shuffle."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=3)
    for batch in slices(batches):
        body = pa.array([pack.compress(t.encode()) for t in batch.column(2).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), body], ["id", "mark", "packed"])


def _words(packed: bytes) -> list[bytes]:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(packed).split()


def _segments(window: int):
    """(id, mark, packed, list of (start, n, anchor)) to (anchor, id, mark, start, n, words)."""

    def cut(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                words = _words(batch.column(2)[row].as_py())
                runs = batch.column(3)[row].values
                start, n = runs.field(0).to_numpy(), runs.field(1).to_numpy()
                text = [b" ".join(words[s : s + m + window - 1]) for s, m in zip(start.tolist(), n.tolist(), strict=True)]
                same = pa.array(np.zeros(len(start), np.int64))
                yield pa.RecordBatch.from_arrays(
                    [runs.field(2), batch.column(0).slice(row, 1).take(same), batch.column(1).slice(row, 1).take(same), runs.field(0), runs.field(1), pa.array(text, pa.binary())],
                    ["anchor", "id", "mark", "start", "n", "words"],
                )

    return cut


def _rechunked(function, rows: int = 2000):
    """Join the small batches that ``function`` yields."""

    def run(batches):
        held, count = [], 0
        for batch in function(batches):
            held.append(batch)
            count += batch.num_rows
            if count >= rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, count = [], 0
        if count:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    return run


def _single_windows(window: int):
    """Segments to one row (h1, h2, id, mark, start) for each window."""

    def split(batches):
        for batch in batches:
            for first, n, offsets, raw in text_chunks(batch.column(5).cast(pa.string()), _CHUNK):
                hashes, rows, _, _ = split_words(offsets, raw, lower=False)
                whole = grams(hashes, window)
                other = grams(mix(hashes ^ U(0x5851F42D4C957F2D)), window)
                at = np.flatnonzero(rows[: len(whole)] == rows[window - 1 :]) if len(whole) else np.zeros(0, np.int64)
                begins = np.searchsorted(rows, np.arange(n))
                pick = pa.array(rows[at] + first)
                start = batch.column(3).take(pick).to_numpy() + (at - begins[rows[at]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(whole[at].view(np.int64)), pa.array(other[at].view(np.int64)), batch.column(1).take(pick), batch.column(2).take(pick), pa.array(start.astype(np.int32))],
                    ["h1", "h2", "id", "mark", "start"],
                )

    return split


def repeats(codes: np.ndarray, size: int, ends: np.ndarray, window: int) -> np.ndarray:
    """Which of the windows that end at ``ends`` (in order of precedence) equal an earlier one, by an FM-index of ``codes``."""
    index = FMIndex(codes, size, window)
    length, low, _ = index.matching_statistics(codes, ends, window)
    found = np.flatnonzero(length == window)
    gone = np.zeros(len(ends), bool)
    # One interval for each text: all but the first window of an interval repeat it.
    order = found[np.argsort(low[found], kind="stable")]
    gone[order[1:][low[order[1:]] == low[order[:-1]]]] = True
    return gone


def _shard(window: int):
    """Segments of a shard to the repeated windows in them: (id, mark, start, n)."""

    def search(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending"), ("mark", "ascending"), ("start", "ascending")])
        words = table.column("words").to_pylist()
        seen: dict[bytes, tuple] = {}
        place = list(zip(table.column("id").to_pylist(), table.column("mark").to_pylist(), table.column("start").to_pylist(), strict=True))
        first = np.zeros(len(words), bool)
        copy = np.zeros(len(words), bool)
        for i, w in enumerate(words):
            held = seen.setdefault(w, place[i])
            first[i] = held is place[i]
            copy[i] = not first[i] and held != place[i]
        n = table.column("n").to_numpy()
        rows = np.flatnonzero(copy)
        starts, many = np.zeros(len(rows), np.int64), n[rows].astype(np.int64)
        heads = np.flatnonzero(first)
        texts = pa.array([words[i] for i in heads], pa.binary()).cast(pa.string())
        hashes, owners, at = [], [], 0
        for lo, _, offsets, raw in text_chunks(texts):
            h, r, _, _ = split_words(offsets, raw, lower=False)
            hashes.append(h)
            owners.append(r + lo)
        hashes, owners = np.concatenate(hashes), np.concatenate(owners)
        symbols, codes = np.unique(hashes, return_inverse=True)
        # A separator, code 0, behind each segment.
        spot = np.arange(len(codes)) + owners
        text = np.zeros(len(codes) + len(heads), np.int64)
        text[spot] = codes + 1
        begins = spot[np.searchsorted(owners, np.arange(len(heads)))]
        span = n[heads].astype(np.int64)
        owner = np.repeat(np.arange(len(heads)), span)
        inner = np.arange(len(owner)) - np.repeat(np.cumsum(span) - span, span)
        gone = repeats(text, len(symbols) + 1, begins[owner] + inner + window, window)
        owner, inner = owner[gone], inner[gone]
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (inner[1:] != inner[:-1] + 1)
        at = np.flatnonzero(new)
        rows = np.concatenate([rows, heads[owner[at]]])
        starts = np.concatenate([starts, inner[at]])
        many = np.concatenate([many, np.diff(np.append(at, len(owner)))])
        pick = pa.array(rows)
        return pa.table(
            {
                "id": table.column("id").take(pick).combine_chunks(),
                "mark": table.column("mark").take(pick).combine_chunks(),
                "start": pa.array((table.column("start").to_numpy()[rows] + starts).astype(np.int32)),
                "n": pa.array(many.astype(np.int32)),
            }
        )

    return search


def _without(window: int):
    """(row, packed, list of (start, n), copy) to (row, n_words, n_removed, kept)."""

    def drop(batches):
        for batch in slices(batches):
            n_words, n_removed, kept = [], [], []
            for row in range(batch.num_rows):
                words = _words(batch.column(2)[row].as_py())
                runs, copy = batch.column(3)[row], batch.column(4)[row].as_py()
                n = len(words)
                gone = np.zeros(n, bool)
                if copy and n >= window:
                    gone[:] = True
                elif runs.is_valid:
                    edge = np.zeros(n + 1, np.int64)
                    start = runs.values.field(0).to_numpy()
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + runs.values.field(1).to_numpy() + window - 1, -1)
                    gone = np.cumsum(edge)[:n] > 0
                n_words.append(n)
                n_removed.append(int(gone.sum()))
                kept.append(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g] if n_removed[-1] else words))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                ["id", "n_words", "n_removed", "kept"],
            )

    return drop


def remove_repeats(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of ``docs``: its id, ``n_words``, ``n_removed`` and ``kept``, the words that stay joined by a space.

    A word goes if a window of ``window`` words over it also starts earlier: in a document of smaller id, or earlier in
    the same one. Windows are judged on the input. Words are what blanks (\\x20, \\x09-\\x0D) separate.

    * Null or empty text has no words. Texts of fewer words than a window are never touched, also as copies.
    * Rows that repeat (same id and text) are one document and get the same result. Of one id with several texts, the
      one of smaller hash comes first.
    * A row without an id is not compared: all its words stay. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    frame = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("body"))
    frame = frame.select("id", F.xxhash64("body").alias("mark"), "body")
    known = frame.where("id IS NOT NULL")
    field = T.StructField
    key = [field("id", kind), field("mark", T.LongType())]
    run = [field("start", T.IntegerType()), field("n", T.IntegerType())]

    # Copies of whole texts.
    texts = cut_lineage(known.select("id", "mark", F.xxhash64(F.lit(7), "body").alias("other")), "text-hashes")
    firsts = texts.groupBy("mark", "other").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    firsts = cut_lineage(firsts, "first-texts")
    copies = texts.join(firsts, ["mark", "other"]).where("id <> first").select("id", "mark").distinct()
    copies = cut_lineage(copies, "copies")

    # Anchors that occur more than once, and where.
    scanned = known.mapInArrow(_scan(window), T.StructType([field("anchor", T.LongType()), *key, *run]))
    counts = scanned.groupBy("anchor").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    counts = cut_lineage(counts.select("anchor", (F.col("often") > HOT).alias("hot")), "anchors")
    # What grows with the corpus is merged at every size, never sent whole to all tasks.
    placed = scanned.join(counts.hint("merge"), "anchor").join(copies.hint("merge"), ["id", "mark"], "left_anti")
    runs = placed.distinct().groupBy("id", "mark").agg(F.collect_list(F.struct("start", "n", "anchor", "hot")).alias("runs"))
    runs = cut_lineage(runs, "anchored")

    packed_type = T.StructType([*key, field("packed", T.BinaryType())])
    packed = known.mapInArrow(_squeeze, packed_type)
    bodies = packed.join(runs.hint("merge"), ["id", "mark"]).dropDuplicates(["id", "mark"])
    pieces = T.StructType([field("anchor", T.LongType()), *key, *run, field("words", T.BinaryType())])

    def segments(hot: bool) -> DataFrame:
        own = F.expr(f"transform(filter(runs, r -> r.hot = {str(hot).lower()}), r -> named_struct('start', r.start, 'n', r.n, 'anchor', r.anchor))")
        return table.select("id", "mark", "packed", own.alias("runs")).where("size(runs) > 0").mapInArrow(_rechunked(_segments(window)), pieces)

    table = cut_lineage(bodies, "anchored-texts")
    # What anchors of few occurrences cover goes to shards; each holds about SHARD segments.
    total = runs.agg(F.coalesce(F.sum(F.size(F.expr("filter(runs, r -> NOT r.hot)"))), F.lit(0))).first()[0]
    shard = F.pmod(F.xxhash64("anchor"), F.lit(max(1, -(-total // SHARD))))
    gone = segments(False).withColumn("shard", shard).groupBy("shard").applyInArrow(_shard(window), T.StructType([*key, *run]))

    # Hot anchors: equal segments are one class, all but whose first repeat it whole, as one interval; only the first
    # segment of each class is cut into windows.
    hot = segments(True).select(F.xxhash64("words").alias("h1"), F.xxhash64(F.lit(7), "words").alias("h2"), "id", "mark", "start", "n", "words")
    hot = cut_lineage(hot, "hot-segments")
    first = F.min(F.struct("id", "mark", "start", "n", "words")).alias("e")
    classes = cut_lineage(hot.groupBy("h1", "h2").agg(first, F.count(F.lit(1)).alias("often")), "hot-classes")
    many = classes.where("often > 1").select("h1", "h2", F.col("e.id").alias("i"), F.col("e.mark").alias("m"), F.col("e.start").alias("s"))
    again = hot.drop("words").join(many, ["h1", "h2"]).where("NOT (id = i AND mark = m AND start = s)").select("id", "mark", "start", "n")
    heads = classes.select(F.lit(0).cast("long").alias("anchor"), "e.id", "e.mark", "e.start", "e.n", "e.words")
    singles = heads.mapInArrow(
        _single_windows(window), T.StructType([field("h1", T.LongType()), field("h2", T.LongType()), *key, field("start", T.IntegerType())])
    )
    singles = cut_lineage(singles, "single-windows")
    earliest = singles.groupBy("h1", "h2").agg(F.min(F.struct("id", "mark", "start")).alias("e"), F.count(F.lit(1)).alias("often")).where("often > 1")
    earliest = cut_lineage(earliest.select("h1", "h2", F.col("e.id").alias("i"), F.col("e.mark").alias("m"), F.col("e.start").alias("s")), "earliest")
    late = singles.join(earliest, ["h1", "h2"]).where("NOT (id = i AND mark = m AND start = s)").select("id", "mark", "start", F.lit(1).alias("n"))
    late = late.unionAll(again)

    gone = gone.unionAll(late).groupBy("id", "mark").agg(F.collect_list(F.struct("start", "n")).alias("gone"))
    gone = gone.join(copies.withColumn("copy", F.lit(True)), ["id", "mark"], "full")
    gone = cut_lineage(gone.select(F.col("id").alias("id2"), F.col("mark").alias("mark2"), "gone", "copy"), "repeats")
    both = frame.mapInArrow(_squeeze, packed_type).join(gone.hint("merge"), (F.col("id") == F.col("id2")) & (F.col("mark") == F.col("mark2")), "left")
    both = both.select("id", "mark", "packed", "gone", F.coalesce("copy", F.lit(False)).alias("copy"))
    out = [field("id", kind), field("n_words", T.LongType()), field("n_removed", T.LongType()), field("kept", T.StringType())]
    return both.mapInArrow(_without(window), T.StructType(out)).withColumnRenamed("id", id_col)

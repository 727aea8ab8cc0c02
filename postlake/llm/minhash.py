"""Near-duplicate groups of documents by MinHash.

Each text becomes the set of its word shingles. Texts of equal sets form a class. Of each class, many universal hash
minima are taken, cut into bands, and documents that share a band are candidates. Their signatures are compared first,
then the full sets. Links form groups by alternating large-star and small-star.

A band that many documents share is never expanded into all its pairs: its members are linked to one pivot. Where the
members of a band are then still in different groups, documents of different groups meet by the rarest shingles of their
sets, under length and positional bounds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlake.llm.common import CHUNK_BYTES, U, grams, mix, small_batches, split_words, text_chunks
from postlake.llm.components import components
from postlake.session import cut_lineage

_OWN, _MARK, _TO, _TO_MARK, _PLACE = "__own", "__own_mark", "__to", "__to_mark", "__place"
#: Pairs that two groups with a band in common are first tried by, and how often.
TRIED, ROUNDS = 8, 1
#: Bytes of text that one group of confirmations holds.
GROUP_BYTES = 8 << 20


def shingle_sets(offsets: np.ndarray, raw: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle hash) of a chunk, distinct and in order: runs of ``k`` words, or the whole sequence if shorter."""
    words, rows, _, _ = split_words(offsets, raw, lower=True)
    hashes = grams(words, k)
    keep = rows[: len(hashes)] == rows[k - 1 :] if len(hashes) else np.zeros(0, bool)
    hashes, owners = hashes[keep], rows[: len(keep)][keep]
    counts = np.bincount(rows, minlength=len(offsets) - 1)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        first = np.concatenate([[0], np.cumsum(counts)])
        own = [mix(grams(words[first[r] : first[r + 1]], int(counts[r])) + U(int(counts[r]))) for r in short]
        hashes, owners = np.concatenate([hashes, *own]), np.concatenate([owners, short])
    order = np.lexsort((hashes, owners))
    hashes, owners = hashes[order], owners[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])
    return owners[new], hashes[new]


def _universal(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(seed)
    return draw.integers(1, 1 << 63, n, dtype=U) * U(2) + U(1), draw.integers(0, 1 << 63, n, dtype=U)


def _lists(values: np.ndarray, width: int, kind: pa.DataType) -> pa.Array:
    offsets = np.arange(0, values.size + 1, width, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.reshape(-1), kind))


def _signer(k: int, bands: int, rows_per_band: int, seed: int):
    """Map batches (id, mark, body) to (id, mark, n, s1, s2, bands, signature); one row a row."""

    def sign(batches):
        times, plus = _universal(bands * rows_per_band, seed)
        for batch in batches:
            ids = batch.column(0)
            for first, n, offsets, raw in text_chunks(batch.column(2), CHUNK_BYTES // 4):
                owners, hashes = shingle_sets(offsets, raw, k)
                counts = np.bincount(owners, minlength=n)
                full = np.flatnonzero(counts)
                starts = np.concatenate([[0], np.cumsum(counts)])[full]
                minima = np.zeros((n, len(times)), np.uint32)
                sums = np.zeros((2, n), U)
                if len(full):
                    low = hashes >> U(32)
                    for j in range(len(times)):
                        minima[full, j] = np.minimum.reduceat((low * times[j] + plus[j]) >> U(32), starts)
                    sums[0, full] = np.add.reduceat(mix(hashes), starts)
                    sums[1, full] = np.add.reduceat(mix(hashes ^ U(0xA5A5A5A5A5A5A5A5)), starts)
                keys = np.zeros((n, bands), U)
                for j in range(rows_per_band):
                    keys = mix(keys * U(0x9E3779B97F4A7C15) + minima[:, j::rows_per_band])
                keys = mix(keys + np.arange(bands, dtype=U))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(first, n),
                        batch.column(1).slice(first, n),
                        pa.array(counts, pa.int64()),
                        pa.array(sums[0].view(np.int64)),
                        pa.array(sums[1].view(np.int64)),
                        _lists(keys.view(np.int64), bands, pa.int64()),
                        pa.array([minima[i].astype("<u2").tobytes() for i in range(n)], pa.binary()),
                    ],
                    ["id", "mark", "n", "s1", "s2", "bands", "signature"],
                )

    return sign


def _alike(least: float):
    """Keep (a, b) whose signatures agree in a share of ``least`` or more."""

    def compare(batches):
        for batch in batches:
            if batch.num_rows:
                left = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u2").reshape(batch.num_rows, -1)
                right = np.frombuffer(b"".join(batch.column(3).to_pylist()), "<u2").reshape(batch.num_rows, -1)
                near = (left == right).mean(axis=1) >= least
                yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(near)) for i in (0, 1)], ["a", "b"])

    return compare


def _confirm(k: int, percent: int):
    """Pairs of a bounded group whose full sets are similar enough."""

    def sets_of(ids, texts):
        found = {}
        for first, n, offsets, raw in text_chunks(texts):
            owners, hashes = shingle_sets(offsets, raw, k)
            cuts = np.searchsorted(owners, np.arange(n + 1))
            for i in range(n):
                found[ids[first + i]] = hashes[cuts[i] : cuts[i + 1]]
        return found

    def confirm(left: pa.Table, right: pa.Table) -> pa.Table:
        pivots = sets_of(right.column("pivot").to_pylist(), right.column("whole"))
        a, b = left.column("a").to_pylist(), left.column("b").to_pylist()
        out_a, out_b, at = [], [], 0
        for first, n, offsets, raw in text_chunks(left.column("body")):
            owners, hashes = shingle_sets(offsets, raw, k)
            cuts = np.searchsorted(owners, np.arange(n + 1))
            for i in range(n):
                own, other = hashes[cuts[i] : cuts[i + 1]], pivots[a[first + i]]
                both = len(np.intersect1d(own, other, assume_unique=True))
                if 100 * both >= percent * (len(own) + len(other) - both):
                    out_a.append(a[first + i])
                    out_b.append(b[first + i])
        return pa.table({"a": pa.array(out_a, left.schema.field("a").type), "b": pa.array(out_b, left.schema.field("b").type)})

    return confirm


class _Linker:
    """Candidate pairs of class representatives to confirmed links."""

    def __init__(self, texts: DataFrame, signed: DataFrame, k: int, percent: int, minima: int):
        self.texts, self.signed, self.k, self.percent = texts, signed, k, percent
        share = percent / 100
        self.least = max(0.0, share - 6 * (share * (1 - share) / minima) ** 0.5)

    def links(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` (a, b), distinct; the pivot ``a`` may have any number of partners."""
        kind = pairs.schema["a"].dataType.simpleString()
        near = (
            pairs.join(self.signed.select(F.col("id").alias("b"), F.col("signature").alias("sb")), "b")
            .join(self.signed.select(F.col("id").alias("a"), F.col("signature").alias("sa")), "a")
            .select("a", "b", "sa", "sb")
            .mapInArrow(_alike(self.least), f"a {kind}, b {kind}")
        )
        near = cut_lineage(near, "near-pairs")
        sizes = near.join(self.texts.select(F.col("id").alias("b"), F.octet_length("body").alias("bytes")), "b")
        sizes = sizes.groupBy("a").agg(F.sum("bytes").alias("bytes"))
        sizes = cut_lineage(sizes, "pivot-sizes")
        total = sizes.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
        groups = max(1, -(-total // GROUP_BYTES))
        # A pivot with more partners than a group may hold is dealt over several.
        parts = sizes.select("a", F.ceil(F.col("bytes") / GROUP_BYTES * 2).alias("parts"))
        dealt = cut_lineage(
            near.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part")), "dealt-pairs"
        )
        group = F.pmod(F.xxhash64("a", "part"), F.lit(groups))
        left = dealt.join(self.texts.select(F.col("id").alias("b"), "body"), "b").select(group.alias("g"), "a", "b", "body")
        right = dealt.select("a", group.alias("g")).distinct().join(self.texts.select(F.col("id").alias("a"), "body"), "a")
        right = right.select(F.col("g").alias("h"), F.col("a").alias("pivot"), F.col("body").alias("whole"))
        found = left.groupBy("g").cogroup(right.groupBy("h")).applyInArrow(_confirm(self.k, self.percent), f"a {kind}, b {kind}")
        return cut_lineage(found, "links")


def _shingler(k: int):
    """Rows (id, c, body) to (id, c, n, tokens): the distinct shingles of each text."""

    def run(batches):
        for batch in batches:
            for first, n, offsets, raw in text_chunks(batch.column(2)):
                owners, hashes = shingle_sets(offsets, raw, k)
                cuts = np.searchsorted(owners, np.arange(n + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, n),
                        batch.column(1).slice(first, n),
                        pa.array(np.diff(cuts).astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(cuts), pa.array(hashes.view(np.int64))),
                    ],
                    ["id", "c", "n", "tokens"],
                )

    return run


def _across(shared: DataFrame, label: DataFrame, linker: _Linker) -> DataFrame | None:
    """Candidate pairs (a, b) between groups that still share a band: what the pivots alone can't show.

    Such documents meet by prefixes of their sets. Shingles are ordered by how many of these documents hold them, rarest
    first; two sets that are similar enough share one among the first ``n - ceil(share * n) + 1`` of each, and the first
    that they share leaves room behind it, in both, for the overlap they need. A shingle that one group alone holds links
    nothing, and of a group's own documents no two are compared.
    """
    kind, percent = linker.signed.schema["id"].dataType.simpleString(), linker.percent
    named = label.select(F.col("node").alias("id"), F.col("component").alias("c"))
    rows = shared.select("band", "id").join(named, "id", "left").withColumn("c", F.coalesce("c", "id"))
    rows = cut_lineage(rows, "grouped-bands")
    split = rows.groupBy("band").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("band")
    apart = cut_lineage(rows.join(split, "band", "left_semi").select("id", "c").distinct(), "apart")
    if apart.isEmpty():
        return None
    sets = linker.texts.join(apart, "id").select("id", "c", "body").mapInArrow(
        _shingler(linker.k), f"id {kind}, c {kind}, n long, tokens array<long>"
    )
    held = cut_lineage(sets.select("id", "c", "n", F.explode("tokens").alias("t")), "held-shingles")
    known = held.groupBy("t").agg(F.count(F.lit(1)).alias("f"), (F.min("c") != F.max("c")).alias("meets"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("f", "t")) - 1
    first = held.join(known, "t").withColumn("i", place)
    first = first.where(F.col("meets") & (F.col("i") <= F.col("n") - F.ceil(F.col("n") * percent / 100)))
    first = cut_lineage(first.select("t", "id", "c", "n", "i"), "prefixes")
    other = first.toDF("t", "id2", "c2", "n2", "i2")
    enough = (100 + percent) * F.least(F.col("n") - F.col("i"), F.col("n2") - F.col("i2")) >= percent * (F.col("n") + F.col("n2"))
    near = (F.col("c") < F.col("c2")) & (100 * F.least("n", "n2") >= percent * F.greatest("n", "n2")) & enough
    pairs = first.join(other, "t").where(near).select(F.col("id").alias("a"), F.col("id2").alias("b"))
    return cut_lineage(pairs.distinct(), "prefix-pairs")


def near_duplicates(
    docs: DataFrame,
    shingle: int = 5,
    percent: int = 80,
    bands: int = 32,
    rows_per_band: int = 5,
    seed: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """For each row of ``docs``: its id, ``n_shingles``, ``component_id`` and ``kept``.

    Two documents are linked if their shingle sets have a Jaccard similarity of ``percent`` / 100 or more, confirmed in
    whole numbers on the full sets. ``component_id`` is the smallest id that links reach, ``kept`` whether it is the
    own id. A pair right at the threshold of 0.8 shares no band, and is missed, with probability 3e-6 by default.

    * Null text, or text without words: no shingles, linked with nothing.
    * Equal sets are one class and compared once, however many copies there are.
    * An id stands for one text. Repeats of a row get the same result, so all are kept or none. If rows of one id differ,
      each has the component of its own set, but a set whose smallest id is another set's too is not compared further.
    * A row without an id takes no part: its component is null and it is kept.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    frame = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("body"))
    frame = frame.select("id", F.xxhash64("body").alias("mark"), "body")
    signed = frame.mapInArrow(
        _signer(shingle, bands, rows_per_band, seed),
        f"id {kind}, mark long, n long, s1 long, s2 long, bands array<long>, signature binary",
    )
    # Written: the minima are the dear part, and each later step reads other columns of it.
    signed = cut_lineage(signed, "signed")
    sets = signed.where("n > 0 AND id IS NOT NULL")
    classes = cut_lineage(sets.groupBy("n", "s1", "s2").agg(F.min("id").alias("head")), "classes")
    mine = classes.groupBy("head").agg(F.min(F.struct("n", "s1", "s2")).alias("c"))
    mine = mine.select(F.col("head").alias("id"), "c.n", "c.s1", "c.s2")
    heads = sets.join(mine, ["id", "n", "s1", "s2"], "left_semi").select("id", "mark", "bands", "signature")
    heads = cut_lineage(heads.dropDuplicates(["id"]), "heads")

    members = heads.select("id", F.explode("bands").alias("band"))
    pivots = members.groupBy("band").agg(F.min("id").alias("pivot"), F.count(F.lit(1)).alias("size")).where("size > 1")
    pivots = cut_lineage(pivots.select("band", "pivot"), "pivots")
    shared = cut_lineage(members.join(pivots, "band"), "shared-bands")
    involved = heads.join(shared.select("id").distinct(), "id", "left_semi").select("id", "mark")
    # What grows with the corpus is merged at every size, never sent whole to all tasks.
    texts = frame.join(cut_lineage(involved, "involved").hint("merge"), ["id", "mark"], "left_semi").select("id", "body")
    texts = cut_lineage(texts.dropDuplicates(["id"]), "involved-texts")
    linker = _Linker(texts, heads, shingle, percent, bands * rows_per_band)

    # First each document with the pivot it shares most bands with, then what is still apart.
    stars = shared.where("id <> pivot").groupBy(F.col("pivot").alias("a"), F.col("id").alias("b")).agg(F.count(F.lit(1)).alias("hits"))
    stars = cut_lineage(stars, "stars")
    best = stars.groupBy("b").agg(F.max(F.struct("hits", "a")).alias("m")).select(F.col("m.a").alias("a"), "b")
    links = linker.links(best)
    label = cut_lineage(components(links), "labels")

    def labelled(pairs: DataFrame, labels: DataFrame) -> DataFrame:
        for side in ("a", "b"):
            found = labels.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))
            pairs = pairs.join(found, side, "left").withColumn(f"c{side}", F.coalesce(f"c{side}", side))
        return pairs

    # Groups that a band joins are tried by a few of its pairs, those of most bands; whatever these don't show comes next.
    tried = best
    for _ in range(ROUNDS):
        rest = labelled(stars.join(tried, ["a", "b"], "left_anti"), label).where("ca <> cb")
        order = Window.partitionBy(F.least("ca", "cb"), F.greatest("ca", "cb")).orderBy(F.desc("hits"), F.xxhash64("a", "b"))
        some = rest.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= TRIED).select("a", "b")
        some = cut_lineage(some, "star-rest")
        if some.isEmpty():
            break
        links, tried = links.unionAll(linker.links(some)), tried.unionAll(some)
        label = cut_lineage(components(links), "labels")

    pairs = _across(shared, label, linker)
    if pairs is not None:
        links = links.unionAll(linker.links(pairs))
        label = cut_lineage(components(links), "labels")

    verdict = classes.join(label.withColumnRenamed("node", "head"), "head", "left").select(
        "n", "s1", "s2", F.coalesce("component", "head").alias("component")
    )
    verdict = cut_lineage(verdict, "class-components")
    judged = signed.select("id", "n", "s1", "s2").join(verdict.hint("merge"), ["n", "s1", "s2"], "left")
    component = F.coalesce("component", "id")
    return judged.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", **options) -> DataFrame:
    """``docs`` without near-duplicates: of each group of ``near_duplicates`` one row stays, with its columns.

    ``keep`` says whose: that of the ``smallest`` or the ``largest`` id. Rows are told apart by id and text: of repeated
    rows one stays, and of rows that share an id each belongs to its own text's group. A row without an id belongs to no
    group; of those of equal text one stays. Texts without words are no near-duplicates of each other.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"unknown: keep={keep}")
    body = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    own = F.xxhash64(F.col(f"`{id_col}`"), F.xxhash64(body))
    named = docs.withColumn(_OWN, own).withColumn(_MARK, F.xxhash64(body))
    # Of repeated rows the first by all columns; each task sends one on, however many it holds.
    place = F.row_number().over(Window.partitionBy(_OWN, _MARK).orderBy(F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in docs.columns])))
    named = named.withColumn(_PLACE, place).where(F.col(_PLACE) == 1).drop(_PLACE)
    known = F.col(f"`{id_col}`").isNotNull()
    judged = near_duplicates(docs.where(known).select(own.alias("id"), body.alias("body")), id_col="id", text_col="body", **options)
    judged = cut_lineage(judged.select("id", "component_id").distinct(), "judged-texts")
    ids = docs.select(own.alias("id"), F.xxhash64(body).alias("mark"), F.col(f"`{id_col}`").alias("doc")).distinct()
    best = F.min if keep == "smallest" else F.max
    chosen = ids.join(judged, "id").groupBy("component_id").agg(best(F.struct("doc", "id", "mark")).alias("m")).select("m.id", "m.mark")
    chosen = chosen.unionByName(ids.where("doc IS NULL").select("id", "mark"))
    chosen = cut_lineage(chosen.toDF(_TO, _TO_MARK), "kept-texts")
    same = (F.col(_OWN) == F.col(_TO)) & (F.col(_MARK) == F.col(_TO_MARK))
    return named.join(chosen.hint("merge"), same, "left_semi").drop(_OWN, _MARK)

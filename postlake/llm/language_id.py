"""Language identification: hashed subwords, averaged embeddings, a linear softmax.

The model is trained by stochastic gradient descent in numpy on a bounded sample of labelled rows. As the layers are
linear, an embedding and the output weights fold into one row of scores for each hash bucket; a text's scores are the
mean of its subwords' rows. Part of the sample is held back to fit a temperature and two thresholds of rejection: on the
probability, and on the share of a text's subwords that the sample holds at all, as a softmax is sure of itself on letters
that it has never seen.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlake.llm.common import text_chunks
from postlake.session import cut_lineage

UNKNOWN = "und"
SIZES = (2, 3, 4)
#: Bits of the hash by which a subword counts as known; those of an embedding's bucket are the first of them.
KNOWN_BITS = 20
_CHUNK = 256 << 10

#: Letters of ASCII in lower case and bytes of other characters; all else is a boundary.
_FOLD = np.zeros(256, np.uint32)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def subwords(offsets: np.ndarray, raw: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the byte runs of 2, 3 and 4 inside words, with one boundary allowed at either end."""
    n = len(offsets) - 1
    # A boundary between rows, and behind the last.
    room = np.zeros(len(raw) + n + 1, np.uint32)
    rows = np.repeat(np.arange(n), np.diff(offsets))
    room[np.arange(len(raw)) + rows + 1] = _FOLD[raw]
    owner = np.zeros(len(room), np.int64)
    owner[np.arange(len(raw)) + rows + 1] = rows
    all_rows, all_buckets = [], []
    for size in SIZES:
        m = len(room) - size + 1
        if m <= 0:
            continue
        value = room[:m].copy()
        for j in range(1, size):
            value |= room[j : m + j] << np.uint32(8 * j)
        use = (room[:m] != 0) | (room[size - 1 :] != 0)
        for j in range(1, size - 1):
            use &= room[j : m + j] != 0
        at = np.flatnonzero(use)
        # The row is that of a byte that is no boundary.
        inner = at + (room[at] == 0)
        all_rows.append(owner[inner])
        all_buckets.append(((value[at] ^ np.uint32(size * 0x3D4D51CB)) * np.uint32(2654435761)) >> np.uint32(32 - bits))
    if not all_rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(all_rows), np.concatenate(all_buckets).astype(np.int64)


@dataclass
class LanguageModel:
    languages: list[str]
    scores: np.ndarray  # bucket x language, float32
    bias: np.ndarray
    temperature: float
    threshold: float
    bits: int
    known: np.ndarray  # by the first KNOWN_BITS of a subword's hash
    least_known: float

    def probabilities(self, offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated probabilities of each row of a chunk, and its share of known subwords; without any it is uniform."""
        n = len(offsets) - 1
        rows, hashes = subwords(offsets, raw, KNOWN_BITS)
        buckets = hashes >> (KNOWN_BITS - self.bits)
        count = np.bincount(rows, minlength=n)
        share = np.bincount(rows, weights=self.known[hashes], minlength=n) / np.maximum(count, 1)
        logits = np.zeros((n, len(self.languages)))
        for c in range(len(self.languages)):
            logits[:, c] = np.bincount(rows, weights=self.scores[buckets, c], minlength=n)
        logits = logits / np.maximum(count, 1)[:, None] + self.bias
        logits[count == 0] = 0
        return _softmax(logits / self.temperature), share


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _features():
    """(label, body) to (label, buckets, counts), by the first KNOWN_BITS of the hash."""
    bits = KNOWN_BITS

    def count(batches):
        for batch in batches:
            for first, n, offsets, raw in text_chunks(batch.column(1), _CHUNK):
                rows, buckets = subwords(offsets, raw, bits)
                key, times = np.unique(rows << bits | buckets, return_counts=True)
                cuts = np.searchsorted(key, np.arange(n + 1) << bits).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, n),
                        pa.ListArray.from_arrays(pa.array(cuts), pa.array((key & ((1 << bits) - 1)).astype(np.int32))),
                        pa.ListArray.from_arrays(pa.array(cuts), pa.array(times.astype(np.int32))),
                    ],
                    ["label", "buckets", "counts"],
                )

    return count


def train(
    docs: DataFrame,
    max_rows: int = 3000,
    max_labels: int = 400,
    bits: int = 15,
    width: int = 16,
    epochs: int = 10,
    rate: float = 8.0,
    reject_share: float = 0.005,
    seed: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "lang",
) -> LanguageModel | None:
    """Fit on at most ``max_rows`` labelled rows, dealt evenly over the labels and chosen by the hash of their id and text.

    Rows without an id, label, or a letter of text are not used; None if no row is left. Rows of equal id, text and label
    are one. Of more than ``max_labels`` labels the most frequent are learned. The rows come to the driver as counts of
    their different subwords. A fifth of them is held back: it fits the temperature and the thresholds. That on the
    probability is the one below which ``reject_share`` of them fall, but 0.4 at most, as texts in two languages are near
    one half, and stay; that on known subwords is half of what all but ``reject_share`` of them reach.
    """
    usable = docs.where(F.col(f"`{id_col}`").isNotNull() & F.col(f"`{label_col}`").isNotNull() & F.col(f"`{text_col}`").rlike(r"\p{L}"))
    body = F.col(f"`{text_col}`")
    usable = usable.select(F.xxhash64(F.col(f"`{id_col}`"), body).alias("key"), F.col(f"`{label_col}`").alias("label"), body.alias("body"))
    often = usable.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(max_labels)
    often = {r.label: r.n for r in often.collect()}
    if not often:
        return None
    each = max(2, max_rows // len(often))
    # A hash bound for each label, at which some more rows than wanted are left: what is then ranked is bounded.
    bounds = docs.sparkSession.createDataFrame(
        [(k, min(2.0**63 - 1024, (4 * each + 40) / n * 2.0**64 - 2.0**63)) for k, n in often.items()], ["of", "bound"]
    )
    bounds = bounds.select(F.col("of").cast(usable.schema["label"].dataType).alias("of"), "bound")
    near = usable.select("key", "label").join(F.broadcast(bounds), F.col("label") == F.col("of")).where(F.col("key") <= F.col("bound"))
    order = Window.partitionBy("label").orderBy("key")
    chosen = near.select("key", "label").distinct().withColumn("place", F.row_number().over(order)).where(F.col("place") <= each)
    # max_rows pairs at most, two a label at least.
    chosen = cut_lineage(chosen.select("key", "label"), "language-sample")
    sample = usable.join(F.broadcast(chosen), ["key", "label"], "left_semi")
    ints = T.ArrayType(T.IntegerType())
    named = sample.select(F.struct("label", "key").alias("label"), "body")
    schema = T.StructType([named.schema["label"], T.StructField("buckets", ints), T.StructField("counts", ints)])
    rows = named.mapInArrow(_features(), schema).groupBy("label").agg(F.min(F.struct("buckets", "counts")).alias("f"))
    found = rows.select("label.key", F.col("label.label").alias("name"), "f.buckets", "f.counts").toArrow().combine_chunks()
    keys, names = found["key"].to_numpy(), found["name"].to_pylist()
    order = sorted(range(len(names)), key=lambda i: (keys[i], str(names[i])))
    lists = [(found["buckets"][i].values.to_numpy().astype(np.int64), found["counts"][i].values.to_numpy().astype(float)) for i in order]
    return _fit([names[i] for i in order], lists, bits, width, epochs, rate, reject_share, seed)


def _fit(
    names: list, rows: list[tuple[np.ndarray, np.ndarray]], bits: int, width: int, epochs: int, rate: float, reject_share: float, seed: int
) -> LanguageModel:
    """``rows``: (hashes of different subwords, how often each occurs)."""
    languages = sorted(set(names))
    kinds = np.array([languages.index(n) for n in names])
    hashes = [h for h, _ in rows]
    buckets = [h >> (KNOWN_BITS - bits) for h in hashes]
    weights = [c / max(1.0, c.sum()) for _, c in rows]
    back = np.arange(len(rows)) % 5 == 4
    draw = np.random.default_rng(seed)
    table = draw.uniform(-1 / width, 1 / width, (1 << bits, width))
    out, bias = np.zeros((width, len(languages))), np.zeros(len(languages))
    learn = np.flatnonzero(~back)
    known = np.zeros(1 << KNOWN_BITS, bool)
    for i in learn:
        known[hashes[i]] = True
    steps, step = epochs * -(-len(learn) // 16), 0
    for _ in range(epochs):
        draw.shuffle(learn)
        for at in range(0, len(learn), 16):
            some = learn[at : at + 16]
            ids = np.concatenate([buckets[i] for i in some])
            share = np.concatenate([weights[i] for i in some])
            owner = np.repeat(np.arange(len(some)), [len(buckets[i]) for i in some])
            parts = table[ids] * share[:, None]
            hidden = np.stack([np.bincount(owner, parts[:, d], len(some)) for d in range(width)], axis=1)
            wrong = _softmax(hidden @ out + bias)
            wrong[np.arange(len(some)), kinds[some]] -= 1
            pace = rate * (1 - step / steps)
            back_to = wrong @ out.T
            out -= pace * hidden.T @ wrong / len(some)
            bias -= 0.01 * pace * wrong.mean(axis=0)
            # Embeddings of frequent subwords move with their share of the text.
            moved = back_to[owner] * share[:, None] * (pace * 4)
            keys, where = np.unique(ids, return_inverse=True)
            table[keys] -= np.stack([np.bincount(where, moved[:, d], len(keys)) for d in range(width)], axis=1)
            step += 1
    scores = table @ out
    held = np.flatnonzero(back) if back.any() else np.arange(len(rows))
    logits = np.array([(scores[buckets[i]] * weights[i][:, None]).sum(axis=0) for i in held]) + bias
    tries = np.geomspace(0.02, 20, 60)
    loss = [-np.log(_softmax(logits / t)[np.arange(len(held)), kinds[held]] + 1e-12).mean() for t in tries]
    # Smoothed towards 1, so that a separable sample doesn't call for certainty everywhere.
    best = float(tries[int(np.argmin(np.array(loss) + 0.002 * np.log(tries) ** 2))])
    at = int(len(held) * reject_share)
    sure = np.sort(_softmax(logits / best).max(axis=1))
    share = np.sort([float((known[hashes[i]] * weights[i]).sum()) for i in held])
    return LanguageModel(languages, scores.astype(np.float32), bias, best, float(min(0.4, sure[at])), bits, known, float(share[at]) / 2)


def _has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _predictor(model: LanguageModel | None):
    def predict(batches):
        for batch in batches:
            texts = batch.column(1)
            for first, n, offsets, raw in text_chunks(texts, _CHUNK):
                known = np.array([_has_letter(t.as_py()) for t in texts.slice(first, n)], bool)
                if model is None:
                    names, sure, passed = [UNKNOWN] * n, np.zeros(n), np.zeros(n, bool)
                else:
                    chances, share = model.probabilities(offsets, raw)
                    top = chances.argmax(axis=1)
                    sure = np.where(known, chances[np.arange(n), top], 0.0)
                    names = [model.languages[k] if ok else UNKNOWN for k, ok in zip(top, known, strict=True)]
                    passed = known & (sure >= model.threshold) & (share >= model.least_known)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n), pa.array(names), pa.array(sure), pa.array(passed)],
                    ["row", "name", "sure", "passed"],
                )

    return predict


def identify(docs: DataFrame, model: LanguageModel | None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (calibrated probability) and ``accepted``; such input columns are replaced.

    * Null text, or text without a letter: ``und``, score 0, not accepted. So is all if ``model`` is None.
    * A text is accepted if its score, and its share of known subwords, reach the model's thresholds. Whole texts are
      read, of any length.
    * Only the text is read for it; other columns pass through.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").alias("body"))
    schema = T.StructType(
        [
            rows.schema["row"],
            T.StructField("name", T.StringType()),
            T.StructField("sure", T.DoubleType()),
            T.StructField("passed", T.BooleanType()),
        ]
    )
    out = rows.mapInArrow(_predictor(model), schema)
    new = {"lang_pred": "name", "score": "sure", "accepted": "passed"}
    return out.select(
        *[F.col("row").getField(c).alias(c) for c in docs.columns if c not in new], *[F.col(v).alias(k) for k, v in new.items()]
    )


def held_out(doc_id: Column) -> Column:
    """Whether an id belongs to the quarter that is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))

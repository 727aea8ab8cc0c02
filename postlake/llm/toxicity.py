"""Toxicity: gradient-boosted trees over dense features of a text, calibrated by isotonic regression.

All is fitted on a bounded sample of labelled rows. The lexicon counts words, and beginnings of words, by the number of
toxic and of clean documents that hold them. A word counts only if it stands behind three different words in toxic
documents, so that the words of one text with many copies don't pass for insults. For the trees and the calibration a
row's own share is taken out of the lexicon's counts.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlake.llm.common import slices, unfold, whole_row
from postlake.session import cut_lineage

#: Lengths of the beginnings of words that are counted beside whole words.
STEMS = (4, 5, 6)
#: Different words before it, from which on a word can enter the lexicon.
CONTEXTS = 3
#: Tokens that a task remembers, and words it holds counts of, before it lets them go or sends them on.
HELD = 400_000
#: Standard deviations by which the counts of a word are bent.
BENT = 1.5
#: Distance in words at which an insult counts as aimed at the reader.
NEAR = 6

# Second persons of the languages at hand, and signs that stand for letters.
SECOND_PERSON = frozenset(
    """you your yours yourself u ur du dich dir dein deine deinen ihr euch euer sie tu te toi ton ta tes vous votre vos
    tú ti usted ustedes vosotros vuestro contigo""".split()
)
SIGNS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "+": "t", "|": "l"})

_OUTER = re.compile(r"^[\W_]+|[\W_]+$")
_NO_LETTER = re.compile(r"[\W\d_]+")
_LONG_RUN = re.compile(r"(\w)\1{2,}")
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[i for i in range(33, 127) if not chr(i).isalnum()]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[i for i in range(128) if chr(i).isalpha()]] = True


def read_token(token: str) -> tuple[str, bool]:
    """The word in a token between blanks, in lower case, and whether signs inside it disguise it."""
    core = token if token.isalpha() else _OUTER.sub("", token)
    if core.isalpha():
        return core.lower(), False
    letters = sum(map(str.isalpha, core))
    if letters < 2 or 2 * letters < len(core):
        return core.lower(), False
    # Signs that stand for letters, or part them: "st*pid", "1d1ot", "s.c.u.m".
    return _NO_LETTER.sub("", _LONG_RUN.sub(r"\1", core.lower().translate(SIGNS))), True


def words_of(text: str | None, known: dict[str, str]) -> list[str]:
    """The words of a text in order; ``known`` remembers tokens."""
    if len(known) > HELD:
        known.clear()
    out = []
    for token in (text or "").split():
        word = known.get(token)
        if word is None:
            word = known[token] = read_token(token)[0]
        if word:
            out.append(word)
    return out


def forms(word: str) -> list[str]:
    """A word, and its beginnings marked by ``*``."""
    return [word, *[word[:n] + "*" for n in STEMS if len(word) > n]]


#: Features, in order.
FEATURES = (
    "length", "weight_per_word", "greatest_weight", "third_weight", "hits", "strong_hits", "strong_share", "kinds",
    "aimed_hits", "second_person", "capitals", "shouted", "exclamations", "questions", "punctuation", "repeated_signs",
    "disguised", "disguised_hits", "stretched", "digits", "word_length",
)


@dataclass
class Lexicon:
    """Counts of toxic and clean documents by word or beginning."""

    counts: dict[str, tuple[int, int]]
    toxic: int
    clean: int
    _weights: dict = field(default_factory=dict, repr=False)

    @functools.cached_property
    def heads(self) -> frozenset[str]:
        """How the words begin; most words begin otherwise."""
        return frozenset(w[: min(STEMS)] for w in self.counts)

    def weight(self, toxic: int, clean: int) -> float:
        """Log odds ratio of the shares, each bent towards the other by its uncertainty; 0 below two toxic documents."""
        key = (toxic, clean)
        if key not in self._weights:
            often = max(0.1, toxic + 0.5 - BENT * toxic**0.5) / (self.toxic + 1)
            rarely = (clean + 0.5 + BENT * (clean + 0.25) ** 0.5) / (self.clean + 1)
            self._weights[key] = max(0.0, float(np.log(often / rarely))) if toxic >= 2 else 0.0
        return self._weights[key]

    def score(self, word: str, label: int | None = None) -> float:
        """Weight of a word: its own, or that of a beginning. ``label``: of the document it comes from, left out."""
        best = 0.0
        if word[: min(STEMS)] not in self.heads:
            return best
        for form in forms(word):
            found = self.counts.get(form)
            if found is not None:
                t, c = found
                if label is not None:
                    t, c = t - label, c - (1 - label)
                best = max(best, self.weight(t, c))
        return best


class Featurizer:
    """Text to features. What a token is, is found once: most are plain words of no weight, and cost one look-up."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.codes: dict[int | None, dict[str, int]] = {None: {}, 0: {}, 1: {}}
        self.facts: list[tuple[str, float, bool, bool, bool]] = []

    def _code(self, token: str, label: int | None) -> int:
        """0 for a plain word, else the place of (word, weight, second person, disguised, shouted)."""
        word, disguised = read_token(token)
        weight = self.lexicon.score(word, label) if word else 0.0
        fact = (word, weight, word in SECOND_PERSON, disguised, len(token) > 2 and token.isupper())
        if not any(fact[1:]):
            return 0
        self.facts.append(fact)
        return len(self.facts)

    def __call__(self, text: str | None, label: int | None = None) -> list[float]:
        text = text or ""
        tokens = text.split()
        if sum(map(len, self.codes.values())) > HELD:
            self.codes, self.facts = {None: {}, 0: {}, 1: {}}, []
        codes = self.codes[label]
        for token in set(tokens).difference(codes):
            codes[token] = self._code(token, label)
        found = [codes[token] for token in tokens]
        n = max(1, len(tokens))
        at = np.flatnonzero(found)
        facts = [self.facts[found[i] - 1] for i in at]
        weights = np.array([f[1] for f in facts])
        top = np.sort(weights)[::-1]
        is_strong = weights >= 3
        strong, second = at[is_strong], at[np.array([f[2] for f in facts], bool)]
        aimed = 0
        if len(strong) and len(second):
            place = np.searchsorted(second, strong)
            before, after = second[np.maximum(place - 1, 0)], second[np.minimum(place, len(second) - 1)]
            aimed = int(((np.abs(strong - before) <= NEAR) | (np.abs(strong - after) <= NEAR)).sum())
        disguised = np.array([f[3] for f in facts], bool)
        raw = np.frombuffer(text.encode(), np.uint8)
        signs = np.bincount(raw, minlength=256)
        mark = _PUNCTUATION[raw]
        same = raw[1:] == raw[:-1]
        thrice = same[1:] & same[:-1] & _LETTER[raw[2:]]
        upper, lower = int(signs[65:91].sum()), int(signs[97:123].sum())
        return [
            float(np.log1p(len(tokens))),
            float(weights.sum()) / n,
            float(top[0]) if len(top) else 0.0,
            float(top[2]) if len(top) > 2 else 0.0,
            float(np.log1p((weights >= 1).sum())),
            float(np.log1p(len(strong))),
            len(strong) / n,
            float(len({f[0] for f, s in zip(facts, is_strong, strict=True) if s})),
            float(aimed),
            len(second) / n,
            upper / max(1, upper + lower),
            sum(f[4] for f in facts) / n,
            signs[33] / n,
            signs[63] / n,
            int(signs[_PUNCTUATION].sum()) / max(1, len(raw)),
            int((mark[1:] & same).sum()) / n,
            int(disguised.sum()) / n,
            float((disguised & is_strong).sum()),
            int((thrice[1:] & ~thrice[:-1]).sum() + (len(thrice) > 0 and thrice[0])) / n,
            int(signs[48:58].sum()) / max(1, len(raw)),
            len(raw) / n,
        ]


@dataclass
class Trees:
    """Complete binary trees: inner nodes by level, leaves behind them; a row goes right where above the threshold."""

    features: np.ndarray  # trees x inner nodes
    thresholds: np.ndarray
    leaves: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        rows, out = np.arange(len(x)), np.full(len(x), self.base)
        inner = self.features.shape[1]
        for feature, threshold, leaf in zip(self.features, self.thresholds, self.leaves, strict=True):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += leaf[node - inner]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 64, ridge: float = 3.0) -> Trees:
    """Newton boosting of the logistic loss over binned features; a leaf has one row in 200 at least, or five."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    n, wide = x.shape
    weight, least = weight / weight.mean(), max(5, n // 200)
    share = np.clip((weight * y).sum() / weight.sum(), 1e-4, 1 - 1e-4)
    base = float(np.log(share / (1 - share)))
    margin, inner = np.full(n, base), 2**depth - 1
    flat = binned + np.arange(wide) * bins
    all_features, all_thresholds, all_leaves = [], [], []
    for _ in range(trees):
        chance = 1 / (1 + np.exp(-margin))
        slope, bend = weight * (y - chance), weight * chance * (1 - chance)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first = 2**level - 1
            for k in range(first, 2 * first + 1):
                rows = np.flatnonzero(node == k)
                if len(rows) < 2:
                    continue
                cells = flat[rows].ravel()
                g = np.bincount(cells, np.repeat(slope[rows], wide), wide * bins).reshape(wide, bins).cumsum(axis=1)
                h = np.bincount(cells, np.repeat(bend[rows], wide), wide * bins).reshape(wide, bins).cumsum(axis=1)
                c = np.bincount(cells, minlength=wide * bins).reshape(wide, bins).cumsum(axis=1)
                rest_g, rest_h, rest = g[:, -1:] - g, h[:, -1:] - h, c[:, -1:] - c
                gain = g**2 / (h + ridge) + rest_g**2 / (rest_h + ridge) - g[:, -1:] ** 2 / (h[:, -1:] + ridge)
                gain[(c < least) | (rest < least)] = 0
                j, b = divmod(int(gain.argmax()), bins)
                if gain[j, b] > 0.1 and b < len(cuts[j]):
                    feature[k], threshold[k] = j, cuts[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        leaf = node - inner
        g, h = np.bincount(leaf, slope, inner + 1), np.bincount(leaf, bend, inner + 1)
        step = rate * g / (h + ridge)
        margin = margin + step[leaf]
        all_features.append(feature)
        all_thresholds.append(threshold)
        all_leaves.append(step)
    return Trees(np.array(all_features), np.array(all_thresholds), np.array(all_leaves), base)


def isotonic(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of a rising curve from margin to share: pooled adjacent violators, shares smoothed towards the mean."""
    order = np.argsort(margin, kind="stable")
    mean = float((weight * y).sum() / weight.sum())
    blocks: list[list[float]] = []  # weight, weighted labels, lowest and greatest margin
    for i in order:
        if blocks and margin[i] == blocks[-1][3]:
            blocks[-1][0] += weight[i]
            blocks[-1][1] += weight[i] * y[i]
        else:
            blocks.append([weight[i], weight[i] * y[i], margin[i], margin[i]])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            w, s, _, high = blocks.pop()
            blocks[-1] = [blocks[-1][0] + w, blocks[-1][1] + s, blocks[-1][2], high]
    points, shares = [], []
    for w, s, low, high in blocks:
        share = (s + mean) / (w + 1)
        points += [low, high] if high > low else [low]
        shares += [share, share] if high > low else [share]
    return np.array(points), np.maximum.accumulate(shares)


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    trees: Trees | None
    points: np.ndarray
    shares: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        margin = self.trees.margin(x) if self.trees else np.zeros(len(x))
        return np.interp(margin, self.points, self.shares)


def _toxic_words(batches):
    """(word, context, n): documents by word, and up to CONTEXTS hashes of the word before it."""
    known, held = {}, {}

    def rows():
        out = [(w, c, n if k == 0 else 0) for w, (n, cs) in held.items() for k, c in enumerate(sorted(cs))]
        held.clear()
        columns = zip(zip(*out, strict=True), (pa.string(), pa.int32(), pa.int64()), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], ["word", "context", "n"])

    for batch in slices(batches):
        for text in batch.column(0).to_pylist():
            last, seen = "", set()
            for word in words_of(text, known):
                context = zlib.crc32(last.encode()) & 0x7FFFFFFF
                for form in forms(word):
                    entry = held.setdefault(form, [0, set()])
                    if form not in seen:
                        seen.add(form)
                        entry[0] += 1
                    if len(entry[1]) < CONTEXTS:
                        entry[1].add(context)
                last = word
        if len(held) > HELD:
            yield rows()
    if held:
        yield rows()


def _count_words(chosen: frozenset):
    def count(batches):
        known, held = {}, Counter()
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                held.update({f for w in set(words_of(text, known)) for f in forms(w) if f in chosen})
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    return count


def labelled(
    docs: DataFrame, labels: DataFrame, max_rows: int = 12_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"
) -> tuple[DataFrame, dict[int, int]]:
    """(key, toxic, text) of ``max_rows`` judged rows at most, written, and how many rows of each kind there are.

    A row is toxic if one of several labels of its id says so. Rows of equal id and text are one, so copies of a row don't
    count twice. A third of the sample is toxic where there are as many; rows are chosen by the hash ``key`` of id and
    text. Labels meet hashes of rows; only the sample's texts are moved, found by its keys, which go to all tasks.
    """
    judged = labels.where(F.col(f"`{label_col}`").isNotNull() & F.col(f"`{id_col}`").isNotNull())
    judged = judged.groupBy(F.col(f"`{id_col}`").alias("judged")).agg(F.max((F.col(f"`{label_col}`").cast("int") != 0).cast("int")).alias("toxic"))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows = rows.select("id", F.xxhash64("id", "text").alias("key"), "text")
    keys = rows.select("id", "key").join(judged, F.col("id") == F.col("judged")).groupBy("key").agg(F.max("toxic").alias("toxic"))
    keys = cut_lineage(keys, "judged-keys")
    number = {0: 0, 1: 0} | {r.toxic: r.n for r in keys.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    most = {1: min(number[1], max(max_rows // 3, max_rows - number[0]))}
    most[0] = min(number[0], max_rows - most[1])
    some = [keys.where(F.col("toxic") == kind).orderBy("key").limit(n) for kind, n in most.items()]
    chosen = cut_lineage(some[0].unionByName(some[1]), "chosen-keys")
    # max_rows keys at most, of 12 bytes.
    texts = rows.select("key", "text").join(F.broadcast(chosen), "key").groupBy("key", "toxic").agg(F.min("text").alias("text"))
    return cut_lineage(texts, "toxicity-sample"), number


def train(sample: DataFrame, number: dict[int, int], max_words: int = 5000, max_candidates: int = 50_000) -> ToxicityModel | None:
    """Fit on what :func:`labelled` gives; None without rows of both kinds.

    Words are counted over the whole sample: the ``max_candidates`` words of most toxic documents in clean ones as well,
    of which the ``max_words`` of most evidence are kept. The trees see the features of the sample, with weights that
    restore the shares of ``number``; every fifth row is held back for the calibration. The driver gets those counts and
    features.
    """
    if not number.get(0) or not number.get(1):
        return None
    found = sample.where("toxic = 1").select("text").mapInArrow(_toxic_words, "word string, context int, n long")
    found = found.groupBy("word", "context").agg(F.sum("n").alias("n")).groupBy("word").agg(F.sum("n").alias("t"), F.count("*").alias("contexts"))
    found = found.where((F.col("contexts") >= CONTEXTS) & (F.col("t") >= 2)).orderBy(F.desc("t"), "word").limit(max_candidates)
    toxic = {r.word: r.t for r in found.collect()}
    counter = _count_words(frozenset(toxic))
    seen = sample.where("toxic = 0").select("text").mapInArrow(counter, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    clean = {r.word: r.n for r in seen.collect()}  # no more than the candidates
    size = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    lexicon = Lexicon({}, size[1], size[0])
    weights = {w: lexicon.weight(t, clean.get(w, 0)) for w, t in toxic.items()}
    best = sorted((w for w in weights if weights[w] > 0.7), key=lambda w: (-weights[w] * toxic[w], w))[:max_words]
    lexicon.counts = {w: (toxic[w], clean.get(w, 0)) for w in best}
    rows = sample.select("key", "toxic", "text").mapInArrow(_featurize(lexicon), "key long, toxic int, x array<double>").collect()
    rows.sort(key=lambda r: (r.key, r.toxic))
    x, y = np.array([r.x for r in rows]), np.array([r.toxic for r in rows], float)
    weight = np.where(y == 1, number[1] / y.sum(), number[0] / (1 - y).sum())
    back = np.zeros(len(y), bool)
    for kind in (0, 1):
        back[np.flatnonzero(y == kind)[4::5]] = True
    if not y[back].any() or y[back].all():
        back[:] = False
    trees = fit_trees(x[~back], y[~back], weight[~back])
    held = back if back.any() else ~back
    points, shares = isotonic(trees.margin(x[held]), y[held], weight[held] / weight[held].mean())
    return ToxicityModel(lexicon, trees, points, shares)


def _featurize(lexicon: Lexicon):
    def run(batches):
        features = Featurizer(lexicon)
        for batch in slices(batches):
            found = [features(t, k) for t, k in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.float64()))], ["key", "toxic", "x"])

    return run


def judge(docs: DataFrame, model: ToxicityModel | None, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """``docs`` with ``score`` (calibrated, 0 to 1) and ``predicted`` (1 from ``least`` on); such input columns are replaced.

    Every text is read whole; a null text counts as empty and gets the score of an empty one. Without a model the score
    is 0. Rows are judged one by one, so repeated rows, ids and other columns play no part.
    """
    rows = docs.select(whole_row(docs).alias("row"), F.col(f"`{text_col}`").alias("body"))
    if model is None:
        scored = rows.select("row", F.lit(0.0).alias("score"))
    else:

        def score(batches):
            features = Featurizer(model.lexicon)
            for batch in slices(batches):
                x = np.array([features(t) for t in batch.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(x))], ["row", "score"])

        scored = rows.mapInArrow(score, T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())]))
    return unfold(scored, "row", docs.columns, score=F.col("score"), predicted=(F.col("score") >= least).cast("int"))


def held_out(doc_id: Column) -> Column:
    """Whether an id belongs to the fifth whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))

"""Personal data by weak supervision, with DataFrame functions only.

Patterns propose spans. Labelers (patterns with their checks, gazetteers, the words in front, the form) vote for or
against each proposal or abstain. Expectation-maximisation over the counts of vote patterns, which are few whatever
the corpus, estimates how reliable each labeler is. The posteriors are soft labels for a logistic span classifier over
votes, kind and length, which decides on the proposals that are no base match. Base matches always stay.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlake.llm.common import hex_lines
from postlake.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")

# Patterns as Java reads them. Possessive runs never give characters back, which the base patterns never need, and the
# guards in front only rule out starts inside a run whose own start has failed; so the matches are those of the plain
# patterns, in linear time and without recursion on long runs.
_LOCAL = r"A-Za-z0-9._%+-"
_EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

#: Proposals beyond the base patterns: (kind, pattern).
_MORE = (
    ("email", rf"(?<![{_LOCAL}])[{_LOCAL}]++ ?(?:\[at\]|\(at\)) ?[A-Za-z0-9-]++(?: ?(?:\.|\[dot\]|\(dot\)) ?[A-Za-z0-9-]++)++"),
    ("ip", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    ("phone", r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9.-]*[0-9])"),
)

#: Words in front that speak for a kind, and such as speak against any. Fixed lists of the labelers.
_FOR = {
    "email": "e-?mail|mail|contact|write to|kontakt|courriel|correo",
    "ip": "ip|address|host|server|login from|adresse|servidor",
    "card": "card|visa|mastercard|credit|karte|carte|tarjeta",
    "phone": "phone|tel|telephone|call|mobile|fax|telefon|teléfono|téléphone",
}
_AGAINST = "version|v|release|token|key|hash|isbn|order|serial|invoice|sha1|md5"
#: Gazetteers: common top-level domains, and the first digits of card networks.
_DOMAINS = "com|org|net|edu|gov|de|fr|es|uk|eu|io|info|co"
_NETWORKS = "^(?:4|5[1-5]|2[2-7]|3[47]|6)"
#: Characters in front of a span that the context labelers read.
_FRONT = 32

LABELERS = ("pattern", "checksum", "gazetteer", "context_for", "context_against", "form")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    parts = F.transform(
        F.split(F.reverse(digits), ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)),
    )
    return F.aggregate(parts, F.lit(0), lambda a, x: a + x) % 10 == 0


def _found(frame: DataFrame, kind: str, pattern: str, base: bool, needs: str) -> DataFrame:
    """Matches of one pattern with their start in code points and the text in front."""
    text = pattern.replace("\\", "\\\\").replace("'", "\\'")
    cut = frame.where(F.col("body").rlike(needs)).select(
        "id", "mark", F.expr(f"regexp_extract_all(body, '{text}', 0)").alias("m"), F.expr(f"split(body, '{text}', -1)").alias("g")
    )
    each = f"transform(m, (x, i) -> named_struct('nth', i, 'gap', length(get(g, i)), 'front', right(get(g, i), {_FRONT}), 'value', x))"
    rows = cut.select("id", "mark", F.expr(f"inline({each})"))
    return rows.select(F.lit(kind).alias("kind"), F.lit(base).alias("base"), "id", "mark", "nth", "gap", "front", "value")


def _spans(frame: DataFrame) -> DataFrame:
    """All proposals: id, mark, kind, base, front, value, start, end. Base ones passed their checks; others touch no base one."""
    plans = [
        _found(frame, "email", _EMAIL, True, "@"),
        _found(frame, "ip", _IP, True, r"[0-9]\.[0-9]"),
        _found(frame, "card", _CARD, True, "[0-9]"),
        _found(frame, "phone", _PHONE, True, r"\+[0-9]"),
    ]
    needs = {"email": r"(?i)\bat[\])]", "ip": "[0-9A-Fa-f]:[0-9A-Fa-f]", "phone": r"[0-9]{3}[.-][0-9]{4}"}
    plans += [_found(frame, kind, pattern, False, needs[kind]) for kind, pattern in _MORE]
    found = reduce(DataFrame.unionAll, plans)
    # Rows that repeat a document propose the same; one of each is enough to place them.
    found = cut_lineage(found.dropDuplicates(["id", "mark", "kind", "base", "nth"]), "matches")
    so_far = Window.partitionBy("id", "mark", "kind", "base").orderBy("nth")
    size = F.char_length("value")
    found = found.withColumn("end", F.sum(F.col("gap") + size).over(so_far).cast("long"))
    found = found.withColumn("start", F.col("end") - size)
    digits = F.regexp_replace("value", "[^0-9]", "")
    n = F.char_length(digits)
    octets = F.forall(F.split("value", r"\."), lambda p: F.coalesce(F.ltrim(p, F.lit("0")).rlike("^([0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"), F.lit(False)))
    passes = (
        F.when(~F.col("base"), True)
        .when(F.col("kind") == "ip", octets)
        .when(F.col("kind") == "card", n.between(13, 19) & luhn(F.when(n <= 19, digits).otherwise("0")))
        .when(F.col("kind") == "phone", n.between(9, 15))
        .otherwise(True)
    )
    # Digits of card length that fail the check are proposals for the classifier.
    failed = F.col("base") & (F.col("kind") == "card") & n.between(13, 19) & ~passes
    found = found.where(passes | failed).withColumn("base", F.col("base") & ~failed)
    found = cut_lineage(found.select("id", "mark", "kind", "base", "front", "value", "start", "end"), "proposals")
    base = found.where("base").select("id", "mark", F.col("start").alias("s"), F.col("end").alias("e"))
    clear = found.where("NOT base").join(
        base.withColumnRenamed("id", "id2").withColumnRenamed("mark", "mark2"),
        F.col("id").eqNullSafe(F.col("id2")) & (F.col("mark") == F.col("mark2")) & (F.col("start") < F.col("e")) & (F.col("s") < F.col("end")),
        "left_anti",
    )
    return found.where("base").unionAll(clear)


def _votes(spans: DataFrame) -> DataFrame:
    """``spans`` with the labelers' votes: 1 for, -1 against, 0 abstains."""
    kind, value, front = F.col("kind"), F.col("value"), F.lower("front")
    digits = F.regexp_replace("value", "[^0-9]", "")
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    near = lambda words: front.rlike(rf"(?:^|[^\p{{L}}])(?:{words})[ .:=#\"'(]*$")
    positive = reduce(or_, [(kind == k) & near(words) for k, words in _FOR.items()])
    card = kind == "card"
    network = F.regexp_extract("value", r"\.([A-Za-z]+)$", 1)
    return spans.withColumns(
        {
            "pattern": vote(F.col("base"), F.lit(False)),
            "checksum": vote(card & F.col("base"), card & ~F.col("base")),
            "gazetteer": vote(
                ((kind == "email") & F.lower(network).rlike(f"^(?:{_DOMAINS})$")) | (card & digits.rlike(_NETWORKS)),
                (card & ~digits.rlike(_NETWORKS)) | ((kind == "ip") & value.rlike(r"^(?:0|10|127|192\.168)\.")),
            ),
            "context_for": vote(positive, F.lit(False)),
            "context_against": vote(F.lit(False), near(_AGAINST)),
            "form": vote(
                ((kind == "phone") & value.rlike(r"[ .-][0-9]{3}[ .-][0-9]{4}$")) | (card & value.rlike(r"^[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]+$")),
                (kind == "phone") & value.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"),
            ),
            "width": F.least(F.floor(F.log2(F.char_length("value").cast("double"))), F.lit(7)).cast("int"),
        }
    )


def _posterior(rows: list, rounds: int = 40) -> tuple[list[float], dict]:
    """Two-class expectation-maximisation over rows (votes, count); labelers are independent given the class.

    A labeler that abstains says nothing: only its votes for and against are modelled.
    """
    guess = []
    for r in rows:
        total = sum(r["votes"])
        guess.append(0.9 if total > 0 else 0.1 if total < 0 else 0.5)
    chance = {}
    for _ in range(rounds):
        mass = [1.0 + sum(r["n"] * (p if c else 1 - p) for r, p in zip(rows, guess, strict=True)) for c in (0, 1)]
        chance = {}
        for j in range(len(LABELERS)):
            for c in (0, 1):
                said = {v: sum(r["n"] * (p if c else 1 - p) for r, p in zip(rows, guess, strict=True) if r["votes"][j] == v) for v in (-1, 1)}
                for v in (-1, 1):
                    # A labeler is taken to be right more often than wrong before any data.
                    prior = 3.0 if v == 2 * c - 1 else 1.0
                    chance[j, c, v] = (said[v] + prior) / (said[-1] + said[1] + 4.0)
        guess = []
        for r in rows:
            log = [math.log(mass[c]) + sum(math.log(chance[j, c, v]) for j, v in enumerate(r["votes"]) if v) for c in (0, 1)]
            guess.append(1 / (1 + math.exp(min(60.0, log[0] - log[1]))))
    return guess, chance


def _features(kind: str, width: int, votes: tuple) -> list[str]:
    return ["bias", f"kind:{kind}", f"width:{width}"] + [f"{name}:{v}" for name, v in zip(LABELERS, votes, strict=True) if v]


def train(spans: DataFrame, rounds: int = 300, rate: float = 0.5) -> dict[str, float]:
    """Weights of the span classifier. The driver sees counts of (kind, width, votes): 4 * 8 * 3 ** 6 rows at most."""
    groups = spans.groupBy("kind", "width", *LABELERS).count().collect()
    rows = sorted(({"kind": g["kind"], "width": g["width"], "votes": tuple(g[c] for c in LABELERS), "n": g["count"]} for g in groups), key=str)
    if not rows:
        return {}
    soft, _ = _posterior(rows)
    total = sum(r["n"] for r in rows)
    names = [_features(r["kind"], r["width"], r["votes"]) for r in rows]
    weights = dict.fromkeys((f for own in names for f in own), 0.0)
    for _ in range(rounds):
        slope = {f: 1e-4 * w for f, w in weights.items()}
        for r, own, p in zip(rows, names, soft, strict=True):
            wrong = (1 / (1 + math.exp(-sum(weights[f] for f in own))) - p) * r["n"] / total
            for f in own:
                slope[f] += wrong
        for f in weights:
            weights[f] -= rate * slope[f]
    return weights


def _probability(weights: dict[str, float]) -> Column:
    score = F.lit(weights.get("bias", 0.0))
    for name, weight in sorted(weights.items()):
        field, _, value = name.partition(":")
        if value:
            score = score + F.when(F.col(field).cast("string") == value, F.lit(weight)).otherwise(0.0)
    return 1 / (1 + F.exp(-score))


def find_personal_data(docs: DataFrame, least: float = 0.9, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of ``docs``: its id and ``spans``, an array of (kind, start, end, base, probability).

    Spans are ordered by kind (email, ip, card, phone), then start; positions are code points, the end exclusive. Base
    matches always stay. Another proposal is added if it touches no base match, the classifier gives it ``least`` or
    more, and some labeler other than a pattern speaks for it.

    * Null text is empty and has no spans. Rows that repeat, or lack an id, are judged each by its text.
    * Without proposals there is no classifier and nothing is added. Other columns are not read.
    """
    frame = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("body"))
    frame = frame.withColumn("mark", F.xxhash64("body"))
    voted = cut_lineage(_votes(_spans(frame)), "votes")
    weights = train(voted)
    spoken = reduce(or_, [F.col(c) > 0 for c in LABELERS[1:]])
    chosen = voted.withColumn("probability", _probability(weights)).where(F.col("base") | ((F.col("probability") >= least) & spoken))
    place = reduce(lambda c, k: c.when(F.col("kind") == k[1], k[0]), enumerate(KINDS), F.when(F.lit(False), -1))
    lists = chosen.groupBy("id", "mark").agg(
        F.sort_array(F.collect_list(F.struct(place.alias("place"), "start", "end", "kind", "base", "probability"))).alias("spans")
    )
    lists = lists.select(
        F.col("id").alias("id2"),
        F.col("mark").alias("mark2"),
        F.expr("transform(spans, s -> named_struct('kind', s.kind, 'start', s.start, 'end', s.end, 'base', s.base, 'probability', s.probability))").alias("spans"),
    )
    lists = cut_lineage(lists, "span-lists")
    out = frame.select("id", "mark").join(lists, F.col("id").eqNullSafe(F.col("id2")) & (F.col("mark") == F.col("mark2")), "left")
    none = F.expr("CAST(array() AS array<struct<kind:string,start:bigint,end:bigint,base:boolean,probability:double>>)")
    return out.select(F.col("id").alias(id_col), F.coalesce("spans", none).alias("spans"))


def span_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Numbers of base spans by kind, the hash of the base spans' list, and the list of all spans."""
    written = "transform({}, s -> s.kind || ':' || s.start || ':' || s.end)"
    counts = [F.size(F.expr(f"filter(spans, s -> s.base AND s.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(
        id_col,
        *counts,
        hex_lines(F.expr(written.format("filter(spans, s -> s.base)"))).alias("base_sha256"),
        F.array_join(F.expr(written.format("spans")), ",").alias("spans"),
    )

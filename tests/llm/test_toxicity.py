import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlake.llm import queries, toxicity
from postlake.llm.toxicity import Featurizer, Lexicon, fit_trees, forms, isotonic, judge, labelled, read_token, train, words_of

INSULTS = ["grolbix", "snarfo", "wretchulent", "blarg"]


def corpus(n=700, seed=3):
    """Invented words; a tenth of the rows have insults at random places; a third of the labels are missing."""
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choice("abcdeimnorstu") for _ in range(draw.randrange(2, 9))) for _ in range(900)]
    docs, labels = [], []
    for i in range(n):
        words = [draw.choice(vocabulary) for _ in range(draw.randrange(5, 80))]
        toxic = i % 10 == 0
        if toxic:
            for _ in range(draw.randrange(2, 5)):
                words.insert(draw.randrange(len(words)), draw.choice(INSULTS) + draw.choice(["", "", ".", "ak"]))
        docs.append((i, " ".join(words)))
        if i % 3:
            labels.append((i, 1, int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus()
    return (
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
        {i for i, _ in docs if i % 10 == 0},
    )


@pytest.fixture(scope="module")
def model(tables):
    docs, labels, _ = tables
    return train(*labelled(docs.where(~toxicity.held_out(F.col("doc_id"))), labels))


def test_held_out_rows(spark, tables, model):
    docs, _, toxic = tables
    held = docs.where(toxicity.held_out(F.col("doc_id")))
    assert {r.doc_id for r in held.collect()} == {i for i in range(700) if zlib.crc32(str(i).encode()) % 5 == 0}
    found = judge(held, model).collect()
    hit = {r.doc_id for r in found if r.predicted}
    want = {r.doc_id for r in found} & toxic
    assert len(hit & want) >= 0.9 * len(want) and len(hit - want) <= 0.01 * len(found)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)


def test_counts_are_those_of_brute_force(spark, tables):
    docs, labels, toxic = tables
    got = train(*labelled(docs, labels)).lexicon
    texts = {r.doc_id: r.text for r in docs.collect()}
    known = {r.doc_id: r.toxic for r in labels.collect()}
    assert (got.toxic, got.clean) == (sum(known.values()), len(known) - sum(known.values()))
    sets = {i: {f for w in words_of(texts[i], {}) for f in forms(w)} for i in known}
    assert {"snarfo", "snar*", "grolbix"} <= set(got.counts)
    for word, (t, c) in got.counts.items():
        assert (t, c) == (sum(word in sets[i] for i in known if known[i]), sum(word in sets[i] for i in known if not known[i]))


def test_words_of_one_copied_text_are_no_insults(spark):
    docs, labels = corpus()
    text = "oneoff zyxwords standing always inthe same order"
    extra = list(range(10_000, 10_040))
    docs = spark.createDataFrame([*docs, *[(i, f"{text} {i}") for i in extra]], "doc_id long, text string")
    labels = spark.createDataFrame([*labels, *[(i, 1, 1) for i in extra]], "doc_id long, quality int, toxic int")
    counts = train(*labelled(docs, labels)).lexicon.counts
    assert "zyxwords" not in counts and "snarfo" in counts


def test_odd_rows(spark, make_docs, odd_rows, model):
    given = make_docs([*odd_rows, (99, "SNARFO!!! snarfo " * 40), (98, "😀 \x00 é")])
    out = judge(given, model)
    assert out.columns == [c for c in given.columns if c != "score"] + ["score", "predicted"]
    rows = out.collect()
    assert len(rows) == len(odd_rows) + 2 and all(0 <= r.score <= 1 and (r.body, r.id) == ("b", 7) for r in rows)
    empty = {r.score for r in rows if not (r.text or "").split()}
    assert len({r.score for r in rows if not r.text}) == 1 and empty
    assert judge(make_docs([]), model).count() == 0
    assert [(r.score, r.predicted) for r in judge(make_docs([(1, "x"), (2, None)]), None).collect()] == [(0.0, 0)] * 2


def test_labels_that_repeat_clash_or_lack(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, None), (3, "c"), (None, "d"), (4, "e")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, None), (None, 1), (2, None)], "doc_id long, toxic int")
    sample, number = labelled(docs, labels)
    assert sorted((r.text, r.toxic) for r in sample.collect()) == [("", 0), ("a", 1), ("b", 1)] and number == {0: 1, 1: 2}
    assert train(*labelled(docs, labels.where("toxic = 0"))) is None
    assert train(*labelled(docs.limit(0), labels)) is None


def test_the_sample_is_bounded(spark, tables):
    """Whatever the number of labelled rows, and of copies of one row."""
    docs, labels, _ = tables
    many = docs.unionByName(docs.where("doc_id = 10").join(spark.range(500).select(), how="cross"))
    sample, number = labelled(many, labels, max_rows=60)
    assert sample.count() == 60 and sample.where("toxic = 1").count() == 20
    assert number[0] + number[1] == labels.select("doc_id").distinct().count()
    assert train(sample, number).lexicon.toxic == 20


def test_words_and_disguise():
    found = ["stupid", "stpid", "idiot", "scum", "x2", "42", "the"]
    assert words_of("Stupid, st*pid 1d1ot s.c.u.m x2 42 -- THE&&&", {}) == found
    assert [read_token(t)[1] for t in ("plain", "1d1ot", "s.c.u.m", "(well)")] == [False, True, True, False]
    lexicon = Lexicon({"idiot": (40, 0), "lowe*": (9, 0), "the": (30, 300)}, 50, 500)
    features = Featurizer(lexicon)
    at = dict(zip(toxicity.FEATURES, features("you 1d1ot LOWELY the " + "word " * 30), strict=True))
    assert at["disguised_hits"] == 1 and at["aimed_hits"] >= 1 and at["kinds"] == 2 and at["strong_hits"] > 0
    assert lexicon.score("the") < 1 < lexicon.score("lowely") < lexicon.score("idiot")
    # A row's own share is left out.
    assert Lexicon({"once": (2, 0)}, 50, 500).score("once", 1) == 0


def test_trees_and_calibration():
    draw = np.random.default_rng(2)
    x = draw.normal(size=(2000, 4))
    y = ((x[:, 0] > 0.3) & (x[:, 1] < 0.5)).astype(float)
    trees = fit_trees(x, y, np.ones(len(y)))
    margin = trees.margin(x)
    assert ((margin > 0) == (y == 1)).mean() > 0.98
    points, shares = isotonic(margin, y, np.ones(len(y)))
    assert (np.diff(points) >= 0).all() and (np.diff(shares) >= 0).all() and 0 <= shares[0] < 0.05 < 0.95 < shares[-1] <= 1
    points, shares = isotonic(np.array([1.0, 1.0, 2.0, 3.0]), np.array([0.0, 1.0, 0.0, 1.0]), np.ones(4))
    assert np.allclose(shares, [(1 + 0.5) / 4, (1 + 0.5) / 4, 1.5 / 2])


def test_query(spark):
    out = queries.QUERIES["op12_toxicity"](spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = out.collect()
    assert len(rows) == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)

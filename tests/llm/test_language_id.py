import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from postlake.llm import language_id


def labelled(spark, n=240):
    draw = random.Random(1)
    parts = {"aa": ["ka", "mo", "ti", "lu"], "bb": ["sch", "ung", "keit", "ß"], "cc": ["ção", "nho", "lh", "é"]}
    rows = []
    for i in range(n):
        lang = sorted(parts)[i % 3]
        words = ["".join(draw.choice(parts[lang]) for _ in range(draw.randrange(1, 4))) for _ in range(draw.randrange(2, 60))]
        rows.append((i, " ".join(words), lang if i % 7 else None))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows


def test_held_out_accuracy_and_rejection(spark):
    docs, rows = labelled(spark)
    model = language_id.train(docs.where(~language_id.held_out(F.col("doc_id"))))
    assert model.languages == ["aa", "bb", "cc"]
    held = docs.where(language_id.held_out(F.col("doc_id")))
    want = {i: sorted(["aa", "bb", "cc"])[i % 3] for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    found = language_id.identify(held, model).collect()
    assert {r.doc_id for r in found} == set(want)
    assert np.mean([r.lang_pred == want[r.doc_id] for r in found]) >= 0.97
    assert np.mean([r.accepted for r in found]) >= 0.97 and all(0 <= r.score <= 1 for r in found)
    odd = spark.createDataFrame([(1, "12 34 !!", "x"), (2, None, "x"), (3, "", "x"), (4, " ++ \n", "x")], "doc_id long, text string, lang string")
    assert all((r.lang_pred, r.score, r.accepted) == ("und", 0.0, False) for r in language_id.identify(odd, model).collect())


def test_odd_rows(spark, make_docs, odd_rows):
    docs, _ = labelled(spark)
    model = language_id.train(docs)
    given = make_docs([*odd_rows, (99, "😀 42"), (98, "²"), (97, "ª")])
    out = language_id.identify(given, model)
    assert out.columns == [c for c in given.columns if c != "score"] + ["lang_pred", "score", "accepted"]
    rows = out.collect()
    assert len(rows) == len(odd_rows) + 3
    for r in rows:
        letter = r.text is not None and any(c.isalpha() for c in r.text)
        assert (r.lang_pred != "und") == letter and (r.body, r.id) == ("b", 7)


def test_what_was_never_learned_is_rejected(spark):
    """Other scripts and letters that no label uses go; texts in two learned languages, and short ones, stay."""
    docs, rows = labelled(spark, 400)
    model = language_id.train(docs)
    given = [(1, "Съешь же ещё этих мягких французских булок " * 3), (2, "qzx " * 50), (3, "色は匂へど 散りぬるを " * 4), (4, "wvq zzxw qwv xxq " * 9)]
    known = [next(t for _, t, k in rows if k == lang and len(t) > 60) for lang in ("aa", "bb", "cc")]
    given += [(10, known[0]), (11, known[0] + " " + known[1]), (12, known[1] + " 123 -- !!"), (13, known[0].upper()), (14, " ".join(known))]
    found = {r.doc_id: r.accepted for r in language_id.identify(spark.createDataFrame(given, "doc_id long, text string"), model).collect()}
    assert {i for i, ok in found.items() if not ok} == {1, 2, 3, 4}


def test_the_sample_is_bounded(spark, monkeypatch):
    """By rows and labels, however often a row or an id is repeated, and whatever a label holds."""
    docs, rows = labelled(spark, 600)
    copies = spark.createDataFrame([(7, rows[1][1], "bb")] * 500 + [(8, f"{rows[1][1]} {n}", "bb") for n in range(500)], docs.schema)
    many = spark.createDataFrame([(10_000 + n, f"text of label {n}", f"l{n}") for n in range(300)], docs.schema)
    seen = []
    fit = language_id._fit
    monkeypatch.setattr(language_id, "_fit", lambda names, lists, *rest: seen.append(names) or fit(names, lists, *rest))
    language_id.train(docs.unionByName(copies), max_rows=90)
    assert len(seen[0]) == 90 and all(seen[0].count(k) == 30 for k in ("aa", "bb", "cc"))
    model = language_id.train(docs.unionByName(many), max_rows=90, max_labels=5)
    assert len(set(seen[1])) == 5 and {"aa", "bb", "cc"} <= set(model.languages)


def test_without_labels(make_docs):
    assert language_id.train(make_docs([(1, "text")])) is None
    assert language_id.train(make_docs([])) is None
    assert [r.lang_pred for r in language_id.identify(make_docs([(1, "text")]), None).collect()] == ["und"]
    assert language_id.identify(make_docs([]), None).count() == 0


def test_same_model_each_time(spark):
    docs, _ = labelled(spark, 60)
    a, b = language_id.train(docs), language_id.train(docs.repartition(3))
    assert np.array_equal(a.scores, b.scores) and a.threshold == b.threshold


def test_subwords_stay_inside_rows():
    raw = np.frombuffer(b"abab", np.uint8)
    rows, buckets = language_id.subwords(np.array([0, 2, 4]), raw, 15)
    assert sorted(buckets[rows == 0]) == sorted(buckets[rows == 1]) and len(rows) == 2 * (3 + 2)

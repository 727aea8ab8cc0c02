import string

import corpus_pipeline
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"
BLANKS = " \t\n\x0b\x0c\r"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def key(line):
    return line.strip(BLANKS).translate(LOWER)


def lines_by_hand(rows):
    """(id, text) after line dedup; rows of one id are one document, those without an id count for nothing."""
    held = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if i is not None and len(key(line)) >= 20:
                held.setdefault(key(line), set()).add(i)
    out = []
    for i, text in rows:
        keep = [x for x in (text or "").split("\n") if i is None or len(held.get(key(x), ())) < 3 or max(held[key(x)]) == i]
        if any(x.strip(BLANKS) for x in keep):
            out.append((i, "\n".join(keep)))
    return out


def groups_by_hand(rows):
    """One row of each group stays, that of the largest id; equal rows are one; without an id nothing is a copy."""
    rows = sorted(set(rows), key=str)
    sets = []
    for _, text in rows:
        words = (text or "").translate(LOWER).encode().split()
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set()))
    named = [n for n, (i, _) in enumerate(rows) if i is not None]
    group = {n: n for n in named}

    def root(n):
        while group[n] != n:
            n = group[n]
        return n

    for a in named:
        for b in named:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                group[root(a)] = root(b)
    best = {}
    for n in named:
        if not sets[n]:
            best[("empty", rows[n][0])] = rows[n]
        else:
            best[root(n)] = max(best.get(root(n), rows[n]), rows[n], key=lambda r: r[0])
    return [*best.values(), *[r for r in rows if r[0] is None]]


def clean_by_hand(rows, items):
    windows = set()
    split = lambda t: "".join(c if c.isdigit() and c.isascii() or c in string.ascii_lowercase or ord(c) > 127 else " " for c in (t or "").translate(LOWER)).split()
    for text in items:
        w = split(text)
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}

    def dirty(text):
        w = split(text)
        return any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))

    return [r for r in rows if not dirty(r[1])]


def table(df):
    return sorted([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()], key=str)


def test_stages_against_brute_force(spark, make_docs, odd_rows, tmp_path):
    """On odd rows: nulls in id and text, long texts, copies, repeated rows, one id with several texts."""
    shared = odd_rows[0][1]
    extra = [(50, shared + " and one more word"), (51, "a clean row of words that nothing else holds"), (51, "words of an item that leak"), (None, "words of an item that leak")]
    extra += [(52, "The same line is in many documents.\nown words one two three"), (53, "the same line is in many documents."), (54, " The same line is in many documents.\t\nother")]
    rows = [*odd_rows, *extra]
    spark.createDataFrame([(1, "Words of an item"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    docs = make_docs(rows)
    lines = stages["line dedup"](spark, docs, str(tmp_path))
    assert lines.columns == docs.columns and table(lines) == sorted(lines_by_hand(rows), key=str)
    assert all(r.n_chars == len(r.text) for r in lines.collect())
    given = [(r.doc_id, r.text) for r in lines.collect()]
    groups = stages["near-duplicates"](spark, lines, str(tmp_path))
    assert groups.columns == docs.columns and table(groups) == sorted(groups_by_hand(given), key=str)
    given = table(groups)
    clean = stages["decontamination"](spark, groups, str(tmp_path))
    assert clean.columns == docs.columns and table(clean) == sorted(clean_by_hand(given, ["Words of an item", None]), key=str)
    left = table(clean)
    assert (None, "words of an item that leak") in given and (None, "words of an item that leak") not in left
    assert [t for i, t in left if i == 51] == ["a clean row of words that nothing else holds"]


def test_no_repeated_line_is_lost(spark):
    """Every line that line dedup takes out of a document is in some document after near-duplicates."""
    docs = spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    lines = stages["line dedup"](spark, docs, DATA).cache()
    kept = stages["near-duplicates"](spark, lines, DATA).collect()
    held = {}
    for r in docs.collect():
        for line in (r.text or "").split("\n"):
            if len(key(line)) >= 20:
                held.setdefault(key(line), set()).add(r.doc_id)
    repeated = {k for k, ids in held.items() if len(ids) >= 3}
    assert len(repeated) > 50
    assert repeated <= {key(line) for r in kept for line in r.text.split("\n")}


def test_language_stage(spark, make_docs):
    """Rejected documents go, with nulls and texts without a letter; others stay as they are."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = corpus_pipeline.keep_known_languages(spark, docs, DATA)
    before, after = table(docs), table(kept)
    assert kept.columns == docs.columns and set(after) <= set(before)
    assert not [t for _, t in after if t is None or not any(map(str.isalpha, t))]
    assert len(after) >= 0.98 * sum(t is not None and any(map(str.isalpha, t)) for _, t in before)


def test_run_is_the_stages_one_after_the_other(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA).cache()
        assert docs.columns == columns and 0 < docs.count() <= before, name
        before = docs.count()
    kept = {r.doc_id for r in docs.select("doc_id").collect()}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    assert {r.doc_id for r in packed} == kept
    again = corpus_pipeline.run(spark, DATA)
    assert {(r.doc_id, r.piece, r.ids_crc32) for r in again.collect()} == {(r.doc_id, r.piece, r.ids_crc32) for r in packed}


def test_empty_and_unlabelled(spark, make_docs, odd_rows, tmp_path):
    make_docs(odd_rows).drop("n_lines").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0  # no language is known
    docs = make_docs([]).withColumn("lang", F.lit("en"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
    assert docs.columns == make_docs([]).columns and docs.count() == 0

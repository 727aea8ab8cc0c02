"""The inverted index: lexeme -> postings, as a partitioned Parquet table.

Building it moves each posting once. Positions are grouped per document inside
the row (sort the tokens, cut the array where the lexeme changes), so tokens
are never shuffled; the one shuffle is the write by lexeme bucket, which splits
a bucket made large by a lexeme that a third of all postings share.

Until they are written, places are packed: one int each, position * 4 + field.
As an array of structs a place is 32 bytes of a row, eight times as much to
shuffle and sort.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postlake.functions.analyze import (
    MAX_FIELD_POSITIONS,
    MAX_POS,
    MAX_POSITIONS,
    WEIGHTS,
    check_analyzer,
    plain_text,
    stop_list,
    words,
)
from postlake.functions.settle import settle
from postlake.functions.stem import with_stem
from postlake.session import set_within, shuffles_freed

BUCKETS = 256
DEALT_ROWS = 1_000_000  # of a bucket, to one task
MERGE_PASSES = 8  # at most, over parts of the buckets

# Ids follow each other within a lexeme, so their differences are small.
_FILES = {"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary#id": "false"}


def document_words(jobs: DataFrame, analyzer: str, keep: list[str]) -> DataFrame:
    """Adds the words of each field (``_a``, ``_b``, ``_c``) and the offsets of the
    second and third field in the whole (``o1``, ``o2``).

    A field counts up to its last word that is kept, so stop words at its end
    take no room.
    """
    check_analyzer(analyzer)
    # One projection per stage: an array used twice is then computed once.
    split = jobs.select(
        *keep,
        words("title").alias("_a"),
        words("location").alias("_b"),
        words(plain_text("description")).alias("_c"),
    )
    if analyzer == "english":
        kept = "array_compact(transform({0}, (t, i) -> IF(t IN ({1}), NULL, i + 1)))"
        ends = [f"coalesce(array_max({kept.format(c, stop_list())}), 0)" for c in ("_a", "_b")]
    else:
        ends = ["size(_a)", "size(_b)"]
    sized = split.selectExpr(*keep, "_a", "_b", "_c", f"{ends[0]} AS _na", f"{ends[1]} AS _nb")
    return sized.selectExpr(*keep, "_a", "_b", "_c", "_na AS o1", "_na + _nb AS o2")


def in_fields(value: str) -> str:
    """SQL for one array over all fields. ``value`` is the entry for word ``t`` at
    ``{p}`` in field number ``{f}`` with weight ``{w}``; null entries are left out."""
    offsets = ("0", "o1", "o2")
    parts = ", ".join(
        f"transform({c}, (t, i) -> {value.format(p=f'i + 1 + {o}', f=f, w=f'{w}D')})"
        for f, (c, o, w) in enumerate(zip(("_a", "_b", "_c"), offsets, WEIGHTS.values()))
    )
    return f"array_compact(concat({parts}))"


def word_positions(
    jobs: DataFrame, analyzer: str = "simple", initials: list[str] | None = None
) -> DataFrame:
    """``(id, word, places)``, one row per document and distinct word.

    ``places`` is a packed ``array<int>`` in text order, without the limits of
    :func:`capped`. No shuffle: the sort and the cut happen inside the row.
    ``initials`` keeps words by their first letter, which no stemming changes.
    """
    entry = "named_struct('x', t, 'p', ({p}) * 4 + {f})"
    if initials:
        listed = ", ".join(f"'{c}'" for c in initials)
        entry = f"IF(left(t, 1) IN ({listed}), {entry}, NULL)"
    if analyzer == "english":
        entry = f"IF(t IN ({stop_list()}), NULL, {entry})"
    docs = document_words(jobs, analyzer, ["id"])
    by_word = docs.selectExpr("id", f"sort_array({in_fields(entry)}) AS a")
    # No filter on empty documents: it would be copied below, tokenizing twice.
    cuts = "filter(sequence(0, size(a)), i -> i < size(a) AND (i = 0 OR a[i].x != a[i - 1].x)) AS s"
    starts = by_word.selectExpr("id", "a", cuts)
    # The runs are whole before explode: beside it, the array would be copied for every word of its document.
    places = "transform(slice(a, i + 1, coalesce(get(s, n + 1), size(a)) - i), t -> t.p)"
    run = f"named_struct('word', a[i].x, 'places', {places})"
    runs = starts.selectExpr("id", f"explode(transform(s, (i, n) -> {run})) AS r")
    return runs.selectExpr("id", "r.word AS word", "r.places AS places")


def capped(places: str, packed: bool = False) -> str:
    """SQL for the stored ``(p, w)``, or the packed places, of one lexeme from those in text order.

    Positions stop at the limit (of those at the limit the first is kept), and
    a lexeme has a greatest number of positions per field and in all. Most
    lexemes are far from either, and pass as they are.
    """
    if packed:
        p, in_field, stopped = "shiftright({}, 2)", "t & 3 = {f}", f"least(shiftright(t, 2), {MAX_POS}) * 4 + (t & 3)"
    else:
        p, in_field, stopped = "{}.p", "t.w = {w}D", f"named_struct('p', least(t.p, {MAX_POS}), 'w', t.w)"
    field = ", ".join(
        f"slice(filter({places}, t -> {in_field.format(f=f, w=w)}), 1, {MAX_FIELD_POSITIONS})" for f, w in enumerate(WEIGHTS.values())
    )
    placed = f"transform(concat({field}), t -> {stopped})"
    cut = f"filter(every, (t, i) -> i = 0 OR {p.format('t')} < {MAX_POS} OR {p.format('every[i - 1]')} < {MAX_POS})"
    # transform(array(v), x -> ...)[0] names a value that is used repeatedly.
    limited = f"transform(array({placed}), every -> slice({cut}, 1, {MAX_POSITIONS}))[0]"
    last = p.format(f"get({places}, size({places}) - 1)")
    within = f"size({places}) <= {MAX_FIELD_POSITIONS} AND coalesce({last}, 0) < {MAX_POS}"
    return f"IF({within}, {places}, {limited})"


def unpacked(places: str) -> str:
    """SQL for the stored ``(p, w)`` from packed places."""
    a, b, c = WEIGHTS.values()
    return f"transform({places}, t -> named_struct('p', shiftright(t, 2), 'w', CASE t & 3 WHEN 0 THEN {a}D WHEN 1 THEN {b}D ELSE {c}D END))"


def stem_words(found: DataFrame) -> DataFrame:
    """``(id, lexeme, places)`` from words with their places: words that share a stem in one document are put together."""
    stemmed = with_stem(found, "word", "lexeme")
    return stemmed.groupBy("id", "lexeme").agg(F.sort_array(F.flatten(F.collect_list("places"))).alias("places"))


def _merged_stems(found: DataFrame, vocabulary: DataFrame, counts: DataFrame, buckets: int) -> DataFrame:
    """``(lexeme, id, places, bucket)`` from words with their places, in order within each task.

    ``vocabulary (word, lexeme)`` holds the stem of every word, and is joined back; ``counts (word, n)`` are the rows of
    each. One shuffle puts the words of one stem together and deals the buckets out, a large one in slices by id.
    """
    bucket = lexeme_bucket(F.col("lexeme"), buckets)
    per_bucket = counts.join(vocabulary, "word").groupBy(bucket.alias("bucket")).agg(F.sum("n").alias("n")).collect()
    slices = [1] * buckets
    for row in per_bucket:
        slices[row["bucket"]] = -(-row["n"] // DEALT_ROWS)
    slice_ = f"pmod(xxhash64(id), array({', '.join(map(str, slices))})[bucket])"
    rows = found.join(vocabulary, "word").withColumn("bucket", bucket).withColumn("slice", F.expr(slice_).cast("int"))
    dealt = rows.repartition(sum(slices[row["bucket"]] for row in per_bucket) or 1, "bucket", "slice")
    # The order of the files serves the grouping, too.
    stem = Window.partitionBy("bucket", "lexeme", "id", "slice").orderBy("word")
    whole = stem.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    gathered = dealt.select("*", F.collect_list("places").over(whole).alias("all"), F.row_number().over(stem).alias("nth"))
    first = gathered.where("nth = 1")
    return first.selectExpr("lexeme", "id", "IF(size(all) = 1, places, sort_array(flatten(all))) AS places", "bucket")


def as_postings(found: DataFrame, limits: bool = False, packed: bool = False) -> DataFrame:
    """``postings(lexeme, id, positions array<struct<p int, w double>>)`` from ``(id, lexeme, places)``.

    ``packed``: ``(lexeme, id, places)``, for :func:`write_postings`.
    """
    value = capped("places", packed=True) if limits else "places"
    return found.selectExpr("lexeme", "id", f"{value} AS places" if packed else f"{unpacked(value)} AS positions")


def build_postings(
    jobs: DataFrame, analyzer: str = "simple", initials: list[str] | None = None, limits: bool = False, packed: bool = False
) -> DataFrame:
    """The postings of documents.

    ``limits`` applies those of :func:`capped`; without them every position of every document is kept. ``packed`` as in
    :func:`as_postings`.
    """
    found = word_positions(jobs, analyzer, initials)
    found = stem_words(found) if analyzer == "english" else found.withColumnRenamed("word", "lexeme")
    return as_postings(found, limits, packed)


def lexeme_bucket(lexeme: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(lexeme), F.lit(buckets)).cast("int")


class IndexMismatch(ValueError):
    """An index is used with other settings than it was written with."""


def _stored_buckets(spark: SparkSession, path: str) -> int | None:
    """The bucket count kept beside the postings; null where there is no index yet."""
    try:
        row = spark.read.schema("buckets int").json(f"{path}/_settings").first()
    except AnalysisException:
        return None
    return row and row[0]


def write_postings(postings: DataFrame, path: str, buckets: int = BUCKETS, mode: str = "append", stored: str = "positions") -> None:
    """Add postings, packed or not, to the index; new postings land in files of their own.

    The bucket count is kept with the index, and adding with another one is refused. ``stored``: "places" leaves packed
    postings packed.

    The shuffle is by bucket, and rebalanced by measured size: a bucket that one
    lexeme made large is split over as many tasks and files as it takes. Each task
    sends its postings in order: they take half the room on disk, and what arrives
    is sorted runs.
    """
    spark = postings.sparkSession
    held = _stored_buckets(spark, path) if mode == "append" else None
    if held not in (None, buckets):
        raise IndexMismatch(f"the index has {held} buckets, not {buckets}")
    runs = postings.sortWithinPartitions("lexeme", "id")
    _write(_dealt(runs, buckets), path, buckets, mode, held, stored)


def _dealt(runs: DataFrame, buckets: int) -> DataFrame:
    # The optimizer drops a sort below another one; it does not look below an explode.
    dealt = settle(runs, "bucket", lexeme_bucket(F.col("lexeme"), buckets)).hint("rebalance", F.col("bucket"))
    return dealt.sortWithinPartitions("bucket", "lexeme", "id")


def write_merged(segments: DataFrame, gone: DataFrame | None, path: str, buckets: int) -> None:
    """A new index of ``segments (lexeme, id, places, seg, bucket)`` without what later ones replaced.

    ``gone (gone_id, v)``: the postings of an id in segments before ``v`` do not count. The buckets are merged in a few
    passes, so that what is shuffled at a time is a part of the index.
    """
    spark = segments.sparkSession
    sizes = {r["bucket"]: r["n"] for r in segments.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}
    ids = gone.count() if gone is not None else 0
    at_once = DEALT_ROWS * spark.sparkContext.defaultParallelism
    held = None
    for chosen in _passes(sizes, min(MERGE_PASSES, -(-sum(sizes.values()) // at_once))):
        tasks = {b: -(-max(sizes[b], ids) // DEALT_ROWS) for b in chosen}  # by its rows, and the ids to look up
        # One shuffle meets the ids and makes the files: by bucket and slice of ids, the key by which both sides are dealt.
        with set_within(spark, "spark.sql.requireAllClusterKeysForCoPartition", "false"):
            rows = _sliced(segments.where(F.col("bucket").isin(*chosen)), "id", tasks)
            if gone is not None:
                every = gone.select("*", F.explode(F.lit(chosen).cast("array<int>")).alias("bucket"))
                out = _sliced(every, "gone_id", tasks).withColumnsRenamed({"bucket": "gone_bucket", "slice": "gone_slice"})
                same = "bucket = gone_bucket AND slice = gone_slice AND id = gone_id AND seg < v"
                # A merge join would sort the postings by id; they come as sorted runs. An anti join would be moved
                # below the shuffle, and ask for one of its own.
                rows = rows.join(out.hint("shuffle_hash"), F.expr(same), "left").where("gone_id IS NULL")
            merged = rows.select("lexeme", "id", "places", "bucket").sortWithinPartitions("bucket", "lexeme", "id")
            _write(merged, path, buckets, "append" if held else "overwrite", held, "places")
        held = buckets


def _sliced(rows: DataFrame, key: str, tasks: dict[int, int]) -> DataFrame:
    """Adds ``slice``, by ``key``, and deals the rows out by bucket and slice, to as many tasks as all buckets have.

    Few large buckets are cut finer than that, as slices fall on tasks by chance.
    """
    finer = max(1, 16 // max(1, len(tasks)))
    counts = ", ".join(f"{b}, {n * finer if n > 1 else 1}" for b, n in tasks.items())
    slice_ = f"pmod(xxhash64({key}), map({counts})[bucket])" if tasks else "0"
    return rows.withColumn("slice", F.expr(slice_).cast("int")).repartition(sum(tasks.values()) or 1, "bucket", "slice")


def _passes(sizes: dict[int, int], wanted: int) -> list[list[int]]:
    """The buckets in ``wanted`` groups of about the same size, fewer if there are fewer; one group at least."""
    groups = [[0, []] for _ in range(max(1, min(wanted, len(sizes))))]
    for bucket in sorted(sizes, key=lambda b: (-sizes[b], b)):
        least = min(groups, key=lambda g: g[0])
        least[0] += sizes[bucket]
        least[1].append(bucket)
    return [chosen for _, chosen in groups]


def write_stemmed(
    found: DataFrame, vocabulary: DataFrame, counts: DataFrame, path: str, buckets: int = BUCKETS, limits: bool = False
) -> None:
    """A new index of words with their places, by stem, packed; arguments as of :func:`_merged_stems`."""
    merged = _merged_stems(found, vocabulary, counts, buckets)
    value = capped("places", packed=True) if limits else "places"
    _write(merged.selectExpr("lexeme", "id", f"{value} AS places", "bucket"), path, buckets, "overwrite", None, "places")


def _write(rows: DataFrame, path: str, buckets: int, mode: str, held: int | None, stored: str) -> None:
    if stored == "positions" and "places" in rows.columns:
        rows = rows.selectExpr("lexeme", "id", f"{unpacked('places')} AS positions", "bucket")
    with shuffles_freed(rows.sparkSession):
        rows.write.mode(mode).options(**_FILES).partitionBy("bucket").parquet(path)
    if held is None:
        settings = rows.sparkSession.sql(f"SELECT {int(buckets)} AS buckets")
        settings.write.mode("overwrite").json(f"{path}/_settings")


def read_postings(spark: SparkSession, path: str, lexemes: list[str] | None = None, buckets: int | None = None) -> DataFrame:
    """The index, or only the postings of some lexemes. The bucket count is that of the index.

    The bucket numbers are folded to literals, so the scan prunes to those
    folders, and within their files to the row groups that hold the lexemes.
    """
    schema = "lexeme string, id bigint, positions array<struct<p:int,w:double>>, bucket int"
    table = spark.read.schema(schema).parquet(path)
    if lexemes is None:
        return table
    held = _stored_buckets(spark, path)
    if held is None:
        raise IndexMismatch(f"no settings are kept with the index at {path}")
    if buckets not in (None, held):
        raise IndexMismatch(f"the index has {held} buckets, not {buckets}")
    wanted = [lexeme_bucket(F.lit(x), held) for x in lexemes]
    found = table.where(F.col("bucket").isin(*wanted) & F.col("lexeme").isin(*lexemes))
    found.only_lexemes = frozenset(lexemes)  # a search for others is refused
    return found


def tsvector_rows(postings: DataFrame) -> DataFrame:
    """Positions, packed or not, as text with weight letters, e.g. ``1A,7C``."""
    if "places" in postings.columns:
        text = F.expr("array_join(transform(places, t -> concat(CAST(shiftright(t, 2) AS STRING), array('A', 'B', 'C')[t & 3])), ',')")
        return postings.select("id", "lexeme", text.alias("positions"))
    letter = lambda w: F.when(w == 1.0, "A").when(w == 0.4, "B").otherwise("C")
    text = F.array_join(
        F.transform("positions", lambda s: F.concat(s["p"].cast("string"), letter(s["w"]))), ","
    )
    return postings.select("id", "lexeme", text.alias("positions"))

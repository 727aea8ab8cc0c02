"""Which documents hold windows of benchmark items, as a prefix-filtered set join. DataFrame functions only.

A window of an item is a set of word shingles. Only a document window of the same length that holds all of them can
equal it, so one shingle, the rarest in the corpus, is a sufficient prefix. Documents' shingles are joined with the
benchmark's, counted, and joined again with the chosen prefixes; the offset inside the window and its length bound
where it can lie. What is left is compared word by word with the document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.llm.common import ascii_lower, hex_lines
from postlake.session import cut_lineage

_OWN, _MARK, _TO, _TO_MARK = "__own", "__own_mark", "__to", "__to_mark"
#: Words of a shingle; a shorter window is one shingle.
SHINGLE = 3

#: What separates words: ASCII other than digits and lower-case letters.
_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: str):
    return F.array_remove(F.split(ascii_lower(F.coalesce(F.col(text), F.lit(""))), _GAPS), "")


def _shingles(words: str, k: int) -> str:
    """SQL for the hashes of all runs of ``k`` of an array of words, by position."""
    parts = ", ".join(f"get({words}, i + {j})" for j in range(k))
    return f"if(size({words}) >= {k}, transform(sequence(0, size({words}) - {k}), i -> xxhash64({k}, {parts})), array())"


def _windows(benchmark: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """(item, key, length): each window of each item; its key is its words joined by a space."""
    items = benchmark.select(F.col(f"`{id_col}`").cast("string").alias("item"), F.col(f"`{text_col}`").alias("body"))
    items = items.select("item", _words("body").alias("w"))
    starts = f"if(size(w) >= {window}, sequence(1, size(w) - {window - 1}), if(size(w) > 0, array(1), array()))"
    cut = items.select("item", F.explode(F.expr(f"transform({starts}, s -> slice(w, s, {window}))")).alias("v"))
    return cut.select("item", F.array_join("v", " ").alias("key"), F.size("v").alias("length")).distinct()


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    with_mark: bool = False,
) -> DataFrame:
    """For each row of ``docs``: its id, ``n_words``, ``n_hit``, ``items`` (sorted, as strings), ``contaminated``.

    ``with_mark`` adds the hash of its text.

    A window is ``window`` consecutive words of an item, or all words of a shorter item. A word of a document is hit if
    it lies in an occurrence of any window; ``items`` are those of which a window occurs.

    * Null text, and items of null text, have no words. Long texts are read whole; overlapping windows count a word once.
    * Rows of one id are judged each by its text, also rows without an id. Items that repeat are listed once.
    * An item without an id hits words but is not listed. Without items or documents nothing is hit.
    """
    frame = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("body"))
    frame = frame.withColumn("mark", F.xxhash64("body"))
    holders = cut_lineage(_windows(benchmark, window, item_col, item_text_col), "windows")
    keys = holders.select("key", "length").distinct().withColumn("v", F.split("key", " "))
    sizes = [r[0] for r in holders.select(F.least("length", F.lit(SHINGLE))).distinct().collect()]  # three at most

    tokens = [
        keys.where(F.least("length", F.lit(SHINGLE)) == k).select("key", "length", F.posexplode(F.expr(_shingles("v", k))).alias("off", "token"))
        for k in sizes
    ]
    parsed = frame.select("id", "mark", _words("body").alias("w"))
    result = frame.select("id", "mark", "body")
    if sizes:
        tokens = cut_lineage(reduce(DataFrame.unionAll, tokens), "window-shingles")
        # Its size is known from its file; the engine sends it to all tasks only below its own bound, else it shuffles.
        known = cut_lineage(tokens.select("token").distinct(), "shingles")
        every = [
            parsed.select("id", "mark", F.size("w").alias("n"), F.posexplode(F.expr(_shingles("w", k))).alias("pos", "token"))
            for k in sizes
        ]
        hits = cut_lineage(reduce(DataFrame.unionAll, every).join(known, "token"), "shingle-hits")
        counts = cut_lineage(hits.groupBy("token").agg(F.count(F.lit(1)).alias("often")), "shingle-counts")
        # Whoever lacks a shingle altogether can't occur; the rest is found by its rarest.
        rated = tokens.join(counts, "token", "left").withColumn("often", F.coalesce("often", F.lit(0)))
        prefix = rated.groupBy("key", "length").agg(F.min(F.struct("often", "token", "off")).alias("p"))
        prefix = prefix.where("p.often > 0").select("key", "length", "p.token", "p.off")
        prefix = cut_lineage(prefix, "prefixes")
        places = hits.join(prefix, "token").withColumn("start", F.col("pos") - F.col("off"))
        places = places.where("start >= 0 AND start + length <= n")
        places = places.groupBy("id", "mark").agg(F.collect_set(F.struct("start", "length", "key")).alias("c"))
        places = cut_lineage(places, "places").select(F.col("id").alias("id2"), F.col("mark").alias("mark2"), "c")
        # The places grow with the corpus: merged at every size, never sent whole to all tasks.
        result = result.join(places.hint("merge"), F.col("id").eqNullSafe(F.col("id2")) & (F.col("mark") == F.col("mark2")), "left")
    else:
        result = result.withColumn("c", F.expr("CAST(NULL AS array<struct<start:int,length:int,key:string>>)"))
    found = "filter(coalesce(c, array()), x -> array_join(slice(w, x.start + 1, x.length), ' ') = x.key)"
    result = result.select("id", "mark", "c", _words("body").alias("w"))
    result = result.select("id", "mark", F.size("w").cast("long").alias("n_words"), F.expr(found).alias("f"))
    covered = "array_distinct(flatten(transform(f, x -> sequence(x.start, x.start + x.length - 1))))"
    result = result.select(
        "id", "mark", "n_words", F.size(F.expr(covered)).cast("long").alias("n_hit"), F.expr("array_distinct(f.key)").alias("keys")
    )
    result = cut_lineage(result, "judged")
    listed = result.where("n_hit > 0").select("id", "mark", F.explode("keys").alias("key")).distinct()
    listed = listed.join(holders.where("item IS NOT NULL").select("item", "key"), "key").select("id", "mark", "item").distinct()
    listed = listed.groupBy("id", "mark").agg(F.sort_array(F.collect_list("item")).alias("items"))
    listed = listed.select(F.col("id").alias("id2"), F.col("mark").alias("mark2"), "items")
    out = result.join(listed, F.col("id").eqNullSafe(F.col("id2")) & (F.col("mark") == F.col("mark2")), "left")
    return out.select(
        F.col("id").alias(id_col),
        "n_words",
        "n_hit",
        F.coalesce("items", F.expr("CAST(array() AS array<string>)")).alias("items"),
        (F.col("n_hit") > 0).alias("contaminated"),
        *(["mark"] if with_mark else []),
    )


def contamination_digest(judged: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``contamination`` with the items as their number and one hash."""
    return judged.select(
        id_col, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), hex_lines(F.col("items")).alias("items_sha256"), "contaminated"
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose text is not contaminated, by id (null or not) and text: clean rows of the same id stay."""
    body = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    plain = docs.select(F.col(f"`{id_col}`").alias("id"), body.alias("body"))
    gone = contamination(plain, benchmark, id_col="id", text_col="body", with_mark=True, **options).where("contaminated")
    gone = gone.select(F.xxhash64("id", "mark").alias(_TO), F.col("mark").alias(_TO_MARK)).distinct()
    gone = cut_lineage(gone, "contaminated-texts")
    named = docs.withColumn(_OWN, F.xxhash64(F.col(f"`{id_col}`"), F.xxhash64(body))).withColumn(_MARK, F.xxhash64(body))
    same = (F.col(_OWN) == F.col(_TO)) & (F.col(_MARK) == F.col(_TO_MARK))
    return named.join(gone.hint("merge"), same, "left_anti").drop(_OWN, _MARK)

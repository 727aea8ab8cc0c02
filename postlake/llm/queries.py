"""The queries over the numbered operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.llm import language_id, toxicity
from postlake.llm.common import read
from postlake.llm.decontaminate import contamination, contamination_digest
from postlake.llm.hard_negatives import mine
from postlake.llm.line_dedup import drop_repeated_lines
from postlake.llm.maxscore import quantized, top_k
from postlake.llm.minhash import near_duplicates
from postlake.llm.packing import pack_documents
from postlake.llm.pii import find_personal_data, span_digest
from postlake.llm.substrings import remove_repeats
from postlake.llm.url_filter import judge_urls
from postlake.llm.vector_codes import encode, learn, with_group_sum
from postlake.llm.warc import deduplicated_archives
from postlake.session import cut_lineage

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: SQL texts that several queries use: blanks of the contracts, and lower case of A-Z alone.
BLANK_SQL = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
LOWER_SQL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


WORDS_SQL = f"list_filter(regexp_split_to_array({LOWER_SQL}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op1_packing")
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the tokens bind here; the other two capacities are as large as they can get."""
    return pack_documents(read(spark, sf_dir, "documents"), tokenizer_path())


@query(
    "op2_line_dedup",
    f"""
    WITH lines AS (
        SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
        FROM documents),
    keyed AS (SELECT *, trim({LOWER_SQL.format("line")}, {BLANK_SQL}) AS key FROM lines),
    common AS (
        SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
        GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
    judged AS (
        SELECT k.*, c.key IS NOT NULL AND k.doc_id <> c.keeper AS gone FROM keyed k LEFT JOIN common c ON k.key = c.key)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
    FROM judged GROUP BY doc_id
    """,
)
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op9_pii")
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digest(find_personal_data(read(spark, sf_dir, "documents").select("doc_id", "text")))


@query(
    "op10_minhash",
    f"""
    WITH RECURSIVE words AS (
        SELECT doc_id, list_filter(regexp_split_to_array({LOWER_SQL.format("text")}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
        FROM documents),
    sets AS (
        SELECT doc_id, CASE WHEN len(w) < 2 THEN w
               ELSE list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) END AS s
        FROM words),
    one AS (SELECT s, min(doc_id) AS head, len(s) AS n FROM (SELECT doc_id, list_sort(s) AS s FROM sets WHERE len(s) > 0) GROUP BY s),
    tokens AS (SELECT head, n, unnest(s) AS t FROM one),
    links AS (
        SELECT a.head AS a, b.head AS b FROM tokens a JOIN tokens b ON a.t = b.t AND a.head < b.head
        GROUP BY a.head, b.head, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
    edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links UNION SELECT head, head FROM one),
    reach AS (
        SELECT a, b FROM edges
        UNION
        SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
    label AS (SELECT a AS head, min(b) AS component FROM reach GROUP BY a)
    SELECT d.doc_id, coalesce(len(d.s), 0) AS n_shingles, coalesce(l.component, d.doc_id) AS component_id,
           coalesce(l.component, d.doc_id) = d.doc_id AS kept
    FROM sets d LEFT JOIN one o ON o.s = list_sort(d.s) LEFT JOIN label l ON l.head = o.head
    """,
)
def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"), shingle=2)


@query(
    "op3_substring_dedup",
    """
    WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
    win AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS key
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
    late AS (SELECT doc_id, i FROM (
        SELECT doc_id, i, row_number() OVER (PARTITION BY key ORDER BY doc_id, i) AS nth FROM win) WHERE nth > 1),
    gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS at_word FROM late),
    each_word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS at_word FROM d),
    kept AS (SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.at_word) AS kept, count(*) AS n
             FROM each_word e LEFT JOIN gone g USING (doc_id, at_word) WHERE g.doc_id IS NULL GROUP BY e.doc_id)
    SELECT d.doc_id, len(d.w) AS n_words, len(d.w) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
    FROM d LEFT JOIN kept k USING (doc_id)
    """,
)
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query(
    "op4_warc",
    """
    WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
    d AS (SELECT *, strlen(payload) AS payload_bytes, sha1(payload) AS hex FROM p),
    b AS (
        SELECT *, max(page_id) OVER (PARTITION BY hex, payload_bytes) AS first_id,
               list_transform(range(0, 8), lambda i: ('0x' || hex[5 * i + 1:5 * i + 5])::BIGINT) AS parts FROM d)
    SELECT page_id, payload_bytes,
           array_to_string(list_transform(range(0, 32), lambda i:
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((parts[i // 4 + 1] >> (5 * (3 - i % 4))) & 31)::INT + 1]), '') AS payload_digest,
           CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> first_id THEN first_id END AS refers_to
    FROM b
    """,
)
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = deduplicated_archives(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return records.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")


@query(
    "op5_maxscore",
    """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
        FROM embeddings
        WHERE embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
        SELECT q.vec_id AS query_id, c.vec_id,
               CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
        FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
    """,
)
def op5_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), quantized(F.col("embedding")).alias("v"))
    return top_k(rows, rows.where("id % 100 = 0"), 10)


@query("op6_language_id")
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.train(docs.where(~language_id.held_out(F.col("doc_id"))))
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


#: Fixed values of the query.
URL_RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)


@query("op7_url_filter")
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_urls(read(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "template", "block_share")


@query(
    "op8_decontamination",
    f"""
    WITH dw AS (SELECT doc_id, coalesce({WORDS_SQL.format("text")}, []) AS w FROM documents),
    iw AS (SELECT item_id, {WORDS_SQL.format("text")} AS w FROM benchmark WHERE text IS NOT NULL),
    win AS (
        SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS key
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM iw WHERE len(w) > 0)),
    place AS (
        SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS key
        FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i
              FROM dw, (SELECT DISTINCT size FROM win) WHERE len(w) >= size)),
    found AS (SELECT p.doc_id, p.i, p.size, w.item_id FROM place p JOIN win w ON p.key = w.key),
    hit AS (SELECT doc_id, count(DISTINCT at_word) AS n_hit
            FROM (SELECT doc_id, unnest(range(i, i + size)) AS at_word FROM found) GROUP BY doc_id),
    listed AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
               FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
    SELECT d.doc_id, len(d.w) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(l.n_items, 0) AS n_items,
           sha256(coalesce(l.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
    FROM dw d LEFT JOIN hit h USING (doc_id) LEFT JOIN listed l USING (doc_id)
    """,
)
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return contamination_digest(contamination(docs, read(spark, sf_dir, "benchmark")))


#: Rows of ``embeddings`` that take part, with whole components.
VECTORS_SQL = """
        SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS e
        FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""


@query(
    "op11_hard_negatives",
    f"""
    WITH v AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, e
        FROM ({VECTORS_SQL.format(scale=256)}) WHERE label IS NOT NULL),
    s AS (
        SELECT q.vec_id AS anchor_id, q.label = c.label AS same, c.vec_id,
               CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
        FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
    p AS (
        SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
    n AS (
        SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
               row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
        FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same
         AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score)
    SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
    """,
)
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.expr("IF(vec_id % 7 = 0, (label + 1) % 10, label)").alias("label")
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), label, F.col("embedding").alias("v"))
    return mine(rows, F.expr("id % 100 = 0"))


@query("op12_toxicity")
def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    known = docs.where(~toxicity.held_out(F.col("doc_id")))
    model = toxicity.train(*toxicity.labelled(known, read(spark, sf_dir, "labels").select("doc_id", "toxic")))
    return toxicity.judge(docs, model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def _codes_sql(rounds: int = 4) -> str:
    """The rounds written out, each an assignment and the means of it."""
    ctes = [
        f"v AS MATERIALIZED ({VECTORS_SQL.format(scale=1024)})",
        "base AS MATERIALIZED (SELECT vec_id, label, p, e[p * (len(e) // 4) + 1:(p + 1) * (len(e) // 4)] AS x FROM v, range(4) t(p))",
        "k0 AS MATERIALIZED (SELECT p, n - 1 AS i, x AS c FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY vec_id) AS n FROM base) WHERE n <= 256)",
    ]
    for r in range(rounds + 1):
        ctes.append(
            f"""a{r} AS MATERIALIZED (
            SELECT vec_id, label, p, x, min(256 * d + i) AS m FROM (
                SELECT b.*, k.i, CAST(list_sum(list_transform(range(1, len(x) + 1), lambda j: (x[j] - c[j]) * (x[j] - c[j]))) AS BIGINT) AS d
                FROM base b JOIN k{r} k ON b.p = k.p)
            GROUP BY vec_id, label, p, x)"""
        )
        if r < rounds:
            ctes.append(
                f"""k{r + 1} AS MATERIALIZED (
                SELECT k.p, k.i, coalesce(n.c, k.c) AS c FROM k{r} k LEFT JOIN (
                    SELECT p, i, list(mean ORDER BY j) AS c FROM (
                        SELECT p, m % 256 AS i, j, CAST(floor(CAST(sum(x[j]) AS DOUBLE) / count(*)) AS BIGINT) AS mean
                        FROM a{r}, LATERAL (SELECT unnest(range(1, len(x) + 1)) AS j) GROUP BY 1, 2, 3)
                    GROUP BY p, i) n ON k.p = n.p AND k.i = n.i)"""
            )
    return "WITH " + ",\n".join(ctes) + f"""
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
           (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, i)) FROM k{rounds}) AS codebooks_sha256
    FROM (SELECT vec_id, label, string_agg(printf('%02x', m % 256), '' ORDER BY p) AS code, CAST(sum(m // 256) AS BIGINT) AS error
          FROM a{rounds} GROUP BY vec_id, label)
    """


@query("op13_vector_codes", _codes_sql())
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    books = learn(rows, id_col="vec_id", vector_col="embedding")
    coded = cut_lineage(encode(rows, books, "embedding").select("vec_id", "label", "code", "error"), "vector-codes")
    summed = with_group_sum(coded, "label", "error", "label_error", F.col("vec_id"))
    digest = F.lit(books.digest() if books else None).cast("string")
    return summed.select("vec_id", "code", "error", "label_error", digest.alias("codebooks_sha256"))

"""WARC archives of pages, and revisit records for payloads that repeat.

Archives are written with the text sink (records end in CRLF CRLF, the second of which is the sink's line end), so that
they land wherever Spark can write, and are read whole by file; a file holds a bounded number of bytes. Duplicates are
resolved on headers alone: they are shuffled by payload digest, revisits are joined to their original response, and new
archives are written with fresh headers, in which a revisit carries no payload. Archives may hold revisits already, and
records of other kinds, which pass through as they are.
"""

from __future__ import annotations

import base64
import gzip
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.session import cut_lineage, scratch_path

#: Bytes of payload in one archive, about.
ARCHIVE_BYTES = 24 << 20
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_SCHEMA = (
    "file string, at long, record_type string, record_id string, uri string, page_id long, digest string, payload_bytes long, "
    "refers_to long, refers_id string, date string"
)


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: five hex digits are four of base 32."""
    hex40 = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hex40, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def _record() -> Column:
    """The record of a row (record_type, record_id, uri, page_id, digest, payload, payload_bytes, refers_to, refers_id, date).

    A record of another kind than response and revisit is its ``payload``, headers and all.
    """
    nothing = F.lit("")
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"),
        _line("Content-Length", F.col("payload_bytes").cast("string")),
        F.lit("\r\n"),
    )
    revisit = F.col("record_type") == "revisit"
    block = F.concat(http, F.when(revisit, nothing).otherwise(F.col("payload")))
    uri = F.replace(F.replace(F.col("uri"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    known = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.col("record_type")),
        _line("WARC-Record-ID", F.col("record_id")),
        _line("WARC-Date", F.col("date")),
        F.coalesce(_line("WARC-Target-URI", uri), nothing),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.coalesce(_line("X-Page-ID", F.col("page_id").cast("string")), nothing),
        F.when(revisit, _line("WARC-Profile", F.lit(PROFILE))).otherwise(nothing),
        F.when(revisit, F.coalesce(_line("WARC-Refers-To", F.col("refers_id")), nothing)).otherwise(nothing),
        F.when(revisit, F.coalesce(_line("X-Refers-To-Page", F.col("refers_to").cast("string")), nothing)).otherwise(nothing),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        _line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
        F.lit("\r\n"),
    )
    return F.when(F.col("record_type").isin("response", "revisit"), known).otherwise(F.concat(F.col("payload"), F.lit("\r\n")))


def _write(records: DataFrame, path: str) -> None:
    # The sink adds the last line end of each record.
    records.select(_record().alias("value")).write.option("lineSep", "\r\n").option("compression", "gzip").text(path)


def write_archives(pages: DataFrame, path: str, date: str = DATE, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """One response record for each row of ``pages``, in archives of bounded size below ``path``.

    Null html is an empty payload; a null url or id leaves its header out; line ends in a url are percent-encoded.
    Other columns are not read.
    """
    rows = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("page_id"),
        F.col(f"`{url_col}`").alias("uri"),
        F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("payload"),
    ).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    total = rows.agg(F.coalesce(F.sum("payload_bytes"), F.lit(0))).first()[0]
    rows = rows.repartition(max(1, -(-total // ARCHIVE_BYTES)))
    rows = rows.withColumn("digest", base32_sha1(F.col("payload")))
    rows = rows.withColumns(
        {
            "record_type": F.lit("response"),
            "record_id": _uuid(F.col("page_id"), F.col("uri"), F.col("digest"), F.lit(date)),
            "refers_to": F.lit(None).cast("long"),
            "refers_id": F.lit(None).cast("string"),
            "date": F.lit(date),
        }
    )
    _write(rows, path)


def _parser(with_payload: bool):
    def flush(rows: list[list]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        kinds += [pa.binary()] * with_payload
        names = [f"c{i}" for i in range(len(kinds))]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    def parse(batches):
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                data = gzip.decompress(content.as_buffer())
                at, rows, held = 0, [], 0
                while at < len(data):
                    row, size, at = _one(name.as_py(), data, at, with_payload)
                    rows.append(row)
                    held += size
                    if held > 4 << 20 or len(rows) >= 2000:
                        yield flush(rows)
                        rows, held = [], 0
                if rows:
                    yield flush(rows)

    return parse


def _fields(lines: list[str]) -> dict[str, str]:
    """Header fields by lower-case name; of a repeated one the first."""
    out: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if colon:
            out.setdefault(name.strip().lower(), value.strip())
    return out


def _one(file: str, data: bytes, at: int, with_payload: bool) -> tuple[list, int, int]:
    """One record: any version, any kind. What a header doesn't say is found in the payload, or null."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode(errors="replace").split("\r\n")
    head = _fields(lines[1:])
    if not lines[0].startswith("WARC/") or "content-length" not in head:
        raise ValueError(f"{file}: no record at {at}")
    start = end + 4
    stop = start + int(head["content-length"])
    after = stop + 4 if data[stop : stop + 4] == b"\r\n\r\n" else len(data)
    kind = head.get("warc-type", "").lower()
    number = lambda key: int(head[key]) if head.get(key, "").lstrip("-").isdigit() else None
    digest = head.get("warc-payload-digest")
    digest = digest.removeprefix("sha1:").upper() if digest and digest.lower().startswith("sha1:") else None
    size, payload = None, data[at:stop]
    if kind in ("response", "revisit"):
        body = data.find(b"\r\n\r\n", start, stop)
        http = _fields(data[start:body].decode(errors="replace").split("\r\n")[1:]) if body >= 0 else {}
        payload = data[body + 4 : stop] if body >= 0 else b""
        if kind == "response":
            found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            if digest not in (None, found):
                raise ValueError(f"{file}: the payload at {at} doesn't have its digest")
            digest, size = found, len(payload)
        else:
            size = int(http["content-length"]) if http.get("content-length", "").isdigit() else None
            payload = b""
    row = [file, at, kind, head.get("warc-record-id"), head.get("warc-target-uri"), number("x-page-id"), digest, size]
    row += [number("x-refers-to-page"), head.get("warc-refers-to"), head.get("warc-date")] + [payload] * with_payload
    return row, len(payload) if with_payload else 0, after


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """A row for each record below ``path``: its place (file, at), headers, and the payload's length, digest and bytes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    return files.mapInArrow(_parser(with_payload), _SCHEMA + ", payload binary" * with_payload)


def resolve_revisits(spark: SparkSession, source: str, target: str, min_bytes: int = 0, date: str | None = None) -> None:
    """Write the records of ``source`` to ``target``, with revisits for payloads that repeat.

    Of responses of equal payloads (by digest) of ``min_bytes`` or more, the one of the largest page id stays a response,
    of rows that repeat an id the last by file and place; a missing id counts as smallest. The others become revisits that
    refer to it, and so do revisits of that digest that are there already; one whose response is not there stays as it is.
    Records of other kinds pass through. Records keep their dates, but for revisits if ``date`` is given, and all then.
    """
    heads = read_archives(spark, source).select("file", "at", "record_type", "digest", "payload_bytes", "page_id", "record_id")
    heads = cut_lineage(heads, "heads")
    originals = heads.where((F.col("record_type") == "response") & (F.col("payload_bytes") >= min_bytes)).groupBy("digest")
    originals = originals.agg(F.max(F.struct("page_id", "file", "at", "record_id")).alias("first"))
    # Written, so that the join on a digest of very many pages is one that the engine can split.
    originals = cut_lineage(originals, "originals")
    judged = heads.where(F.col("record_type").isin("response", "revisit")).join(originals, "digest", "left")
    same = (F.col("file") == F.col("first.file")) & (F.col("at") == F.col("first.at"))
    small = (F.col("record_type") == "response") & (F.col("payload_bytes") < min_bytes)
    kind = F.when(F.col("first").isNull() | small, F.col("record_type")).when(same, "response").otherwise("revisit")
    judged = judged.select(
        F.col("file").alias("f"),
        F.col("at").alias("a"),
        kind.alias("kind"),
        F.col("first.page_id").alias("to_page"),
        F.col("first.record_id").alias("to_record"),
    )
    judged = cut_lineage(judged, "resolved")
    # Dealt by place into as many parts as there will be archives: the join and the writer share one shuffle of payloads.
    total = heads.agg(F.coalesce(F.sum("payload_bytes"), F.lit(0))).first()[0]
    archives = max(1, -(-total // ARCHIVE_BYTES))
    payloads = read_archives(spark, source, with_payload=True).repartition(archives, "file", "at")
    place = (F.col("file") == F.col("f")) & (F.col("at") == F.col("a"))
    full = payloads.join(judged.repartition(archives, "f", "a").hint("merge"), place, "left")
    turned = (F.col("kind") == "revisit") & (F.col("record_type") == "response")
    revisit = F.col("kind") == "revisit"
    dated = F.coalesce(F.lit(date), F.col("date"), F.lit(DATE))
    fresh = full.select(
        F.coalesce("kind", "record_type").alias("record_type"),
        F.when(turned, _uuid(F.col("record_id"), F.col("file"), F.col("at"), dated)).otherwise(F.coalesce("record_id", _uuid(F.col("file"), F.col("at")))).alias("record_id"),
        "uri",
        "page_id",
        F.coalesce("digest", F.lit("")).alias("digest"),
        F.col("payload").cast("string").alias("payload"),
        F.coalesce("payload_bytes", F.lit(0)).alias("payload_bytes"),
        F.when(revisit, F.coalesce("to_page", "refers_to")).alias("refers_to"),
        F.when(revisit, F.coalesce("to_record", "refers_id")).alias("refers_id"),
        dated.alias("date"),
    )
    _write(fresh, target)


def deduplicated_archives(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """The records read back from deduplicated archives of ``pages``: one for each row (see ``write_archives``)."""
    spark = pages.sparkSession
    raw, target = scratch_path(spark, "warc-raw"), scratch_path(spark, "warc")
    write_archives(pages, raw)
    resolve_revisits(spark, raw, target, min_bytes)
    return read_archives(spark, target)

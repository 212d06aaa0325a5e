"""WARC: archives of page captures, and captures assembled from archives.

Writing: every page becomes a request, a response (or a revisit, where an
earlier page has the same payload) and a metadata record; the request and the
metadata name the response in WARC-Concurrent-To.  Records are lines of a text
file whose line separator is the CR LF CR LF that ends a WARC record, so Spark's
text writer puts them into any file system.  Reading: files (of bounded size)
are parsed record by record by Content-Length, and the records of a transaction
meet at the identifier of their response.

Defined results: a null html is an empty payload; a null url leaves out the
target URI; pages equal in page_id and payload are each a response (or each a
revisit of the same page); a page without page_id is a response.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import scratch, table

#: Payload bytes of a file on average, which a task parses in memory, and tasks that write at most; beyond, a task writes several files.
FILE_BYTES, WRITERS = 24 << 20, 20_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

RECORD = "record_id string, record_type string, concurrent_to string, refers_to_id string, target_uri string, payload_bytes long, payload_digest string, fields map<string,string>, payload binary"


def base32_of_hex(digest: Column) -> Column:
    """Base32 of 40 hex digits: each 5 of them are 4 characters."""

    def four(i: Column) -> Column:
        n = F.conv(F.substr(digest, i * 5 + 1, F.lit(5)), 16, 10).cast("int")
        return F.concat(*[F.substr(F.lit(ALPHABET), F.shiftright(n, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)])

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), four), "")


def _urn(*parts: Column | str) -> Column:
    h = F.md5(F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("-")) for p in parts]).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)), F.lit(">"))


def _record(kind: Column | str, record_id: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    """A record without the empty lines that end it; headers whose value is null are left out."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), record_id), F.lit(f"WARC-Date: {DATE}")]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in headers]
    lines += [F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF), block)


def write_warc(pages: DataFrame, path: str, least: int = 0, file_bytes: int = FILE_BYTES, writers: int = WRITERS) -> None:
    """Write a transaction of three records for each page (page_id, url, html) to gzip files at path.

    Payloads of at least `least` bytes that an earlier page has are revisits of it.
    At most `writers` tasks write, each as many files as its records need.
    """
    page = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    page = page.withColumn("bytes", F.octet_length("html").cast("long")).withColumn("sha", F.sha1(F.col("html").cast("binary")))
    total, n = pages.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("html"), F.lit(0)) + 1500), F.lit(0)), F.count("*")).first()
    files = max(1, math.ceil(total / file_bytes))
    tasks = min(files, writers)
    a_file = 0 if files <= writers else max(3, 3 * n // files)  # records; 0: all of a task's
    # who comes first is found on slim rows; the pages themselves move once, evenly
    slim = page.where((F.col("bytes") >= least) & F.col("page_id").isNotNull()).select("page_id", "sha").distinct()
    firsts = slim.join(slim.groupBy("sha").agg(F.min("page_id").alias("first_id")), "sha")
    # pages equal in page_id and payload are told apart by their number; number 1 is the one that revisits name
    nth = F.row_number().over(Window.partitionBy("page_id", "sha").orderBy("url"))
    page = page.repartition(tasks, "page_id", "sha").withColumn("nth", nth).join(firsts.repartition(tasks, "page_id", "sha").hint("merge"), ["page_id", "sha"], "left")
    revisit = F.coalesce((F.col("bytes") >= least) & (F.col("page_id") != F.col("first_id")), F.lit(False))
    uri = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    key = [F.col("page_id"), F.col("sha"), F.col("nth")]
    answer = _urn("response", *key)
    digest = F.concat(F.lit("sha1:"), base32_of_hex(F.col("sha")))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF + CRLF))
    host = F.coalesce(F.regexp_extract(uri, "^[a-zA-Z]+://([^/?#]*)", 1), F.lit(""))
    target = F.coalesce(F.regexp_extract(uri, "^[a-zA-Z]+://[^/?#]*([^#]*)", 1), F.lit(""))
    records = F.array(
        _record("request", _urn("request", *key), [("WARC-Target-URI", uri), ("WARC-Concurrent-To", answer), ("Content-Type", F.lit("application/http;msgtype=request"))], F.concat(F.lit("GET "), F.when(target == "", "/").otherwise(target), F.lit(f" HTTP/1.1{CRLF}Host: "), host, F.lit(CRLF + CRLF))),
        _record(
            F.when(revisit, "revisit").otherwise("response"),
            answer,
            [("WARC-Target-URI", uri), ("WARC-Payload-Digest", digest), ("WARC-Refers-To", F.when(revisit, _urn("response", F.col("first_id"), F.col("sha"), F.lit(1)))), ("WARC-Profile", F.when(revisit, PROFILE)), ("Content-Type", F.lit("application/http;msgtype=response"))],
            F.when(revisit, http).otherwise(F.concat(http, F.col("html"))),
        ),
        _record("metadata", _urn("metadata", *key), [("WARC-Target-URI", uri), ("WARC-Concurrent-To", answer), ("Content-Type", F.lit("application/warc-fields"))], F.concat(F.lit("pageId: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(CRLF))),
    )
    page.select(F.explode(records).alias("value")).write.option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", a_file).text(path)


def _headers(block: bytes) -> dict[str, str]:
    found = {}
    for line in block.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if colon:
            found[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    return found


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a file, gzip or plain; a broken end is an error."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        if not data.startswith(b"WARC/1.", at):
            raise ValueError(f"no WARC record at byte {at}")
        end = data.index(b"\r\n\r\n", at)
        headers = _headers(data[data.index(b"\r\n", at) + 2 : end])
        size = int(headers["content-length"])
        block = data[end + 4 : end + 4 + size]
        at = end + 4 + size
        if len(block) < size or data[at : at + 4] != b"\r\n\r\n":
            raise ValueError("a record is cut short")
        at += 4
        yield headers, block


def _records(with_payload: bool):
    def row(headers: dict[str, str], block: bytes) -> dict:
        kind = headers.get("warc-type")
        out = {"record_id": headers.get("warc-record-id"), "record_type": kind, "concurrent_to": headers.get("warc-concurrent-to"), "refers_to_id": headers.get("warc-refers-to"), "target_uri": headers.get("warc-target-uri")}
        out["payload_digest"] = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
        if kind in ("response", "revisit"):
            top, _, payload = block.partition(b"\r\n\r\n")
            if kind == "response":
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                if out["payload_digest"] not in (None, digest):
                    raise ValueError(f"{out['record_id']}: payload and digest differ")
                out |= {"payload_digest": digest, "payload_bytes": len(payload), "payload": payload if with_payload else None}
            else:  # the payload's size is what its HTTP header says
                out["payload_bytes"] = int(_headers(top)["content-length"])
        elif kind == "metadata":
            out["fields"] = list(_headers(block).items())
        return out

    names = ["record_id", "record_type", "concurrent_to", "refers_to_id", "target_uri", "payload_bytes", "payload_digest", "fields", "payload"]
    schema = pa.schema([(n, pa.int64() if n == "payload_bytes" else pa.map_(pa.string(), pa.string()) if n == "fields" else pa.binary() if n == "payload" else pa.string()) for n in names])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                held, size = [], 0
                for headers, block in parse_warc(content.as_py()):
                    held.append(row(headers, block))
                    size += len(block)
                    if len(held) >= 4096 or size >= 4 << 20:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    return scan


def read_records(spark, path: str, with_payload: bool = True) -> DataFrame:
    """One row a record of the files at path; each file is parsed by one task."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(_records(with_payload), RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row a capture: response (a struct), requests and metadata (arrays of structs)."""
    one = F.struct("record_id", "record_type", "target_uri", "refers_to_id", "payload_bytes", "payload_digest", "fields", "payload")
    kind = F.col("record_type")
    keyed = records.withColumn("capture_id", F.coalesce("concurrent_to", "record_id"))
    return (
        keyed.groupBy("capture_id")
        .agg(F.first(F.when(kind.isin("response", "revisit"), one), ignorenulls=True).alias("response"), F.collect_list(F.when(kind == "request", one)).alias("requests"), F.collect_list(F.when(kind == "metadata", one)).alias("metadata"))
        .where(F.col("response").isNotNull())
    )


def op9_warc(spark, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    write_warc(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    captures = assemble(read_records(spark, path, with_payload=False)).select(
        "capture_id",
        F.element_at(F.element_at("metadata", 1)["fields"], "pageid").try_cast("long").alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.record_type").alias("record_type"),
        F.col("response.refers_to_id").alias("refers_to_id"),
    )
    originals = captures.where("record_type = 'response'").groupBy(F.col("capture_id").alias("refers_to_id")).agg(F.min("page_id").alias("refers_to"))
    revisits = captures.where("record_type = 'revisit'").join(originals, "refers_to_id", "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type"]
    return captures.where("record_type = 'response'").select(*columns, F.lit(None).cast("long").alias("refers_to")).unionByName(revisits.select(*columns, "refers_to"))


OP9_SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS x FROM p),
d AS (SELECT *, array_to_string(list_transform(range(0, 8), lambda i: array_to_string(list_transform([15, 10, 5, 0], lambda s:
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(x, i * 5 + 1, 5) AS BIGINT) >> s) & 31 AS BIGINT) + 1, 1)), '')), '') AS digest,
  min(page_id) OVER (PARTITION BY x) AS least FROM h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> least THEN least END AS refers_to FROM d
"""

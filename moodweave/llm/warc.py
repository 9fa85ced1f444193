"""WARC archives without repeated payloads.

Headers alone are shuffled by payload digest; in each group of equal payloads one record stays a response and the others become
revisit records that refer to it.  Archives are written by Spark's text writer (a record's closing CRLF CRLF is the line
separator), so commits are atomic on any file system and survive lost executors, and are read back by Content-Length.  That
writer makes one gzip member a file; where records must be sought, write without compression.
"""

from __future__ import annotations

import base64
import datetime
import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import settle, small_batches

#: Most bytes of one archive file before compression, if no record alone is larger; a file is read whole by one task.
FILE_BYTES = 32 << 20
#: Records are written by classes of their size, each up to four times as large as the one before, so that a number of records
#: bounds a file; the first class goes up to this size.
SMALL_BYTES = 4096
END = "\r\n\r\n"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1 of the UTF-8 bytes of a string: eight runs of five hexadecimal digits as four of base 32."""
    digest = F.sha1(payload)
    runs = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*runs), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def resolve(headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """headers(page_id, payload_digest, payload_bytes, ...) with record_type and refers_to.

    Of records with equal payloads of at least min_bytes bytes, those with the largest page_id are responses (repeated rows all
    are), the others revisits of it.  A null page_id never wins against a number; a group of nulls only are responses.  The group
    maximum is combined before the shuffle and only groups of several records are joined back, on headers; a digest that a third
    of all records share is split by Spark's skew handling, since nothing needs its rows together.
    """
    large = F.col("payload_bytes") >= min_bytes
    groups = headers.where(large).groupBy("payload_digest").agg(F.max("page_id").alias("original"), F.count("*").alias("copies"))
    groups = groups.where(F.col("copies") > 1).select("payload_digest", "original")
    joined = headers.join(groups, "payload_digest", "left")
    revisit = large & F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    return joined.withColumns({"record_type": F.when(revisit, "revisit").otherwise("response"), "refers_to": F.when(revisit, F.col("original"))}).drop("original")


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), page_id.cast("string"), F.lit(">"))


def _record_id(page_id: Column, url: Column, digest: Column) -> Column:
    """The page's name; without a page_id one made of what the record holds, in the form of a UUID."""
    made = F.regexp_replace(F.md5(F.concat_ws(" ", url, digest)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "<urn:uuid:$1-$2-$3-$4-$5>")
    return F.coalesce(_urn(page_id), made)


def _record(fields: list[tuple[str, Column]], block: Column, length: Column) -> Column:
    lines = [F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise(F.lit("")) for name, value in [*fields, ("Content-Length", length.cast("string"))]]
    return F.concat(F.lit("WARC/1.1\r\n"), *lines, F.lit("\r\n"), block)


def _http(payload_bytes: Column) -> Column:
    return F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), payload_bytes.cast("string"), F.lit("\r\n\r\n"))


def _safe(url: Column) -> Column:
    """A header value stays on its line."""
    return F.regexp_replace(url, r"[\r\n]+", " ")


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0, file_bytes: int = FILE_BYTES, date: str | None = None, compression: str = "gzip") -> None:
    """One WARC record a row of pages, under fresh headers, as files of at most file_bytes before compression in folders by size.

    Response records are the only ones that carry payloads, each behind an HTTP header; revisits come from the headers alone.  A
    null html is an empty payload; a null page_id is named by what the record holds; rows that repeat a page_id share its name;
    a payload larger than a file is one of its own; extra columns are not written.  The date of all records is that given, else
    the time of writing, as pages have none.  An empty table writes an empty archive.  Headers and revisits are settled first, so
    the planner knows how many payloads to drop before it reads any: few revisits are broadcast and payloads then go from the
    pages to the archive without a shuffle.
    """
    said = F.lit(date or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ"))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    ceiling = F.col("payload_bytes") + 3 * F.coalesce(F.octet_length("url"), F.lit(0)) + 1024  # of the whole record
    rows = rows.withColumn("size", F.greatest(F.lit(0), F.ceil(F.log(4.0, ceiling / SMALL_BYTES))).cast("int"))
    digested = rows.withColumn("payload_digest", base32_sha1(F.col("payload")))
    headers = settle(digested.select("page_id", "url", "payload_digest", "payload_bytes", "size"), "warc-headers")
    name = lambda i, u: _record_id(F.col(i), F.col(u), F.col("payload_digest"))
    common = [("WARC-Record-ID", name("page_id", "url")), ("WARC-Date", said), ("WARC-Target-URI", _safe(F.col("url"))), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))), ("X-Payload-Length", F.col("payload_bytes").cast("string"))]
    revisit = _record([("WARC-Type", F.lit("revisit")), *common, ("WARC-Refers-To", _urn(F.col("refers_to"))), ("WARC-Refers-To-Date", said), ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))], F.lit(""), F.lit(0))
    http = _http(F.col("payload_bytes"))
    response = _record([("WARC-Type", F.lit("response")), *common, ("Content-Type", F.lit("application/http; msgtype=response"))], F.concat(http, F.col("payload")), F.octet_length(http) + F.col("payload_bytes"))
    revisits = settle(resolve(headers, min_bytes).where("record_type = 'revisit'").withColumn("size", F.greatest(F.lit(0), F.ceil(F.log(4.0, (ceiling - F.col("payload_bytes")) / SMALL_BYTES))).cast("int")), "warc-revisits")

    def write(records: DataFrame, kind: str, size: int) -> None:
        most = max(1, file_bytes // (SMALL_BYTES << (2 * size)))
        records.write.option("lineSep", END).option("compression", compression).option("maxRecordsPerFile", most).text(f"{path}/{kind}-{size}")

    for size in [r["size"] for r in revisits.select("size").distinct().orderBy("size").collect()]:  # a dozen classes at most
        write(revisits.where(F.col("size") == size).select(revisit.alias("record")), "revisits", size)
    gone = revisits.select(F.col("page_id").alias("gone_id"), F.col("payload_digest").alias("gone_digest")).distinct()
    met = digested["page_id"].eqNullSafe(gone["gone_id"]) & (digested["payload_digest"] == gone["gone_digest"])
    for size in [r["size"] for r in headers.select("size").distinct().orderBy("size").collect()] or [0]:
        write(digested.where(F.col("size") == size).join(gone, met, "left_anti").select(response.alias("record")), "responses", size)


def _parse(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    data, at = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw, 0
    while at < len(data):
        head_end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:head_end].decode("utf-8", "replace").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {k: v.strip() for k, _, v in (line.partition(":") for line in lines)}
        start = head_end + 4
        end = start + int(fields["Content-Length"])
        yield fields, data[start:end]
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} is not closed")
        at = end + 4


def read_archives(spark, path: str, payloads: bool = False) -> DataFrame:
    """Every record of the archives under path: page_id, url, record_type, payload_bytes, payload_digest, refers_to and, if asked for, payload.

    A response's length and digest are taken anew from its payload, which is what follows the HTTP header, and the digest is
    checked against the WARC header.  Names that are no page's give a null page_id.
    """
    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long" + ", payload string" * payloads

    def number(urn: str | None) -> int | None:
        return int(urn.rstrip(">").rpartition(":")[2]) if urn and urn.startswith("<urn:page:") else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                rows = []
                for f, block in _parse(raw.as_py()):
                    digest, n = f["WARC-Payload-Digest"].removeprefix("sha1:"), int(f["X-Payload-Length"])
                    if f["WARC-Type"] == "response":
                        block = block[block.index(b"\r\n\r\n") + 4 :]
                        own = base64.b32encode(hashlib.sha1(block).digest()).decode("ascii")
                        if own != digest:
                            raise ValueError(f"payload of {f.get('WARC-Record-ID')} does not have its digest")
                        n = len(block)
                    row = {"page_id": number(f.get("WARC-Record-ID")), "url": f.get("WARC-Target-URI"), "record_type": f["WARC-Type"], "payload_bytes": n, "payload_digest": digest, "refers_to": number(f.get("WARC-Refers-To"))}
                    rows.append(row | ({"payload": block.decode("utf-8", "replace")} if payloads else {}))
                kinds = pa.schema([(n, pa.int64() if n in ("page_id", "payload_bytes", "refers_to") else pa.string()) for n in ("page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", *["payload"] * payloads)])
                yield from pa.Table.from_pylist(rows, kinds).to_batches()

    small_batches(spark)
    # One archive an Arrow batch and few a task: a task holds about one file's bytes at a time.
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt*").load(path).select("content")
    return files.mapInArrow(read, schema)

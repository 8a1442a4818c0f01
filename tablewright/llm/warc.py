"""WARC archives with revisit resolution.

Headers are shuffled by payload digest: of records with equal payloads of a minimal
size the one with the largest id is the response, the others refer to it. Archives
are written by Spark's own writers, so they go wherever the cluster can write: each
record is a gzip member of its own, and files are cut by bytes. They are read back file
by file and record by record; a record's length, never a separator, ends its payload.
"""

from __future__ import annotations

import datetime as dt
import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.common import NULL_ID, pick, public_id
from tablewright.scratch import folder

MIN_BYTES = 1000
#: A file ends with the record that makes it this long, compressed.
FILE_BYTES = 32 << 20
#: Archives are decompressed and rows given on in portions of about so many bytes.
PORTION = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "page long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"


def keyed_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page, url, payload binary, payload_bytes, payload_digest); a null payload is empty, as is a null url."""
    rows = pick(pages, page=id_col, url=url_col, payload=html_col).select(
        F.coalesce(F.col("page").cast("long"), F.lit(NULL_ID)).alias("page"),
        F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), r"[\r\n]+", " ").alias("url"),
        F.coalesce(F.col("payload").cast("binary"), F.lit(b"")).alias("payload"),
    )
    return rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload")})


def find_revisits(headers: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(page, payload_digest, refers_to) of records that repeat a response's payload.

    Needs (page, payload_digest, payload_bytes) only. Digests are grouped with partial
    aggregates, so one that most records share meets no single task with all of them.
    """
    large = headers.where(F.col("payload_bytes") >= min_bytes).select("page", "payload_digest", "payload_bytes")
    kept = large.groupBy("payload_digest").agg(F.max("page").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return large.join(kept, "payload_digest").where("page <> refers_to").select("page", "payload_digest", "refers_to").distinct()


def _header(fields: list[tuple[str, Column | str]]) -> Column:
    parts: list[Column] = [F.lit("WARC/1.1")]
    for name, value in fields:
        parts += [F.lit(f"\r\n{name}: "), F.lit(value) if isinstance(value, str) else value]
    return F.concat(*parts, F.lit("\r\n\r\n"))


def member(record: bytes) -> bytes:
    """A record as gzip, ending in a zero byte: the highest of its length, or that of an empty member after it."""
    data = gzip.compress(record, 6, mtime=0)
    return data if data[-1] == 0 else data + gzip.compress(b"", mtime=0)


def _files(file_bytes: int):
    """Rows of about ``file_bytes`` of compressed records, without the last byte of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], ["value"])

        for batch in batches:
            for header, payload in zip(batch.column("header"), batch.column("payload"), strict=True):
                held.append(member(b"".join([header.as_py().encode(), payload.as_py() or b"", b"\r\n\r\n"])))
                size += len(held[-1])
                if size >= file_bytes:
                    yield row()
                    held, size = [], 0
        if held:
            yield row()

    return run


def write_archives(records: DataFrame, path: str, file_bytes: int = FILE_BYTES, date: str | None = None) -> None:
    """Write (page, url, payload, payload_bytes, payload_digest, refers_to) rows as WARC files with fresh headers.

    ``date`` is that of the records, by default the present. A task holds one file's
    compressed records at a time. Spark's text writer ends each row by a separator: here
    the zero byte in which a gzip member ends.
    """
    date = date or dt.datetime.now(dt.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.col(c).cast("string"), F.lit(">"))
    size = F.col("payload_bytes").cast("string")
    shared = [("WARC-Record-ID", urn("page")), ("WARC-Target-URI", F.col("url")), ("WARC-Date", date), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))), ("WARC-Payload-Length", size)]
    response = _header([("WARC-Type", "response"), *shared, ("Content-Type", "text/html"), ("Content-Length", size)])
    revisit = _header([("WARC-Type", "revisit"), *shared, ("WARC-Profile", PROFILE), ("WARC-Refers-To", urn("refers_to")), ("Content-Length", "0")])
    first = F.col("refers_to").isNull()
    lines = records.select(F.when(first, response).otherwise(revisit).alias("header"), F.when(first, F.col("payload").cast("binary")).alias("payload"))
    files = lines.mapInArrow(_files(file_bytes), "value binary").select(F.col("value").cast("string").alias("value"))
    files.write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def portions(data: bytes, size: int = PORTION) -> Iterator[bytes]:
    """An archive's bytes, decompressed if it is gzip (members one after another, with zeros between them or not)."""
    view, at = memoryview(data), 0
    if data[:2] != b"\x1f\x8b":
        for at in range(0, len(data), size):
            yield bytes(view[at : at + size])
        return
    while at < len(data):
        if view[at] == 0:
            at += 1
            continue
        unpacker = zlib.decompressobj(31)
        while not unpacker.eof:
            if at >= len(data):
                raise ValueError("the archive ends inside a gzip member")
            block = view[at : at + size // 64]
            out = unpacker.decompress(block)
            at += len(block) - len(unpacker.unused_data)
            if out:
                yield out


def parse_archive(stream: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, payload) of each record; holds one record at a time."""
    held, more, place = bytearray(), iter(stream), 0

    def need(n: int) -> bool:
        while len(held) < n:
            part = next(more, None)
            if part is None:
                return False
            held.extend(part)
        return True

    while need(1):
        end = -1
        while end < 0:
            end = held.find(b"\r\n\r\n")
            if end < 0 and not need(len(held) + 1):
                raise ValueError(f"the record at byte {place} has no end of header")
        lines = held[:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {place}")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        a = end + 4
        b = a + int(fields["Content-Length"])
        if not need(b + 4) or held[b : b + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {place} ends short")
        yield fields, bytes(held[a:b])
        del held[: b + 4]
        place += b + 4


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row for each record below path. Digests of responses are computed anew and checked.

    A file comes to its task whole, so those written elsewhere should be below 1 GB, as
    archives usually are; what it holds is decompressed and given on portion by portion.
    """
    number = lambda urn: int(urn.removeprefix("<urn:page:").removesuffix(">"))
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in RECORDS.split(", ")]

    def rows_as_batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for content in batch.column("content"):
                for f, payload in parse_archive(portions(content.as_py())):
                    digest, kind = f["WARC-Payload-Digest"].removeprefix("sha1:"), f["WARC-Type"]
                    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"{f['WARC-Record-ID']}: the payload doesn't have its digest")
                    refers = number(f["WARC-Refers-To"]) if kind == "revisit" else None
                    rows.append((number(f["WARC-Record-ID"]), f["WARC-Target-URI"], kind, digest, int(f["WARC-Payload-Length"]), refers, payload if with_payload else None))
                    size += 200 + (len(payload) if with_payload else 0)
                    if size >= PORTION:
                        yield rows_as_batch(rows)
                        rows, size = [], 0
        if rows:
            yield rows_as_batch(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(run, RECORDS)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Records with refers_to taken from the response that holds their payload, joined by digest.

    A revisit whose response is nowhere in the archives keeps a null refers_to.
    """
    revisits = records.where("record_type = 'revisit'").drop("refers_to")
    originals = records.where("record_type = 'response'").groupBy("payload_digest").agg(F.max("page").alias("refers_to"))
    return records.where("record_type <> 'revisit'").unionByName(revisits.join(originals, "payload_digest", "left").select(records.columns))


def archive_pages(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES, **columns) -> None:
    """Write a deduplicated archive of ``pages``: a record for each row, null ids included.

    Of equal payloads, rows with the largest id are responses; rows that repeat an id and
    payload are all responses, or all revisits of one page. A null id is smaller than any
    other. Null and empty payloads are responses of length 0. Other columns, whatever
    their names, are ignored; an empty table gives no records.
    """
    rows = keyed_pages(pages, **columns)
    revisits = find_revisits(rows, min_bytes)
    write_archives(rows.join(revisits.hint("shuffle_hash"), ["page", "payload_digest"], "left"), path)


def deduplicate_archives(spark: SparkSession, source: str, target: str, min_bytes: int = MIN_BYTES) -> None:
    """Rewrite archives: payloads held twice become revisits, old revisits get their payload's new response.

    A revisit whose response is nowhere in the archives stays as it is.
    """
    records = read_archives(spark, source).withColumn("old", F.col("refers_to"))
    headers = records.select("page", "payload_digest", "payload_bytes", "record_type")
    full = resolve_revisits(records)
    held = headers.where("record_type = 'response'")
    again = find_revisits(held, min_bytes).withColumnRenamed("refers_to", "newer")
    moved = again.select(F.col("page").alias("refers_to"), "payload_digest", F.col("newer").alias("moved"))
    out = full.join(again, ["page", "payload_digest"], "left").join(moved, ["refers_to", "payload_digest"], "left")
    out = out.select("page", "url", "payload", "payload_bytes", "payload_digest", F.coalesce("newer", "moved", "refers_to", "old").alias("refers_to"))
    write_archives(out, target)


def archived_pages(pages: DataFrame, min_bytes: int = MIN_BYTES, **columns) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of archives written and read back.

    For all cases see archive_pages(). A page of any size is one record, which a task
    holds whole.
    """
    spark = pages.sparkSession
    path = folder(spark, "warc")
    archive_pages(pages, path, min_bytes, **columns)
    back = resolve_revisits(read_archives(spark, path, with_payload=False))
    return back.select(public_id("page").alias("page_id"), "payload_bytes", "payload_digest", "record_type", public_id("refers_to").alias("refers_to"))

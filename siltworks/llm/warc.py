"""WARC archives, index first.

Tasks write one gzip member per record and, beside the archive, an index row with file, offset, length, URL and digest.
Reads start from the index: the selected rows are sorted by file and offset, neighbouring byte ranges become one read,
and every payload is checked against its digest. A file carries a random part in its name and only the index of the
successful attempt refers to it, so a task that is run again (or twice) does no harm.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.llm.frames import fresh, map_rows, numbered, octets, text_of
from siltworks.session import pin_small, scratch_path

LEAST_REVISIT = 100
FILE_BYTES, READ_BYTES, GAP_BYTES = 512 * 1024 * 1024, 8 * 1024 * 1024, 64 * 1024
INDEX = "page_id long, url string, file string, offset long, length long, record_id string, record_type string, refers_to_id string, refers_to long, payload_bytes long, payload_digest string"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
_URL_UNSAFE = re.compile(r"[\x00-\x20\x7f]")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record_id(page, copy: int) -> str:
    return f"urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{page}/{copy}'.encode()).digest())}"


def warc_record(headers: dict[str, str], block: bytes) -> bytes:
    """One record, not compressed."""
    lines = ["WARC/1.1", *[f"{k}: {v}" for k, v in headers.items()], f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names lower-cased) and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return headers, rest[: int(headers["content-length"])]


def gzip_member(data: bytes, level: int = 6) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write_archives(pages: DataFrame, root: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_revisit: int = LEAST_REVISIT, date: str = "2026-01-01T00:00:00Z") -> DataFrame:
    """Write a record per row of ``pages`` below ``root`` and return the index, itself written there.

    Null html is an empty payload, a null URL leaves its header out. Of equal payloads of at least ``least_revisit``
    bytes the row with the smallest identifier (nulls last, then the first of repeated rows) is the response and the
    others revisit it. Digests are made before anything is shuffled, and only digests that occur twice are looked up.
    """
    spark = pages.sparkSession
    root = root or scratch_path(spark, "warc")
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page"), F.col(f"`{url_col}`").cast("string").alias("url"), text_of(html_col).alias("html"))
    rows = numbered(rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256)), "pages", "copy")
    one = F.struct(F.col("page").isNull().alias("none"), "page", "copy")
    seen = rows.where(F.octet_length("html") >= least_revisit).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(one).alias("first"))
    twice = pin_small(seen.where("n > 1").select("digest", "first.page", "first.copy").toDF("digest", "first_page", "first_copy"))
    marked = rows.join(twice, "digest", "left").select("page", "url", "html", "copy", "digest", "first_page", "first_copy")
    folder = f"{root.rstrip('/')}/archive"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        store, base = pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        store.create_dir(base, recursive=True)
        sink, name, at = None, "", 0
        try:
            for batch in batches:
                pages_, urls, htmls, copies, digests, firsts, first_copies = (batch.column(i) for i in range(7))
                for page, url, html, copy, digest, first, first_copy in zip(pages_.to_pylist(), urls.to_pylist(), octets(htmls), copies.to_pylist(), digests.to_pylist(), firsts.to_pylist(), first_copies.to_pylist()):
                    if sink is None or at >= FILE_BYTES:
                        if sink:
                            sink.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        sink = store.open_output_stream(f"{base}/{name}", compression=None)
                    revisit = first_copy is not None and first_copy != copy
                    own, other = _record_id(page, copy), _record_id(first, first_copy) if revisit else None
                    headers = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": f"<{own}>", "WARC-Date": date, "WARC-Payload-Digest": f"sha256:{digest}", "Content-Type": "application/http; msgtype=response"}
                    if url is not None:
                        headers["WARC-Target-URI"] = _URL_UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url)
                    if page is not None:
                        headers["Page-Id"] = str(page)
                    if revisit:
                        headers |= {"WARC-Profile": _PROFILE, "WARC-Refers-To": f"<{other}>"}
                        if first is not None:
                            headers["Refers-To-Page-Id"] = str(first)
                    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
                    member = gzip_member(warc_record(headers, http if revisit else http + html))
                    sink.write(member)
                    yield page, url, name, at, len(member), own, headers["WARC-Type"], other, first if revisit else None, len(html), digest
                    at += len(member)
        finally:
            if sink:
                sink.close()

    index = map_rows(marked, write, INDEX)
    index.write.parquet(f"{root.rstrip('/')}/index")
    return read_index(spark, root)


def read_index(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{root.rstrip('/')}/index").withColumn("root", F.lit(root.rstrip("/")))


def ranges(rows: list[tuple], read_bytes: int = READ_BYTES, gap: int = GAP_BYTES) -> Iterator[list[tuple]]:
    """Rows of (file, offset, length, ...), sorted, in groups that one read fetches."""
    held: list[tuple] = []
    for row in rows:
        if held and (row[0] != held[0][0] or row[1] - (held[-1][1] + held[-1][2]) > gap or row[1] + row[2] - held[0][1] > read_bytes):
            yield held
            held = []
        held.append(row)
    if held:
        yield held


def read_records(index: DataFrame, root: str) -> DataFrame:
    """The records of the index rows given: what their headers say, and the payload as read (null for a revisit).

    A record whose bytes do not match its digest or its index row fails the job.
    """
    wanted = index.select("file", "offset", "length", "payload_digest").repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    folder = f"{root.rstrip('/')}/archive"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        store, base = pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        name, source = None, None
        for batch in batches:
            rows = list(zip(*[batch.column(i).to_pylist() for i in range(4)]))
            for group in ranges(rows):
                if group[0][0] != name:
                    if source:
                        source.close()
                    name = group[0][0]
                    source = store.open_input_file(f"{base}/{name}")
                begin = group[0][1]
                held = source.read_at(group[-1][1] + group[-1][2] - begin, begin)
                for _, offset, length, digest in group:
                    headers, block = parse_record(zlib.decompress(held[offset - begin : offset - begin + length], 31))
                    http, _, payload = block.partition(b"\r\n\r\n")
                    revisit = headers["warc-type"] == "revisit"
                    said = headers["warc-payload-digest"].removeprefix("sha256:")
                    if said != digest or not revisit and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"record at {name}:{offset} does not match its digest")
                    size = int(re.search(rb"Content-Length: (\d+)", http)[1]) if revisit else len(payload)
                    page, other = headers.get("page-id"), headers.get("refers-to-page-id")
                    yield int(page) if page else None, headers.get("warc-target-uri"), headers["warc-type"], int(other) if other else None, size, said, None if revisit else payload
        if source:
            source.close()

    return map_rows(wanted, read, RECORDS)


__all__ = ["fresh", "gzip_member", "parse_record", "ranges", "read_index", "read_records", "warc_record", "write_archives"]

"""WARC archives: one gzip member per record, written by Spark tasks and read back as a stream.

Writing: pages with equal payloads of at least ``least_revisit`` bytes become
one ``response`` (smallest page_id) and ``revisit`` records that refer to it.
Reading: each archive is one sequential pass; zlib inflates chunk by chunk,
records are framed by Content-Length, the payload digest is recomputed.

Defined results: null html is an empty payload; a null url is written as the
page's own urn; a null page_id is kept and never referred to; rows repeated
under the smallest page_id are all responses; a page_id that stands with several
payloads is decided for each payload on its own; payloads of any length are
written and read whole; an empty table gives no rows; further columns of the
input are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewise.llm.common import scratch, table

CHUNK = 1 << 20
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, verified boolean, archive string, position long"


def mark_revisits(pages: DataFrame, least_revisit: int = 100) -> DataFrame:
    """page_id, url, html, payload_digest, refers_to: the page whose payload this one repeats, or null.

    Only digests and ids are grouped and shuffled for the decision, with
    partial aggregation, so a payload that a third of the pages share is one
    row per map task.
    """
    text = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", text.alias("html"), F.sha2(text, 256).alias("payload_digest"))
    long_enough = F.octet_length("html") >= least_revisit
    first = rows.where(long_enough).groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    ids = rows.where(long_enough).select("page_id", "payload_digest").join(first, "payload_digest").where("page_id > first_id")
    ids = ids.select("page_id", "payload_digest", F.col("first_id").alias("refers_to")).distinct()
    return rows.join(ids, ["page_id", "payload_digest"], "left")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record, uncompressed."""
    urn = lambda x: f"<urn:page:{'null' if x is None else x}>"
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else urn(page_id)[1:-1]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {urn(page_id)}", f"WARC-Target-URI: {target}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {urn(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(rows: DataFrame, folder: str, roll_bytes: int = 64 << 20, level: int = 3) -> int:
    """Writes page_id, url, html, payload_digest, refers_to as ``*.warc.gz`` into the shared folder; number of records.

    A file is written under a passing name and then moved to a name that
    depends on its partition alone, so a task that runs again replaces its own
    files and never adds to them.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        part, k, n, out, size, passing = TaskContext.get().partitionId(), 0, 0, None, 0, ""

        def close() -> None:
            out.close()
            store.move(passing, f"{root}/part-{part:06d}-{k:05d}.warc.gz")

        for batch in batches:
            for page_id, url, html, digest, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    passing, size = f"{root}/_{part:06d}-{k:05d}-{uuid.uuid4().hex}", 0
                    out = store.open_output_stream(passing, compression=None)
                z = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = z.compress(record(page_id, url, html.encode("utf-8", "surrogatepass"), digest, refers)) + z.flush()
                out.write(member)
                size, n = size + len(member), n + 1
                if size >= roll_bytes:
                    close()
                    out, k = None, k + 1
        if out is not None:
            close()
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    columns = rows.select("page_id", "url", "html", "payload_digest", "refers_to")
    return columns.mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0


def members(chunks: Iterator[bytes]) -> Iterator[tuple[int, bytes]]:
    """(offset, inflated bytes) of each gzip member of a stream, read chunk by chunk."""
    z, start, seen, parts = None, 0, 0, []
    for chunk in chunks:
        while chunk:
            if z is None:
                z, start, parts = zlib.decompressobj(31), seen, []
            parts.append(z.decompress(chunk))
            seen += len(chunk) - len(z.unused_data)
            chunk = z.unused_data
            if z.eof:
                yield start, b"".join(parts)
                z = None
            else:
                break
    if z is not None:
        raise ValueError(f"the gzip member at byte {start} is cut off")


def parse(member: bytes) -> dict:
    """Headers and payload of the one record in a member; raises ValueError where framing or digest is wrong."""
    head, sep, rest = member.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not sep or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    h = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    length = int(h["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"{h.get('warc-record-id')}: Content-Length {length} does not frame its record")
    http, _, payload = rest[:length].partition(b"\r\n\r\n")
    full = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    number = lambda x: None if x is None or x.endswith(":null>") else int(x.rpartition(":")[2].rstrip(">"))
    digest, kind = h["warc-payload-digest"].removeprefix("sha256:"), h["warc-type"]
    if kind == "response" and (len(payload) != full or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"{h['warc-record-id']}: payload and digest differ")
    return {"page_id": number(h["warc-record-id"]), "url": h["warc-target-uri"], "payload_bytes": full, "payload_digest": digest, "record_type": kind, "refers_to": number(h.get("warc-refers-to")), "verified": True if kind == "response" else None}


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record of the archives in a folder; see RECORD for its columns. Memory: one record and one chunk."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("verified", pa.bool_()), ("archive", pa.string()), ("position", pa.int64())])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, name = fs.FileSystem.from_uri(re.sub(r"^(\w+):/(?!/)", r"\1:///", path))
                rows = []
                with store.open_input_stream(name, compression=None) as f:
                    for at, member in members(iter(lambda: f.read(CHUNK), b"")):
                        rows.append(parse(member) | {"archive": name.rpartition("/")[2], "position": at})
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path")
    return files.mapInArrow(read, RECORD)


def archive_pages(pages: DataFrame, least_revisit: int = 100) -> DataFrame:
    """Writes the pages to archives in the shared folder and reads them back: one row per page, as the archives say."""
    spark, folder = pages.sparkSession, scratch(pages.sparkSession, "warc")
    if not write_archives(mark_revisits(pages, least_revisit), folder):
        return spark.createDataFrame([], RECORD)
    return read_archives(spark, folder)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified")


OP10_SQL = """
with p as (select page_id, coalesce(html, '') as t from pages),
d as (select page_id, octet_length(encode(t)) as payload_bytes, sha256(t) as payload_digest from p),
f as (select *, min(page_id) over (partition by payload_digest) as first_id from d)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= 100 and page_id > first_id then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 100 and page_id > first_id then first_id end as refers_to,
       case when payload_bytes >= 100 and page_id > first_id then null else true end as verified
from f
"""

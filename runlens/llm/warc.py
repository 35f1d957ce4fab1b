"""WARC archives with revisit resolution.

`resolve` shuffles headers (page_id, digest, length), never payloads, to find for each payload digest the original response:
the record with the largest page_id. `write_archives` joins revisits to their originals' identity and writes .warc.gz files with
fresh headers; `read_archives` parses them again.

Defined results: a null html is an empty payload; payloads under `min_bytes` are always responses; rows that agree in page_id and
payload are written each with the same decision; a null page_id counts as smaller than any other; a null url leaves the target URI out;
control characters in a url are percent-encoded; extra columns are ignored; an empty table gives no archive and no row.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm.common import batch_of, shared_dir, ship, slices, write_file

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ROWS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, refers_to_url string, archive string"
FIELDS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("refers_to_url", pa.string()), ("archive", pa.string())])


def base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers: tuple[int | None, str | None] | None, date: str) -> bytes:
    """One record, a gzip member by itself. refers: page_id and url of the original for a revisit."""
    safe = "".join(map(chr, range(33, 127)))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=safe)}")
    head.append(f"WARC-Payload-Digest: sha1:{base32(digest)}")
    head.append(f"WARC-Block-Digest: sha1:{base32(hashlib.sha1(block).hexdigest())}")
    if refers:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers[0]}>"]
        if refers[1] is not None:
            head.append(f"WARC-Refers-To-Target-URI: {quote(refers[1], safe=safe)}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    press = zlib.compressobj(5, zlib.DEFLATED, 31)
    return press.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + press.flush()


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of every record; a damaged archive raises."""
    f = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data)), 1 << 20)
    while line := f.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/1."):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head = {}
        while (line := f.readline()).strip():
            name, _, value = line.decode().partition(":")
            head[name.lower()] = value.strip()
        block = f.read(size := int(head["content-length"]))
        if len(block) != size:
            raise ValueError("a record is cut short")
        yield head, block


def with_digest(pages: DataFrame) -> DataFrame:
    """page_id, url, payload (binary), digest (hex), payload_bytes."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary"))
    return pages.select("page_id", "url", payload.alias("payload")).withColumns({"digest": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")})


def resolve(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """The revisits: page_id, digest, original's page_id and url. Only headers are shuffled, partly aggregated before."""
    heads = with_digest(pages).where(F.col("payload_bytes") >= min_bytes).select("page_id", "url", "digest")
    originals = heads.groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("first"))
    again = heads.select("page_id", "digest").distinct().join(originals, "digest")
    again = again.where(~F.col("page_id").eqNullSafe(F.col("first.page_id")))
    return again.select("page_id", "digest", F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("refers_to_url"))


def write_archives(pages: DataFrame, out: str, date: str, min_bytes: int = 0, archive_bytes: int = 16 << 20) -> DataFrame:
    """Writes .warc.gz files of about `archive_bytes` below `out`; returns one row for each file."""
    ship(pages.sparkSession)
    schema = pa.schema([("archive", pa.string()), ("records", pa.int64())])
    again = resolve(pages, min_bytes).select(F.col("page_id").alias("again_id"), F.col("digest").alias("again_digest"), "refers_to", "refers_to_url", F.lit(True).alias("revisit"))
    rows = with_digest(pages)
    rows = rows.join(again, rows.page_id.eqNullSafe(again.again_id) & (rows.digest == again.again_digest), "left").select("page_id", "url", "payload", "digest", "refers_to", "refers_to_url", "revisit")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, k, held, size = TaskContext.get().partitionId(), 0, [], 0

        def close():
            nonlocal k, held, size
            name = f"part-{part:06d}-{k:05d}.warc.gz"
            write_file(f"{out}/{name}", b"".join(held))
            row = batch_of(schema, archive=[name], records=[len(held)])
            k, held, size = k + 1, [], 0
            return row

        for b in slices(batches, "payload", 8 << 20):
            for x in b.to_pylist():
                held.append(record(x["page_id"], x["url"], x["payload"], x["digest"], (x["refers_to"], x["refers_to_url"]) if x["revisit"] else None, date))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield close()
        if held:
            yield close()

    return rows.mapInArrow(write, "archive string, records long")


def read_archives(spark: SparkSession, out: str) -> DataFrame:
    """Parses every archive; checks each response's payload against its digest."""
    ship(spark)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda x: int(x[10:-1]) if x and x[10:-1] else None  # noqa: E731  <urn:page:N>
        for b in batches:
            for path, content in zip(b.column(0), b.column(1)):
                cols: dict[str, list] = {f.name: [] for f in FIELDS}
                for head, block in parse(content.as_buffer().to_pybytes()):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(re.search(rb"(?i)content-length: *(\d+)", http)[1])
                    digest = head["warc-payload-digest"].removeprefix("sha1:")
                    if head["warc-type"] == "response" and (len(payload) != size or base32(hashlib.sha1(payload).hexdigest()) != digest):
                        raise ValueError(f"{path}: payload of {head['warc-record-id']} differs from its header")
                    found = (number(head["warc-record-id"]), head.get("warc-target-uri"), size, digest, head["warc-type"], number(head.get("warc-refers-to")), head.get("warc-refers-to-target-uri"), path.as_py().rpartition("/")[2])
                    for name, value in zip(cols, found):
                        cols[name].append(value)
                if cols["page_id"]:
                    yield batch_of(FIELDS, **cols)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(out).select("path", "content")
    return files.mapInArrow(read, ROWS)


def deduplicated(pages: DataFrame, date: str, out: str | None = None, **options) -> DataFrame:
    """Writes the archives, reads them back and returns one row for each record."""
    spark = pages.sparkSession
    out = out or shared_dir(spark, "warc")
    manifest = f"{out}-manifest"
    write_archives(pages, out, date, **options).write.parquet(manifest)
    if spark.read.parquet(manifest).isEmpty():
        return spark.createDataFrame([], ROWS)
    return read_archives(spark, out)

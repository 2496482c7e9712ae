"""WARC archives written from and read into chunked record tables.

Records are gzip members of their own, as in any .warc.gz. A payload is never held as one object: the writer takes rows (record, chunk number, bytes) that Spark has cut,
writes each chunk as it comes and carries the digest along; the reader streams archives and gives the chunks
of each payload as rows with the digest and length so far. Archives lie in a folder that all executors share
(any URI that Arrow's file systems open). A task writes files of its own names and reports them; only
reported files are read, so tasks that were lost or ran twice leave nothing that is read.

Of records with equal payloads of at least ``least`` bytes, that with the largest id is the response, the
others revisit it (``identical-payload-digest``). A null payload is empty; smaller payloads are all responses.
A record without an id never stands for others that have one. Every response's digest is checked when read.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.session import materialise

CHUNK = 1 << 20
ARCHIVE = 1 << 30
LEVEL = 6
LEAST = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def shared_folder(spark) -> str:
    """A new folder under the cluster's checkpoint folder."""
    materialise(spark.range(0))  # names a folder where the session has none
    return f"{spark.conf.get('spark.checkpoint.dir').rstrip('/')}/sieveline/warc-{uuid.uuid4().hex}"


def record_table(pages: DataFrame, id_col: str, url_col: str, payload_col: str, least: int = LEAST, chunk: int = CHUNK) -> DataFrame:
    """id, url, length, digest, refers_to and the payload in rows (chunk, data)."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(url_col), F.lit("")).alias("url"),
        F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload"),
    ).withColumns({"length": F.octet_length("payload").cast("long"), "digest": F.sha1("payload")})
    heads = (
        rows.filter(F.col("length") >= least)
        .groupBy("digest", "length")
        .agg(F.max("id").alias("_head"), F.count(F.lit(1)).alias("_n"))
        .filter("_n > 1")
        .drop("_n")
    )
    marked = rows.join(heads, ["digest", "length"], "left").withColumn(
        "refers_to", F.when(F.col("_head").isNotNull() & ~F.col("id").eqNullSafe(F.col("_head")), F.col("_head"))
    )
    # A revisit carries no payload; a payload is cut where it lies, so its chunks stay neighbours.
    held = F.when(F.col("refers_to").isNull(), F.col("length")).otherwise(F.lit(0))
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(held / chunk) - 1, F.lit(0)).cast("int")), lambda k: F.when(held > 0, F.substring(F.col("payload"), k * chunk + 1, F.lit(chunk))).otherwise(F.lit(b"")))
    return marked.select("id", "url", "length", "digest", "refers_to", F.posexplode(parts).alias("chunk", "data"))


def http_head(length: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()


def name_of(record: int | None) -> str:
    return f"<urn:x-page:{'' if record is None else record}>"


def warc_head(record: int | None, url: str, length: int, digest: str, refers_to: int | None, block: int) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name_of(record)}", f"WARC-Date: {DATE}"]
    lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {name_of(refers_to)}", f"WARC-Profile: {PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {block}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def write_archives(records: DataFrame, folder: str, limit: int = ARCHIVE) -> DataFrame:
    """Write a record table; the result lists path, records and bytes of the archives."""

    def work(batches):
        at = out = None
        path, count, size, seen = "", 0, 0, None
        for batch in batches:
            for record, url, length, digest, refers_to, chunk, data in zip(*(c.to_pylist() for c in batch.columns)):
                if chunk == 0:
                    if out is not None and size >= limit:
                        out.close()
                        yield path, count, size
                        out = None
                    if out is None:
                        at, base = file_system(folder)
                        at.create_dir(base, recursive=True)
                        path, count, size = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = at.open_output_stream(f"{base}/{path.rpartition('/')[2]}", compression=None)
                    body, done, seen = (length if refers_to is None else 0), 0, hashlib.sha1()
                    head = http_head(length)
                    packed = zlib.compressobj(level=LEVEL, wbits=31)  # a gzip member of its own for each record
                    out.write(packed.compress(warc_head(record, url, length, digest, refers_to, len(head) + body) + head))
                    size += len(head) + body
                    count += 1
                out.write(packed.compress(data))
                seen.update(data)
                done += len(data)
                if done == body:
                    if refers_to is None and seen.hexdigest() != digest:
                        raise ValueError(f"record {record}: the chunks don't have the payload's digest")
                    out.write(packed.compress(b"\r\n\r\n") + packed.flush())
        if out is not None:
            out.close()
            yield path, count, size

    def batches_of(batches):
        for path, count, size in work(batches):
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([count], pa.int64()), pa.array([size], pa.int64())], names=["path", "records", "bytes"])

    return materialise(records.select("id", "url", "length", "digest", "refers_to", "chunk", "data").mapInArrow(batches_of, "path string, records long, bytes long"))


def chunks_of(stream, chunk: int) -> Iterator[tuple]:
    """The chunk rows of one open archive."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        head = headers(stream)
        left = int(head["content-length"])
        http, left_http = {}, left
        status = stream.readline()
        left_http -= len(status)
        while True:
            line = stream.readline()
            left_http -= len(line)
            if not line.strip():
                break
            key, _, value = line.decode().partition(":")
            http[key.strip().lower()] = value.strip()
        kind = head["warc-type"]
        digest = head["warc-payload-digest"].partition(":")[2]
        seen, number, read = hashlib.sha1(), 0, 0
        length = int(http["content-length"])
        while True:
            data = stream.read(min(chunk, left_http - read))
            read += len(data)
            seen.update(data)
            last = read == left_http
            if not last and not data:
                raise ValueError("an archive ends inside a record")
            if kind == "revisit":
                so_far, size = digest, length
            else:
                so_far, size = seen.hexdigest(), read
                if last and (so_far != digest or read != length):
                    raise ValueError(f"{head['warc-record-id']}: payload and digest differ")
            yield head["warc-record-id"], kind, head.get("warc-refers-to"), head["warc-target-uri"], number, last, size, so_far, data
            number += 1
            if last:
                break


def headers(stream) -> dict[str, str]:
    found = {}
    while True:
        line = stream.readline()
        if not line.strip():
            return found
        key, _, value = line.decode().partition(":")
        found[key.strip().lower()] = value.strip()


def read_archives(archives: DataFrame, chunk: int = CHUNK, payloads: bool = True) -> DataFrame:
    """The chunk rows of listed archives: record_id, record_type, refers_to, url, chunk, last, size and digest of
    the payload so far (of a revisit: of the payload it stands for), data."""
    names = ["record_id", "record_type", "refers_to", "url", "chunk", "last", "size", "digest", "data"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.binary()]

    def work(batches):
        rows, held = [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                at, name = file_system(path)
                with at.open_input_stream(name, compression=None, buffer_size=1 << 20) as raw, io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 18) as stream:
                    for row in chunks_of(stream, chunk):
                        rows.append(row if payloads else (*row[:-1], None))
                        held += 400 + (len(row[-1]) if payloads else 0)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    schema = "record_id string, record_type string, refers_to string, url string, chunk long, last boolean, size long, digest string, data binary"
    cores = archives.sparkSession.sparkContext.defaultParallelism
    return archives.select("path").repartition(max(cores, 1)).mapInArrow(work, schema)

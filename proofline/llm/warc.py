"""WARC archives: a writer of per-record gzip members and a splittable reader.

The reader needs no index. A task gets a range of bytes of a file, looks there for gzip's magic bytes, and takes a place for the
start of a member only if what follows inflates to a WARC record's header. It owns the records that start in its range and reads
past the end of the range to finish its last one.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.llm.common import Scratch, prepare

MAGIC = b"\x1f\x8b\x08"
CHUNK = 1 << 20
#: Tasks of one read.
MOST_TASKS = 50_000
RECORD = "record_type string, target_uri string, record_id string, refers_to_id string, payload_digest string, payload_bytes long, payload binary"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def member(kind: str, uri: str, record_id: str, digest: str, refers_to: str | None, payload: bytes) -> bytes:
    """One record in one gzip member. A revisit keeps the HTTP header, with the payload's length, and leaves the payload out."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}"]
    head += [f"WARC-Target-URI: {uri}"] if uri else []
    head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {refers_to}"] if kind == "revisit" else []
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def write(pages: DataFrame, folder: str, min_revisit_bytes: int = 0, file_bytes: int = 256 << 20) -> DataFrame:
    """Write a record for every row of pages (page_id, url, html) below folder, a path that all executors share.

    Gives (path, records, bytes) of the files. Of rows with equal payloads of at least min_revisit_bytes bytes, that with the
    smallest page_id is a response and the others revisit it; repeated rows of that page_id are each a response. A null html is an
    empty payload; rows with a null page_id are responses only if the payload has no other row. A task writes files under names of its own attempt, and
    only files of attempts that succeeded are listed, so a task that runs again harms nothing.
    """
    spark = pages.sparkSession
    prepare(spark)
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    shared = rows.where(F.octet_length("payload") >= min_revisit_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    marked = rows.join(shared, "digest", "left")
    arrow = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, out, done, name = None, None, [], f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for page_id, url, payload, first in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "first")), strict=True):
                page_id, first, payload = page_id.as_py(), first.as_py(), payload.as_py()
                kind = "response" if first is None or page_id == first else "revisit"
                if out is None:
                    where = f"{name}-{len(done)}.warc.gz"
                    out, records, written = store.open_output_stream(f"{base}/{where}", compression=None), 0, 0
                uri = "".join((url.as_py() or "").split())
                data = member(kind, uri, _uri(page_id), base32_sha1(payload), _uri(first) if kind == "revisit" else None, payload)
                out.write(data)
                records, written = records + 1, written + len(data)
                if written >= file_bytes:
                    out.close()
                    out = done.append((f"{folder}/{where}", records, written))
        if out is not None:
            out.close()
            done.append((f"{folder}/{where}", records, written))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done, strict=True), arrow, strict=True)], schema=arrow)

    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    return marked.select("page_id", "url", "payload", "first").mapInArrow(run, "path string, records long, bytes long")


class _Source:
    """A file read forward in chunks; what lies before the place of interest is let go."""

    def __init__(self, file: fs.NativeFile, at: int):
        self.file, self.base, self.data = file, at, b""
        file.seek(at)

    def more(self) -> bool:
        got = self.file.read(CHUNK)
        self.data += got
        return bool(got)

    def forget(self, at: int) -> None:
        if at - self.base >= CHUNK:
            self.data, self.base = self.data[at - self.base :], at

    def back(self, at: int) -> None:
        if at < self.base:
            self.file.seek(at)
            self.data, self.base = b"", at


def _header(data: bytes) -> dict[str, str] | None:
    """The fields of a WARC header at the start of data; None if it is none or not whole."""
    if not data.startswith(b"WARC/") or b"\r\n\r\n" not in data:
        return None
    lines = data[: data.index(b"\r\n\r\n")].decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    return fields if "warc-type" in fields and fields.get("content-length", "").isdigit() else None


def scan(file: fs.NativeFile, start: int, end: int, max_header: int = 1 << 20) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header, block) of the members that start in [start, end) and hold a whole WARC record.

    The magic bytes also occur by chance inside members. Such a place is passed over, since what follows doesn't inflate to a
    WARC header of at most max_header bytes; after a member that was read whole, the search goes on behind it.
    """
    source, at = _Source(file, start), start
    while at < end:
        found = source.data.find(MAGIC, at - source.base)
        if found < 0:
            at = max(at, source.base + len(source.data) - len(MAGIC) + 1)
            source.forget(at)
            if not source.more():
                return
            continue
        at = source.base + found
        if at >= end:
            return
        source.forget(at)
        unpack, text, pos, fields, good = zlib.decompressobj(31), [], at, None, True
        try:
            while not unpack.eof:
                if pos - source.base >= len(source.data) and not source.more():
                    break
                piece = source.data[pos - source.base : pos - source.base + (1 << 16)]
                got = unpack.decompress(piece)
                pos += len(piece) - len(unpack.unused_data)
                if fields is not None:  # most likely a record; should it not end well, the file is read again from here
                    source.forget(pos)
                text.append(got)
                if fields is None:
                    head = b"".join(text)
                    text = [head]
                    fields = _header(head)
                    if fields is None and (not b"WARC/".startswith(head[:5]) and not head.startswith(b"WARC/") or len(head) > max_header):
                        good = False
                        break
        except zlib.error:
            good = False
        if not good or not unpack.eof or fields is None:
            at += 1
            source.back(at)
            continue
        record = b"".join(text)
        body = record.index(b"\r\n\r\n") + 4
        length = int(fields["content-length"])
        if len(record) >= body + length:
            yield at, fields, record[body : body + length]
        at = pos


def _payload(fields: dict[str, str], block: bytes) -> tuple[int, bytes | None]:
    """The payload's length by the HTTP header (else the block's), and for a response the payload."""
    head, mark, payload = block.partition(b"\r\n\r\n")
    if not (mark and head.startswith(b"HTTP/")):
        return len(block), block
    if fields["warc-type"] != "revisit":
        return len(payload), payload
    sizes = [v for k, _, v in (line.partition(b":") for line in head.split(b"\r\n")) if k.strip().lower() == b"content-length"]
    return int(sizes[0]) if sizes else 0, None


def read(spark: SparkSession, files: DataFrame, split_bytes: int = 16 << 20) -> DataFrame:
    """The records of files (path, bytes): one row each, with the columns of RECORD.

    Ranges of split_bytes are dealt to tasks; a file may be larger than any task's share. The digest of a response is computed
    from its payload; a revisit has that of its header and no payload. What is no whole record is passed over.
    """
    prepare(spark)
    ranges = files.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))).alias("start"))
    arrow = pa.schema([("record_type", pa.string()), ("target_uri", pa.string()), ("record_id", pa.string()), ("refers_to_id", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, start in zip(*(batch.column(c).to_pylist() for c in ("path", "bytes", "start")), strict=True):
                store, name = fs.FileSystem.from_uri(path)
                held, held_bytes = [], 0
                with store.open_input_file(name) as file:
                    for _, fields, block in scan(file, start, min(start + split_bytes, size)):
                        n, payload = _payload(fields, block)
                        digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") if payload is None else base32_sha1(payload)
                        held.append((fields["warc-type"], fields.get("warc-target-uri"), fields.get("warc-record-id"), fields.get("warc-refers-to"), digest, n, payload))
                        held_bytes += len(block)
                        if held_bytes > 8 << 20 or len(held) >= 1000:
                            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), arrow, strict=True)], schema=arrow)
                            held, held_bytes = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), arrow, strict=True)], schema=arrow)

    return ranges.repartition(max(1, min(ranges.count(), MOST_TASKS))).mapInArrow(run, RECORD)  # a range for each task, or a few


def round_trip(pages: DataFrame, min_revisit_bytes: int = 0, split_bytes: int = 16 << 20) -> DataFrame:
    """Write pages to the shared folder and read the archives back: (page_id, record_type, refers_to, payload_digest, payload_bytes, payload)."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    files = scratch.keep(write(pages, f"{scratch.folder}/archives", min_revisit_bytes), "files")
    id_of = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    return read(spark, files, split_bytes).select(id_of("record_id").alias("page_id"), "record_type", id_of("refers_to_id").alias("refers_to"), "payload_digest", "payload_bytes", "payload")

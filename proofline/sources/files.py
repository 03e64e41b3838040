"""Files that tasks read and write themselves, byte for byte: transcripts, their masked copies, mutants, JSON lists.

Paths are local or URIs that pyarrow's file systems open; a cluster needs a folder that all executors share. A file is written
under a name of its own attempt and moved when it is whole, so a task that runs again harms nothing.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline.packages import ship

WRITTEN = "path string, lines long, bytes long, sha256 string"
#: Rows of an output batch.
BATCH = 1000


def place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(path))


def joined(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{name}"


def existing(paths: DataFrame) -> DataFrame:
    """Of rows (path): those whose path is a file. The tasks look, not the driver."""
    ship(paths.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            there = []
            for path in batch.column("path").to_pylist():
                try:
                    store, name = place(path)
                    there.append(store.get_file_info(name).type == fs.FileType.File)
                except (OSError, ValueError):
                    there.append(False)
            yield batch.filter(pa.array(there, pa.bool_()))

    return paths.select("path").where("path is not null").distinct().mapInArrow(run, "path string")


def _split(stream: pa.NativeFile) -> Iterator[str]:
    """The text between line feeds, the part after the last one too."""
    rest = b""
    while chunk := stream.read(1 << 20):
        parts = chunk.split(b"\n")
        if len(parts) == 1:
            rest += chunk
            continue
        yield (rest + parts[0]).decode("utf-8", "replace")
        for part in parts[1:-1]:
            yield part.decode("utf-8", "replace")
        rest = parts[-1]
    yield rest.decode("utf-8", "replace")


def physical_lines(files: DataFrame, returns: bool = False) -> DataFrame:
    """(path, line, raw) of the files of rows (path): split at line feeds only, so that the lines joined by them are the file.

    returns: carriage returns, alone or before a line feed, end lines too.
    Bytes that are not UTF-8 become the replacement character. A task holds no more of a file than a batch of lines.
    """
    ship(files.sparkSession)
    schema = pa.schema([("path", pa.string()), ("line", pa.int32()), ("raw", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, name = place(path)
                with store.open_input_stream(name, compression=None) as stream:
                    held: list[str] = []
                    number = 0
                    for text in _split(stream):
                        for raw in text.removesuffix("\r").split("\r") if returns else (text,):
                            held.append(raw)
                            number += 1
                            if len(held) == BATCH:
                                yield _lines(path, number, held)
                                held = []
                    if held:
                        yield _lines(path, number, held)

    def _lines(path: str, last: int, held: list[str]) -> pa.RecordBatch:
        numbers = range(last - len(held) + 1, last + 1)
        return pa.RecordBatch.from_arrays([pa.array([path] * len(held)), pa.array(numbers, pa.int32()), pa.array(held)], schema=schema)

    return files.select("path").mapInArrow(run, "path string, line int, raw string")


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[str, Iterator[str]]]:
    """Of rows sorted by a key: each key with its texts, which are read as they are asked for."""
    rows = ((k, t) for batch in batches for k, t in zip(batch.column(key).to_pylist(), batch.column("text").to_pylist(), strict=True))
    ahead = next(rows, None)
    while ahead is not None:
        now = ahead[0]

        def texts() -> Iterator[str]:
            nonlocal ahead
            while ahead is not None and ahead[0] == now:  # noqa: B023
                yield ahead[1] or ""
                ahead = next(rows, None)

        mine = texts()
        yield now, mine
        for _ in mine:  # what was not asked for
            pass


def digests(rows: DataFrame, key: str) -> DataFrame:
    """(key, sha256) of each key's texts (key, line, text) in order, joined by line feeds; no text is held but the one at hand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, texts in _groups(batches, key):
            digest = hashlib.sha256()
            for i, text in enumerate(texts):
                digest.update(("\n" if i else "").encode() + text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([digest.hexdigest()])], names=[key, "sha256"])

    ship(rows.sparkSession)
    return rows.select(key, "line", "text").repartition(key).sortWithinPartitions(key, "line").mapInArrow(run, f"{key} string, sha256 string")


def write_files(rows: DataFrame, folder: str) -> DataFrame:
    """Write a file below folder for each path of rows (path, line, text): its texts in order, joined by line feeds, and no more.

    Gives (path, lines, bytes, sha256), which are taken while writing. Running it writes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, texts in _groups(batches, "path"):
            store, name = place(joined(folder, path))
            store.create_dir(os.path.dirname(name), recursive=True)
            aside, digest, count, size = f"{name}.{uuid.uuid4().hex}.part", hashlib.sha256(), 0, 0
            with store.open_output_stream(aside, compression=None) as out:
                for text in texts:
                    data = ("\n" if count else "").encode() + text.encode()
                    out.write(data)
                    digest.update(data)
                    count, size = count + 1, size + len(data)
            store.move(aside, name)
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([count]), pa.array([size]), pa.array([digest.hexdigest()])], names=["path", "lines", "bytes", "sha256"])

    ship(rows.sparkSession)
    return rows.select("path", "line", "text").repartition("path").sortWithinPartitions("path", "line").mapInArrow(run, WRITTEN)


def write_list(rows: DataFrame, path: str, order: list[str]) -> None:
    """Write the rows as one JSON list, in order; columns that are null are left out. One task streams it."""
    texts = rows.select(F.to_json(F.struct(*rows.columns)).alias("text"), *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, name = place(path)
        store.create_dir(os.path.dirname(name), recursive=True)
        aside, count = f"{name}.{uuid.uuid4().hex}.part", 0
        with store.open_output_stream(aside, compression=None) as out:
            for batch in batches:
                for text in batch.column("text").to_pylist():
                    entry = json.dumps(json.loads(text), indent=2, ensure_ascii=False).replace("\n", "\n  ")
                    out.write((("," if count else "[") + "\n  " + entry).encode())
                    count += 1
            out.write(b"\n]" if count else b"[]")
        store.move(aside, name)
        yield pa.RecordBatch.from_arrays([pa.array([count])], names=["entries"])

    ship(rows.sparkSession)
    texts.repartition(1).sortWithinPartitions(*order).select("text").mapInArrow(run, "entries long").collect()

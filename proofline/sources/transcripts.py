"""Transcript files (JSON lines, one file a session) as rows of lines.

Strict JSON is the only thing that Spark's own parsers don't offer (they take trailing text, single quotes, or reject repeated
keys), so a line is parsed in Python, over Arrow batches, straight into typed columns; all that follows is DataFrame operations.
"""

from __future__ import annotations

import glob
import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.packages import ship

KNOWN_TYPES = ("assistant", "user", "system", "attachment")
TOOLS = ("Bash", "Edit", "Write")
BLOCK = "kind string, text string, tool string, tool_id string, command string, file_path string, is_error boolean"
PARSED = f"file string, line int, raw string, state string, type string, session_id string, version string, cwd string, ts string, plain string, bad_content boolean, blocks array<struct<{BLOCK}>>"


def expand(patterns: list[str]) -> list[str]:
    """Files of the glob patterns, each once and sorted; a pattern without a match is taken as a path."""
    found: set[str] = set()
    for pattern in patterns:
        found.update([p for p in glob.glob(pattern, recursive=True) if os.path.isfile(p)] or [pattern])
    return sorted(found)


def read_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, content): whole files by any path that Spark reads. One file is one session, which one task must hold."""
    df = spark.read.text(paths, wholetext=True)
    return df.select(F.regexp_replace("_metadata.file_path", "^file:/+", "/").alias("file"), F.col("value").alias("content"))


def lines(files: DataFrame, breaks: str = r"\r\n|\n|\r") -> DataFrame:
    """(file, line, raw): all physical lines, numbered from 1."""
    out = files.select("file", F.posexplode(F.split("content", breaks, -1)).alias("pos", "raw"))
    return out.select("file", (F.col("pos") + 1).alias("line"), "raw")


def _constant(name: str) -> None:
    raise ValueError(name)


def strict_json(text: str) -> object:
    """JSON as ECMAScript reads it: nothing after the value, no NaN or Infinity; of repeated keys the last counts."""
    return json.loads(text.strip(" \t\n\r"), parse_constant=_constant) if not text.startswith("﻿") else _constant("byte order mark")


def is_json(text: str | None) -> bool:
    try:
        strict_json(text or "")
    except (ValueError, RecursionError):
        return False
    return True


def _text(value: object) -> str | None:
    """Strings only; halves of surrogate pairs become the replacement character, as in UTF-8 output."""
    if not isinstance(value, str):
        return None
    return value if value.isascii() else value.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _result_text(content: object) -> str:
    if isinstance(content, str):
        return content
    if isinstance(content, list):
        return "\n".join(b["text"] for b in content if isinstance(b, dict) and b.get("type") == "text" and isinstance(b.get("text"), str))
    return ""


def _block(block: object, speaker: str) -> dict:
    """kind: text, blank, ignored, use, result, unsupported or invalid."""
    if not isinstance(block, dict):
        return {"kind": "invalid"}
    kind = block.get("type")
    if kind == "text":
        text = block.get("text")
        return {"kind": "text", "text": _text(text)} if isinstance(text, str) and text.strip() else {"kind": "blank"}
    if speaker == "assistant":
        if kind == "thinking":
            return {"kind": "ignored"}
        if kind != "tool_use" or not isinstance(block.get("name"), str) or not isinstance(block.get("id"), str):
            return {"kind": "invalid"}
        if block["name"] not in TOOLS:
            return {"kind": "unsupported"}
        given = block.get("input") if isinstance(block.get("input"), dict) else {}
        return {"kind": "use", "tool": block["name"], "tool_id": _text(block["id"]), "command": _text(given.get("command")) or "", "file_path": _text(given.get("file_path")) or ""}
    if kind != "tool_result" or not isinstance(block.get("tool_use_id"), str):
        return {"kind": "invalid"}
    return {"kind": "result", "tool_id": _text(block["tool_use_id"]), "is_error": block.get("is_error") is True, "text": _text(_result_text(block.get("content")))}


def parse_line(raw: str) -> dict:
    """state: blank, parse_error, unknown_type or parsed."""
    if not raw.strip("﻿ \t\n\r\x0b\x0c\xa0     　" + "".join(map(chr, range(0x2000, 0x200B)))):
        return {"state": "blank"}
    try:
        found = strict_json(raw)
    except (ValueError, RecursionError):
        return {"state": "parse_error"}
    if not isinstance(found, dict) or found.get("type") not in KNOWN_TYPES:
        return {"state": "unknown_type"}
    out = {"state": "parsed", "type": found["type"]} | {to: _text(found.get(key)) for to, key in (("session_id", "sessionId"), ("version", "version"), ("cwd", "cwd"), ("ts", "timestamp"))}
    if found["type"] in ("assistant", "user"):
        message = found.get("message")
        content = message.get("content") if isinstance(message, dict) else None
        if isinstance(content, str):
            out["plain"] = _text(content) if content.strip() else None
        elif isinstance(content, list):
            out["blocks"] = [_block(b, found["type"]) for b in content]
        elif content is not None:
            out["bad_content"] = True
    return out


def parse(rows: DataFrame) -> DataFrame:
    """lines() with the columns of PARSED."""
    ship(rows.sparkSession)
    block = pa.list_(pa.struct([(n, pa.bool_() if n == "is_error" else pa.string()) for n in ("kind", "text", "tool", "tool_id", "command", "file_path", "is_error")]))
    names = ("state", "type", "session_id", "version", "cwd", "ts", "plain", "bad_content", "blocks")
    kinds = [pa.string()] * 7 + [pa.bool_(), block]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parse_line(raw) for raw in batch.column("raw").to_pylist()]
            arrays = [pa.array([f.get(n) for f in found], k) for n, k in zip(names, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, *names])

    return rows.select("file", "line", "raw").mapInArrow(run, PARSED)

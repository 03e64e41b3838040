"""Transcript lines to sessions and events."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofline.functions.commands import command_class, suppressed
from proofline.functions.dictionaries import COMMAND_CLASSES, Redaction
from proofline.functions.patterns import js
from proofline.functions.redact import redact_with_count
from proofline.operators.pairing import paired

EVENT = ("ts", "type", "tool", "input", "outcome_status", "outcome_exit_code", "cwd", "use_line", "result_line", "tool_id")


def _absent(text: Column) -> Column:
    return F.when(text != "", text)


def exit_code(text: Column) -> Column:
    return F.regexp_extract(text, js(r"Exit code (\d+)"), 1).try_cast("int")


def raw_events(parsed: DataFrame) -> DataFrame:
    """(file, seq, EVENT) from parsed lines: tool events where their result stands, then a line's instruction, then open uses,
    then the last assistant text as the report."""
    some = parsed.where("state = 'parsed'")
    blocks = some.select("file", "line", "type", "cwd", "ts", F.posexplode("blocks").alias("blk", "b")).select("file", "line", "blk", "type", "cwd", "ts", "b.*")
    tokens = blocks.where("kind in ('use', 'result')").withColumn("is_use", F.col("kind") == "use")
    tokens = paired(tokens, ["file", "tool_id"], ["line", "blk"])
    tool_input = lambda u: F.when(F.col(f"{u}tool") == "Bash", F.col(f"{u}command")).otherwise(F.col(f"{u}file_path"))
    tool_type = lambda u: F.when(F.col(f"{u}tool") == "Bash", "command").otherwise("file_edit")
    none, nothing = F.lit(None).cast("string"), F.lit(None).cast("int")
    answered = tokens.where("use is not null").select(
        "file", F.struct(F.lit(0).alias("phase"), "line", F.lit(0).alias("sub"), "blk").alias("at"), F.coalesce("ts", "use.ts").alias("ts"), tool_type("use.").alias("type"), F.col("use.tool").alias("tool"), tool_input("use.").alias("input"),
        F.when(F.col("is_error"), "error").otherwise("ok").alias("outcome_status"), exit_code(F.col("text")).alias("outcome_exit_code"), _absent(F.col("use.cwd")).alias("cwd"), F.col("use.line").alias("use_line"), F.col("line").alias("result_line"), F.col("tool_id"),
    )
    orphans = tokens.where("orphan").select(
        "file", F.struct(F.lit(1).alias("phase"), F.col("place.line").alias("line"), F.lit(0).alias("sub"), F.col("place.blk").alias("blk")).alias("at"), "ts", tool_type("").alias("type"), "tool", tool_input("").alias("input"),
        F.lit("unknown").alias("outcome_status"), nothing.alias("outcome_exit_code"), _absent(F.col("cwd")).alias("cwd"), F.col("line").alias("use_line"), nothing.alias("result_line"), "tool_id",
    )
    texts = F.transform(F.filter("blocks", lambda b: b["kind"] == "text"), lambda b: b["text"])
    spoken = some.withColumn("said", F.coalesce("plain", F.when(F.size(texts) > 0, F.array_join(texts, "\n")))).where("type = 'user' and said is not null")
    plain_event = lambda df, phase, kind, text: df.select(
        "file", F.struct(F.lit(phase).alias("phase"), "line", F.lit(1).alias("sub"), F.lit(0).alias("blk")).alias("at"), "ts", F.lit(kind).alias("type"), none.alias("tool"), F.col(text).alias("input"),
        none.alias("outcome_status"), nothing.alias("outcome_exit_code"), _absent(F.col("cwd")).alias("cwd"), F.col("line").alias("use_line"), nothing.alias("result_line"), none.alias("tool_id"),
    )
    instructions = plain_event(spoken, 0, "instruction", "said")
    last = some.where("type = 'assistant'").select("file", "line", "ts", "cwd", F.coalesce("plain", F.try_element_at(F.filter(texts, lambda t: t.isNotNull()), F.lit(-1))).alias("said")).where("said is not null")
    last = last.groupBy("file").agg(F.max_by(F.struct("line", "ts", "cwd", "said"), "line").alias("r")).select("file", "r.*")
    reports = plain_event(last, 2, "report", "said")
    events = answered.unionByName(instructions).unionByName(orphans).unionByName(reports)
    return events.withColumn("seq", F.row_number().over(Window.partitionBy("file").orderBy("at")) - 1).drop("at")


def session_facts(parsed: DataFrame) -> DataFrame:
    """A row for each file: its id (the first non-empty of its lines, else its name), version, and counts of lines and blocks."""
    named = F.col("state") == "parsed"
    first = lambda c: F.min_by(c, F.when(named & (F.col(c) != ""), F.col("line")))
    kinds = lambda kind: F.sum(F.coalesce(F.size(F.filter("blocks", lambda b: b["kind"] == kind)), F.lit(0)))
    is_ = lambda *states: F.count_if(F.col("state").isin(*states))
    facts = parsed.groupBy("file").agg(
        first("session_id").alias("content_id"), first("version").alias("version"), is_("parse_error", "unknown_type", "parsed").alias("total_lines"), is_("parsed").alias("parsed_lines"),
        is_("parse_error", "unknown_type").alias("skipped_lines"), is_("parse_error").alias("parse_error_lines"), is_("unknown_type").alias("unknown_type_lines"),
        kinds("unsupported").alias("unsupported_tool_count"), (kinds("invalid") + F.count_if("bad_content")).alias("invalid_block_count"), kinds("result").alias("results"),
    )
    name = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.jsonl\z", "")
    project = F.coalesce(F.get(F.split("file", "/"), F.size(F.split("file", "/")) - 2), F.lit(""))
    return facts.withColumns({"session_id": F.coalesce("content_id", name), "mismatch": F.coalesce(F.col("content_id") != name, F.lit(False)), "project": project})


def adapt(parsed: DataFrame, settings: Redaction = Redaction(), classes: Mapping[str, list[str]] = COMMAND_CLASSES, agent: str = "transcript", ingested_at: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(sessions, events) of parsed lines. Classes come from raw commands; what is stored is redacted. Both keep the column file."""
    facts = session_facts(parsed)
    raw = raw_events(parsed)
    is_command = F.col("type") == "command"
    marked = raw.withColumns({"command_class": F.when(is_command, command_class(F.col("input"), classes)), "suppressed": F.when(is_command, suppressed(F.col("input")))})
    masked = redact_with_count(redact_with_count(marked, "input", "redacted_input", "n_input", settings), "cwd", "cwd", "n_cwd", settings)
    events = masked.join(facts.select("file", "session_id"), "file").select(
        "file", "session_id", "seq", "ts", "type", "tool", "redacted_input", "command_class", "suppressed", "outcome_status", "outcome_exit_code", "cwd",
        F.col("use_line").alias("evidence_tool_use_source_line"), F.col("result_line").alias("evidence_tool_result_source_line"), F.col("tool_id").alias("evidence_tool_use_id"),
    )
    counts = masked.groupBy("file").agg(F.sum(F.col("n_input") + F.coalesce("n_cwd", F.lit(0))).alias("n_events"), F.count_if(F.col("result_line").isNotNull()).alias("answered"))
    named = facts.join(counts, "file", "left")
    named = redact_with_count(redact_with_count(named, "file", "source_path", "n_path", settings), "project", "project", "n_project", settings)
    sessions = named.select(
        "file", F.col("session_id").alias("id"), F.lit(agent).alias("agent_name"), F.coalesce("version", F.lit("unknown")).alias("agent_version"), F.lit(2).alias("schema_version"), "source_path",
        (F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'") if ingested_at is None else ingested_at).alias("ingested_at"), "project", "total_lines", "skipped_lines", "parse_error_lines", "unknown_type_lines", "unsupported_tool_count",
        (F.col("results") - F.coalesce("answered", F.lit(0))).alias("unmatched_result_count"), "invalid_block_count", (F.coalesce("n_events", F.lit(0)) + F.col("n_path") + F.col("n_project")).cast("long").alias("redaction_count"), "mismatch",
    )
    return sessions, events

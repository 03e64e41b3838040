"""The tables of the engine."""

from __future__ import annotations

from pyspark.sql.types import StructType, _parse_datatype_string


def _schema(text: str) -> StructType:
    kind = _parse_datatype_string(text)
    assert isinstance(kind, StructType)
    return kind


SCHEMA_VERSION = 2
STORE_VERSION = 6
EVENT_TYPES = ("command", "file_edit", "test_run", "instruction", "report")
COMMAND_CLASSES = ("test", "lint", "build", "composite")
STATUSES = ("ok", "error", "unknown")
CHECK_KINDS = ("test_pass", "lint_clean", "build_ok")
CLAIM_KINDS = (*CHECK_KINDS, "task_done", "scope_respected", "verification_done")
VERDICTS = ("proven", "contradicted", "unknown")
#: The classes of commands that are evidence for a kind of claim.
EVIDENCE = {"test_pass": ("test", "composite"), "lint_clean": ("lint", "composite"), "build_ok": ("build", "composite")}


def tables() -> dict[str, StructType]:
    """Name to schema; needs an active session."""
    return {
        "sessions": _schema("id string, agent_name string, agent_version string, schema_version int, source_path string, ingested_at string, project string, total_lines long, skipped_lines long, parse_error_lines long, unknown_type_lines long, unsupported_tool_count long, unmatched_result_count long, invalid_block_count long, redaction_count long"),
        "events": _schema("session_id string, seq int, ts string, type string, tool string, redacted_input string, command_class string, suppressed boolean, outcome_status string, outcome_exit_code int, cwd string, evidence_tool_use_source_line int, evidence_tool_result_source_line int, evidence_tool_use_id string"),
        "claims": _schema("claim_id string, session_id string, text string, kind string, turn int, cwd string, scope_subtype string, paths array<string>, extractor_backend string, extractor_model string, extractor_prompt_version string"),
        "verdicts": _schema("session_id string, claim_id string, verdict string, reason_code string, evidence_refs array<int>"),
    }

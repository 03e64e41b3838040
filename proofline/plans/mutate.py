"""Mutation: transcripts changed so that the right verdict on one claim is known.

Each operator looks for sessions that it can change by plain queries over events and claims, never by verdicts. What it does is a
row of edits (lines to leave out, lines to rewrite, lines to put before the report); one join with the sessions' lines makes all
mutants of all sessions at once.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from proofline.functions.dictionaries import COMMAND_CLASSES, Redaction
from proofline.operators.adapter import adapt
from proofline.operators.claims import RuleClaims
from proofline.packages import ship
from proofline.schemas import CHECK_KINDS, EVIDENCE
from proofline.scratch import cut
from proofline.sources.files import joined, write_files, write_list
from proofline.sources.transcripts import parse, strict_json

OPERATORS = ("M1", "M2", "M3", "M4", "M5", "M6", "M7", "M8")
#: A command that is evidence for a kind, and a sentence that claims it and that no negation rule hits.
COMMANDS = {"test_pass": "npm test", "lint_clean": "npm run lint", "build_ok": "npm run build"}
PHRASES = {"test_pass": "All tests passed.", "lint_clean": "Lint clean, all good.", "build_ok": "Build succeeded, everything is fine."}
#: Fixed value: longer than the window in which a negation counts.
SEPARATOR = "\n\n=== mutation-injected note (unrelated to the above) ===\n"
TIME = "2026-01-01T00:00:00.000Z"
#: Expected verdict and reason, and by how much the number of lines changes (M1 and M4: minus the lines left out).
EXPECTED = {"M1": ("contradicted", "D1"), "M2": ("contradicted", "D2"), "M3": ("contradicted", "D1"), "M4": ("contradicted", "D2"), "M5": ("unknown", "D2-UNRELATED-CWD"), "M6": ("unknown", "D1-UNVERIFIED"), "M7": ("unknown", "D2-COMPOSITE-AMBIGUOUS"), "M8": ("unknown", "D2-PARTIAL-RERUN")}
NOTES = {
    "M1": "the only successful run is deleted, so no evidence is left before the claim", "M2": "the last successful run is turned into a failure", "M3": "a claim is put into the report though the session has no such run",
    "M4": "the successful rerun after a failure is deleted, so the failure is the last run", "M5": "a failure in a folder that has nothing to do with the claim is put in", "M6": "the only successful run is suppressed, and a rerun without a result is all that is left",
    "M7": "a failed composite run is the only evidence that is put in for the claim", "M8": "after a failure of the whole suite only a narrower command succeeds",
}
REWRITE = "struct<line: int, how: string, arg: string>"


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for p in table.items() for x in p]), key)


def _kind_rank(kind: Column, order: tuple[str, ...] = CHECK_KINDS) -> Column:
    return F.array_position(F.array(*map(F.lit, order)), kind)


def runs(events: DataFrame) -> DataFrame:
    """Unsuppressed commands with the kinds of check that they are evidence for."""
    kinds = F.array_compact(F.array(*[F.when(F.col("command_class").isin(*classes), F.lit(kind)) for kind, classes in EVIDENCE.items()]))
    return events.where("type = 'command' and command_class is not null and not coalesce(suppressed, false)").withColumn("kind", F.explode(kinds))


def candidates(claims: DataFrame, events: DataFrame) -> DataFrame:
    """(session_id, kind, turn, n, last, before_last) for each check claim: the evidence before it, whatever its folder."""
    check = claims.where(F.col("kind").isin(*CHECK_KINDS) & F.col("turn").isNotNull()).select("session_id", "kind", "turn")
    ran = runs(events).select("session_id", "kind", F.struct("seq", F.col("outcome_status").alias("status"), F.col("command_class").alias("class"), F.col("evidence_tool_use_source_line").alias("use"), F.col("evidence_tool_result_source_line").alias("result"), F.col("evidence_tool_use_id").alias("tool_id"), "cwd").alias("e"))
    hit = check.join(ran, ["session_id", "kind"], "left").withColumn("e", F.when(F.col("e.seq") < F.col("turn"), F.col("e")))
    rows = hit.groupBy("session_id", "kind", "turn").agg(F.array_sort(F.collect_list("e")).alias("es"))
    return rows.select("session_id", "kind", "turn", F.size("es").alias("n"), F.try_element_at("es", F.lit(-1)).alias("last"), F.try_element_at("es", F.lit(-2)).alias("before_last"))


def unproven_kinds(reports: DataFrame, events: DataFrame) -> DataFrame:
    """(session_id, kind) of checks for which a session has no evidence at all."""
    all_kinds = reports.select("session_id", F.explode(F.array(*map(F.lit, CHECK_KINDS))).alias("kind"))
    return all_kinds.join(runs(events).select("session_id", "kind").distinct(), ["session_id", "kind"], "left_anti")


def _use(session: Column, cwd: Column, command: Column, tool_id: Column) -> Column:
    call = F.struct(F.lit("tool_use").alias("type"), tool_id.alias("id"), F.lit("Bash").alias("name"), F.struct(command.alias("command"), F.lit("mutation-injected").alias("description")).alias("input"))
    message = F.struct(F.lit("assistant").alias("role"), F.array(call).alias("content"))
    return F.to_json(F.struct(F.lit("assistant").alias("type"), session.alias("sessionId"), cwd.alias("cwd"), F.lit(TIME).alias("timestamp"), message.alias("message")))


def _result(session: Column, cwd: Column, text: str, tool_id: Column, error: bool) -> Column:
    block = F.struct(F.lit("tool_result").alias("type"), tool_id.alias("tool_use_id"), F.lit(text).alias("content"), F.lit(True if error else None).cast("boolean").alias("is_error"))
    message = F.struct(F.lit("user").alias("role"), F.array(block).alias("content"))
    return F.to_json(F.struct(F.lit("user").alias("type"), session.alias("sessionId"), cwd.alias("cwd"), F.lit(TIME).alias("timestamp"), message.alias("message")))


def edits(claims: DataFrame, events: DataFrame) -> DataFrame:
    """A row for each mutant: (session_id, operator, kind, report_line, deletes, rewrites, inserts, delta)."""
    report = events.where("type = 'report'").groupBy("session_id").agg(F.min_by(F.struct(F.col("evidence_tool_use_source_line").alias("report_line"), F.col("cwd").alias("report_cwd")), "seq").alias("r")).select("session_id", "r.*").where("report_line is not null")
    made = candidates(claims, events).join(report, "session_id")
    free = unproven_kinds(report, events).join(report, "session_id")
    none, no_edits = F.array().cast("array<int>"), F.array().cast(f"array<{REWRITE}>")
    no_lines = F.array().cast("array<string>")
    session = F.col("session_id")

    def rewrite(line: Column, how: str, arg: Column) -> Column:
        return F.array(F.struct(line.cast("int").alias("line"), F.lit(how).alias("how"), arg.cast("string").alias("arg")))

    def first(df: DataFrame, order: tuple[str, ...] = CHECK_KINDS) -> DataFrame:
        return df.groupBy("session_id").agg(F.min_by(F.struct(*[c for c in df.columns if c != "session_id"]), _kind_rank(F.col("kind"), order)).alias("x")).select("session_id", "x.*")

    def out(df: DataFrame, operator: str, delta: Column, deletes: Column = none, rewrites: Column = no_edits, inserts: Column = no_lines) -> DataFrame:
        return df.select("session_id", F.lit(operator).alias("operator"), "kind", "report_line", deletes.alias("deletes"), rewrites.alias("rewrites"), inserts.alias("inserts"), delta.cast("int").alias("delta"))

    pair = F.array_compact(F.array("last.use", "last.result"))
    say = rewrite(F.col("report_line"), "say", _lookup(PHRASES, F.col("kind")))
    tool = lambda op, n=1: F.concat_ws("_", F.lit("tu_mut"), F.lit(op), F.col("kind"), F.lit(n))
    single = first(made.where("n = 1 and last.status = 'ok' and last.use is not null"))
    last_ok = first(made.where("last.status = 'ok' and last.class <> 'composite' and last.result is not null"))
    resolved = first(made.where("n >= 2 and last.status = 'ok' and before_last.status = 'error' and last.use is not null"))
    placed = free.where("report_cwd is not null")
    cwd = F.col("report_cwd")
    other = F.concat(cwd, F.lit("/mut-unrelated"))
    command = _lookup(COMMANDS, F.col("kind"))
    unrelated = F.array(_use(session, other, command, tool("M5")), _result(session, other, "Exit code 1\nfailure in unrelated directory (mutation-injected)", tool("M5"), True))
    again = F.array(_use(session, F.coalesce("last.cwd", "report_cwd", F.lit("")), command, tool("M6")))
    composite = F.array(_use(session, cwd, F.lit("preflight"), tool("M7")), _result(session, cwd, "Exit code 1\ncomposite preflight failed (mutation-injected)", tool("M7"), True))
    partial = F.array(
        _use(session, cwd, F.lit("npm test"), tool("M8", 1)), _result(session, cwd, "Exit code 1\n3 failing tests in full suite (mutation-injected)", tool("M8", 1), True),
        _use(session, cwd, F.lit("npm test -- src/one.test.ts"), tool("M8", 2)), _result(session, cwd, "1 passing (mutation-injected)", tool("M8", 2), False),
    )
    parts = [
        out(single, "M1", -F.size(pair), deletes=pair),
        out(last_ok, "M2", F.lit(0), rewrites=rewrite(F.col("last.result"), "fail", F.col("last.tool_id"))),
        out(first(free), "M3", F.lit(0), rewrites=say),
        out(resolved, "M4", -F.size(pair), deletes=pair),
        out(first(placed, ("lint_clean", "build_ok", "test_pass")), "M5", F.lit(2), rewrites=say, inserts=unrelated),
        out(single, "M6", F.lit(1), rewrites=rewrite(F.col("last.use"), "suppress", F.col("last.tool_id")), inserts=again),
        out(placed, "M7", F.lit(2), rewrites=say, inserts=composite),
        out(placed.where("kind = 'test_pass'"), "M8", F.lit(4), rewrites=say, inserts=partial),
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def _blocks(found: object, kind: str) -> list[dict]:
    message = found.get("message") if isinstance(found, dict) else None
    content = message.get("content") if isinstance(message, dict) else None
    return [b for b in content if isinstance(b, dict) and b.get("type") == kind] if isinstance(content, list) else []


def rewritten(raw: str, how: str, arg: str | None) -> str | None:
    """A line after an edit, its keys in order; None where the edit finds nothing to change."""
    try:
        found = strict_json(raw)
    except (ValueError, RecursionError):
        return None
    if how == "say":
        message = found.get("message") if isinstance(found, dict) else None
        content = message.get("content") if isinstance(message, dict) else None
        if isinstance(content, str):
            message["content"] = content + SEPARATOR + arg
        elif isinstance(content, list):
            texts = [b for b in _blocks(found, "text") if isinstance(b.get("text"), str)]
            if texts:
                texts[-1]["text"] += SEPARATOR + arg
            else:
                content.append({"type": "text", "text": arg})
    elif how == "fail":
        block = next((b for b in _blocks(found, "tool_result") if b.get("tool_use_id") == arg), None)
        if block is None:
            return None
        block |= {"is_error": True, "content": "Exit code 1\nmutation-injected failure"}
    elif how == "suppress":
        block = next((b for b in _blocks(found, "tool_use") if b.get("id") == arg), None)
        if block is None or not isinstance(block.get("input"), dict) or not isinstance(block["input"].get("command"), str):
            return None
        block["input"]["command"] += " || true"
    return json.dumps(found, separators=(",", ":"), ensure_ascii=False)


@pandas_udf(StringType())
def _rewrite(raw, how, arg):  # noqa: ANN001, ANN202
    """JSON rewriting that keeps the order of keys, which no function of Spark does."""
    import pandas as pd

    return pd.Series([rewritten(r, h, a) for r, h, a in zip(raw, how, arg, strict=True)])


def mutant_id() -> Column:
    return F.concat_ws("-", "operator", "session_id", "kind")


def mutant_session_id() -> Column:
    return F.concat_ws("-", F.lit("mut"), F.lower("operator"), "session_id", "kind")


def mutants(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """(mutant_id, operator, kind, line, raw) from lines (session_id, line, raw) split at line feeds, and edits(). Only lines that
    an edit changes go through Python."""
    ship(rows.sparkSession)
    named = changes.withColumn("mutant_id", mutant_id())
    edit = F.get(F.filter("rewrites", lambda r: r["line"] == F.col("line")), F.lit(0))
    old = rows.join(named, "session_id").where(~F.array_contains("deletes", F.col("line"))).withColumn("edit", edit)
    edited = old.where("edit is not null").withColumn("raw", _rewrite("raw", "edit.how", "edit.arg"))
    old = old.where("edit is null").unionByName(edited).select("mutant_id", "session_id", "operator", "kind", F.col("line").alias("at"), F.lit(1).alias("sub"), F.lit(0).alias("pos"), "raw")
    new = named.select("mutant_id", "session_id", "operator", "kind", F.col("report_line").alias("at"), F.lit(0).alias("sub"), F.posexplode("inserts").alias("pos", "raw"))
    both = old.unionByName(new)
    by = Window.partitionBy("mutant_id").orderBy("at", "sub", "pos")
    changed = F.replace(F.col("raw"), F.concat(F.lit('"sessionId":"'), F.col("session_id"), F.lit('"')), F.concat(F.lit('"sessionId":"'), mutant_session_id(), F.lit('"')))
    return both.select("mutant_id", "operator", "kind", F.row_number().over(by).alias("line"), changed.alias("raw"))


def generate(physical: DataFrame, settings: Redaction = Redaction(), classes: Mapping[str, list[str]] = COMMAND_CLASSES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lines, manifest, skipped) of all mutants of the sessions in files, given as their lines (file, line, raw), split at line
    feeds only.

    A mutant is kept if its number of lines changed as planned, its text changed, its report stands where it should, and the claim
    can be found there. target_claim_turn is the report's seq after the change.
    """
    physical = cut(physical.select("file", "line", "raw"), "physical")
    _, events = adapt(cut(parse(physical.withColumn("raw", F.regexp_replace("raw", r"\r$", ""))), "parsed"), settings, classes)
    events = cut(events, "events")
    claims = cut(RuleClaims(settings).extract(events.where("type = 'report'")), "claims")
    rows = physical.join(events.select("file", "session_id").distinct(), "file").select("session_id", "line", "raw")
    changes = cut(edits(claims, events).withColumn("mutant_id", mutant_id()), "edits")
    made = cut(mutants(rows, changes.drop("mutant_id")), "mutants")
    _, after = adapt(cut(parse(made.select(F.concat(F.lit("/mutants/"), F.col("mutant_id"), F.lit(".jsonl")).alias("file"), "line", "raw").where("raw is not null")), "parsed"), settings, classes)
    after = cut(after.withColumn("mutant_id", F.regexp_extract("file", r"^/mutants/(.*)\.jsonl$", 1)), "events")
    reports = after.where("type = 'report'").select("mutant_id", "seq", "redacted_input", "cwd", F.col("evidence_tool_use_source_line").alias("found_line"))
    found = RuleClaims(settings).extract(reports.withColumnRenamed("mutant_id", "session_id")).select(F.col("session_id").alias("mutant_id"), "kind", F.col("turn").alias("target_claim_turn"))
    size = rows.groupBy("session_id").agg(F.count("*").alias("lines_before"))
    size_after = made.groupBy("mutant_id").agg(F.count("*").alias("lines_after"), F.count_if(F.col("raw").isNull()).alias("failed"))
    checked = changes.join(size, "session_id").join(size_after, "mutant_id").join(reports.select("mutant_id", "found_line"), "mutant_id", "left").join(found, ["mutant_id", "kind"], "left")
    why = F.when(F.col("failed") > 0, "a line could not be rewritten").when(F.col("lines_after") - F.col("lines_before") != F.col("delta"), "the number of lines is not as planned").when(F.coalesce(F.col("found_line"), F.lit(-1)) != F.col("report_line") + F.col("delta"), "the report is not where it should be").when(F.col("target_claim_turn").isNull(), "the claim was not found")
    checked = checked.withColumn("reason", why)
    expected = lambda i: _lookup({k: v[i] for k, v in EXPECTED.items()}, F.col("operator"))
    targets = F.concat("deletes", F.transform("rewrites", lambda r: r["line"]), F.when(F.col("operator") == "M6", F.array("report_line")).otherwise(F.array().cast("array<int>")))
    manifest = checked.where("reason is null").select(
        "mutant_id", F.col("session_id").alias("source_session"), mutant_session_id().alias("mutant_session_id"), "operator", F.col("kind").alias("claim_kind"), "target_claim_turn", targets.alias("target_lines"),
        expected(0).alias("expected_verdict"), expected(1).alias("expected_reason_code"), F.concat("operator", F.lit("/"), "session_id", F.lit("-"), "kind", F.lit(".jsonl")).alias("mutant_file"),
        _lookup(NOTES, F.col("operator")).alias("notes"),
    )
    return made, manifest, checked.where("reason is not null").select("mutant_id", "operator", "reason")


def write(made: DataFrame, manifest: DataFrame, folder: str) -> None:
    """Write each mutant of the manifest to its mutant_file below folder, and manifest.json."""
    rows = made.join(manifest.select("mutant_id", F.col("mutant_file").alias("path")), "mutant_id").select("path", "line", F.col("raw").alias("text"))
    write_files(rows, folder).agg(F.sum("bytes")).collect()
    write_list(manifest, joined(folder, "manifest.json"), ["operator", "source_session", "claim_kind"])


def per_operator(manifest: DataFrame, enough: int = 3) -> DataFrame:
    """(operator, n, short) for all eight operators."""
    spark = manifest.sparkSession
    ids = spark.range(1, 9).select(F.concat(F.lit("M"), F.col("id").cast("string")).alias("operator"))
    return ids.join(manifest.groupBy("operator").agg(F.count("*").alias("n")), "operator", "left").select("operator", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) < enough).alias("short"))

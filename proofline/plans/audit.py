"""Ingest and audit."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.functions.dictionaries import COMMAND_CLASSES, Redaction
from proofline.operators.adapter import adapt
from proofline.operators.claims import ClaimExtractor, RuleClaims
from proofline.operators.contract import ContractExtractor, RuleContract
from proofline.operators.verdicts import evaluate
from proofline.scratch import cut
from proofline.sources.files import existing, physical_lines
from proofline.sources.store import Store
from proofline.sources.transcripts import lines, parse, read_files


def ingest(store: Store, paths: str | list[str], force: bool = False) -> DataFrame:
    """Read transcripts into the store; gives the sessions that were stored."""
    sessions, events = adapt(cut(parse(lines(read_files(store.spark, paths))), "parsed"), store.settings)
    sessions, events = cut(sessions, "sessions"), cut(events, "events")
    store.upsert(sessions, events, force)
    return sessions.select("id", "source_path", "total_lines", "redaction_count", "mismatch")


def ingest_all(store: Store, paths: list[str], force: bool = False, classes: Mapping[str, list[str]] = COMMAND_CLASSES) -> tuple[DataFrame, DataFrame]:
    """Read all transcripts in one go, however many: (stored sessions, refused (file, reason)). A file that can't be stored keeps no
    other from it."""
    return ingest_table(store, store.spark.createDataFrame([(p,) for p in paths], "path string"), force, classes)


def ingest_table(store: Store, wanted: DataFrame, force: bool = False, classes: Mapping[str, list[str]] = COMMAND_CLASSES) -> tuple[DataFrame, DataFrame]:
    """ingest_all() for a table of paths (path)."""
    there = cut(existing(wanted), "there")
    missing = wanted.join(there, "path", "left_anti").select(F.col("path").alias("file"), F.lit("there is no such file").alias("reason"))
    rows = physical_lines(there.repartition("path"), returns=True).select(F.col("path").alias("file"), "line", "raw")
    sessions, events = adapt(cut(parse(rows), "parsed"), store.settings, classes)
    sessions, events = cut(sessions, "sessions"), cut(events, "events")
    bad = cut(store.refused(sessions, events, force), "refused")
    good = cut(sessions.join(bad, "file", "left_anti"), "good")
    store.upsert(good, events.join(good.select("file"), "file", "left_semi"), force)
    return good.select("id", "source_path", "total_lines", "redaction_count", "mismatch"), missing.unionByName(bad)


def audit(events: DataFrame, claims: ClaimExtractor | None = None, contract: ContractExtractor | None = None, settings: Redaction = Redaction()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(claims, verdicts, contracts) of all sessions with events; give it a table that was read, not a long plan."""
    found = (claims or RuleClaims(settings)).extract(events.where("type = 'report'"))
    contracts = (contract or RuleContract(settings)).extract(events.where("type = 'instruction'").select("session_id", "seq", "redacted_input"))
    return found, evaluate(found, events), contracts


def audit_store(store: Store, session_id: str | None = None, claims: ClaimExtractor | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Audit one session or all, and store the result."""
    events = store.read("events", session_id)
    found, _, contracts = audit(events, claims, settings=store.settings)
    found = cut(found, "claims")  # an extractor may not give the same twice
    verdicts = cut(evaluate(found, events), "verdicts")
    sessions = store.read("sessions", session_id).selectExpr("id as session_id")
    store.save_audit(found, verdicts, sessions)
    return found, verdicts, contracts


def run(spark: SparkSession, paths: str | list[str], settings: Redaction = Redaction()) -> dict[str, DataFrame]:
    """The whole way without a store."""
    sessions, events = adapt(cut(parse(lines(read_files(spark, paths))), "parsed"), settings)
    events = cut(events, "events")
    claims, verdicts, contracts = audit(events, settings=settings)
    return {"sessions": sessions, "events": events, "claims": claims, "verdicts": verdicts, "contracts": contracts}

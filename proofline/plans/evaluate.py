"""Evaluation: mutants are audited and their verdicts held against the manifest."""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.functions.dictionaries import COMMAND_CLASSES, Redaction
from proofline.operators.adapter import adapt
from proofline.operators.claims import ClaimExtractor
from proofline.plans.audit import audit
from proofline.scratch import cut
from proofline.sources.files import joined, physical_lines
from proofline.sources.transcripts import parse

GATE = 0.95


def compare(manifest: DataFrame, claims: DataFrame, verdicts: DataFrame) -> DataFrame:
    """manifest with actual_verdict, actual_reason_code, match and error (no claim, or no verdict)."""
    target = claims.select(F.col("session_id").alias("mutant_session_id"), F.col("kind").alias("claim_kind"), F.col("turn").alias("target_claim_turn"), "claim_id")
    judged = verdicts.select(F.col("session_id").alias("mutant_session_id"), "claim_id", F.col("verdict").alias("actual_verdict"), F.col("reason_code").alias("actual_reason_code"))
    both = manifest.join(target, ["mutant_session_id", "claim_kind", "target_claim_turn"], "left").join(judged, ["mutant_session_id", "claim_id"], "left")
    same = (F.col("actual_verdict") == F.col("expected_verdict")) & (F.col("actual_reason_code") == F.col("expected_reason_code"))
    error = F.when(F.col("claim_id").isNull(), "claim not found").when(F.col("actual_verdict").isNull(), "no verdict")
    return both.withColumns({"match": F.coalesce(same, F.lit(False)), "error": error})


def evaluate(mutants: DataFrame, manifest: DataFrame, settings: Redaction = Redaction(), extractor: ClaimExtractor | None = None, classes: Mapping[str, list[str]] = COMMAND_CLASSES) -> DataFrame:
    """compare() for mutants (mutant_id, line, raw). A mutant is judged as the session that the manifest names."""
    rows = mutants.join(manifest.select("mutant_id", "mutant_session_id"), "mutant_id")
    _, events = adapt(cut(parse(rows.select(F.concat(F.lit("/mutants/"), F.col("mutant_session_id"), F.lit(".jsonl")).alias("file"), "line", "raw")), "parsed"), settings, classes)
    events = cut(events.withColumn("session_id", F.regexp_extract("file", r"^/mutants/(.*)\.jsonl$", 1)), "events")
    claims, verdicts, _ = audit(events, extractor, settings=settings)
    return compare(manifest, claims, verdicts)


MANIFEST = "mutant_id string, source_session string, mutant_session_id string, operator string, claim_kind string, target_claim_turn int, target_lines array<int>, expected_verdict string, expected_reason_code string, mutant_file string, notes string"


def read_mutants(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(lines, manifest) of what mutate.write() wrote below folder; the tasks read the files."""
    manifest = cut(spark.read.schema(MANIFEST).json(joined(folder, "manifest.json"), multiLine=True), "manifest")
    base = folder if "://" in folder else os.path.abspath(folder)
    paths = manifest.select("mutant_id", F.concat(F.lit(base.rstrip("/") + "/"), "mutant_file").alias("path"))
    return physical_lines(paths.repartition("path")).join(paths, "path").select("mutant_id", "line", "raw"), manifest


def rates(results: DataFrame) -> DataFrame:
    """(operator, total, match, rate) by operator, in order, and for all (operator null, last); the rate of nothing is 0."""
    out = results.rollup("operator").agg(F.count("*").alias("total"), F.count_if("match").alias("match"))
    return out.withColumn("rate", F.when(F.col("total") > 0, F.col("match") / F.col("total")).otherwise(0.0)).orderBy(F.col("operator").asc_nulls_last())


def passed(results: DataFrame) -> bool:
    total, match = results.agg(F.count("*"), F.count_if("match")).first()
    return total == 0 or match / total >= GATE


def mismatches(results: DataFrame) -> DataFrame:
    shown = lambda v, r: F.concat(F.col(v), F.lit("/"), F.col(r))
    return results.where(~F.col("match")).select("mutant_id", "operator", "claim_kind", shown("expected_verdict", "expected_reason_code").alias("expected"), F.coalesce(shown("actual_verdict", "actual_reason_code"), F.lit("(no verdict)")).alias("actual"), "error")


def report(results: DataFrame) -> DataFrame:
    """(json, markdown), one row."""
    by = rates(results)
    entry = F.struct(F.coalesce("operator", F.lit("~")).alias("operator"), "total", "match", "rate")
    collected = by.agg(F.array_sort(F.collect_list(entry)).alias("r")).crossJoin(mismatches(results).agg(F.array_sort(F.collect_list(F.struct("mutant_id", "operator", "claim_kind", "expected", "actual", "error"))).alias("m")))  # one row each
    percent = lambda x: F.format_string("%.1f%%", x["rate"] * 100)
    every = F.filter("r", lambda x: x["operator"] != "~")
    whole = F.get(F.filter("r", lambda x: x["operator"] == "~"), F.lit(0))
    rows = F.array_join(F.transform(every, lambda x: F.concat(F.lit("| "), x["operator"], F.lit(" | "), x["match"].cast("string"), F.lit(" | "), x["total"].cast("string"), F.lit(" | "), percent(x), F.lit(" |"))), "\n")
    missed = F.array_join(F.transform("m", lambda x: F.concat(F.lit("- "), x["mutant_id"], F.lit(": expected "), x["expected"], F.lit(", got "), x["actual"])), "\n")
    text = F.concat(F.lit("# Mutation evaluation\n\n- match: "), whole["match"].cast("string"), F.lit("/"), whole["total"].cast("string"), F.lit(" ("), percent(whole), F.lit(")\n\n| operator | match | total | rate |\n|---|---|---|---|\n"), rows, F.when(F.size("m") > 0, F.concat(F.lit("\n\n## Mismatches\n\n"), missed)).otherwise(F.lit("")))
    data = F.to_json(F.struct(F.struct(whole["total"].alias("total"), whole["match"].alias("match"), whole["rate"].alias("rate")).alias("overall"), every.alias("by_operator"), F.col("m").alias("mismatches")))
    return collected.select(data.alias("json"), text.alias("markdown"))

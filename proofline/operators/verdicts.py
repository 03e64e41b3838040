"""Verdicts: each claim against what was observed before it.

The sequential bookkeeping of failures (an error opens its command, a success of the same command closes it, a composite success
closes all) becomes aggregates: a command is open if its last error comes after its own last success and after the last composite
success. So one join of claims with events and two levels of aggregation decide all claims at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.functions.commands import normalized
from proofline.functions.patterns import matches_any
from proofline.schemas import CHECK_KINDS, EVIDENCE

NO_CWD = "__unknown_cwd__"


def _checks() -> Column:
    """For each kind of claim, the kinds of checks that it rests on, in order."""
    check = lambda i: F.struct(F.lit(i).alias("n"), F.lit(CHECK_KINDS[i]).alias("check"), F.array(*map(F.lit, EVIDENCE[CHECK_KINDS[i]])).alias("classes"))
    out = F.when(F.col("kind") == "task_done", F.array(*map(check, range(3))))
    for i, kind in enumerate(CHECK_KINDS):
        out = out.when(F.col("kind") == kind, F.array(check(i)))
    return out


def evidence(claims: DataFrame, events: DataFrame) -> DataFrame:
    """(session_id, claim_id, kind, n, check, status, refs) for every check that a claim with a turn rests on.

    status: no-evidence, cwd-mismatch, clear-success, clear-failure, clear-failure-composite, partial-rerun or all-unknown; refs:
    the seq of all rows in scope, ascending.
    """
    asked = claims.where("turn is not null").select("session_id", "claim_id", "kind", "turn", F.col("cwd").alias("claim_cwd"), F.explode(_checks()).alias("__check")).select("*", "__check.n", "__check.check", "__check.classes").drop("__check")
    ran = events.where("type = 'command' and command_class is not null and not coalesce(suppressed, false)").select(
        "session_id", "seq", "command_class", F.col("outcome_status").alias("status"), "cwd", normalized(F.col("redacted_input")).alias("command"),
    )
    hit = asked.join(ran, "session_id").where((F.col("seq") < F.col("turn")) & F.array_contains("classes", F.col("command_class")))
    inside = F.col("claim_cwd").isNull() | (F.col("cwd") == F.col("claim_cwd"))
    composite = F.col("command_class") == "composite"
    key = ["session_id", "claim_id", "n"]
    at = lambda when: F.max(F.when(inside & when, F.col("seq")))
    per_command = hit.groupBy(*key, "claim_cwd", "command").agg(
        at(F.col("status") == "error").alias("error"), at((F.col("status") == "ok") & ~composite).alias("ok"), at((F.col("status") == "ok") & composite).alias("all_ok"),
        F.max(F.when(inside, F.struct("seq", "status", "command_class"))).alias("last"), F.collect_list(F.when(inside, F.col("seq"))).alias("refs"),
        F.min(F.coalesce("cwd", F.lit(NO_CWD))).alias("cwd_low"), F.max(F.coalesce("cwd", F.lit(NO_CWD))).alias("cwd_high"),
    )
    per_check = per_command.groupBy(*key, "claim_cwd").agg(
        F.max(F.when(F.col("error") > F.coalesce("ok", F.lit(-1)), F.col("error"))).alias("open"), F.max("all_ok").alias("all_ok"), F.max("last").alias("last"),
        F.array_sort(F.flatten(F.collect_list("refs"))).alias("refs"), (F.min("cwd_low") != F.max("cwd_high")).alias("many"),
    )
    mismatch = F.when(F.col("claim_cwd").isNull(), F.col("many")).otherwise(F.size("refs") == 0)
    status = F.when(mismatch, "cwd-mismatch").when((F.col("last.status") == "error") & (F.col("last.command_class") == "composite"), "clear-failure-composite").when(F.col("last.status") == "error", "clear-failure")
    status = status.when(F.coalesce("open", F.lit(-1)) > F.coalesce("all_ok", F.lit(-1)), "partial-rerun").when(F.col("last.status") == "ok", "clear-success").otherwise("all-unknown")
    decided = per_check.select(*key, status.alias("status"), F.when(mismatch, F.array().cast("array<int>")).otherwise(F.col("refs").cast("array<int>")).alias("refs"))
    out = asked.select(*key, "kind", "check").join(decided, key, "left")
    return out.select("session_id", "claim_id", "kind", "n", "check", F.coalesce("status", F.lit("no-evidence")).alias("status"), F.coalesce("refs", F.array().cast("array<int>")).alias("refs"))


#: Verdict and reason of a check claim by the status of its evidence.
CHECK_VERDICTS = {
    "cwd-mismatch": ("unknown", "D2-UNRELATED-CWD"), "no-evidence": ("contradicted", "D1"), "clear-success": ("proven", "D1"), "clear-failure": ("contradicted", "D2"),
    "clear-failure-composite": ("unknown", "D2-COMPOSITE-AMBIGUOUS"), "partial-rerun": ("unknown", "D2-PARTIAL-RERUN"), "all-unknown": ("unknown", "D1-UNVERIFIED"),
}


def _checked(claims: DataFrame, events: DataFrame) -> DataFrame:
    failed = F.col("status").isin("clear-failure", "clear-failure-composite")
    by_claim = evidence(claims, events).groupBy("session_id", "claim_id", "kind").agg(
        F.array_sort(F.collect_list(F.when(failed, F.struct("n", "refs")))).alias("failures"), F.first("status").alias("status"), F.first("refs").alias("refs"),
    )
    table = F.create_map(*[F.lit(x) if isinstance(x, str) else F.struct(*[F.lit(v).alias(n) for v, n in zip(x, ("v", "r"), strict=True)]) for pair in CHECK_VERDICTS.items() for x in pair])
    check = F.element_at(table, F.col("status"))
    done = F.col("kind") == "task_done"
    bad = F.size("failures") > 0
    return by_claim.select(
        "session_id", "claim_id", F.when(done & bad, "contradicted").when(done, "unknown").otherwise(check["v"]).alias("verdict"), F.when(done & bad, "D2").when(done, "NOT-PROVABLE").otherwise(check["r"]).alias("reason_code"),
        F.when(done, F.array_distinct(F.flatten(F.transform("failures", lambda f: f["refs"])))).otherwise(F.col("refs")).alias("evidence_refs"),
    )


def _scoped(claims: DataFrame, events: DataFrame) -> DataFrame:
    asked = claims.where("turn is not null and kind = 'scope_respected'")
    clear = F.col("scope_subtype").isNotNull() & (F.coalesce(F.size("paths"), F.lit(0)) > 0)
    edits = events.where("type = 'file_edit' and redacted_input <> ''").select("session_id", "seq", "redacted_input")
    hit = asked.where(clear).join(edits, "session_id").where(F.col("seq") < F.col("turn"))
    touches = matches_any(F.col("redacted_input"), F.col("paths"))
    bad = hit.where(F.when(F.col("scope_subtype") == "untouched", touches).otherwise(~touches)).groupBy("session_id", "claim_id").agg(F.array_sort(F.collect_list("seq")).cast("array<int>").alias("refs"))
    found = asked.join(bad, ["session_id", "claim_id"], "left")
    reason = F.when(~clear, "D3-AMBIGUOUS").when(F.col("refs").isNotNull(), "D3").otherwise("D3-LIMITED")
    return found.select("session_id", "claim_id", F.when(reason == "D3", "contradicted").otherwise("unknown").alias("verdict"), reason.alias("reason_code"), F.coalesce("refs", F.array().cast("array<int>")).alias("evidence_refs"))


def evaluate(claims: DataFrame, events: DataFrame) -> DataFrame:
    """A verdict for every claim: rows of the verdicts table."""
    none = F.array().cast("array<int>")
    plain = claims.where("turn is null or kind = 'verification_done'").select("session_id", "claim_id", F.lit("unknown").alias("verdict"), F.when(F.col("turn").isNull(), "NO-ANCHOR").otherwise("NOT-PROVABLE").alias("reason_code"), none.alias("evidence_refs"))
    return _checked(claims, events).unionByName(_scoped(claims, events)).unionByName(plain)

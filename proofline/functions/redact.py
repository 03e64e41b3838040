"""Redaction: secrets and personal names in text are replaced, rule by rule, in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.functions.dictionaries import Redaction
from proofline.functions.patterns import escape, js

KEY = "[REDACTED_KEY]"
#: Fixed values: (pattern, without regard to case, replacement), in the order in which they apply.
RULES: list[tuple[str, bool, str]] = [
    (r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----", False, "[REDACTED_PEM_KEY]"),
    (r"\/(Users|home)\/[a-zA-Z0-9_.-]+", False, "/$1/USER"),
    (r"-Users-[A-Za-z0-9_.]+?-", False, "-Users-USER-"),
    (r"\bsk-[A-Za-z0-9_-]{8,}\b", False, KEY),
    (r"\bghp_[A-Za-z0-9]{20,}\b", False, KEY),
    (r"\bgithub_pat_[A-Za-z0-9_]{20,}\b", False, KEY),
    (r"\bgh[osu]_[A-Za-z0-9]{20,}\b", False, KEY),
    (r"\bxoxb-[A-Za-z0-9-]{10,}\b", False, KEY),
    (r"\bAKIA[0-9A-Z]{12,}\b", False, KEY),
    (r"\bASIA[0-9A-Z]{12,}\b", False, KEY),
    (r"\blin_api_[A-Za-z0-9]{10,}\b", False, KEY),
    (r"\bBearer\s+[A-Za-z0-9._-]+", False, f"Bearer {KEY}"),
    (r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", False, "[REDACTED_EMAIL]"),
    (r"([a-zA-Z][a-zA-Z0-9+.-]*:\/\/[^\s:/@]+:)([^\s@/]+)(@)", False, "$1[REDACTED_VALUE]$3"),
    (r"\b([A-Za-z0-9_]*(?:KEY|TOKEN|SECRET|PASSWORD|PASS|CREDENTIAL|AUTH)[A-Za-z0-9_]*)\s*=\s*(\"[^\"]*\"|'[^']*'|\S+)", True, "$1=[REDACTED_VALUE]"),
]
#: A user's name counts unless it is part of a longer word; the letter of an escape such as \n before it is none.
NOT_INSIDE = (r"(?<!(?<!\\)[a-zA-Z0-9])", r"(?![a-zA-Z0-9])")


def rules(settings: Redaction) -> list[tuple[str, str]]:
    """(Spark pattern, replacement) of all rules."""
    out = [(js(p, i), r) for p, i, r in RULES]
    if settings.known_user:
        out.append((f"(?i){NOT_INSIDE[0]}{escape(settings.known_user)}{NOT_INSIDE[1]}", "USER"))
    return out + [(js(p), r.replace("\\", "\\\\").replace("$", "\\$")) for p, r in settings.dictionary]


def redact(text: Column, settings: Redaction = Redaction()) -> Column:
    for pattern, replacement in rules(settings):
        text = F.regexp_replace(text, pattern, replacement)
    return text


def redact_with_count(df: DataFrame, column: str, out: str, count: str, settings: Redaction = Redaction()) -> DataFrame:
    """df with the redacted column and the number of replacements, each made after those of the rules before it."""
    df = df.withColumn("__text", F.col(column)).withColumn(count, F.when(F.col(column).isNotNull(), F.lit(0)))
    for pattern, replacement in rules(settings):
        df = df.withColumns({count: F.col(count) + F.regexp_count("__text", F.lit(pattern)), "__text": F.regexp_replace("__text", pattern, replacement)})
    return df.withColumn(out, F.col("__text")).drop("__text")


#: What is left where a path of a user was not masked, and the label of that.
RESIDUAL = [(r"\/Users\/(?!USER\b)[A-Za-z0-9_.-]+", "unmasked-Users-path"), (r"-Users-(?!USER-)[A-Za-z0-9_.]+?-", "unmasked-encoded-Users-path")]


def residual_secrets(text: Column, settings: Redaction = Redaction()) -> Column:
    """Labels of what redaction should have masked, in a fixed order; empty for null and clean text."""
    found = []
    if settings.known_user:
        found.append(F.when(F.contains(F.lower(text), F.lit(settings.known_user.lower())), F.lit(f"os-username:{settings.known_user}")))
    found += [F.when(F.rlike(text, F.lit(js(p))), F.lit(label)) for p, label in RESIDUAL]
    found += [F.when(F.rlike(text, F.lit(js(p))), F.lit(f"dictionary-pattern:{p}")) for p, _ in settings.dictionary]
    return F.array_compact(F.array(*found))


def unmask(path: Column, user: str) -> Column:
    """A masked path as it is on the machine of this user."""
    return F.replace(F.replace(path, F.lit("/Users/USER"), F.lit(f"/Users/{user}")), F.lit("-Users-USER-"), F.lit(f"-Users-{user}-"))

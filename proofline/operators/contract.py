"""The contract that a session's instructions set: obligations, prohibitions and paths in scope."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofline.functions.clauses import clause_at, path_tokens, split_clauses
from proofline.functions.dictionaries import Redaction
from proofline.functions.patterns import js, match_spans, may_match, trim
from proofline.functions.redact import redact


class ContractExtractor(Protocol):
    """Instructions (session_id, seq, redacted_input) to (obligations, prohibitions, scope paths)."""

    def extract(self, instructions: DataFrame) -> DataFrame: ...


#: Fixed values: (pattern, without regard to case) of prohibitions; (kind, pattern, without regard to case) of obligations; scope.
PROHIBITIONS = [(r"(触らない|変更しない|編集禁止|変更禁止|触れない|さわらない)", False), (r"\bdo\s+not\s+(touch|modify|edit|change)\b", True)]
OBLIGATIONS = [
    ("test", r"テスト.{0,5}(を)?通(す|して|すこと)", False),
    ("test", r"\b(run|pass|fix)\s+(the\s+)?tests?\b", True),
    ("lint", r"(lint|エスリント).{0,5}(を)?通(す|して|すこと)", True),
    ("lint", r"\b(run|pass|fix)\s+(the\s+)?lint\b", True),
    ("build", r"(ビルド|型チェック|タイプチェック).{0,5}(を)?通(す|して|すこと)", False),
    ("build", r"\b(run|pass|fix)\s+(the\s+)?(build|typecheck)\b", True),
    ("behavior", r"preflight.{0,5}(を)?通(す|して|すこと)", True),
    ("behavior", r"\brun\s+(the\s+)?preflight\b", True),
]
SCOPES = [(r"担当[:：]\s*([^\n]+)", False), (r"\bscope[:：]\s*([^\n]+)", True), (r"\bassigned[:：]\s*([^\n]+)", True)]


def _clauses_of(instructions: DataFrame, rules: list[tuple[str | None, str, bool]]) -> DataFrame:
    """(session_id, seq, rule, pos, kind, clause) of every match of every rule; the patterns are literals, compiled once."""
    text = F.col("redacted_input")

    def matches(rule: int, kind: str | None, pattern: str, ignore_case: bool) -> Column:
        compiled = F.lit(js(pattern, ignore_case))
        found = F.struct(F.lit(rule).alias("rule"), F.lit(kind).cast("string").alias("kind"), match_spans(text, compiled).alias("spans"))
        return F.when(may_match(text, F.col("lower"), pattern, ignore_case) & F.rlike(text, compiled), found)

    hits = F.array_compact(F.array(*[matches(i, *rule) for i, rule in enumerate(rules)]))
    tried = instructions.where("redacted_input is not null and redacted_input <> ''").withColumn("lower", F.lower(text)).withColumn("r", F.explode(hits))
    spans = tried.withColumn("clauses", split_clauses(text)).select("session_id", "seq", "r.rule", "r.kind", "clauses", F.posexplode("r.spans").alias("pos", "span"))
    return spans.select("session_id", "seq", "rule", "pos", "kind", clause_at(F.col("clauses"), F.col("span.start"))["text"].alias("clause"))


def _number(prefix: str) -> Column:
    order = F.row_number().over(Window.partitionBy("session_id").orderBy("seq", "rule", "pos")) - 1
    return F.concat_ws("-", F.lit(prefix), order)


def obligations(instructions: DataFrame, settings: Redaction = Redaction()) -> DataFrame:
    """(session_id, id, text, source_turn, kind), numbered in a session by instruction, rule and place."""
    found = _clauses_of(instructions, OBLIGATIONS).withColumn("id", _number("obligation"))
    return found.select("session_id", "id", redact(trim(F.col("clause")), settings).alias("text"), F.col("seq").alias("source_turn"), "kind")


def prohibitions(instructions: DataFrame, settings: Redaction = Redaction()) -> DataFrame:
    """(session_id, id, text, source_turn, paths): only those whose clause names a path; numbered among themselves."""
    found = _clauses_of(instructions, [(None, p, c) for p, c in PROHIBITIONS]).withColumn("paths", path_tokens(F.col("clause"))).where(F.size("paths") > 0)
    return found.withColumn("id", _number("prohibition")).select("session_id", "id", redact(trim(F.col("clause")), settings).alias("text"), F.col("seq").alias("source_turn"), "paths")


def scope_paths(instructions: DataFrame) -> DataFrame:
    """(session_id, scope_paths): the paths of the scope that each instruction declares first, each once, in order."""
    said = F.coalesce(*[F.get(F.regexp_extract_all("redacted_input", F.lit(js(p, c)), F.lit(1)), F.lit(0)) for p, c in SCOPES])
    found = instructions.select("session_id", "seq", path_tokens(said).alias("paths")).where(F.size("paths") > 0)
    ordered = F.array_sort(F.collect_list(F.struct("seq", "paths")))
    return found.groupBy("session_id").agg(F.array_distinct(F.flatten(F.transform(ordered, lambda x: x["paths"]))).alias("scope_paths"))


class RuleContract:
    def __init__(self, settings: Redaction = Redaction()):
        self.settings = settings

    def extract(self, instructions: DataFrame) -> DataFrame:
        """(session_id, contract struct<obligations, prohibitions, scope_paths>) for each session with an instruction."""
        order = lambda x: F.element_at(F.split(x["id"], "-"), -1).cast("int")
        by = lambda a, b: F.when(order(a) < order(b), -1).when(order(a) > order(b), 1).otherwise(0)
        found = obligations(instructions, self.settings).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("id", "text", "source_turn", "kind")), by).alias("obligations"))
        banned = prohibitions(instructions, self.settings).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("id", "text", "source_turn", "paths")), by).alias("prohibitions"))
        sessions = instructions.select("session_id").distinct().join(found, "session_id", "left").join(banned, "session_id", "left").join(scope_paths(instructions), "session_id", "left")
        empty = lambda c, like: F.coalesce(F.col(c), F.array().cast(like.schema[c].dataType))
        return sessions.select("session_id", F.struct(empty("obligations", found).alias("obligations"), empty("prohibitions", banned).alias("prohibitions"), F.coalesce("scope_paths", F.array().cast("array<string>")).alias("scope_paths")).alias("contract"))

"""Claims that a report makes about its session, found by rules."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.functions.clauses import clause_at, path_tokens, split_clauses
from proofline.functions.dictionaries import Redaction
from proofline.functions.patterns import js, match_spans, may_match, trim
from proofline.functions.redact import redact


class ClaimExtractor(Protocol):
    """Reports (session_id, seq, redacted_input, cwd) to rows of the claims table."""

    def extract(self, reports: DataFrame) -> DataFrame: ...


#: Words that turn a statement into its opposite, near a match.
NEGATION = r"\b(not|n't|no|except|but|failing)\b|していない|していません|できていない|できない|できず|できません|不可|ではない|ありません|ません|まだ(終わ|完了)|未(完了|完成|対応|着手|マージ)"
#: Fixed values: (kind, pattern, without regard to case, scope subtype), tried in this order.
RULES: list[tuple[str, str, bool, str | None]] = [
    ("test_pass", r"(全て(の)?|すべて(の)?)?テスト.{0,10}(通(り|った|過)|パス|成功)", False, None),
    ("test_pass", r"\ball\s+tests?\s+pass(ed)?\b", True, None),
    ("test_pass", r"\btests?\s+(now\s+)?pass(ed|ing)?\b", True, None),
    ("test_pass", r"\b\d+\s+(tests?|specs?)\s+passed\b", True, None),
    ("test_pass", r"\btest\s+suite\s+pass(ed|es)?\b", True, None),
    ("lint_clean", r"(lint|eslint|biome|リント).{0,15}(クリーン|通過|エラー(が)?\s*(0|ゼロ|なし))", True, None),
    ("lint_clean", r"\b(lint|eslint|biome)\b.{0,30}\b(clean|passed|no errors|0 errors)\b", True, None),
    ("build_ok", r"(ビルド|型チェック|タイプチェック|tsc).{0,15}(成功|通過|パス|エラー(が)?\s*(0|ゼロ|なし))", True, None),
    ("build_ok", r"\b(build|tsc|typecheck)\b.{0,30}\b(succeed(ed)?|passed|success|no errors)\b", True, None),
    ("scope_respected", r"(触って(い)?ません|変更して(い)?ません|変更していない|編集して(い)?ません)", False, "untouched"),
    ("scope_respected", r"\b(did not|didn't|have not|haven't)\s+(touch(ed)?|modif(y|ied)|chang(e|ed)|edit(ed)?)\b", True, "untouched"),
    ("scope_respected", r"\bonly changed\b", True, "exclusive"),
    ("task_done", r"(完了しました|実装しました|対応しました|修正しました|終わりました)", False, None),
    ("task_done", r"(タスク|作業|実装|修正|対応|変更|調査|リリース)?(が)?(完了|終了|完成)(?!条件|予定|したら|後)(しました|した|です)?", False, None),
    ("task_done", r"マージ(?!予定|前)(済み|されました|しました)?", False, None),
    ("task_done", r"お疲れ(さま|様)でした", False, None),
    ("task_done", r"\btask\s+(is\s+)?(complete|completed|done)\b", True, None),
    ("task_done", r"\b(implementation|fix|feature)\s+(is\s+)?(complete|completed|done)\b", True, None),
    ("task_done", r"\bmerged\b", True, None),
    ("verification_done", r"スポットチェック", False, None),
    ("verification_done", r"手動確認|目視確認", False, None),
    ("verification_done", r"record.{0,15}(一致|突合)", True, None),
    ("verification_done", r"\bverified\s*[:=]?\s*\d+\s*\/\s*\d+", True, None),
]
#: Characters around a match in which a negation counts, and that make up a claim's text.
GUARD, CONTEXT = 20, 40


def _around(text: Column, span: Column, width: int) -> Column:
    start = F.greatest(span["start"] - width, F.lit(0))
    return F.substring(text, start + 1, span["end"] + width - start)


def _first_match(text: Column, lower: Column, rule: int) -> Column:
    """A struct of the rule's number, kind and subtype and the span of its first match that no negation turns round; else null.

    The pattern is a literal, so that it is compiled once, and spans are only taken of texts that match.
    """
    kind, pattern, ignore_case, subtype = RULES[rule]
    compiled = F.lit(js(pattern, ignore_case))
    spans = match_spans(text, compiled)
    kept = spans if subtype else F.filter(spans, lambda s: ~F.rlike(_around(text, s, GUARD), F.lit(js(NEGATION, True))))
    found = F.struct(F.lit(rule).alias("rule"), F.lit(kind).alias("kind"), F.lit(subtype).cast("string").alias("subtype"), F.get(kept, F.lit(0)).alias("span"))
    return F.when(may_match(text, lower, pattern, ignore_case) & F.rlike(text, compiled), found)


def matched(reports: DataFrame) -> DataFrame:
    """reports with rule (number), kind, subtype and span of each rule's first match that no negation turns round."""
    text = F.col("redacted_input")
    some = reports.where("redacted_input is not null and redacted_input <> ''").withColumn("lower", F.lower(text))
    found = F.array_compact(F.array(*[_first_match(text, F.col("lower"), i) for i in range(len(RULES))]))
    return some.withColumn("r", F.explode(found)).where("r.span is not null").select(*reports.columns, "r.rule", "r.kind", "r.subtype", "r.span")


class RuleClaims:
    """One claim for each report and kind: that of the first rule with a match."""

    def __init__(self, settings: Redaction = Redaction()):
        self.settings = settings

    def extract(self, reports: DataFrame) -> DataFrame:
        found = matched(reports.select("session_id", "seq", "redacted_input", "cwd"))
        best = found.groupBy("session_id", "seq", "kind").agg(F.min_by(F.struct("redacted_input", "cwd", "subtype", "span"), "rule").alias("m")).select("session_id", "seq", "kind", "m.*")
        clause = clause_at(split_clauses(F.col("redacted_input")), F.col("span.start"))
        best = best.withColumn("paths", F.when(F.col("subtype").isNotNull(), F.transform(path_tokens(clause["text"]), lambda p: redact(p, self.settings))))
        has_paths = F.size("paths") > 0
        none = F.lit(None).cast("string")
        return best.select(
            F.concat_ws("#", "session_id", F.lit("claim"), "kind", "seq").alias("claim_id"), "session_id", redact(trim(_around(F.col("redacted_input"), F.col("span"), CONTEXT)), self.settings).alias("text"), "kind", F.col("seq").alias("turn"), "cwd",
            F.when(has_paths, F.col("subtype")).alias("scope_subtype"), F.when(has_paths, F.col("paths")).alias("paths"), F.lit("rules").alias("extractor_backend"), none.alias("extractor_model"), none.alias("extractor_prompt_version"),
        )

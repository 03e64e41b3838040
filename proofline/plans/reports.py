"""Reports of an audit: evidence lines, JSON, Markdown and HTML, one text for each session, and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.functions.markup import escape_html, script_safe
from proofline.schemas import VERDICTS

BADGES = {"proven": "✅ proven", "contradicted": "❌ contradicted", "unknown": "❔ unknown"}


def evidence_lines(verdicts: DataFrame, events: DataFrame, width: int = 160) -> DataFrame:
    """(session_id, claim_id, pos, seq, line): one line of text for each evidence reference; an event that is missing says so."""
    refs = verdicts.select("session_id", "claim_id", F.posexplode("evidence_refs").alias("pos", "seq"))
    seen = events.select("session_id", "seq", "type", "command_class", "redacted_input", F.col("evidence_tool_use_source_line").alias("use"), F.col("evidence_tool_result_source_line").alias("result"))
    found = refs.join(seen, ["session_id", "seq"], "left")
    shown = F.coalesce(F.col("use").cast("string"), F.lit("?"))
    place = F.when(F.col("result").isNotNull(), F.concat(F.lit("use line "), shown, F.lit(" / result line "), F.col("result").cast("string"))).otherwise(F.concat(F.lit("line "), shown))
    text = F.coalesce("redacted_input", F.lit(""))
    said = F.when(F.col("type") == "command", F.concat(F.lit("command("), F.coalesce("command_class", F.lit("-")), F.lit("): "), text)).otherwise(F.concat(F.col("type"), F.lit(": "), text))
    seq = F.concat(F.lit("seq="), F.col("seq").cast("string"))
    line = F.when(F.col("type").isNull(), F.concat(seq, F.lit(" (event not found)"))).otherwise(F.concat(seq, F.lit(" ("), place, F.lit(") "), F.substring(said, 1, width)))
    return found.select("session_id", "claim_id", "pos", "seq", line.alias("line"))


def _counts() -> list[Column]:
    return [F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS]


def histogram(verdicts: DataFrame, column: str = "verdict") -> DataFrame:
    return verdicts.groupBy(column).agg(F.count("*").alias("n"))


def totals(claims: DataFrame, verdicts: DataFrame, sessions: DataFrame) -> DataFrame:
    """(session_id, claims, proven, contradicted, unknown) for each session (session_id), and a last row of all with null."""
    per = sessions.select("session_id").distinct().join(claims.select("session_id", "claim_id"), "session_id", "left").join(verdicts.select("session_id", "claim_id", "verdict"), ["session_id", "claim_id"], "left")
    return per.rollup("session_id").agg(F.count("claim_id").alias("claims"), *_counts())


def run_totals(claims: DataFrame, sessions: DataFrame) -> DataFrame:
    """(sessions, claims, sessions_without_claims)."""
    per = sessions.select("session_id").distinct().join(claims.groupBy("session_id").agg(F.count("*").alias("n")), "session_id", "left")
    return per.agg(F.count("*").alias("sessions"), F.coalesce(F.sum("n"), F.lit(0)).alias("claims"), F.count_if(F.col("n").isNull()).alias("sessions_without_claims"))


def bundle(sessions: DataFrame, claims: DataFrame, verdicts: DataFrame, events: DataFrame, contracts: DataFrame, width: int = 160) -> DataFrame:
    """(session_id, contract, items): a session's claims in order of turn and id, each with its verdict and evidence lines."""
    lines = evidence_lines(verdicts, events, width).groupBy("session_id", "claim_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]).alias("lines"))
    joined = claims.join(verdicts, ["session_id", "claim_id"], "left").join(lines, ["session_id", "claim_id"], "left")
    claim = F.struct(*[c for c in claims.columns])
    verdict = F.when(F.col("verdict").isNotNull(), F.struct("session_id", "claim_id", "verdict", "reason_code", "evidence_refs"))
    item = F.struct("turn", "claim_id", claim.alias("claim"), verdict.alias("v"), F.coalesce("lines", F.array().cast("array<string>")).alias("lines"))
    per = joined.groupBy("session_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    out = sessions.select("session_id").distinct().join(per, "session_id", "left").join(contracts, "session_id", "left")
    return out.withColumn("items", F.coalesce("items", F.array().cast(per.schema["items"].dataType)))


def _count(verdict: str) -> Column:
    return F.size(F.filter("items", lambda i: i["v"]["verdict"] == verdict)).cast("string")


def as_json(bundles: DataFrame) -> DataFrame:
    """(session_id, json) of {session_id, contract, claims, verdicts}."""
    claims = F.transform("items", lambda i: i["claim"])
    verdicts = F.filter(F.transform("items", lambda i: i["v"]), lambda v: v.isNotNull())
    return bundles.select("session_id", F.to_json(F.struct("session_id", "contract", claims.alias("claims"), verdicts.alias("verdicts")), {"pretty": "true"}).alias("json"))


def as_markdown(bundles: DataFrame) -> DataFrame:
    badge = lambda v: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in BADGES.items() for x in p]), v), F.lit("(no verdict)"))

    def section(i: Column) -> Column:
        lines = F.when(F.size(i["lines"]) > 0, F.concat(F.lit("- evidence:\n  - "), F.array_join(i["lines"], "\n  - "))).otherwise(F.lit("- evidence: (none)"))
        judged = F.when(i["v"].isNotNull(), F.concat(F.lit("\n- reason_code: `"), i["v"]["reason_code"], F.lit("`\n"), lines, F.lit("\n"))).otherwise(F.lit(""))
        return F.concat(F.lit("### "), i["claim"]["kind"], F.lit(" — "), badge(i["v"]["verdict"]), F.lit("\n\n> "), i["claim"]["text"], F.lit("\n"), judged)

    head = F.concat(F.lit("# audit: "), F.col("session_id"), F.lit("\n\n## Summary\n\n- claims: "), F.size("items").cast("string"), F.lit("\n- proven: "), _count("proven"), F.lit(" / contradicted: "), _count("contradicted"), F.lit(" / unknown: "), _count("unknown"), F.lit("\n\n"))
    body = F.when(F.size("items") == 0, F.lit("no claims extracted")).otherwise(F.concat(F.lit("## Claims\n\n"), F.array_join(F.transform("items", section), "\n")))
    return bundles.select("session_id", F.concat(head, body).alias("markdown"))


PAGE = '<!doctype html>\n<html lang="en">\n<head><meta charset="utf-8"><title>'


def as_html(bundles: DataFrame) -> DataFrame:
    """Self-contained pages; give bundle() a width of 200."""
    json = F.col("json")

    def section(i: Column) -> Column:
        lines = F.array_join(F.transform(i["lines"], lambda x: F.concat(F.lit("<li>"), escape_html(x), F.lit("</li>"))), "")
        return F.concat(F.lit('<section class="claim"><h2>'), escape_html(i["claim"]["kind"]), F.lit(" — "), F.coalesce(i["v"]["verdict"], F.lit("(no verdict)")), F.lit("</h2><blockquote>"), escape_html(i["claim"]["text"]), F.lit("</blockquote><p><code>"), F.coalesce(i["v"]["reason_code"], F.lit("")), F.lit("</code></p><ul>"), lines, F.lit("</ul></section>"))

    name = escape_html(F.col("session_id"))
    counts = F.concat(F.lit("claims="), F.size("items").cast("string"), *[F.concat(F.lit(f" {v}="), _count(v)) for v in VERDICTS])
    page = F.concat(F.lit(PAGE), F.lit("audit: "), name, F.lit("</title></head>\n<body><h1>"), name, F.lit("</h1><p>"), counts, F.lit("</p>"), F.array_join(F.transform("items", section), "\n"), F.lit('<script type="application/json" id="audit">'), script_safe(json), F.lit("</script></body></html>"))
    return bundles.join(as_json(bundles), "session_id").select("session_id", page.alias("html"))


def index_page(per_session: DataFrame) -> DataFrame:
    """(html): one page over totals(); its rows are the sessions' counts, which is one line for each session."""
    cell = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))
    link = F.concat(F.lit('<a href="'), escape_html(F.col("session_id")), F.lit('.html">'), escape_html(F.col("session_id")), F.lit("</a>"))
    row = F.concat(F.lit("<tr>"), cell(link), *[cell(F.col(c).cast("string")) for c in ("claims", *VERDICTS)], F.lit("</tr>"))
    rows = per_session.where("session_id is not null").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("session_id", row.alias("row")))), lambda r: r["row"]), "\n").alias("rows"), F.count("*").alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).cast("string").alias(c) for c in ("claims", *VERDICTS)])
    head = F.concat(F.lit(PAGE), F.lit("audit: index</title></head>\n<body><h1>index</h1><p>"), F.col("n").cast("string"), F.lit(" session(s)"), *[F.concat(F.lit(f" {c}="), F.col(c)) for c in ("claims", *VERDICTS)], F.lit("</p><table>"))
    return rows.select(F.concat(head, F.col("rows"), F.lit("</table></body></html>")).alias("html"))

"""Queries over the synthetic tables, one for each operator, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofline.functions.clauses import path_tokens, split_clauses
from proofline.functions.commands import command_class, normalized, segments, suppressed
from proofline.functions.dictionaries import COMMAND_CLASSES, Redaction
from proofline.functions.markup import escape_html, script_safe
from proofline.functions.redact import RULES as REDACT_RULES
from proofline.functions.redact import redact, redact_with_count, residual_secrets
from proofline.operators.adapter import raw_events, session_facts
from proofline.operators.claims import NEGATION, RULES, RuleClaims
from proofline.operators.contract import OBLIGATIONS, obligations, prohibitions, scope_paths
from proofline.operators.extractors import grounded
from proofline.operators.pairing import paired
from proofline.operators.verdicts import evaluate, evidence
from proofline.plans import evaluate as evaluation
from proofline.plans import audit, export, mutate, reports
from proofline.plans.derived import derived, with_inputs
from proofline.schemas import CLAIM_KINDS
from proofline.scratch import cut, shared_dir
from proofline.sources import store
from proofline.sources.files import digests, physical_lines, write_files
from proofline.sources.transcripts import parse

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: Nothing of the dictionary: RE2 has no lookaround, and the ticket rule is tested by residual_audit and redact_chain.
PLAIN = Redaction(user=None)


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLES[name or f.__name__] = sql
        return f

    return put


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _joined(column: str) -> str:
    return F.array_join(F.transform(F.col(column), lambda x: x.cast("string")), ",").alias(column)


# adapter


@query("SELECT concat('s', user_id) AS session_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq FROM events")
def seq_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a transcript for each user, in which each event is an instruction; its text is the event's id
    order = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    said = F.struct(F.col("event_id").cast("string").alias("content"))
    raw = F.to_json(F.struct(F.lit("user").alias("type"), said.alias("message")))
    lines = _read(spark, sf_dir, "events").select(F.concat(F.lit("/t/s"), "user_id", F.lit(".jsonl")).alias("file"), order.alias("line"), raw.alias("raw"))
    found = raw_events(parse(lines))
    return found.select(F.regexp_extract("file", r"/t/(.*)\.jsonl", 1).alias("session_id"), F.col("input").cast("long").alias("event_id"), F.col("seq").cast("long").alias("seq"))


# the pending map as a recursion would be slow in SQL: a result answers the nearest earlier use with no result of its id in between
PAIRS = """
, r AS (SELECT *, row_number() OVER (PARTITION BY session_id, tool_id ORDER BY pos) AS n FROM d_tokens)
"""


@query(with_inputs(PAIRS + "SELECT r.session_id, r.tool_id, r.pos AS result_pos, u.pos AS use_pos FROM r JOIN r u ON u.session_id = r.session_id AND u.tool_id = r.tool_id AND u.n = r.n - 1 WHERE NOT r.is_use AND u.is_use", "tokens"))
def tool_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = paired(derived(spark, sf_dir, "tokens"), ["session_id", "tool_id"], ["pos"]).where("use is not null")
    return found.select("session_id", "tool_id", F.col("pos").alias("result_pos"), F.col("use.pos").alias("use_pos"))


@query(with_inputs(PAIRS + """
, last_result AS (SELECT session_id, tool_id, max(CASE WHEN is_use THEN 0 ELSE n END) AS n FROM r GROUP BY ALL)
SELECT session_id, tool_id, min(pos) AS place, max(pos) AS use_pos FROM r JOIN last_result l USING (session_id, tool_id) WHERE r.n > l.n GROUP BY ALL
""", "tokens"))  # fmt: skip
def orphan_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = paired(derived(spark, sf_dir, "tokens"), ["session_id", "tool_id"], ["pos"]).where("orphan")
    return found.select("session_id", "tool_id", F.col("place.pos").alias("place"), F.col("pos").alias("use_pos"))


@query("""
SELECT event_id, CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status, TRY_CAST(regexp_extract(concat('Exit code ', json_extract_string(props, '$.k')), 'Exit code ([0-9]+)', 1) AS INT) AS exit_code,
  trim(regexp_replace(concat('  a  ', props, chr(9), 'b '), '\\s+', ' ', 'g')) AS command FROM events
""".replace("\\\\", "\\"))  # fmt: skip
def tool_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a transcript for each user, in which each event is a command with its result
    events = _read(spark, sf_dir, "events").withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")))
    command = F.struct(F.concat(F.lit("  a  "), "props", F.lit("\tb ")).alias("command"))
    use = F.struct(F.lit("tool_use").alias("type"), F.col("event_id").cast("string").alias("id"), F.lit("Bash").alias("name"), command.alias("input"))
    result = F.struct(F.lit("tool_result").alias("type"), F.col("event_id").cast("string").alias("tool_use_id"), F.concat(F.lit("Exit code "), F.get_json_object("props", "$.k")).alias("content"), (F.col("event_type") == "error").alias("is_error"))
    line = lambda speaker, block: F.to_json(F.struct(F.lit(speaker).alias("type"), F.struct(F.array(block).alias("content")).alias("message")))
    both = events.select("user_id", "n", F.posexplode(F.array(line("assistant", use), line("user", result))).alias("second", "raw"))
    lines = both.select(F.concat(F.lit("/t/s"), "user_id", F.lit(".jsonl")).alias("file"), (2 * F.col("n") - 1 + F.col("second")).alias("line"), "raw")
    found = raw_events(parse(lines)).where("type = 'command'")
    return found.select(F.col("tool_id").cast("long").alias("event_id"), F.col("outcome_status").alias("status"), F.col("outcome_exit_code").alias("exit_code"), normalized(F.col("input")).alias("command"))


def _spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of conversations as transcripts, with conv_id and turn; every other text is a list of blocks."""
    said = _read(spark, sf_dir, "conversations").where("role in ('user', 'assistant')")
    block = F.array(F.struct(F.lit("text").alias("type"), "text"))
    line = lambda content: F.to_json(F.struct(F.col("role").alias("type"), F.struct(content.alias("content")).alias("message")))
    raw = F.when(F.col("turn") % 2 == 0, line(F.col("text"))).otherwise(line(block))
    lines = said.select(F.concat(F.lit("/t/"), "conv_id", F.lit(".jsonl")).alias("file"), (F.col("turn") + 1).cast("int").alias("line"), raw.alias("raw"))
    return raw_events(parse(lines)).select("*", F.regexp_extract("file", r"/t/(\d+)", 1).cast("long").alias("conv_id"), (F.col("use_line") - 1).alias("turn"))


@query("SELECT conv_id, max(turn) AS turn, arg_max(text, turn) AS text FROM conversations WHERE role = 'assistant' AND trim(text) <> '' GROUP BY conv_id")
def last_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spoken(spark, sf_dir).where("type = 'report'").select("conv_id", "turn", F.col("input").alias("text"))


@query("SELECT conv_id, count(*) AS n, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations WHERE role = 'user' AND trim(text) <> '' GROUP BY conv_id")
def instruction_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = _spoken(spark, sf_dir).where("type = 'instruction'")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("seq", "input"))), lambda x: x["input"])
    return said.groupBy("conv_id").agg(F.count("*").alias("n"), F.array_join(parts, "\n").alias("text"))


#: Uses and results by event: what an event is, whether its use is answered, and where it stands.
TURNS = """
SELECT user_id, event_id, CASE WHEN event_id % 5 = 0 THEN 'instruction' WHEN event_id % 5 < 4 THEN 'command' ELSE 'file_edit' END AS type, event_id % 7 <> 0 AS answered, event_type = 'error' AS failed,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS n, CAST(event_id % 3 AS INT) AS code
FROM events
"""


@query(f"""
WITH t AS ({TURNS}), e AS (SELECT *, type <> 'instruction' AND NOT answered AS open FROM t)
SELECT concat('s', user_id) AS session_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY open, n) - 1 AS seq, type, CASE WHEN type = 'instruction' THEN concat('go on ', event_id) WHEN type = 'command' THEN concat('run ', event_id) ELSE concat('/w/f', event_id, '.py') END AS input,
  CASE WHEN type = 'instruction' THEN NULL WHEN open THEN 'unknown' WHEN failed THEN 'error' ELSE 'ok' END AS status, CASE WHEN type <> 'instruction' AND answered AND failed THEN code END AS exit_code, 2 * n - 1 AS use_line, CASE WHEN type <> 'instruction' AND answered THEN 2 * n END AS result_line
FROM e
""")  # fmt: skip
def transcript_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.sql(TURNS.replace("FROM events", "FROM {events}"), events=_read(spark, sf_dir, "events"))
    number = F.col("event_id").cast("string")
    line = lambda speaker, content: F.to_json(F.struct(F.lit(speaker).alias("type"), F.struct(content.alias("content")).alias("message")))
    use = lambda tool, key, value: line("assistant", F.array(F.struct(F.lit("tool_use").alias("type"), number.alias("id"), F.lit(tool).alias("name"), F.struct(value.alias(key)).alias("input"))))
    said = F.when(F.col("type") == "instruction", line("user", F.concat(F.lit("go on "), number))).when(F.col("type") == "command", use("Bash", "command", F.concat(F.lit("run "), number)))
    said = said.otherwise(use("Edit", "file_path", F.concat(F.lit("/w/f"), number, F.lit(".py"))))
    text = F.when(F.col("failed"), F.concat(F.lit("Exit code "), "code")).otherwise("done")
    result = line("user", F.array(F.struct(F.lit("tool_result").alias("type"), number.alias("tool_use_id"), text.alias("content"), F.col("failed").alias("is_error"))))
    answer = F.when((F.col("type") != "instruction") & F.col("answered"), result).otherwise("")
    both = turns.select("user_id", "n", F.posexplode(F.array(said, answer)).alias("second", "raw"))
    lines = both.select(F.concat(F.lit("/t/s"), "user_id", F.lit(".jsonl")).alias("file"), (2 * F.col("n") - 1 + F.col("second")).alias("line"), "raw")
    found = raw_events(parse(lines))
    event = F.coalesce("tool_id", F.regexp_extract("input", r"(\d+)", 1)).cast("long")
    return found.select(
        F.regexp_extract("file", r"/t/(.*)\.jsonl", 1).alias("session_id"), event.alias("event_id"), F.col("seq").cast("long").alias("seq"), "type", "input", F.col("outcome_status").alias("status"),
        F.col("outcome_exit_code").alias("exit_code"), "use_line", "result_line",
    )


@query(with_inputs("""
, x AS (SELECT *, event_id % 12 AS k FROM d_lines)
SELECT file, count_if(k <> 1) AS total_lines, count_if(k IN (0, 4)) AS parse_error_lines, count_if(k IN (2, 3)) AS unknown_type_lines, count_if(k IN (0, 2, 3, 4)) AS skipped_lines, count_if(k >= 5) AS parsed_lines,
  count_if(k = 7) AS unsupported_tool_count, 2 * count_if(k = 6) + count_if(k = 8) AS invalid_block_count FROM x GROUP BY file
""", "lines"))  # fmt: skip
def ingest_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = session_facts(parse(derived(spark, sf_dir, "lines")))
    return facts.select("file", *[F.col(c).cast("long").alias(c) for c in ("total_lines", "parse_error_lines", "unknown_type_lines", "skipped_lines", "parsed_lines", "unsupported_tool_count", "invalid_block_count")])


@query(with_inputs("""
SELECT file, coalesce(arg_min(CASE event_id % 12 WHEN 6 THEN concat('c', user_id) ELSE concat('d', event_id) END, line) FILTER (event_id % 12 IN (6, 11)), concat('f', any_value(user_id))) AS session_id,
  arg_min(concat('1.', event_id % 4), line) FILTER (event_id % 12 = 7) AS version, count_if(event_id % 12 IN (6, 11)) > 0 AS mismatch, string_split(any_value(file), '/')[3] AS project FROM d_lines GROUP BY file
""", "lines"))  # fmt: skip
def session_id_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_facts(parse(derived(spark, sf_dir, "lines"))).select("file", "session_id", "version", "mismatch", "project")


@query(with_inputs("""
, x AS (SELECT *, event_id % 12 AS k FROM d_lines)
, pairs AS (SELECT file, count_if(k = 6) AS results FROM x GROUP BY file)
SELECT string_split(file, '/')[4] AS name, coalesce(arg_min(CASE k WHEN 6 THEN concat('c', user_id) ELSE concat('d', event_id) END, line) FILTER (k IN (6, 11)), concat('f', any_value(user_id))) AS session_id, string_split(any_value(file), '/')[3] AS project,
  count_if(k <> 1) AS total_lines, count_if(k IN (0, 4)) AS parse_error_lines, count_if(k IN (2, 3)) AS unknown_type_lines, count_if(k IN (0, 2, 3, 4)) AS skipped_lines, count_if(k = 7) AS unsupported_tool_count, 2 * count_if(k = 6) + count_if(k = 8) AS invalid_block_count
FROM x GROUP BY file
""", "lines"))  # fmt: skip
def ingest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    # transcripts are written as files and ingested into a new store, which is read
    folder = f"{shared_dir(spark)}/proofline-ingest-{uuid.uuid4().hex}"
    texts = derived(spark, sf_dir, "lines").select(F.regexp_replace("file", "^/t/", "").alias("path"), "line", F.col("raw").alias("text"))
    written = cut(write_files(texts, f"{folder}/t"), "written")
    target = store.Store(spark, f"{folder}/db", PLAIN)
    audit.ingest_table(target, written.select(F.concat(F.lit(f"{folder}/t/"), "path").alias("path")))
    counts = ("total_lines", "parse_error_lines", "unknown_type_lines", "skipped_lines", "unsupported_tool_count", "invalid_block_count")
    name = F.element_at(F.split("source_path", "/"), -1)
    return target.read("sessions").select(name.alias("name"), F.col("id").alias("session_id"), "project", *[F.col(c).cast("long").alias(c) for c in counts])


# commands


def _class_sql(s: str) -> str:
    bare = f"CASE WHEN regexp_matches({s}, '^\\S*/[^\\s/]') THEN regexp_replace({s}, '^\\S*/([^\\s/])', '\\1') ELSE {s} END"
    hit = lambda p: f"regexp_matches({s}, '(?i){p}') OR regexp_matches({bare}, '(?i){p}')"
    cases = " ".join(f"WHEN {hit('|'.join(f'(?:{p})' for p in patterns))} THEN '{name}'" for name, patterns in COMMAND_CLASSES.items())
    return f"CASE WHEN {hit('^(echo|printf|rg|grep|cat|sed|less|more|head|tail)' + chr(92) + 'b')} THEN NULL {cases} END"


SEGMENTS = r"list_filter(list_transform(regexp_split_to_array(command, '\|\||&&|;|\n|\|'), lambda x: trim(x)), lambda x: x <> '')"


@query(with_inputs(f"""
, s AS (SELECT event_id, unnest({SEGMENTS}) AS s FROM d_commands), c AS (SELECT event_id, {_class_sql('s')} AS c FROM s), a AS (SELECT event_id, count(DISTINCT c) AS n, min(c) AS c FROM c GROUP BY event_id)
SELECT event_id, CASE WHEN n = 1 THEN c WHEN n > 1 THEN 'composite' END AS class FROM a
""", "commands"))  # fmt: skip
def classify_command(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "commands").select("event_id", command_class(F.col("command")).alias("class"))


@query(with_inputs(r" SELECT event_id, regexp_matches(command, '(?i)\|\|\s*(true\b|exit\s+0\b)') AS suppressed FROM d_commands", "commands"))
def command_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "commands").select("event_id", suppressed(F.col("command")).alias("suppressed"))


@query(with_inputs(f" SELECT event_id, array_to_string({SEGMENTS}, '~') AS parts, CAST(len({SEGMENTS}) AS BIGINT) AS n FROM d_commands", "commands"))
def command_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = segments(F.col("command"))
    return derived(spark, sf_dir, "commands").select("event_id", F.array_join(parts, "~").alias("parts"), F.size(parts).cast("long").alias("n"))


# redaction


def _redact_sql(text: str, rules: list[tuple[str, bool, str]] = REDACT_RULES, ticket: bool = True) -> str:
    for pattern, ignore_case, replacement in [*rules, *[(r"\bJIRA-\d+\b", False, "TICKET-N")] * ticket]:
        p = (("(?i)" if ignore_case else "") + pattern).replace(r"\/", "/").replace(r"[\s\S]", r"(?s:.)").replace("'", "''")
        text = f"regexp_replace({text}, '{p}', '{replacement.replace('$', chr(92))}', 'g')"
    return text


EMAIL = [r for r in REDACT_RULES if r[2] == "[REDACTED_EMAIL]"]
ASSIGNMENT = [r for r in REDACT_RULES if r[2].startswith("$1=")]


@query(f"SELECT doc_id, sha256({_redact_sql('text', EMAIL).replace(chr(92) + 'bJIRA', 'JIRA')}) AS digest, CAST(len(regexp_extract_all(text, '{EMAIL[0][0]}')) AS BIGINT) AS n FROM documents")
def redact_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    from proofline.functions.patterns import js

    text = F.regexp_replace(F.regexp_replace("text", js(EMAIL[0][0]), EMAIL[0][2]), r"JIRA-\d+", "TICKET-N")
    return _read(spark, sf_dir, "documents").select("doc_id", F.sha2(text, 256).alias("digest"), F.regexp_count("text", F.lit(js(EMAIL[0][0]))).cast("long").alias("n"))


@query(f"SELECT page_id, sha256({_redact_sql('html', ASSIGNMENT)}) AS digest FROM pages")
def redact_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from proofline.functions.patterns import js

    text = F.regexp_replace(F.regexp_replace("html", js(ASSIGNMENT[0][0], True), ASSIGNMENT[0][2]), js(r"\bJIRA-\d+\b"), "TICKET-N")
    return _read(spark, sf_dir, "pages").select("page_id", F.sha2(text, 256).alias("digest"))


@query(with_inputs(f" SELECT event_id, {_redact_sql('text')} AS text FROM d_secrets", "secrets"))
def redact_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "secrets").select("event_id", redact(F.col("text"), PLAIN).alias("text"))


def _count_sql(source: str, last: str) -> str:
    """Rule after rule, each counted in what the rules before it have left: the CTEs x0 (source) to x<n>, then a query of the last."""
    steps = [f"x0 AS (SELECT event_id, text, 0 AS n FROM {source})"]
    for i, (pattern, ignore_case, _) in enumerate([*REDACT_RULES, (r"\bJIRA-\d+\b", False, "TICKET-N")]):
        p = (("(?i)" if ignore_case else "") + pattern).replace(r"\/", "/").replace(r"[\s\S]", r"(?s:.)").replace("'", "''")
        masked = _redact_sql("text", [REDACT_RULES[i]], ticket=False) if i < len(REDACT_RULES) else _redact_sql("text", [])
        steps.append(f"x{i + 1} AS (SELECT event_id, {masked} AS text, n + len(regexp_extract_all(text, '{p}')) AS n FROM x{i})")
    return ", " + ", ".join(steps) + " " + last.format(f"x{len(steps) - 1}")


@query(with_inputs(_count_sql("d_secrets", "SELECT event_id, CAST(n AS BIGINT) AS n FROM {}"), "secrets"))
def redaction_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact_with_count(derived(spark, sf_dir, "secrets"), "text", "masked", "n", PLAIN).select("event_id", F.col("n").cast("long").alias("n"))


# the names of SECRETS stand between slashes or at no escape, so that RE2 needs no look behind
@query(with_inputs(f" SELECT event_id, {_redact_sql('regexp_replace(' + _redact_sql('text', ticket=False) + chr(44) + chr(39) + '(?i)(^|[^a-zA-Z0-9])bob($|[^a-zA-Z0-9])' + chr(39) + chr(44) + chr(39) + chr(92) + '1USER' + chr(92) + '2' + chr(39) + chr(44) + chr(39) + 'g' + chr(39) + ')', [])} AS text FROM d_names", "names"))
def redact_os_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "names").select("event_id", redact(F.col("text"), Redaction(user="bob")).alias("text"))


@query(with_inputs(r"""
, x AS (SELECT event_id, text, list_filter(regexp_extract_all(text, '/Users/([A-Za-z0-9_.-]+)', 1), lambda u: NOT regexp_matches(u, '^USER($|[^A-Za-z0-9_])')) AS a, list_filter(regexp_extract_all(text, '-Users-([A-Za-z0-9_.]+)-', 1), lambda u: u <> 'USER') AS b FROM d_residual)
SELECT event_id, concat_ws(',', CASE WHEN len(a) > 0 THEN 'unmasked-Users-path' END, CASE WHEN len(b) > 0 THEN 'unmasked-encoded-Users-path' END, CASE WHEN regexp_matches(text, '\bJIRA-\d+\b') THEN 'dictionary-pattern:\bJIRA-\d+\b' END) AS labels FROM x
""", "residual"))  # fmt: skip
def residual_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "residual").select("event_id", F.array_join(residual_secrets(F.col("text"), PLAIN), ",").alias("labels"))


# clauses and paths

CLAUSE_SPLIT = r"regexp_split_to_array(text, '(?i)[。\n、]|,\s*but\b|;\s*|\bhowever\b,?\s*')"
PATH_RE = r"\.?(?:[\w-]+/)+(?:\*\*|\*|[\w-]+(?:\.[\w-]+)*)|\.?\b[\w-]+(?:\.[\w-]+)+\b"
DISTINCT = "list_transform(list_filter(list_zip({0}, range(len({0}))), lambda p: list_position({0}, p[1]) = p[2] + 1), lambda p: p[1])"


@query(with_inputs(f" SELECT event_id, array_to_string({CLAUSE_SPLIT}, '~') AS parts, CAST(len({CLAUSE_SPLIT}) AS BIGINT) AS n FROM d_clauses", "clauses"))
def clause_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = split_clauses(F.col("text"))
    return derived(spark, sf_dir, "clauses").select("event_id", F.array_join(F.transform(found, lambda c: c["text"]), "~").alias("parts"), F.size(found).cast("long").alias("n"))


@query(with_inputs(f" , x AS (SELECT event_id, regexp_extract_all(text, '{PATH_RE}') AS t FROM d_clauses) SELECT event_id, array_to_string({DISTINCT.format('t')}, ',') AS paths FROM x", "clauses"))
def path_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "clauses").select("event_id", F.array_join(path_tokens(F.col("text")), ",").alias("paths"))


@query(with_inputs(f", c AS (SELECT event_id, {CLAUSE_SPLIT} AS c FROM d_clauses), x AS (SELECT event_id, unnest(range(1, len(c) + 1)) AS pos, c FROM c) SELECT event_id, pos - 1 AS pos, array_to_string(regexp_extract_all(c[pos], '{PATH_RE}'), ',') AS paths FROM x", "clauses"))
def clause_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = derived(spark, sf_dir, "clauses").select("event_id", F.posexplode(split_clauses(F.col("text"))).alias("pos", "c"))
    return each.select("event_id", F.col("pos").cast("long").alias("pos"), F.array_join(path_tokens(F.col("c.text")), ",").alias("paths"))


# claims


def _claim_sql() -> str:
    """Spans by splitting and extracting, the guard on both sides, then the first rule of a kind, as plain SQL over a rule table."""
    rows = []
    for i, (kind, pattern, ignore_case, subtype) in enumerate(RULES):
        tail = None
        for ahead in ("(?!条件|予定|したら|後)", "(?!予定|前)"):
            if ahead in pattern:  # RE2 has no lookahead: the ending is taken into the match, and such matches are left out
                pattern, tail = pattern.replace(ahead, ahead.replace("(?!", "(") + "?"), ahead.replace("(?!", "(")
        rows.append(f"({i}, '{kind}', '{('(?i)' if ignore_case else '') + pattern.replace(chr(39), chr(39) * 2)}', {f'{chr(39)}{subtype}{chr(39)}' if subtype else 'NULL'}, {f'{chr(39)}{tail}{chr(39)}' if tail else 'NULL'})")
    cases = " UNION ALL ".join(
        f"SELECT t, {i} AS rule, '{RULES[i][0]}' AS kind, {'true' if RULES[i][3] else 'false'} AS free, {r.rsplit(', ', 1)[1][:-1]} AS tail, regexp_extract_all(t, {p}) AS m, regexp_split_to_array(t, {p}) AS g FROM texts WHERE regexp_matches(t, {p})" for i, r in enumerate(rows) for p in [r.split(", ", 2)[2].rsplit(", ", 2)[0]]
    )
    return f"""
, texts AS (SELECT DISTINCT redacted_input AS t FROM d_reports)
, tried AS ({cases})
, spans AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM tried)
, placed AS (SELECT *, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS a, length(m[i]) AS n FROM spans)
, kept AS (SELECT * FROM placed WHERE free OR (NOT regexp_matches(substring(t, CAST(greatest(a - 20, 0) + 1 AS BIGINT), CAST(a + n + 20 - greatest(a - 20, 0) AS BIGINT)), '(?i){NEGATION.replace("n't", "n''t")}') AND (tail IS NULL OR NOT regexp_matches(m[i], tail))))
, firsts AS (SELECT t, rule, kind, arg_min(struct_pack(a := a, n := n), i) AS s FROM kept GROUP BY ALL)
, best AS (SELECT t, kind, arg_min(s, rule) AS s, min(rule) AS rule FROM firsts GROUP BY ALL)
, found AS (SELECT r.session_id, r.seq, r.redacted_input AS t, kind, rule, s.a AS a, s.n AS n FROM d_reports r JOIN best ON best.t = r.redacted_input)
"""


CLAIM_SQL = _claim_sql()


def _extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RuleClaims(PLAIN).extract(derived(spark, sf_dir, "reports"))


def _claims_of(kind: str) -> Query:
    return lambda spark, sf_dir: _extracted(spark, sf_dir).where(F.col("kind") == kind).select("claim_id", "session_id", "turn", "cwd")


for _kind in CLAIM_KINDS:
    query(with_inputs(CLAIM_SQL + f"SELECT concat(session_id, '#claim#', kind, '#', seq) AS claim_id, session_id, seq AS turn, '/w' AS cwd FROM found WHERE kind = '{_kind}'", "reports"), f"claims_{_kind}")(_claims_of(_kind))


@query(with_inputs(CLAIM_SQL + f"SELECT session_id, kind, {_redact_sql('trim(substring(t, CAST(greatest(a - 40, 0) + 1 AS BIGINT), CAST(a + n + 40 - greatest(a - 40, 0) AS BIGINT)))')} AS text FROM found", "reports"))
def claim_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extracted(spark, sf_dir).select("session_id", "kind", "text")


@query(with_inputs(CLAIM_SQL + f""", c AS (SELECT *, list_filter({CLAUSE_SPLIT.replace('text', 't')}, lambda x: true) AS cl FROM found WHERE kind = 'scope_respected')
, p AS (SELECT session_id, rule, regexp_extract_all(coalesce(list_filter(cl, lambda x: contains(x, substring(t, CAST(a + 1 AS BIGINT), n)))[1], cl[len(cl)]), '{PATH_RE}') AS t FROM c)
SELECT session_id, CASE WHEN len(t) > 0 THEN CASE WHEN rule = 11 THEN 'exclusive' ELSE 'untouched' END END AS scope_subtype, CASE WHEN len(t) > 0 THEN array_to_string({DISTINCT.format('t')}, ',') END AS paths FROM p""", "reports"))  # fmt: skip
def claim_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extracted(spark, sf_dir).where("kind = 'scope_respected'").select("session_id", "scope_subtype", F.array_join("paths", ",").alias("paths"))


# contract


def _obligation_sql() -> str:
    parts = " UNION ALL ".join(f"SELECT t, {i} AS rule, '{k}' AS kind, regexp_extract_all(t, {p}) AS m, regexp_split_to_array(t, {p}) AS g FROM texts WHERE regexp_matches(t, {p})" for i, (k, pattern, c) in enumerate(OBLIGATIONS) for p in [f"'{('(?i)' if c else '') + pattern}'"])
    return f"""
, texts AS (SELECT DISTINCT redacted_input AS t FROM d_instructions), tried AS ({parts}), spans AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM tried)
, placed AS (SELECT *, {CLAUSE_SPLIT.replace('text', 't')} AS cl FROM spans)
, o AS (SELECT d.session_id, d.seq, rule, i, kind, list_filter(cl, lambda x: contains(x, m[i]))[1] AS c FROM placed JOIN d_instructions d ON d.redacted_input = placed.t)
SELECT session_id, concat('obligation-', row_number() OVER (PARTITION BY session_id ORDER BY seq, rule, i) - 1) AS id, trim(c) AS text, seq AS source_turn, kind FROM o
"""


@query(with_inputs(_obligation_sql(), "instructions"))
def contract_obligations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return obligations(derived(spark, sf_dir, "instructions"), PLAIN)


@query(with_inputs(f"""
, x AS (SELECT session_id, seq, unnest({CLAUSE_SPLIT.replace('text', 'redacted_input')}) AS c FROM d_instructions)
, y AS (SELECT session_id, seq, trim(c) AS text, regexp_extract_all(c, '{PATH_RE}') AS t FROM x WHERE regexp_matches(c, '(?i)(変更しない|\\bdo\\s+not\\s+(touch|modify|edit|change)\\b)'))
SELECT session_id, concat('prohibition-', row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1) AS id, text, seq AS source_turn, array_to_string(t, ',') AS paths FROM y WHERE len(t) > 0
""", "instructions"))  # fmt: skip
def contract_prohibitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prohibitions(derived(spark, sf_dir, "instructions"), PLAIN).withColumn("paths", F.array_join("paths", ","))


@query(with_inputs(f"""
, x AS (SELECT session_id, seq, regexp_extract_all(coalesce(nullif(regexp_extract(redacted_input, '担当[:：]\\s*([^\\n]+)', 1), ''), nullif(regexp_extract(redacted_input, '(?i)\\bscope[:：]\\s*([^\\n]+)', 1), ''), nullif(regexp_extract(redacted_input, '(?i)\\bassigned[:：]\\s*([^\\n]+)', 1), ''), ''), '{PATH_RE}') AS p FROM d_instructions)
, y AS (SELECT session_id, flatten(list(p ORDER BY seq)) AS t FROM x WHERE len(p) > 0 GROUP BY session_id)
SELECT session_id, array_to_string({DISTINCT.format('t')}, ',') AS scope_paths FROM y
""", "instructions"))  # fmt: skip
def contract_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scope_paths(derived(spark, sf_dir, "instructions")).withColumn("scope_paths", F.array_join("scope_paths", ","))


# verdicts: the oracle decides failures as they come, by a correlated look at what follows each error

EVIDENCE_SQL = """
, checks AS (SELECT * FROM (VALUES ('test_pass', 'test'), ('lint_clean', 'lint'), ('build_ok', 'build')) v(check_kind, cls))
, asked AS (SELECT c.*, k.check_kind, k.cls, CASE k.cls WHEN 'test' THEN 0 WHEN 'lint' THEN 1 ELSE 2 END AS n FROM d_claims c JOIN checks k ON c.kind = k.check_kind OR c.kind = 'task_done' WHERE c.turn IS NOT NULL)
, hit AS (SELECT a.session_id, a.claim_id, a.kind, a.n, a.check_kind, a.cwd AS claim_cwd, e.seq, e.command_class, e.outcome_status, e.cwd, trim(regexp_replace(e.redacted_input, '\\s+', ' ', 'g')) AS cmd
  FROM asked a JOIN d_events e ON e.session_id = a.session_id AND e.type = 'command' AND NOT e.suppressed AND e.command_class IN (a.cls, 'composite') AND e.seq < a.turn)
, scope AS (SELECT claim_id, n, any_value(claim_cwd) AS claim_cwd, count_if(cwd = claim_cwd) AS n_in, count(DISTINCT coalesce(cwd, '?')) AS n_cwd FROM hit GROUP BY claim_id, n)
, ok_scope AS (SELECT claim_id, n FROM scope WHERE CASE WHEN claim_cwd IS NULL THEN n_cwd = 1 ELSE n_in > 0 END)
, inside AS (SELECT h.* FROM hit h JOIN ok_scope s USING (claim_id, n) WHERE claim_cwd IS NULL OR cwd = claim_cwd)
, still AS (SELECT DISTINCT e.claim_id, e.n FROM inside e WHERE e.outcome_status = 'error' AND NOT EXISTS (SELECT 1 FROM inside o WHERE o.claim_id = e.claim_id AND o.n = e.n AND o.seq > e.seq AND o.outcome_status = 'ok' AND (o.command_class = 'composite' OR o.cmd = e.cmd)))
, last AS (SELECT claim_id, n, arg_max(outcome_status, seq) AS status, arg_max(command_class, seq) AS cls, string_agg(CAST(seq AS VARCHAR), ',' ORDER BY seq) AS refs FROM inside GROUP BY claim_id, n)
, ev AS (SELECT a.session_id, a.claim_id, a.kind, a.n, a.check_kind, CASE WHEN s.claim_id IS NULL THEN 'no-evidence' WHEN l.claim_id IS NULL THEN 'cwd-mismatch' WHEN l.status = 'error' AND l.cls = 'composite' THEN 'clear-failure-composite' WHEN l.status = 'error' THEN 'clear-failure'
    WHEN t.claim_id IS NOT NULL THEN 'partial-rerun' WHEN l.status = 'ok' THEN 'clear-success' ELSE 'all-unknown' END AS status, coalesce(l.refs, '') AS refs
  FROM asked a LEFT JOIN scope s USING (claim_id, n) LEFT JOIN last l USING (claim_id, n) LEFT JOIN still t USING (claim_id, n))
, checked AS (SELECT session_id, claim_id, kind, CASE status WHEN 'cwd-mismatch' THEN 'unknown' WHEN 'no-evidence' THEN 'contradicted' WHEN 'clear-success' THEN 'proven' WHEN 'clear-failure' THEN 'contradicted' ELSE 'unknown' END AS verdict,
    CASE status WHEN 'cwd-mismatch' THEN 'D2-UNRELATED-CWD' WHEN 'no-evidence' THEN 'D1' WHEN 'clear-success' THEN 'D1' WHEN 'clear-failure' THEN 'D2' WHEN 'clear-failure-composite' THEN 'D2-COMPOSITE-AMBIGUOUS' WHEN 'partial-rerun' THEN 'D2-PARTIAL-RERUN' ELSE 'D1-UNVERIFIED' END AS reason_code, refs AS evidence_refs FROM ev WHERE kind <> 'task_done')
, done_refs AS (SELECT i.claim_id, i.seq, min(i.n) AS n FROM inside i JOIN ev ON ev.claim_id = i.claim_id AND ev.n = i.n WHERE ev.kind = 'task_done' AND ev.status IN ('clear-failure', 'clear-failure-composite') GROUP BY ALL)
, done_list AS (SELECT claim_id, string_agg(CAST(seq AS VARCHAR), ',' ORDER BY n, seq) AS refs FROM done_refs GROUP BY claim_id)
, done AS (SELECT c.session_id, c.claim_id, c.kind, CASE WHEN d.refs IS NULL THEN 'unknown' ELSE 'contradicted' END AS verdict, CASE WHEN d.refs IS NULL THEN 'NOT-PROVABLE' ELSE 'D2' END AS reason_code, coalesce(d.refs, '') AS evidence_refs FROM d_claims c LEFT JOIN done_list d USING (claim_id) WHERE c.kind = 'task_done' AND c.turn IS NOT NULL)
, edits AS (SELECT c.claim_id, c.scope_subtype, e.seq, len(list_filter(string_split(c.path_list, ','), lambda g: regexp_matches(e.redacted_input, '(?i)(^|/)' || replace(replace(replace(replace(CASE WHEN suffix(g, '/') THEN g || '**' ELSE g END, '.', '\\.'), '**', chr(1)), '*', '[^/]*'), chr(1), '.*') || '$'))) > 0 AS hit
  FROM d_claims c JOIN d_events e ON e.session_id = c.session_id AND e.type = 'file_edit' AND e.seq < c.turn WHERE c.kind = 'scope_respected' AND c.scope_subtype IS NOT NULL)
, bad AS (SELECT claim_id, string_agg(CAST(seq AS VARCHAR), ',' ORDER BY seq) AS refs FROM edits WHERE hit = (scope_subtype = 'untouched') GROUP BY claim_id)
, scoped AS (SELECT c.session_id, c.claim_id, c.kind, CASE WHEN b.refs IS NULL THEN 'unknown' ELSE 'contradicted' END AS verdict, CASE WHEN c.scope_subtype IS NULL THEN 'D3-AMBIGUOUS' WHEN b.refs IS NULL THEN 'D3-LIMITED' ELSE 'D3' END AS reason_code, coalesce(b.refs, '') AS evidence_refs
  FROM d_claims c LEFT JOIN bad b USING (claim_id) WHERE c.kind = 'scope_respected' AND c.turn IS NOT NULL)
, anchorless AS (SELECT session_id, claim_id, kind, 'unknown' AS verdict, CASE WHEN turn IS NULL THEN 'NO-ANCHOR' ELSE 'NOT-PROVABLE' END AS reason_code, '' AS evidence_refs FROM d_claims WHERE turn IS NULL OR kind = 'verification_done')
, verdicts AS (SELECT * FROM checked UNION ALL SELECT * FROM done UNION ALL SELECT * FROM scoped UNION ALL SELECT * FROM anchorless)
""".replace("\\\\", "\\")


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = derived(spark, sf_dir, "claims")
    found = evaluate(claims, derived(spark, sf_dir, "events"))
    return found.join(claims.select("claim_id", "kind"), "claim_id").select("session_id", "claim_id", "kind", "verdict", "reason_code", "evidence_refs")


def _shown(df: DataFrame) -> DataFrame:
    return df.withColumn("evidence_refs", _joined("evidence_refs"))


@query(with_inputs(EVIDENCE_SQL + "SELECT claim_id, check_kind, status, refs FROM ev", "claims", "events"))
def evidence_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evidence(derived(spark, sf_dir, "claims"), derived(spark, sf_dir, "events"))
    return found.select("claim_id", F.col("check").alias("check_kind"), "status", _joined("refs"))


@query(with_inputs(EVIDENCE_SQL + "SELECT check_kind, status, count(*) AS n FROM ev GROUP BY ALL", "claims", "events"))
def pending_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evidence(derived(spark, sf_dir, "claims"), derived(spark, sf_dir, "events"))
    return found.groupBy(F.col("check").alias("check_kind"), "status").agg(F.count("*").alias("n"))


VERDICT_COLUMNS = "SELECT session_id, claim_id, kind, verdict, reason_code, evidence_refs FROM verdicts"


@query(with_inputs(EVIDENCE_SQL + VERDICT_COLUMNS, "claims", "events"))
def verdict_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_verdicts(spark, sf_dir))


for _name, _test in {"verdict_check": "kind IN ('test_pass', 'lint_clean', 'build_ok') AND reason_code <> 'NO-ANCHOR'", "verdict_task_done": "kind = 'task_done'", "verdict_scope": "kind = 'scope_respected'", "verdict_no_anchor": "reason_code = 'NO-ANCHOR'"}.items():
    query(with_inputs(EVIDENCE_SQL + VERDICT_COLUMNS + f" WHERE {_test}", "claims", "events"), _name)(lambda spark, sf_dir, test=_test: _shown(_verdicts(spark, sf_dir).where(test)))


@query(with_inputs(EVIDENCE_SQL + "SELECT verdict, count(*) AS n FROM verdicts GROUP BY verdict", "claims", "events"))
def verdict_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.histogram(_verdicts(spark, sf_dir))


@query(with_inputs(EVIDENCE_SQL + "SELECT reason_code, count(*) AS n FROM verdicts GROUP BY reason_code", "claims", "events"))
def reason_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.histogram(_verdicts(spark, sf_dir), "reason_code")


@query(with_inputs(EVIDENCE_SQL + "SELECT session_id, count(*) AS claims, count_if(verdict = 'proven') AS proven, count_if(verdict = 'contradicted') AS contradicted, count_if(verdict = 'unknown') AS unknown FROM verdicts GROUP BY ROLLUP (session_id)", "claims", "events"))
def index_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = derived(spark, sf_dir, "claims")
    return reports.totals(claims, _verdicts(spark, sf_dir), claims.select("session_id").distinct())


@query(with_inputs(" SELECT count(DISTINCT s.id) AS sessions, count(c.claim_id) AS claims, count(DISTINCT s.id) FILTER (c.claim_id IS NULL) AS sessions_without_claims FROM d_sessions s LEFT JOIN (SELECT * FROM d_claims WHERE cwd IS NOT NULL) c ON c.session_id = s.id", "sessions", "claims"))
def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.run_totals(derived(spark, sf_dir, "claims").where("cwd is not null"), derived(spark, sf_dir, "sessions").selectExpr("id as session_id"))


@query(with_inputs(EVIDENCE_SQL + """
, refs AS (SELECT claim_id, session_id, unnest(range(1, len(string_split(evidence_refs, ',')) + 1)) - 1 AS pos, CAST(unnest(string_split(evidence_refs, ',')) AS INT) + CASE WHEN kind = 'scope_respected' THEN 100000 ELSE 0 END AS seq FROM verdicts WHERE evidence_refs <> '')
SELECT r.claim_id, r.pos, r.seq, CASE WHEN e.seq IS NULL THEN concat('seq=', r.seq, ' (event not found)') ELSE concat('seq=', r.seq, ' (', CASE WHEN e.outcome_status <> 'unknown' THEN concat('use line ', 2 * e.seq + 1, ' / result line ', 2 * e.seq + 2) ELSE concat('line ', 2 * e.seq + 1) END, ') ', substring(concat('command(', e.command_class, '): ', e.redacted_input), 1, 160)) END AS line
FROM refs r LEFT JOIN d_events e ON e.session_id = r.session_id AND e.seq = r.seq
""", "claims", "events"))  # fmt: skip
def evidence_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = F.transform("evidence_refs", lambda s: s + F.when(F.col("kind") == "scope_respected", 100000).otherwise(0))
    lines = reports.evidence_lines(_verdicts(spark, sf_dir).withColumn("evidence_refs", shifted), derived(spark, sf_dir, "events"))
    return lines.select("claim_id", F.col("pos").cast("long").alias("pos"), "seq", "line")


# store


@query(with_inputs("""
 SELECT s.id, count(e.seq) AS event_count, count(*) FILTER (e.type = 'command') AS command_count, count(*) FILTER (e.type = 'file_edit') AS file_edit_count, count(*) FILTER (e.type = 'instruction') AS instruction_count, count(*) FILTER (e.type = 'report') AS report_count, count(*) FILTER (e.outcome_status = 'error') AS error_count
 FROM d_sessions s LEFT JOIN (SELECT * FROM d_events WHERE session_id <> 's7') e ON e.session_id = s.id GROUP BY s.id
""", "sessions", "events"))  # fmt: skip
def session_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.summary(derived(spark, sf_dir, "sessions"), derived(spark, sf_dir, "events").where("session_id <> 's7'")).drop("source_path", "ingested_at")


@query(with_inputs("""
, old AS (SELECT session_id, seq, 'old' AS version FROM d_events WHERE event_id % 3 < 2), new AS (SELECT session_id, seq, 'new' AS version FROM d_events WHERE CAST(substring(session_id, 2) AS INT) % 4 = 1 AND event_id % 3 > 0)
 SELECT * FROM new UNION ALL SELECT * FROM old WHERE session_id NOT IN (SELECT session_id FROM new)
""", "events"))  # fmt: skip
def upsert_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = derived(spark, sf_dir, "events")
    old = events.where("event_id % 3 < 2").select("session_id", "seq", F.lit("old").alias("version"))
    new = events.where("cast(substring(session_id, 2) as int) % 4 = 1 and event_id % 3 > 0").select("session_id", "seq", F.lit("new").alias("version"))
    return store.replaced(old, new, new)


@query(with_inputs(" SELECT id, source_path AS stored, replace(source_path, 'p1', 'q1') AS incoming FROM d_sessions WHERE contains(source_path, 'p1')", "sessions"))
def collision_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = derived(spark, sf_dir, "sessions")
    return store.collisions(sessions.withColumn("source_path", F.replace("source_path", F.lit("p1"), F.lit("q1"))), sessions)


@query(with_inputs(" SELECT session_id, claim_id FROM d_claims WHERE kind = 'build_ok'", "claims"))
def orphan_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = derived(spark, sf_dir, "claims").select("session_id", "claim_id", "kind")
    return store.orphan_verdicts(claims, claims.where("kind <> 'build_ok'")).select("session_id", "claim_id")


@query(with_inputs("""
, x AS (SELECT id, concat('/masked/', id, '.jsonl') AS safe, replace(source_path, '/Users/USER', '/Users/alice') AS raw FROM d_sessions)
 SELECT id AS session_id, CASE WHEN a.path IS NOT NULL THEN x.safe WHEN b.path IS NOT NULL THEN x.raw END AS path, CASE WHEN a.path IS NOT NULL THEN 'anonymized' WHEN b.path IS NOT NULL THEN 'raw' END AS origin,
   CASE WHEN a.path IS NULL AND b.path IS NULL THEN concat('resolved path does not exist: ', x.raw) END AS reason FROM x LEFT JOIN d_files a ON a.path = x.safe LEFT JOIN d_files b ON b.path = x.raw
""", "sessions", "files"))  # fmt: skip
def source_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.mutation_sources(derived(spark, sf_dir, "sessions"), derived(spark, sf_dir, "files"), "/masked/", "alice")


# pages and export


@query("SELECT page_id, sha256(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')) AS digest FROM pages")
def html_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "pages").select("page_id", F.sha2(escape_html(F.col("html")), 256).alias("digest"))


@query("SELECT page_id, replace(to_json({'url': url, 'n': page_id}), '</', '<\\/') AS json, sha256(replace(html, '</', '<\\/')) AS digest FROM pages")
def script_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    return pages.select("page_id", script_safe(F.to_json(F.struct("url", F.col("page_id").alias("n")))).alias("json"), F.sha2(script_safe(F.col("html")), 256).alias("digest"))


@query(with_inputs(f"""
, x AS (SELECT concat('s', event_id % 50) AS session_id, event_id AS line, {_redact_sql('text')} AS t FROM d_secrets)
 SELECT session_id, count(*) AS line_count, sha256(string_agg(t, chr(10) ORDER BY line)) AS sha256 FROM x GROUP BY session_id
""", "secrets"))  # fmt: skip
def export_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived(spark, sf_dir, "secrets").select(F.concat(F.lit("s"), (F.col("event_id") % 50).cast("string")).alias("session_id"), F.col("event_id").alias("line"), F.col("text").alias("raw"))
    return export.export(rows, PLAIN)[1].select("session_id", "line_count", "sha256")


@query(with_inputs(f"""
, x AS (SELECT concat('s', event_id % 50) AS session_id, event_id AS line, {_redact_sql('text')} AS t FROM d_secrets)
 SELECT session_id, count(*) AS lines, sha256(string_agg(t, chr(10) ORDER BY line)) AS sha256, sum(strlen(t)) + count(*) - 1 AS bytes FROM x GROUP BY session_id
""", "secrets"))  # fmt: skip
def export_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    # masked transcripts are written as files; lines, bytes and hash are those of the files as they are read again
    folder = f"{shared_dir(spark)}/proofline-export-{uuid.uuid4().hex}"
    line = F.row_number().over(Window.partitionBy(F.col("event_id") % 50).orderBy("event_id"))
    rows = derived(spark, sf_dir, "secrets").select(F.concat(F.lit("s"), (F.col("event_id") % 50).cast("string")).alias("session_id"), line.alias("line"), F.col("text").alias("raw"))
    lines, manifest, problems = export.export(rows, PLAIN)
    wrong = export.write(lines, manifest, problems, folder)
    if wrong:
        raise ValueError(str(wrong))
    read = cut(physical_lines(lines.select(F.concat(F.lit(f"{folder}/"), "session_id", F.lit(".jsonl")).alias("path")).distinct()), "read")
    counts = read.groupBy("path").agg(F.count("*").alias("lines"), (F.sum(F.octet_length("raw")) + F.count("*") - 1).alias("bytes"))
    hashes = digests(read.withColumnRenamed("raw", "text"), "path")
    return counts.join(hashes, "path").select(F.regexp_extract("path", r"([^/]*)\.jsonl$", 1).alias("session_id"), "lines", "sha256", "bytes")


@query(with_inputs(""", raws AS (SELECT event_id, CAST(CASE WHEN event_id % 3 = 0 THEN concat('{"a":"token=', event_id, '"}') ELSE to_json({text: text}) END AS VARCHAR) AS text FROM d_secrets)
""" + _count_sql("raws", "SELECT event_id, CAST(n AS INT) AS count, json_valid(r.text) AND NOT json_valid(x.text) AS broken FROM {} x JOIN raws r USING (event_id)"), "secrets"))  # fmt: skip
def broken_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"a":"token='), F.col("event_id").cast("string"), F.lit('"}'))).otherwise(F.to_json(F.struct("text")))
    return export.redacted_lines(derived(spark, sf_dir, "secrets").select("event_id", raw.alias("raw")), PLAIN).select("event_id", "count", "broken")


# mutation and evaluation

CANDIDATES = """
, runs AS (SELECT e.session_id, k.kind, e.seq, e.outcome_status, e.command_class FROM d_events e JOIN (VALUES ('test_pass', 'test'), ('lint_clean', 'lint'), ('build_ok', 'build')) k(kind, cls) ON e.command_class IN (k.cls, 'composite') WHERE e.type = 'command' AND NOT e.suppressed)
, cand AS (SELECT c.session_id, c.kind, c.turn, count(r.seq) AS n, list(r.outcome_status ORDER BY r.seq DESC) FILTER (r.seq IS NOT NULL) AS st, list(r.command_class ORDER BY r.seq DESC) FILTER (r.seq IS NOT NULL) AS cl
  FROM d_claims c LEFT JOIN runs r ON r.session_id = c.session_id AND r.kind = c.kind AND r.seq < c.turn WHERE c.kind IN ('test_pass', 'lint_clean', 'build_ok') AND c.turn IS NOT NULL GROUP BY ALL)
"""


@query(with_inputs(CANDIDATES + " SELECT session_id, kind, turn, n, st[1] AS last_status, cl[1] AS last_class, st[2] AS before_status FROM cand", "claims", "events"))
def mutate_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mutate.candidates(derived(spark, sf_dir, "claims"), derived(spark, sf_dir, "events"))
    return found.select("session_id", "kind", "turn", F.col("n").cast("long").alias("n"), F.col("last.status").alias("last_status"), F.col("last.class").alias("last_class"), F.col("before_last.status").alias("before_status"))


@query(with_inputs(CANDIDATES + """
 SELECT s.session_id, k.kind FROM (SELECT DISTINCT session_id FROM d_events) s CROSS JOIN (VALUES ('test_pass'), ('lint_clean'), ('build_ok')) k(kind) WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.session_id = s.session_id AND r.kind = k.kind AND r.outcome_status = 'ok' AND r.command_class <> 'composite')
""", "claims", "events"))  # fmt: skip
def mutate_unproven(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = derived(spark, sf_dir, "events")
    return mutate.unproven_kinds(events.select("session_id").distinct(), events.where("outcome_status = 'ok' and command_class <> 'composite'"))


def _mutable(spark: SparkSession, sf_dir: str, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """Claims and events with a report at the turn of each session's claims, its line after all others.

    The events are the first 22 of each session or, if whole, all of them; then a quarter of the sessions has no classed command.
    """
    claims = derived(spark, sf_dir, "claims").where("kind in ('test_pass', 'lint_clean', 'build_ok') and turn is not null")
    events = derived(spark, sf_dir, "events").select("session_id", "seq", "type", "command_class", "suppressed", "outcome_status", "cwd", "evidence_tool_use_source_line", "evidence_tool_result_source_line", "evidence_tool_use_id")
    none = F.lit(None).cast("string")
    report = claims.select("session_id", "turn").distinct().select("session_id", F.col("turn").alias("seq"), F.lit("report").alias("type"), none.alias("command_class"), F.lit(False).alias("suppressed"), none.alias("outcome_status"), F.lit("/w/a").alias("cwd"), F.lit(9999).alias("evidence_tool_use_source_line"), F.lit(None).cast("int").alias("evidence_tool_result_source_line"), none.alias("evidence_tool_use_id"))
    unclassed = F.substring("session_id", 2, 20).cast("long") % 4 == 0
    events = events.withColumn("command_class", F.when(~unclassed, F.col("command_class"))) if whole else events.where("seq < 22")
    return claims, events.unionByName(report)


ONE_EACH = "list_position(['test_pass', 'lint_clean', 'build_ok'], kind)"
MUTABLE = CANDIDATES.replace("FROM d_events e JOIN", "FROM (SELECT * FROM d_events WHERE seq < 22) e JOIN") + f"""
, sess AS (SELECT DISTINCT session_id FROM cand), free AS (SELECT s.session_id, k.kind FROM sess s CROSS JOIN (VALUES ('test_pass'), ('lint_clean'), ('build_ok')) k(kind) WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.session_id = s.session_id AND r.kind = k.kind))
, m AS (
  SELECT session_id, 'M1' AS operator, arg_min(kind, {ONE_EACH}) AS kind, -2 AS delta FROM cand WHERE n = 1 AND st[1] = 'ok' GROUP BY session_id
  UNION ALL SELECT session_id, 'M2', arg_min(kind, {ONE_EACH}), 0 FROM cand WHERE st[1] = 'ok' AND cl[1] <> 'composite' GROUP BY session_id
  UNION ALL SELECT session_id, 'M3', arg_min(kind, {ONE_EACH}), 0 FROM free GROUP BY session_id
  UNION ALL SELECT session_id, 'M4', arg_min(kind, {ONE_EACH}), -2 FROM cand WHERE n >= 2 AND st[1] = 'ok' AND st[2] = 'error' GROUP BY session_id
  UNION ALL SELECT session_id, 'M5', arg_min(kind, list_position(['lint_clean', 'build_ok', 'test_pass'], kind)), 2 FROM free GROUP BY session_id
  UNION ALL SELECT session_id, 'M6', arg_min(kind, {ONE_EACH}), 1 FROM cand WHERE n = 1 AND st[1] = 'ok' GROUP BY session_id
  UNION ALL SELECT session_id, 'M7', kind, 2 FROM free UNION ALL SELECT session_id, 'M8', kind, 4 FROM free WHERE kind = 'test_pass')
"""  # fmt: skip
WHOLE = MUTABLE.replace("SELECT * FROM d_events WHERE seq < 22", "SELECT * REPLACE (CASE WHEN CAST(substring(session_id, 2) AS BIGINT) % 4 <> 0 THEN command_class END AS command_class) FROM d_events")


@query(with_inputs(MUTABLE + "SELECT * FROM m", "claims", "events"))
def mutate_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutate.edits(*_mutable(spark, sf_dir)).select("session_id", "operator", "kind", "delta")


for _op in mutate.OPERATORS:
    query(with_inputs(MUTABLE + f"SELECT session_id, kind, delta FROM m WHERE operator = '{_op}'", "claims", "events"), f"mutate_{_op.lower()}")(lambda spark, sf_dir, op=_op: mutate.edits(*_mutable(spark, sf_dir)).where(F.col("operator") == op).select("session_id", "kind", "delta"))


@query(with_inputs(MUTABLE + ", o AS (SELECT concat('M', i) AS operator FROM range(1, 9) t(i)) SELECT o.operator, count(m.session_id) AS n, count(m.session_id) < 3 AS short FROM o LEFT JOIN m USING (operator) GROUP BY o.operator", "claims", "events"))
def mutants_per_operator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutate.per_operator(mutate.edits(*_mutable(spark, sf_dir)))


# the same over whole sessions


@query(with_inputs(WHOLE + "SELECT * FROM m", "claims", "events"))
def mutate_whole_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutate.edits(*_mutable(spark, sf_dir, whole=True)).select("session_id", "operator", "kind", "delta")


for _op in mutate.OPERATORS:
    query(with_inputs(WHOLE + f"SELECT session_id, kind, delta FROM m WHERE operator = '{_op}'", "claims", "events"), f"mutate_whole_{_op.lower()}")(lambda spark, sf_dir, op=_op: mutate.edits(*_mutable(spark, sf_dir, whole=True)).where(F.col("operator") == op).select("session_id", "kind", "delta"))


@query(with_inputs(WHOLE + ", o AS (SELECT concat('M', i) AS operator FROM range(1, 9) t(i)) SELECT o.operator, count(m.session_id) AS n, count(m.session_id) < 3 AS short FROM o LEFT JOIN m USING (operator) GROUP BY o.operator", "claims", "events"))
def mutants_per_operator_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutate.per_operator(mutate.edits(*_mutable(spark, sf_dir, whole=True)))


def _case(key: str, table: dict[str, str]) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


@query(with_inputs(WHOLE + f"""
, ran AS (SELECT e.session_id, k.kind, e.seq, struct_pack(use := 2 * e.seq + 1, result := 2 * e.seq + 2, tool := concat('t', e.event_id), cwd := e.cwd) AS s
  FROM d_events e JOIN (VALUES ('test_pass', 'test'), ('lint_clean', 'lint'), ('build_ok', 'build')) k(kind, cls) ON e.command_class IN (k.cls, 'composite') WHERE e.type = 'command' AND NOT e.suppressed AND CAST(substring(e.session_id, 2) AS BIGINT) % 4 <> 0)
, last AS (SELECT c.session_id, c.kind, arg_max(r.s, r.seq) AS s FROM d_claims c JOIN ran r ON r.session_id = c.session_id AND r.kind = c.kind AND r.seq < c.turn GROUP BY ALL)
SELECT m.session_id, m.operator, m.kind, 9999 AS report_line, CASE WHEN operator IN ('M1', 'M4') THEN concat(s.use, ',', s.result) ELSE '' END AS deletes,
  CASE WHEN operator = 'M2' THEN concat(s.result, ':fail:', s.tool) WHEN operator = 'M6' THEN concat(s.use, ':suppress:', s.tool) WHEN operator IN ('M3', 'M5', 'M7', 'M8') THEN concat('9999:say:', {_case('m.kind', mutate.PHRASES)}) ELSE '' END AS rewrites,
  CASE operator WHEN 'M5' THEN 2 WHEN 'M6' THEN 1 WHEN 'M7' THEN 2 WHEN 'M8' THEN 4 ELSE 0 END AS n_inserts, CASE operator WHEN 'M5' THEN {_case('m.kind', mutate.COMMANDS)} WHEN 'M6' THEN {_case('m.kind', mutate.COMMANDS)} WHEN 'M7' THEN 'preflight' WHEN 'M8' THEN 'npm test' END AS command,
  CASE operator WHEN 'M5' THEN '/w/a/mut-unrelated' WHEN 'M6' THEN coalesce(s.cwd, '/w/a') WHEN 'M7' THEN '/w/a' WHEN 'M8' THEN '/w/a' END AS cwd
FROM m LEFT JOIN last l ON l.session_id = m.session_id AND l.kind = m.kind
""", "claims", "events"))  # fmt: skip
def mutate_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mutate.edits(*_mutable(spark, sf_dir, whole=True))
    changes = F.transform("rewrites", lambda r: F.concat_ws(":", r["line"], r["how"], r["arg"]))
    first = F.get("inserts", F.lit(0))
    return found.select(
        "session_id", "operator", "kind", "report_line", _joined("deletes"), F.array_join(changes, ",").alias("rewrites"), F.size("inserts").alias("n_inserts"),
        F.get_json_object(first, "$.message.content[0].input.command").alias("command"), F.get_json_object(first, "$.cwd").alias("cwd"),
    )


@query(with_inputs(f"""
, x AS (SELECT event_id % 100 AS k, CAST(floor(event_id / 100) AS INT) + 1 AS line, command FROM d_commands WHERE event_id % 100 IN (SELECT event_id FROM d_commands WHERE event_id < 100))
, edited AS (SELECT k, line, to_json({{type: 'assistant', "sessionId": concat('mut-m3-s', k, '-test_pass'), message: {{content: CASE WHEN line = 1 THEN concat(command, '{mutate.SEPARATOR}', 'All tests passed.') ELSE command END}}}}) AS raw FROM x)
, every AS (SELECT k, 0 AS line, '{{}}' AS raw FROM x WHERE line = 1 UNION ALL SELECT k, line, CAST(raw AS VARCHAR) FROM edited)
SELECT concat('M3-s', k, '-test_pass') AS mutant_id, 'M3' AS operator, 'test_pass' AS kind, row_number() OVER (PARTITION BY k ORDER BY line) AS line, raw FROM every
""", "commands"))  # fmt: skip
def mutate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.to_json(F.struct(F.lit("assistant").alias("type"), F.concat(F.lit("s"), (F.col("event_id") % 100).cast("string")).alias("sessionId"), F.struct(F.col("command").alias("content")).alias("message")))
    rows = derived(spark, sf_dir, "commands").select(F.concat(F.lit("s"), (F.col("event_id") % 100).cast("string")).alias("session_id"), (F.floor(F.col("event_id") / 100) + 1).cast("int").alias("line"), text.alias("raw"))
    ask = rows.where("line = 1").select("session_id", F.lit("M3").alias("operator"), F.lit("test_pass").alias("kind"), F.lit(1).alias("report_line"), F.array().cast("array<int>").alias("deletes"), F.array(F.struct(F.lit(1).alias("line"), F.lit("say").alias("how"), F.lit("All tests passed.").alias("arg"))).alias("rewrites"), F.array(F.lit("{}")).alias("inserts"))
    return mutate.mutants(rows, ask)


RESULTS = """
, results AS (SELECT concat('M', event_id % 8 + 1) AS operator, event_id % 10 > 0 AS match FROM events)
 SELECT operator, count(*) AS total, count_if(match) AS match, count_if(match) / count(*) AS rate FROM results GROUP BY ROLLUP (operator)
"""


@query("WITH " + RESULTS.strip()[2:])
def eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _read(spark, sf_dir, "events")
    return evaluation.rates(events.select(F.concat(F.lit("M"), (F.col("event_id") % 8 + 1).cast("string")).alias("operator"), (F.col("event_id") % 10 > 0).alias("match")))


@query(with_inputs(EVIDENCE_SQL + """
, manifest AS (SELECT claim_id AS mutant_id, session_id, kind, turn, CASE WHEN turn % 2 = 0 THEN 'contradicted' ELSE 'unknown' END AS ev, CASE WHEN turn % 2 = 0 THEN 'D1' ELSE 'D2-UNRELATED-CWD' END AS er, turn % 5 = 0 AS lost FROM d_claims WHERE kind IN ('test_pass', 'lint_clean') AND turn IS NOT NULL)
 SELECT m.mutant_id, v.verdict AS actual_verdict, coalesce(v.verdict = m.ev AND v.reason_code = m.er, false) AS match, CASE WHEN m.lost THEN 'claim not found' END AS error FROM manifest m LEFT JOIN verdicts v ON v.claim_id = m.mutant_id AND NOT m.lost
""", "claims", "events"))  # fmt: skip
def eval_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = derived(spark, sf_dir, "claims")
    even = F.col("turn") % 2 == 0
    manifest = claims.where("kind in ('test_pass', 'lint_clean') and turn is not null").select(F.col("claim_id").alias("mutant_id"), F.col("session_id").alias("mutant_session_id"), F.col("kind").alias("claim_kind"), F.when(F.col("turn") % 5 == 0, F.col("turn") + 1000).otherwise(F.col("turn")).alias("target_claim_turn"), F.when(even, "contradicted").otherwise("unknown").alias("expected_verdict"), F.when(even, "D1").otherwise("D2-UNRELATED-CWD").alias("expected_reason_code"))
    return evaluation.compare(manifest, claims, evaluate(claims, derived(spark, sf_dir, "events"))).select("mutant_id", "actual_verdict", "match", "error")


# claims of a language model


@query(with_inputs("""
, items AS (SELECT session_id, redacted_input AS t, 0 AS pos, 'scope_respected' AS kind, substring(redacted_input, 1, 6) AS text, 'src/,nothing' AS paths FROM d_reports UNION ALL SELECT session_id, redacted_input, 1, 'task_done', 'not in there', '' FROM d_reports
  UNION ALL SELECT session_id, redacted_input, 2, 'task_done', redacted_input, '' FROM d_reports UNION ALL SELECT session_id, redacted_input, 3, 'scope_respected', redacted_input, '' FROM d_reports)
, ok AS (SELECT session_id, kind, arg_min(text, pos) AS text, arg_min(paths, pos) AS paths FROM items WHERE contains(t, text) GROUP BY session_id, kind)
 SELECT concat(session_id, '#claim-llm#', kind, '#3') AS claim_id, text, CASE WHEN kind = 'scope_respected' AND contains(text, 'src/') THEN 'untouched' END AS scope_subtype FROM ok
""", "reports"))  # fmt: skip
def llm_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    none, no_paths = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    item = lambda k, t, s, p: F.struct(F.lit(k).alias("kind"), t.alias("text"), s.alias("scope_subtype"), p.alias("paths"))
    text = F.col("redacted_input")
    items = F.array(item("scope_respected", F.substring(text, 1, 6), F.lit("untouched"), F.array(F.lit("src/"), F.lit("nothing"))), item("task_done", F.lit("not in there"), none, no_paths), item("task_done", text, none, no_paths), item("scope_respected", text, none, no_paths))
    return grounded(derived(spark, sf_dir, "reports").withColumn("items", items), "fake", "none").select("claim_id", "text", "scope_subtype")



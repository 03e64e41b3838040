"""Inputs of the queries, derived from the synthetic tables by SQL that Spark and DuckDB read alike.

The tables hold no transcripts; sessions, events, claims and texts are made from their rows by case distinctions on ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Events of a user are a session's events.
EVENTS = """
SELECT concat('s', user_id) AS session_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS seq, event_id,
  CASE WHEN event_id % 7 < 5 THEN 'command' WHEN event_id % 7 = 5 THEN 'file_edit' ELSE 'instruction' END AS type,
  CASE WHEN event_id % 7 < 5 THEN CASE event_id % 11 WHEN 0 THEN 'test' WHEN 1 THEN 'test' WHEN 2 THEN 'lint' WHEN 3 THEN 'build' WHEN 4 THEN 'composite' ELSE NULL END END AS command_class,
  event_id % 13 = 0 AS suppressed,
  CASE WHEN event_id % 7 < 6 THEN CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'unknown' WHEN 'click' THEN 'error' ELSE 'ok' END END AS outcome_status,
  CASE WHEN user_id % 4 = 0 THEN CASE event_id % 3 WHEN 0 THEN '/w/a' WHEN 1 THEN '/w/b' ELSE NULL END ELSE '/w/a' END AS cwd,
  CASE WHEN event_id % 7 = 5 THEN concat('/w/a/src/', CASE event_id % 4 WHEN 0 THEN 'core/a.ts' WHEN 1 THEN 'b.tsx' WHEN 2 THEN 'Docs/c.md' ELSE 'deep/er/d.py' END)
       WHEN event_id % 7 = 6 THEN 'please go on' ELSE concat(CASE event_id % 3 WHEN 0 THEN 'npm test' WHEN 1 THEN ' npm  run lint ' ELSE 'preflight --all' END, CASE WHEN event_id % 2 = 0 THEN ' -- one' ELSE '' END) END AS redacted_input
FROM events
"""

#: A claim for each session and kind; paths are joined by commas.
CLAIMS = """
SELECT concat('s', u.user_id) AS session_id, concat('s', u.user_id, '#claim#', k.kind, '#', u.user_id % 40) AS claim_id, k.kind,
  CASE WHEN u.user_id % 17 = 3 THEN NULL ELSE CAST(5 + u.user_id % 40 AS INT) END AS turn,
  CASE u.user_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '/w/a' ELSE '/w/b' END AS cwd,
  CASE WHEN k.kind = 'scope_respected' AND u.user_id % 5 < 4 THEN CASE WHEN u.user_id % 2 = 0 THEN 'untouched' ELSE 'exclusive' END END AS scope_subtype,
  CASE WHEN k.kind = 'scope_respected' AND u.user_id % 5 < 4 THEN CASE u.user_id % 4 WHEN 0 THEN 'src/core/' WHEN 1 THEN 'src/**,docs/*.md' WHEN 2 THEN 'nowhere.ts' ELSE 'b.tsx' END END AS path_list
FROM (SELECT DISTINCT user_id FROM events) u
CROSS JOIN (SELECT 'test_pass' AS kind UNION ALL SELECT 'lint_clean' UNION ALL SELECT 'build_ok' UNION ALL SELECT 'task_done' UNION ALL SELECT 'scope_respected' UNION ALL SELECT 'verification_done') k
"""

#: Uses and results of tools: a user's events, with few ids each.
TOKENS = """
SELECT concat('s', user_id) AS session_id, CAST(event_id AS INT) AS pos, concat('t', event_id % 6) AS tool_id, (event_id * 7 + user_id) % 5 < 3 AS is_use, event_type, props
FROM events
"""

COMMANDS = """
SELECT event_id, concat(
  CASE event_id % 16 WHEN 0 THEN 'npm test' WHEN 1 THEN 'npx vitest run' WHEN 2 THEN 'cd app && npm run lint' WHEN 3 THEN './node_modules/.bin/eslint .' WHEN 4 THEN 'tsc -p . --noEmit' WHEN 5 THEN 'bun run build; npm test'
    WHEN 6 THEN 'echo npm test' WHEN 7 THEN 'grep -r pytest .' WHEN 8 THEN '/usr/bin/pytest -q' WHEN 9 THEN 'preflight' WHEN 10 THEN 'git status | cat' WHEN 11 THEN 'PNPM Test' WHEN 12 THEN 'npm testing' WHEN 13 THEN 'bunx   jest' WHEN 14 THEN 'yarn  test || pnpm lint' ELSE 'vite build' END,
  CASE event_id % 5 WHEN 0 THEN ' || true' WHEN 1 THEN ' ||exit 0' WHEN 2 THEN ' || truex' ELSE '' END) AS command
FROM events
"""

SECRETS = """
SELECT event_id, concat('ran ', CASE event_id % 12
  WHEN 0 THEN 'ls /Users/alice/src and /home/bob.x/y' WHEN 1 THEN 'key sk-abcdefgh1234 here' WHEN 2 THEN 'ghp_ABCDEFGHIJKLMNOPQRSTU and AKIAABCDEFGHIJKL' WHEN 3 THEN 'Authorization: Bearer abc.def-ghi' WHEN 4 THEN 'mail jo@ex.org, x_y@b.co.uk'
  WHEN 5 THEN 'postgres://me:secret@db/x' WHEN 6 THEN 'API_KEY = "a b c" done' WHEN 7 THEN 'password=hunter2;auth_token=zz' WHEN 8 THEN 'cd -Users-carol-work-x' WHEN 9 THEN 'see JIRA-1234' WHEN 10 THEN 'xoxb-12345678901 lin_api_abcdefghij ASIA0123456789AB' ELSE 'nothing at all' END, ' at ', event_id) AS text
FROM events
"""

#: Texts with a user's name, as a word or as part of one.
NAMES = """
SELECT event_id, concat(CASE event_id % 7 WHEN 0 THEN 'ls /srv/bob/x' WHEN 1 THEN 'Bob said' WHEN 2 THEN 'bobby and kebob' WHEN 3 THEN 'a-bob_c' WHEN 4 THEN 'x bob' WHEN 5 THEN '/home/bob/y by BOB.' ELSE 'nobody' END, ' at ', event_id) AS text
FROM events
"""

RESIDUAL = """
SELECT event_id, CASE event_id % 8 WHEN 0 THEN '/Users/alice/x' WHEN 1 THEN '/Users/USER/x' WHEN 2 THEN '/Users/USERS' WHEN 3 THEN 'a-Users-bob-c' WHEN 4 THEN '-Users-USER-c' WHEN 5 THEN 'JIRA-9 and /Users/q' WHEN 6 THEN NULL ELSE 'xJIRA-9' END AS text
FROM events
"""

CLAUSES = """
SELECT event_id, concat(CASE event_id % 9 WHEN 0 THEN 'did not touch a.ts, but changed src/b.ts' WHEN 1 THEN 'src/x/** は変更可、lib/y.py は変更しない。以上' WHEN 2 THEN 'one; two;three' WHEN 3 THEN 'However, .env.local stays' WHEN 4 THEN 'old.ts. new.ts'
  WHEN 5 THEN '日本a.tsは docs/* を' WHEN 6 THEN '' WHEN 7 THEN 'a/b-c/d.test.ts however e_f.g' ELSE 'plain words only' END, CASE WHEN event_id % 2 = 0 THEN concat('; f', event_id % 10, '.md') ELSE '' END) AS text
FROM events
"""

REPORTS = """
SELECT concat('r', o_orderkey) AS session_id, 3 AS seq, '/w' AS cwd, concat(CASE o_orderkey % 23 WHEN 0 THEN 'All tests passed.' WHEN 1 THEN 'The tests did not pass; all tests pass now in the whole suite of the project' WHEN 2 THEN 'テストは全て通過しました。' WHEN 3 THEN '12 specs passed and lint is clean'
  WHEN 4 THEN 'eslint: no errors' WHEN 5 THEN 'Build succeeded, task complete' WHEN 6 THEN 'typecheck passed' WHEN 7 THEN 'I have not touched src/secret/a.ts; only changed lib/b.ts' WHEN 8 THEN 'only changed the docs' WHEN 9 THEN '実装しました' WHEN 10 THEN 'まだ完了していない'
  WHEN 11 THEN 'PR merged' WHEN 12 THEN 'not merged' WHEN 13 THEN 'spot: verified: 3/4 records' WHEN 14 THEN 'スポットチェック済み' WHEN 15 THEN 'record の内容が一致' WHEN 16 THEN 'fix is done, mail a@b.org' WHEN 17 THEN 'ビルド成功。リント クリーン' WHEN 18 THEN '.serena/p.yml は変更していない' WHEN 19 THEN 'The test suite passes except one'
  WHEN 20 THEN 'お疲れ様でした' WHEN 21 THEN 'Feature complete. tests now passing' ELSE 'nothing to say' END, ' (', o_orderkey % 7, ')') AS redacted_input
FROM orders
"""

INSTRUCTIONS = """
SELECT concat('i', o_custkey) AS session_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS seq, concat(CASE o_orderkey % 11 WHEN 0 THEN 'run the tests and fix lint' WHEN 1 THEN 'テストを通して、ビルドを通すこと' WHEN 2 THEN 'do not touch src/a.ts; edit b.ts' WHEN 3 THEN 'config/x.yml は変更しない。他は自由'
  WHEN 4 THEN 'scope: src/foo/** and docs/x.md' WHEN 5 THEN 'assigned: lib/y.py' WHEN 6 THEN '担当: app/z.ts' WHEN 7 THEN 'run the preflight, run preflight' WHEN 8 THEN 'Do not edit anything' WHEN 9 THEN 'pass the typecheck however long' ELSE 'hello' END, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE '; thanks' END) AS redacted_input
FROM orders
"""

LINES = """
SELECT concat('/t/p', user_id % 9, '/f', user_id, '.jsonl') AS file, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS line, event_id, user_id,
  CASE event_id % 12 WHEN 0 THEN 'not json' WHEN 1 THEN '  ' WHEN 2 THEN '[1]' WHEN 3 THEN '{"type":"other"}' WHEN 4 THEN '{"type":"assistant"} x' WHEN 5 THEN '{"type":"system","sessionId":""}'
    WHEN 6 THEN concat('{"type":"user","sessionId":"c', user_id, '","message":{"content":[{"type":"tool_result","tool_use_id":"t', event_id % 5, '","content":"Exit code 3"},{"type":"image"},7]}}')
    WHEN 7 THEN concat('{"type":"assistant","version":"1.', event_id % 4, '","message":{"content":[{"type":"tool_use","id":"t', event_id % 5, '","name":"Bash","input":{"command":"ls"}},{"type":"tool_use","id":"x","name":"Read"},{"type":"thinking"}]}}')
    WHEN 8 THEN '{"type":"user","message":{"content":5}}' WHEN 9 THEN '{"type":"user","message":{"content":null}}' WHEN 10 THEN '{"type":"attachment","version":""}' ELSE concat('{"type":"user","sessionId":"d', event_id, '","message":{"content":"hello ', event_id, '"}}') END AS raw
FROM events
"""

SESSIONS = """
SELECT concat('s', user_id) AS id, concat('/Users/USER/p', user_id % 6, '/s', user_id, '.jsonl') AS source_path, min(CAST(ts AS DATE)) AS ingested_at FROM events GROUP BY user_id
"""

FILES = """
SELECT DISTINCT CASE WHEN user_id % 3 = 0 THEN concat('/Users/alice/p', user_id % 6, '/s', user_id, '.jsonl') ELSE concat('/masked/s', user_id, '.jsonl') END AS path FROM events WHERE user_id % 5 < 4
"""

INPUTS = {"events": EVENTS, "claims": CLAIMS, "tokens": TOKENS, "commands": COMMANDS, "secrets": SECRETS, "names": NAMES, "residual": RESIDUAL, "clauses": CLAUSES, "reports": REPORTS, "instructions": INSTRUCTIONS, "lines": LINES, "sessions": SESSIONS, "files": FILES}


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input in Spark, read from the table that it is made of."""
    source = "orders" if name in ("reports", "instructions") else "events"
    sql = INPUTS[name].replace("{", "{{").replace("}", "}}").replace(f"FROM {source}", f"FROM {{{source}}}")
    out = spark.sql(sql, **{source: spark.read.parquet(f"{sf_dir}/{source}.parquet")})
    if name == "claims":
        none = F.lit(None).cast("string")
        out = out.select("claim_id", "session_id", F.lit("").alias("text"), "kind", "turn", "cwd", "scope_subtype", F.split("path_list", ",").alias("paths"), F.lit("rules").alias("extractor_backend"), none.alias("extractor_model"), none.alias("extractor_prompt_version"))
    if name == "events":
        out = out.withColumns({"evidence_tool_use_source_line": 2 * F.col("seq") + 1, "evidence_tool_result_source_line": F.when(F.col("outcome_status") != "unknown", 2 * F.col("seq") + 2), "evidence_tool_use_id": F.concat(F.lit("t"), F.col("event_id").cast("string")), "tool": F.lit(None).cast("string"), "outcome_exit_code": F.lit(None).cast("int"), "ts": F.lit(None).cast("string")})
    return out


def with_inputs(sql: str, *names: str) -> str:
    """DuckDB SQL with the inputs as d_<name>."""
    return "WITH " + ", ".join(f"d_{n} AS ({INPUTS[n].strip()})" for n in names) + sql

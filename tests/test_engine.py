"""The engine from transcripts to verdicts, on transcripts written here."""

import hashlib
import json
import os
import random
import sys

import pytest
from pyspark.sql import functions as F

from proofline.functions.dictionaries import Redaction
from proofline.operators.adapter import adapt
from proofline.operators.claims import RuleClaims
from proofline.operators.contract import RuleContract
from proofline.operators.extractors import BackendClaims, BackendError, json_of, valid_items
from proofline.operators.pairing import paired
from proofline.operators.verdicts import evaluate
from proofline.plans import audit, evaluate as evaluation, export, mutate, reports
from proofline.schemas import EVIDENCE
from proofline.scratch import cut
from proofline.sources import files
from proofline.sources.store import Store, StoreError
from proofline.sources.transcripts import is_json, lines, parse, read_files


def use(tool_id, command, name="Bash", cwd="/Users/bob/p", **more):
    given = {"command": command} if name == "Bash" else {"file_path": command}
    return {"type": "assistant", "sessionId": "s1", "version": "1.2", "cwd": cwd, "timestamp": "t", "message": {"content": [{"type": "tool_use", "id": tool_id, "name": name, "input": given}]}, **more}


def result(tool_id, text="ok", **more):
    return {"type": "user", "sessionId": "s1", "cwd": "/Users/bob/p", "message": {"content": [{"type": "tool_result", "tool_use_id": tool_id, "content": text, **more}]}}


def say(text, speaker="assistant", **more):
    return {"type": speaker, "sessionId": "s1", "cwd": "/Users/bob/p", "message": {"content": [{"type": "text", "text": text}]}, **more}


SESSION = [
    say("Run the tests. Do not touch src/secret.ts", "user"), use("a", "npm test"), result("a", "Exit code 1\nno", is_error=True), "not json", "", {"type": "summary"}, [1],
    use("b", "/Users/bob/p/src/x.ts", "Edit"), use("c", "npm test"), result("c"), result("zzz"), result("b", [{"type": "text", "text": "Exit code 7"}]), use("d", "ls"),
    {"type": "assistant", "message": {"content": [{"type": "tool_use", "id": "e", "name": "Read"}, {"type": "thinking"}, 5]}}, say("Did not touch src/secret.ts in any way at all. All tests passed. Task complete."),
]


@pytest.fixture(scope="module")
def flow(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("in") / "proj"
    folder.mkdir()
    text = "\n".join(x if isinstance(x, str) else json.dumps(x) for x in SESSION) + "\n"
    (folder / "s1.jsonl").write_text(text)
    (folder / "other.jsonl").write_text("\r\n".join(json.dumps(x | {"sessionId": ""}) for x in (say("hello", "user"), say("nothing"))))
    parsed = parse(lines(read_files(spark, f"{folder}/*.jsonl"))).persist()
    sessions, events = adapt(parsed)
    return str(folder), cut(sessions), cut(events)


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_adapter(flow):
    _, sessions, events = flow
    s1 = events.where("session_id = 's1'").orderBy("seq")
    assert rows(s1, "seq", "type", "command_class", "outcome_status", "outcome_exit_code", "evidence_tool_use_source_line", "evidence_tool_result_source_line") == [
        (0, "instruction", None, None, None, 1, None), (1, "command", "test", "error", 1, 2, 3), (2, "command", "test", "ok", None, 9, 10), (3, "file_edit", None, "ok", 7, 8, 12), (4, "command", None, "unknown", None, 13, None), (5, "report", None, None, None, 15, None),
    ]
    assert {r.cwd for r in s1.collect()} == {"/Users/USER/p"}
    assert rows(sessions.orderBy("id"), "id", "agent_version", "project", "total_lines", "skipped_lines", "parse_error_lines", "unknown_type_lines", "unsupported_tool_count", "unmatched_result_count", "invalid_block_count", "mismatch") == [
        ("other", "unknown", "proj", 2, 0, 0, 0, 0, 0, 0, False), ("s1", "1.2", "proj", 14, 3, 1, 2, 1, 1, 1, False),
    ]


def test_strict_json():
    good, bad = ['{"a":1}', " [1] ", '{"a":1,"a":2}', "null"], ["", "{'a':1}", '{"a":1} x', "NaN", "[1,]", '{"a":Infinity}', '"\n"']
    assert all(map(is_json, good)) and not any(map(is_json, bad))


def test_pairing_against_a_map(spark):
    rng = random.Random(5)
    tokens = [(g, i, f"t{rng.randint(0, 2)}", rng.random() < 0.55) for g in range(40) for i in range(rng.randint(0, 14))]
    pairs, orphans = [], []
    for g in range(40):
        open_uses = {}
        for _, i, tool, is_use in [t for t in tokens if t[0] == g]:
            if is_use:
                open_uses[tool] = (open_uses[tool][0] if tool in open_uses else i, i)
            elif tool in open_uses:
                pairs.append((g, open_uses.pop(tool)[1], i))
        orphans += [(g, *v) for v in open_uses.values()]
    found = paired(spark.createDataFrame(tokens, "g int, i int, tool string, is_use boolean"), ["g", "tool"], ["i"]).persist()
    assert sorted(rows(found.where("use is not null"), "g", "use.i", "i")) == sorted(pairs)
    assert sorted(rows(found.where("orphan"), "g", "place.i", "i")) == sorted(orphans)


def test_claims_contract_and_verdicts(flow):
    _, _, events = flow
    claims, verdicts, contracts = audit.audit(events)
    judged = claims.join(verdicts, ["session_id", "claim_id"]).orderBy("kind")
    assert rows(judged, "kind", "verdict", "reason_code", "evidence_refs", "scope_subtype", "paths") == [
        ("scope_respected", "unknown", "D3-LIMITED", [], "untouched", ["src/secret.ts"]), ("task_done", "unknown", "NOT-PROVABLE", [], None, None), ("test_pass", "proven", "D1", [1, 2], None, None),
    ]
    contract = {r.session_id: r.contract for r in contracts.collect()}["s1"]
    assert [(o.id, o.kind) for o in contract.obligations] == [("obligation-0", "test")]
    assert [(p.id, p.paths) for p in contract.prohibitions] == [("prohibition-0", ["src/secret.ts"])]


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("All tests passed", {"test_pass"}), ("the tests did not pass", set()), ("テストは全て通過しました", {"test_pass"}), ("lint is clean", {"lint_clean"}), ("lint: no errors", set()), ("build succeeded", {"build_ok"}),
        ("only changed src/a.ts", {"scope_respected"}), ("作業完了後に連絡", set()), ("作業完了。", {"task_done"}), ("マージ予定", set()), ("ログmergedした", {"task_done"}), ("verified: 3/4", {"verification_done"}), ("スポットチェック", {"verification_done"}), ("", set()),
    ],
)
def test_claim_rules(spark, text, kinds):
    report = spark.createDataFrame([("s", 4, text, None)], "session_id string, seq int, redacted_input string, cwd string")
    assert {r.kind for r in RuleClaims().extract(report).collect()} == kinds


def sequential(claim, events):
    """The verdict of one claim by going through the events in order."""
    _, kind, turn, cwd, subtype, paths = claim
    if turn is None:
        return "unknown", "NO-ANCHOR", []
    if kind == "verification_done":
        return "unknown", "NOT-PROVABLE", []

    def status(check):
        mine = [e for e in events if e[3] in EVIDENCE[check] and not e[4] and e[1] < turn]
        if not mine:
            return "none", []
        if cwd is not None:
            mine = [e for e in mine if e[6] == cwd]
            if not mine:
                return "cwd", []
        elif len({e[6] for e in mine}) > 1:
            return "cwd", []
        pending = set()
        for e in mine:
            if e[5] == "error":
                pending.add(e[7])
            elif e[5] == "ok":
                pending = set() if e[3] == "composite" else pending - {e[7]}
        last, refs = mine[-1], [e[1] for e in mine]
        if last[5] == "error":
            return ("composite" if last[3] == "composite" else "failure"), refs
        return ("partial" if pending else "success" if last[5] == "ok" else "unknown"), refs

    if kind == "task_done":
        refs = []
        for check in EVIDENCE:
            found, r = status(check)
            refs += [x for x in r if x not in refs] if found in ("failure", "composite") else []
        return ("contradicted", "D2", refs) if refs else ("unknown", "NOT-PROVABLE", [])
    found, refs = status(kind)
    table = {"none": ("contradicted", "D1"), "cwd": ("unknown", "D2-UNRELATED-CWD"), "success": ("proven", "D1"), "failure": ("contradicted", "D2"), "composite": ("unknown", "D2-COMPOSITE-AMBIGUOUS"), "partial": ("unknown", "D2-PARTIAL-RERUN"), "unknown": ("unknown", "D1-UNVERIFIED")}
    return (*table[found], refs)


def test_verdicts_against_a_sequential_model(spark):
    rng = random.Random(11)
    events, claims = [], []
    for s in range(60):
        for seq in range(rng.randint(0, 9)):
            events.append((f"s{s}", seq, "command", rng.choice(["test", "lint", "build", "composite", None]), rng.random() < 0.1, rng.choice(["ok", "error", "unknown"]), rng.choice(["/a", "/a", None, "/b"]) if s % 3 else "/a", rng.choice(["x", "y"])))
        claims += [(f"s{s}", kind, rng.choice([None, 3, 6, 9, 9, 9]), rng.choice([None, "/a", "/b"]), None, None) for kind in (*EVIDENCE, "task_done", "verification_done")]
    event_rows = spark.createDataFrame(events, "session_id string, seq int, type string, command_class string, suppressed boolean, outcome_status string, cwd string, redacted_input string")
    claim_rows = spark.createDataFrame([(f"{c[0]}#{c[1]}", *c) for c in claims], "claim_id string, session_id string, kind string, turn int, cwd string, scope_subtype string, paths array<string>")
    got = {r.claim_id: (r.verdict, r.reason_code, r.evidence_refs) for r in evaluate(claim_rows, event_rows).collect()}
    assert len(got) == len(claims)
    for c in claims:
        assert got[f"{c[0]}#{c[1]}"] == sequential(c, [e for e in events if e[0] == c[0]]), c


def test_scope_verdicts(spark):
    events = spark.createDataFrame([("s", 0, "file_edit", None, False, "ok", "/w", "/w/src/a.ts"), ("s", 1, "file_edit", None, False, "ok", "/w", "/w/lib/b.ts")], "session_id string, seq int, type string, command_class string, suppressed boolean, outcome_status string, cwd string, redacted_input string")
    cases = [("untouched", ["src/"], ("contradicted", "D3", [0])), ("untouched", ["doc/**"], ("unknown", "D3-LIMITED", [])), ("exclusive", ["src/**"], ("contradicted", "D3", [1])), ("exclusive", ["a.ts", "lib/*"], ("unknown", "D3-LIMITED", [])), (None, None, ("unknown", "D3-AMBIGUOUS", []))]
    claims = spark.createDataFrame([(str(i), "s", "scope_respected", 5, None, c[0], c[1]) for i, c in enumerate(cases)], "claim_id string, session_id string, kind string, turn int, cwd string, scope_subtype string, paths array<string>")
    assert [r[1:] for r in sorted(rows(evaluate(claims, events), "claim_id", "verdict", "reason_code", "evidence_refs"))] == [c[2] for c in cases]


def test_contract_scope(spark):
    said = spark.createDataFrame([("s", 1, "scope: b/x.ts a.ts"), ("s", 0, "担当: a.ts です"), ("t", 0, "fix the lint, run the preflight")], "session_id string, seq int, redacted_input string")
    got = {r.session_id: r.contract for r in RuleContract().extract(said).collect()}
    assert got["s"].scope_paths == ["a.ts", "b/x.ts"] and [o.kind for o in got["t"].obligations] == ["lint", "behavior"] and got["t"].prohibitions == []


def test_store(spark, flow, tmp_path):
    folder, sessions, events = flow
    store = Store(spark, str(tmp_path / "db"), buckets=4)
    assert store.read("events").count() == 0
    store.upsert(sessions, events)
    claims, verdicts, _ = audit.audit_store(store)
    assert store.read("verdicts", "s1").count() == 3 and store.read("events", "other").count() == 2
    assert [(r.id, r.event_count, r.error_count) for r in store.summary().orderBy("id").collect()] == [("other", 2, 0), ("s1", 6, 1)]
    moved = sessions.where("id = 's1'").withColumn("source_path", F.lit("/elsewhere"))
    with pytest.raises(StoreError):
        store.upsert(moved, events.where("session_id = 's1'"))
    store.upsert(moved, events.where("session_id = 's1' and seq < 2"), force=True)
    assert store.read("events", "s1").count() == 2 and store.read("claims", "s1").count() == 0 and store.read("events", "other").count() == 2
    with pytest.raises(StoreError):
        store.upsert(sessions, events.withColumn("redacted_input", F.lit("/Users/bob")), force=True)
    with pytest.raises(StoreError):
        store.upsert(sessions.where("id = 's1'"), events, force=True)
    with pytest.raises(StoreError):
        store.save_audit(claims.limit(0), spark.createDataFrame([("s1", "gone", "proven", "D1", [1])], verdicts.schema), sessions.selectExpr("id as session_id"))
    assert Store(spark, str(tmp_path / "db")).buckets == 4
    spark.createDataFrame([('{"version": 5, "buckets": 4}',)], "value string").write.text(str(tmp_path / "old" / "_meta"))
    with pytest.raises(StoreError):
        Store(spark, str(tmp_path / "old"))


def test_reports(flow):
    _, sessions, events = flow
    claims, verdicts, contracts = audit.audit(events)
    ids = sessions.selectExpr("id as session_id")
    bundles = reports.bundle(ids, claims, verdicts, events, contracts).persist()
    text = {r.session_id: r.markdown for r in reports.as_markdown(bundles).collect()}
    assert "proven: 1 / contradicted: 0 / unknown: 2" in text["s1"] and "seq=2 (use line 9 / result line 10) command(test): npm test" in text["s1"] and "no claims extracted" in text["other"]
    data = json.loads({r.session_id: r.json for r in reports.as_json(bundles).collect()}["s1"])
    assert len(data["claims"]) == len(data["verdicts"]) == 3 and data["contract"]["obligations"][0]["kind"] == "test"
    page = {r.session_id: r.html for r in reports.as_html(bundles).collect()}["s1"]
    assert page.count("</script>") == 1
    totals = reports.totals(claims, verdicts, ids)
    assert sorted(rows(totals, F.coalesce("session_id", F.lit("")), "claims", "proven")) == [("", 3, 1), ("other", 0, 0), ("s1", 3, 1)]
    assert "2 session(s) claims=3 proven=1" in reports.index_page(totals).first().html
    assert rows(reports.run_totals(claims, ids), "sessions", "claims", "sessions_without_claims") == [(2, 3, 1)]


def test_export(spark, tmp_path):
    raw = spark.createDataFrame([("s", 1, '{"a":"/Users/bob/x"}'), ("s", 2, ""), ("s", 3, '{"a":"token=1"}'), ("s", 4, "broken"), ("t", 1, "é"), ("t", 2, "")], "session_id string, line int, raw string")
    done, manifest, problems = export.export(raw)
    assert manifest.where("session_id = 's'").first().broken_lines[0].line == 3 and manifest.where("session_id = 's'").first().redaction_count == 2
    assert export.write(done, manifest, problems, str(tmp_path / "no")) == ["s:3: redaction produced invalid JSON"] and not (tmp_path / "no").exists()
    done, manifest, problems = export.export(raw.where("line <> 3"))
    sources = spark.createDataFrame([("s", "/Users/bob/s.jsonl", None), ("t", "/Users/bob/t.jsonl", None), ("u", None, "gone")], "session_id string, path string, reason string")
    assert export.write(done, manifest, problems, str(tmp_path / "yes"), sources) == []
    assert (tmp_path / "yes/s.jsonl").read_bytes() == b'{"a":"/Users/USER/x"}\n\nbroken' and (tmp_path / "yes/t.jsonl").read_text("utf-8") == "é\n"
    entries = json.loads((tmp_path / "yes/manifest.json").read_text("utf-8"))
    assert [e["session_id"] for e in entries] == ["s", "t", "u"] and entries[2] == {"session_id": "u", "exported": False, "reason": "gone"}
    for e in entries[:2]:
        assert e["exported"] and e["sha256"] == hashlib.sha256((tmp_path / f"yes/{e['session_id']}.jsonl").read_bytes()).hexdigest()
    assert list(entries[0]) == ["session_id", "exported", "source_path", "line_count", "redaction_count", "sha256", "broken_lines", "exported_at"] and entries[0]["source_path"] == "/Users/USER/s.jsonl"
    assert sorted(p.name for p in (tmp_path / "yes").iterdir() if not p.name.startswith(".")) == ["manifest.json", "s.jsonl", "t.jsonl"]
    hidden = export.export(spark.createDataFrame([("s", 1, "xbobx")], "session_id string, line int, raw string"), Redaction(user="bob"))[2]
    assert rows(hidden, "problem") == [("os-username:bob",)]


def test_physical_lines(spark, tmp_path):
    contents = {"a": "", "b": "\n", "c": "x\r\ny\rz\n\nlast", "d": "\n".join("é" * (i % 7) for i in range(5000)) + "\n", "e": "w" * 3_000_000 + "\nv"}
    for name, text in contents.items():
        (tmp_path / name).write_bytes(text.encode())
    paths = spark.createDataFrame([(str(tmp_path / n),) for n in contents] + [(str(tmp_path),), (str(tmp_path / "none"),), (None,)], "path string")
    there = files.existing(paths)
    assert sorted(r.path[-1] for r in there.collect()) == list(contents)
    got = {}
    for r in files.physical_lines(there).collect():
        got.setdefault(r.path[-1], {})[r.line] = r.raw
    assert {n: "\n".join(x[i + 1] for i in range(len(x))) for n, x in got.items()} == contents
    c = sorted(files.physical_lines(there.where("path like '%/c'"), returns=True).collect(), key=lambda r: r.line)
    assert [r.raw for r in c] == ["x", "y", "z", "", "last"]


SMALL = (say("go", "user"), use("a", "npm test"), result("a"), say("All tests passed."))


def as_lines(objects):
    return "\n".join(json.dumps(x, separators=(",", ":")) for x in objects)


def test_mutation_and_evaluation(spark, tmp_path):
    (tmp_path / "s1.jsonl").write_text(as_lines(SMALL))
    physical = files.physical_lines(spark.createDataFrame([(str(tmp_path / "s1.jsonl"),)], "path string")).withColumnRenamed("path", "file")
    made, manifest, skipped = mutate.generate(physical)
    manifest = manifest.persist()
    assert sorted(rows(manifest, "operator", "claim_kind")) == [("M1", "test_pass"), ("M2", "test_pass"), ("M3", "lint_clean"), ("M5", "lint_clean"), ("M6", "test_pass"), ("M7", "build_ok"), ("M7", "lint_clean")]
    assert skipped.count() == 0
    results = evaluation.evaluate(made, manifest).persist()
    assert evaluation.mismatches(results).collect() == [] and evaluation.passed(results)
    assert "- match: 7/7 (100.0%)" in evaluation.report(results).first().markdown
    assert rows(mutate.per_operator(manifest).where("not short"), "operator") == []
    mutate.write(made, manifest, str(tmp_path / "out"))
    entries = json.loads((tmp_path / "out/manifest.json").read_text("utf-8"))
    assert [e["mutant_id"] for e in entries] == ["M1-s1-test_pass", "M2-s1-test_pass", "M3-s1-lint_clean", "M5-s1-lint_clean", "M6-s1-test_pass", "M7-s1-build_ok", "M7-s1-lint_clean"]
    sixth = entries[4]
    assert sixth["target_lines"] == [2, 4] and sixth["mutant_file"] == "M6/s1-test_pass.jsonl" and sixth["mutant_session_id"] == "mut-m6-s1-test_pass" and sixth["notes"]
    text = (tmp_path / "out/M6/s1-test_pass.jsonl").read_text("utf-8").split("\n")
    assert len(text) == 5 and "npm test || true" in text[1] and '"sessionId":"mut-m6-s1-test_pass"' in text[3]
    again, listed = evaluation.read_mutants(spark, str(tmp_path / "out"))
    assert evaluation.passed(evaluation.evaluate(again, listed)) and listed.count() == 7


def test_command_line(spark, tmp_path, capsys):
    from proofline.__main__ import _arguments, main

    (tmp_path / "in").mkdir()
    (tmp_path / "in/s1.jsonl").write_text(as_lines(SMALL) + "\n")
    (tmp_path / "in/s2.jsonl").write_text(as_lines([say("hi carol", "user") | {"sessionId": "s2"}]))
    (tmp_path / "in/copy.jsonl").write_text(as_lines([say("x", "user") | {"sessionId": "s3"}]))
    (tmp_path / "in/copy2.jsonl").write_text(as_lines([say("y", "user") | {"sessionId": "s3"}]))
    db, corpus, out = (str(tmp_path / n) for n in ("db", "corpus", "mutants"))
    call = lambda command, *more: main(["--user", "carol", command, *more, "--db", db])
    assert call("ingest", str(tmp_path / "in/*.jsonl"), str(tmp_path / "in/none.jsonl")) == 1  # the others are stored
    shown = capsys.readouterr()
    assert "session s1, 4 lines" in shown.out and "stored 2, failed 3" in shown.out and "no such file" in shown.err and "several files" in shown.err
    assert call("export-corpus", "--out", corpus) == 0
    assert (tmp_path / "corpus/s1.jsonl").read_text() == as_lines(SMALL).replace("/bob", "/USER") + "\n" and "hi USER" in (tmp_path / "corpus/s2.jsonl").read_text()
    (tmp_path / "in/s1.jsonl").unlink()  # mutation takes the masked copy
    assert call("mutate", "--out", out, "--anonymized-dir", corpus) == 0
    assert "7 mutants, 0 skipped" in capsys.readouterr().out
    assert call("eval", "--mutations", out) == 0 and "- match: 7/7" in capsys.readouterr().out
    assert _arguments(["sessions"]).user and _arguments(["--user", "", "sessions"]).user == ""
    with pytest.raises(SystemExit):
        main(["audit", "--all", "--extractor", "llm", "--llm-backend", "anthropic", "--db", db]) if not os.environ.get("ANTHROPIC_API_KEY") else sys.exit()


def test_rewriting_keeps_keys():
    raw = '{"z":1,"message":{"content":"é"},"a":2}'
    assert mutate.rewritten(raw, "say", "x") == '{"z":1,"message":{"content":"é' + mutate.SEPARATOR.replace("\n", "\\n") + 'x"},"a":2}'
    assert mutate.rewritten(raw, "fail", "t") is None and mutate.rewritten("no", "say", "x") is None


def test_backend_claims(spark):
    reports_ = spark.createDataFrame([("s", 3, "Did not touch src/a.ts. All good.", "/w"), ("t", 1, "bad", None)], "session_id string, seq int, redacted_input string, cwd string")

    def call(prompt):
        if "bad" in prompt.split("<report>")[1]:
            return {"claims": [{"kind": "nonsense", "text": "bad"}]}
        item = {"kind": "scope_respected", "text": "Did not touch src/a.ts", "scope_subtype": "untouched", "paths": ["src/a.ts", "made/up"]}
        return {"claims": [{"kind": "task_done", "text": "invented"}, item, {"kind": "scope_respected", "text": "All good."}, {"kind": "task_done", "text": "All good."}]}

    found = BackendClaims(call, "fake", "m").extract(reports_).orderBy("kind")
    assert rows(found, "claim_id", "text", "scope_subtype", "paths") == [("s#claim-llm#scope_respected#3", "Did not touch src/a.ts", "untouched", ["src/a.ts"]), ("s#claim-llm#task_done#3", "All good.", None, None)]

    def broken(_):
        raise RuntimeError("no key")

    with pytest.raises(Exception, match="extractor"):
        BackendClaims(broken).extract(reports_).collect()
    assert json_of('x ```json\n{"a":1}\n```') == {"a": 1} and valid_items({"claims": 3}) is None and issubclass(BackendError, RuntimeError)


def test_streaming(spark, flow, tmp_path):
    from proofline.streaming.ingest import follow

    store = Store(spark, str(tmp_path / "db"), buckets=2)
    follow(store, flow[0], str(tmp_path / "ck"), once=True).awaitTermination()
    assert store.read("events").count() == 8 and store.read("verdicts").count() == 3

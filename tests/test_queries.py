"""The queries over the smallest tables, against DuckDB where SQL gives the same rows."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from proofline.plans.derived import derived

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
NAMES = ["verdict_all", "evidence_lines", "tool_pairing", "orphan_uses", "claim_scope", "claim_context", "contract_obligations", "redact_chain", "mutate_plan", "session_id_resolution", "classify_command"]


def shown(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(round(r[i], 9)) if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_against_duckdb(spark, name):
    db = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    got = entry.queries()[name](spark, DATA)
    cursor = db.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(got.columns) == sorted(columns)
    assert shown([tuple(r) for r in got.collect()], got.columns) == shown(cursor.fetchall(), columns)


def test_mutants_of_whole_sessions(spark):
    data = DATA.replace("0.001", "0.01")  # sessions longer than 22 events
    events = derived(spark, data, "events").where("type = 'command' and not suppressed").select("session_id", "command_class").distinct().collect()
    ran = {(s, c) for s, c in events if int(s[1:]) % 4}
    kinds = {"test_pass": "test", "lint_clean": "lint", "build_ok": "build"}
    unfounded = lambda name: [r for r in entry.queries()[name](spark, data).where("operator = 'M7'").collect() if ran & {(r.session_id, kinds[r.kind]), (r.session_id, "composite")}]
    assert unfounded("mutate_plan") and not unfounded("mutate_whole_plan")
    test_against_duckdb(spark, "mutate_whole_plan")


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from proofline.functions.clauses import path_tokens, split_clauses
from proofline.functions.commands import command_class, normalized, suppressed
from proofline.functions.dictionaries import Redaction, load_redactions, merged
from proofline.functions.markup import escape_html, script_safe
from proofline.functions.patterns import js, match_spans, matches_any
from proofline.functions.redact import redact, redact_with_count, residual_secrets, unmask

ME = Redaction(user="alice")


def texts(spark, *rows):
    return spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string").orderBy("i")


def values(df, column):
    return [r[0] for r in df.select(column).collect()]


def test_classes(spark):
    cases = {
        "npm test": "test", "npx  vitest run": "test", "NPM run TEST": "test", "npm testing": None, "npm run lint": "lint", "tsc -p . --noEmit": "build", "tsc -p .": None, "preflight": "composite",
        "cd x && npm test": "test", "npm test && npm run lint": "composite", "echo npm test": None, "rg vitest .": None, "/usr/bin/pytest -q": "test", "./node_modules/.bin/eslint .": "lint", "/bin/echo x": None,
        "cd a\nnpm test\nls": "test", "ls/": None, "": None, "git log | cat": None, "vite build; yarn test": "composite",
    }
    got = values(texts(spark, *cases), command_class(F.col("t")))
    assert dict(zip(cases, got, strict=True)) == cases


def test_suppressed_even_without_class(spark):
    cases = {"npm test || true": True, "ls ||exit 0": True, "x || truex": False, "x | true": False, "a || exit 01": False}
    assert values(texts(spark, *cases), suppressed(F.col("t"))) == list(cases.values())


def test_normalized(spark):
    assert values(texts(spark, "  a \t b\n c ", None), normalized(F.col("t"))) == ["a b c", ""]


def test_redaction_rules_and_counts(spark):
    cases = [
        ("/Users/bob/x /home/eve/y", "/Users/USER/x /home/USER/y", 2), ("-Users-bob-work-", "-Users-USER-work-", 1), ("sk-abcdefgh12", "[REDACTED_KEY]", 1), ("github_pat_ABCDEFGHIJKLMNOPQRST", "[REDACTED_KEY]", 1),
        ("gho_ABCDEFGHIJKLMNOPQRST AKIAABCDEFGHIJKL", "[REDACTED_KEY] [REDACTED_KEY]", 2), ("Bearer ab.c-d", "Bearer [REDACTED_KEY]", 1), ("to a.b@c.org now", "to [REDACTED_EMAIL] now", 1),
        ("pg://u:pw@h/d", "pg://u:[REDACTED_VALUE]@h/d", 1), ("api_key = 'x y' z", "api_key=[REDACTED_VALUE] z", 1), ("PASSWORD=1", "PASSWORD=[REDACTED_VALUE]", 1), ("alice and malice, ALICE_x", "USER and malice, USER_x", 2),
        ("a\\nalice", "a\\nUSER", 1), ("JIRA-12", "TICKET-N", 1), ("-----BEGIN RSA PRIVATE KEY-----\nab\ncd\n-----END RSA PRIVATE KEY-----!", "[REDACTED_PEM_KEY]!", 1), ("OPENAI_API_KEY=sk-abcdefgh12", "OPENAI_API_KEY=[REDACTED_VALUE]", 2), ("plain", "plain", 0),
    ]
    df = redact_with_count(texts(spark, *[c[0] for c in cases]), "t", "out", "n", ME)
    assert [(r.out, r.n) for r in df.orderBy("i").collect()] == [(c[1], c[2]) for c in cases]
    again = df.select("i", redact(F.col("out"), ME).alias("t")).orderBy("i")
    assert values(again, "t") == [c[1] for c in cases]


def test_residual_secrets(spark):
    found = values(texts(spark, "/Users/USER/x", "/Users/bob", "/Users/USERS", "-Users-USER-", "-Users-bob-", "xalicey JIRA-1", None, "/home/bob"), residual_secrets(F.col("t"), ME))
    assert found == [[], ["unmasked-Users-path"], ["unmasked-Users-path"], [], ["unmasked-encoded-Users-path"], ["os-username:alice", r"dictionary-pattern:\bJIRA-\d+\b"], [], []]


def test_unmask(spark):
    assert values(texts(spark, "/Users/USER/-Users-USER-x"), unmask(F.col("t"), "bob")) == ["/Users/bob/-Users-bob-x"]


def test_dictionaries(tmp_path):
    good = tmp_path / "d.json"
    good.write_text('[{"pattern": "ACME", "replacement": "X"}]')
    assert merged(load_redactions(good), [("ACME", "Y"), ("b", "c")]) == [("ACME", "X"), ("b", "c")]
    bad = tmp_path / "bad.json"
    bad.write_text('{"pattern": 1}')
    with pytest.raises(ValueError):
        load_redactions(bad)


def test_clauses_and_paths(spark):
    rows = ["a.tsは変更可、b/c.ts は変更しない。", "did not touch a.ts, but changed b.ts", "one; However, two", "", "日本a.tsは .serena/p.yml"]
    found = values(texts(spark, *rows), F.transform(split_clauses(F.col("t")), lambda c: c["text"]))
    assert found == [["a.tsは変更可", "b/c.ts は変更しない", ""], ["did not touch a.ts", " changed b.ts"], ["one", "", "two"], [""], ["日本a.tsは .serena/p.yml"]]
    spans = values(texts(spark, "𝒳a;b"), split_clauses(F.col("t")))[0]
    assert [(c.start, c.end) for c in spans] == [(0, 2), (3, 4)]
    assert values(texts(spark, "src/foo/** and old.ts. a-b/c.d.ts old.ts", rows[4]), path_tokens(F.col("t"))) == [["src/foo/**", "old.ts", "a-b/c.d.ts"], ["a.ts", ".serena/p.yml"]]


def test_globs(spark):
    rows = [("/w/src/a.ts", "src/a.ts", True), ("/w/src/a.ts.bak", "src/a.ts", False), ("/w/xsrc/a.ts", "src/a.ts", False), ("src/x/y/z.ts", "src/**", True), ("src/x/y.ts", "src/*", False), ("A/B.TS", "b.ts", True), ("docs/a/b", "docs/", True), ("a+b.ts", "a+b.ts", True)]
    df = spark.createDataFrame([(i, *r[:2]) for i, r in enumerate(rows)], "i int, p string, g string").orderBy("i")
    assert values(df, matches_any(F.col("p"), F.array("g"))) == [r[2] for r in rows]


def test_pattern_dialect(spark):
    assert values(texts(spark, "ログmergedした", "src/a.ts\n", "a\u0085b"), F.rlike(F.col("t"), F.lit(js(r"\bmerged\b")))) == [True, False, False]
    assert values(texts(spark, "src/a.ts\n"), F.rlike(F.col("t"), F.lit(js(r"a\.ts$")))) == [False]
    assert values(texts(spark, "a\u0085b", "a\nb"), F.rlike(F.col("t"), F.lit(js(r"a.b")))) == [True, False]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text("ab;x\U0001f600", max_size=12), min_size=1, max_size=5))
def test_match_spans_against_python(spark, rows):
    import re

    found = values(texts(spark, *rows), match_spans(F.col("t"), F.lit("a+|;")))
    assert [[(s.start, s.end, s.text) for s in f] for f in found] == [[(m.start(), m.end(), m[0]) for m in re.finditer("a+|;", r)] for r in rows]


def test_markup(spark):
    assert values(texts(spark, "<a href=\"x\">'&"), escape_html(F.col("t"))) == ["&lt;a href=&quot;x&quot;&gt;&#39;&amp;"]
    assert values(texts(spark, "</script>"), script_safe(F.col("t"))) == ["<\\/script>"]

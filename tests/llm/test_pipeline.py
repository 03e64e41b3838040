"""The pipeline's stages on a small corpus, each against what it should keep."""

import random

import pytest

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(rng):
    word = lambda: "".join(rng.choice(["ba", "ko", "ti", "mu", "re", "lo"]) for _ in range(3))
    line = lambda n=30: " ".join(word() for _ in range(n))
    rows = [(i, "\n".join(line() for _ in range(4))) for i in range(60)]
    near = rows[1][1].split()
    return rows, [(100, rows[0][1]), (101, " ".join(near[:5] + ["zzz"] + near[6:])), (102, "123 456"), (103, None), (104, ""), (105, rows[2][1].split("\n")[0] + "\n" + line()), (106, rows[3][1].replace("\n", " ") + " " + line(20))]


@pytest.fixture(scope="module")
def setup(spark, tmp_path_factory):
    rng = random.Random(3)
    rows, odd = corpus(rng)
    docs = spark.createDataFrame([(i, t, "aa" if i % 2 else "bb", "s", len(t or "")) for i, t in rows + odd], SCHEMA)
    folder = str(tmp_path_factory.mktemp("sf"))
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, " ".join(rows[3][1].split()[:40]))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, docs, dict(rows + odd)


def test_stages(spark, setup):
    folder, docs, texts = setup
    stages = dict(corpus_pipeline.STAGES)
    known = stages["language"](spark, docs, folder)
    assert {r.doc_id for r in known.collect()} == set(texts) - {102, 103, 104}
    fewer = {r.doc_id: r for r in stages["lines"](spark, known, folder).collect()}
    assert 100 not in fewer and fewer[105].text == texts[105].split("\n")[1] and fewer[105].n_chars == len(fewer[105].text) and fewer[0].text == texts[0]
    unlike = {r.doc_id for r in stages["near_duplicates"](spark, known, folder).collect()}
    assert 100 not in unlike and set(range(60)) <= unlike
    clean = {r.doc_id for r in stages["decontamination"](spark, known, folder).collect()}
    assert clean == set(texts) - {102, 103, 104, 3, 106}
    for name in ("language", "lines", "near_duplicates", "decontamination"):
        assert stages[name](spark, docs, folder).columns == docs.columns
        assert stages[name](spark, docs.limit(0), folder).count() == 0


def test_run(spark, setup):
    folder, _, _ = setup
    out = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in out} >= set(range(60)) - {3} and not {r.doc_id for r in out} & {3, 100, 102, 103, 104}
    assert all(r.offset + r.length <= 4096 for r in out)

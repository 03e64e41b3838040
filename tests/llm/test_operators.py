"""Each operator against a brute-force version, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import base64
import gzip
import hashlib
import html
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from proofline.llm import ann, decontam, html_text, langid, line_dedup, packing, quality, quotes, similar, simhash, warc
from proofline.llm.queries import tokenizer

DOCS = "doc_id long, text string, lang string, fp long, `group` string"


def documents(spark, rows):
    """Rows (doc_id, text) with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "xx", 7, "g") for i, t in rows], DOCS)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randint(0, vocabulary)}" for _ in range(n))


# columns named as the operators' own

CLASHES = ("doc", "TH", "drops", "new", "id", "hash", "key", "line", "h1", "h2", "kind", "__score", "__LANG_PRED", "__score_", "n_words", "N_hit", "items", "hits", "n_words_new", "n_hit_new", "items_new", "hits_new", "fp", "first", "component", "n", "need", "size", "bits", "done")


def clashing(docs):
    return docs.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHES if c.lower() not in {x.lower() for x in docs.columns}])


def test_own_names_of_columns_do_not_matter(spark):
    rng = random.Random(21)
    rows = [(i, f"{prose(rng, 60)}\n{prose(rng, 40)}") for i in range(30)]
    rows += [(50, rows[0][1]), (51, rows[1][1].split("\n")[0]), (52, "12 34"), (53, None), (54, ""), (55, rows[2][1] + " tail")]
    docs = spark.createDataFrame([(i, t, "ab"[i % 2], len(t or "")) for i, t in rows], "doc_id long, text string, lang string, n_chars int")
    benchmark = spark.createDataFrame([(1, rows[3][1])], "item_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    net, model = langid.fit(docs), quality.fit(docs, labels)
    stages = {
        "language": lambda d: langid.drop_unidentified(d, net), "predict": lambda d: langid.predict(d, net), "lines": line_dedup.drop_lines, "first": simhash.keep_first, "unlike": similar.keep_unlike,
        "clean": lambda d: decontam.drop_contaminated(d, benchmark), "annotate": lambda d: decontam.annotate(d, benchmark), "quality": lambda d: quality.score(d, model),
    }
    for name, stage in stages.items():
        plain, other = stage(docs), stage(clashing(docs))
        added = len(plain.columns) - len(docs.columns)
        assert other.columns[: len(other.columns) - added] == clashing(docs).columns and len(set(map(str.lower, other.columns))) == len(other.columns), name
        where = [0, 1, 2, 3, *range(len(other.columns) - added, len(other.columns))]
        rows_of = lambda found, at: sorted(str([r[i] for i in at]) for r in found.collect())
        assert rows_of(other, where) == rows_of(plain, range(len(plain.columns))) and other.count() > 20, name
        own = other.select(clashing(docs).columns[4:]).distinct().collect()
        assert len(own) == 1 and all(str(v).startswith("own ") for v in own[0]), name


# 1: quality


def test_quality_ranks_and_thresholds(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.randint(5, 60)) if i % 3 else " ".join(f"W{rng.randint(0, 9)}!!" for _ in range(30))) for i in range(240)]
    docs = documents(spark, [*rows, (900, None), (901, ""), (902, "a" * 200_000), (None, "x y"), (3, rows[3][1])])
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(240)] + [(None, 1, 0), (5, None, 0), (7, 9, 0)], "doc_id long, quality int, toxic int")
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    model = quality.fit(docs, labels, learn)
    got = {r.doc_id: r["__score"] for r in quality.score(docs, model).collect()}
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 20 and all((got[i] >= 0.3) == (i % 3 > 0) for i in held)
    assert all(0 <= s <= 1 for s in got.values()) and {900, 901, 902, None} <= set(got)
    assert quality.score(docs, model).columns == [*docs.columns, "__score"] and quality.score(docs, model).count() == docs.count()
    assert quality.fit(docs, labels.limit(0)) is None and {r["__score"] for r in quality.score(docs, None).collect()} == {0.3}
    assert quality.score(docs.limit(0), model).count() == 0


def test_quality_reads_words(spark):
    rng = random.Random(50)
    sentence = lambda words: " ".join(f"{' '.join(rng.choice(words) for _ in range(8)).capitalize()}." for _ in range(rng.randint(2, 9)))
    shared, fine, poor = (["".join(rng.choice("aeioubdgklmnprst") for _ in range(5)) for _ in range(n)] for n in (60, 40, 40))
    rows = [(i, sentence(shared + (fine if i % 3 else poor))) for i in range(600)]  # alike but for their words
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(600)], "doc_id long, quality int")
    learn = F.col("doc_id") % 5 != 0
    model = quality.fit(docs, labels, learn)
    got = {r.doc_id: r["__score"] for r in quality.score(docs, model).collect()}
    held = range(0, 600, 5)
    assert sum((got[i] >= 0.3) == (i % 3 > 0) for i in held) >= 0.97 * len(held)
    again = quality.fit(docs.repartition(5), labels.repartition(3), learn)
    assert again.lexicon == model.lexicon and np.array_equal(again.weights, model.weights)
    one = quality.fit(docs, labels.where("quality = 1"), learn)
    assert one is None


def test_bradley_terry_orders_by_strength():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    model = quality.train(x, (x[:, 0] - 0.5 * x[:, 1] > 0).astype(int))
    assert np.corrcoef(model.strength(x), x[:, 0] - 0.5 * x[:, 1])[0, 1] > 0.98


# 2: nearest neighbours


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "k", 0) for i, v in rows], "vec_id long, embedding array<float>, label int, key string, rank int")


def test_ann_recall_ties_and_copies(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 12)).astype(np.float32)
    x[100:400] = x[100]  # many copies of one vector, queries among them
    rows = [(i, [float(v) for v in x[i]]) for i in range(1500)]
    bad = [(2000, None), (2020, []), (2040, [0.0] * 12), (2060, [float("nan")] * 12), (2080, [None] + [1.0] * 11), (2100, [1.0] * 5), (None, [1.0] * 12), (20, rows[20][1])]
    got = {}
    for r in ann.search(vectors(spark, rows + bad), F.col("vec_id") % 20 == 0, k=20, leaf_rows=100).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    x64, hits = x.astype(np.float64), 0
    assert set(got) == set(range(0, 1500, 20))
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and q not in [f[1] for f in found]
        score = x64 @ x64[q]
        score[q] = -np.inf
        assert all(abs(score[v] - s) < 1e-9 for _, v, s in found)
        assert all((a[2], -a[1]) > (b[2], -b[1]) for a, b in zip(found, found[1:], strict=False))
        hits += len(set(np.lexsort((np.arange(1500), -np.round(score, 10)))[:20].tolist()) & {v for _, v, _ in found})
    assert hits / (20 * len(got)) >= 0.9


def test_ann_deep_trees_search_less_than_all(spark):
    rng = np.random.default_rng(14)
    x = rng.normal(size=(5000, 16))
    x[:1200] = x[0] + 1e-4 * rng.normal(size=(1200, 16))  # no tree parts these, so their leaves are dealt to several tasks
    scores = x @ x.T
    np.fill_diagonal(scores, -np.inf)
    got = {}
    for r in ann.search(vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)]), F.col("vec_id") % 20 == 0, k=20, cell_rows=200).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    stored = x.astype(np.float32).astype(np.float64)
    hits = 0
    for q, found in got.items():
        found.sort()
        assert len({v for _, v, _ in found}) == 20 and all(abs(stored[v] @ stored[q] - s) < 1e-9 for _, v, s in found)
        hits += sum(s >= np.sort(scores[q])[-20] - 1e-5 for _, _, s in found)
    assert len(got) == 250 and hits / 5000 >= 0.9
    norm = (x * x).sum(axis=1).max()
    forest = ann.plant(ann._lift(x, norm), 10, 9)
    leaves = forest.leaves(ann._lift(x, norm))
    forest.sizes = np.stack([np.concatenate((np.zeros(1 << forest.top), np.bincount(leaves[:, t] >> (9 - forest.top), minlength=1 << forest.top))) for t in range(10)])
    visits = [forest.visit(np.append(x[q] / np.linalg.norm(x[q]) * np.sqrt(norm), 0).astype(np.float32), ann.budget(5000), 0.4) for q in range(2000, 2050)]
    assert all(len(set(v)) == len(v) for v in visits)
    assert np.mean([sum((leaves[:, t] == leaf).sum() for t, leaf in v) for v in visits]) < 0.9 * 5000


def test_ann_small_tables(spark):
    three = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0])]
    got = [tuple(r) for r in ann.search(vectors(spark, three), F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 2.0), (0, 2, 2, 0.0)]
    assert ann.search(vectors(spark, three).limit(0), F.col("vec_id") == 0).count() == 0


# 3: quotations


def test_quotes(spark):
    rows = [
        (1, 0, "u", "Hello there.\n\nSecond\nparagraph."), (1, 1, "a", "> hello   THERE.\nYes."), (1, 2, "u", "On Monday, Al wrote:\n> Yes.\n>> Hello there.\n\nThanks"), (1, 3, "a", "> > second paragraph.\nDeep"), (1, 4, "u", "> nowhere\nend"),
        (2, 0, "u", "> Thanks\nother"), (2, 1, "u", None), (2, 2, "u", ""), (2, 2, "u", ""), (None, 0, "u", "> Thanks"), (3, None, "u", "x"), (3, 0, None, "a" * 150_000 + "\n> Deep"),
    ]
    messages = spark.createDataFrame([(*r, 5, "p") for r in rows], "conv_id long, turn long, role string, text string, depth int, passage string")
    got = {(r.conv_id, r.turn): r for r in quotes.link(messages).collect()}
    assert quotes.link(messages).count() == len(rows)
    shown = lambda k: (got[k].body, got[k].n_quotes, got[k].origin_conv, got[k].origin_turn, got[k].reply_to, got[k].thread_turn, got[k].depth, got[k].position)
    assert shown((1, 0)) == ("Hello there.\n\nSecond\nparagraph.", 0, None, None, None, 0, 0, 1)
    assert shown((1, 1)) == ("Yes.", 1, 1, 0, 0, 0, 1, 2)
    assert shown((1, 2)) == ("Thanks", 2, 1, 1, 1, 0, 2, 4)
    assert shown((1, 3)) == ("Deep", 1, 1, 0, 0, 0, 1, 3)
    assert shown((1, 4)) == ("end", 1, None, None, None, 4, 0, 5)
    assert shown((2, 0)) == ("other", 1, 1, 2, None, 0, 0, 1)
    assert got[2, 1].body is None and got[2, 2].body == "" and got[3, 0].origin_turn == 3
    assert quotes.link(messages.limit(0)).count() == 0


def brute_quotes(rows):
    """link() by loops over distinct rows (conv_id, turn, role, text), without attributions and white space at lines' starts."""

    def paragraphs(lines):
        parts, now = [], []
        for x in [*lines, ""]:
            if x.strip():
                now.append(x)
            elif now:
                parts.append(" ".join(" ".join(now).split()).lower())
                now = []
        return parts

    held, quotes, body = {}, {}, {}
    for key in rows:
        lines = key[3].split("\n")
        level = [len(x) - len(x.lstrip(">")) for x in lines]
        own = [x if not n else "" for x, n in zip(lines, level, strict=True)]
        body[key] = "\n\n".join("\n".join(g) for g in _gaps(own)).strip()
        for passage in paragraphs(own):
            held.setdefault(passage, set()).add(key[:2])
        quotes[key] = [q for n in sorted(set(level) - {0}) for q in paragraphs([x.lstrip(">").removeprefix(" ") if m == n else "" for x, m in zip(lines, level, strict=True)])]
    reply, origin = {}, {}
    for key, asked in quotes.items():
        for q in asked:
            mine = min((t for c, t in held.get(q, ()) if c == key[0]), default=None)
            other = min((x for x in held.get(q, ()) if x[0] != key[0]), default=None)
            found = (key[0], mine) if mine is not None and mine < key[1] else other
            if found and key not in origin:
                origin[key] = found
            if found and found[0] == key[0] and key not in reply:
                reply[key] = mine
    out = []
    for key in rows:
        depth, turn = 0, key[1]
        while True:
            up = next((reply[k] for k in rows if k[:2] == (key[0], turn) and k in reply), None)
            if up is None:
                break
            depth, turn = depth + 1, up
        out.append((key[0], key[1], body[key], len(quotes[key]), *(origin.get(key) or (None, None)), reply.get(key), turn, depth))
    place = {}
    for r in sorted(out, key=lambda r: (r[0], r[7], r[8], r[1])):
        place.setdefault(r[0], []).append(r[1])
    return sorted((*r, place[r[0]].index(r[1]) + 1) for r in out)


def _gaps(lines):
    """Runs of lines with text."""
    runs, now = [], []
    for x in [*lines, ""]:
        if x.strip():
            now.append(x)
        elif now:
            runs.append(now)
            now = []
    return runs


def test_quotes_against_loops(spark):
    rng = random.Random(17)
    said = ["Yes.", "No way", "so be\nit", "one two", "THREE  four", "five"]  # few, so that texts repeat and quotes have several origins
    rows = []
    for conv in range(12):
        for turn in range(rng.choice([1, 4, 9, 40])):
            parts = []
            for _ in range(rng.randint(0, 4)):
                level = rng.choice([0, 0, 1, 1, 2, 3])
                text = rng.choice(said) if rng.random() < 0.8 else f"only {conv} {turn}"
                parts.append("\n".join(">" * level + (" " if level else "") + x for x in text.split("\n")))
            if conv % 3 == 0:  # a long thread
                parts = [f"> line {conv} {turn - rng.randint(1, 2)}", *parts, f"line {conv} {turn}"]
            rows.append((conv, turn, "u", rng.choice(["\n", "\n\n"]).join(parts) if parts else ""))
    got = quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    shown = sorted((r.conv_id, r.turn, r.body, r.n_quotes, r.origin_conv, r.origin_turn, r.reply_to, r.thread_turn, r.depth, r.position) for r in got)
    assert shown == brute_quotes(rows) and max(r.depth for r in got) > 5


def test_quotes_do_not_use_python(spark):
    messages = spark.createDataFrame([(1, 0, "u", "> a")], "conv_id long, turn long, role string, text string")
    plan = quotes.link(messages)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "MapInArrow"))


# 4: line dedup


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_lines_against_all_pairs(spark):
    rng = random.Random(9)
    texts = ["\n".join(" ".join(rng.choice("abc") for _ in range(rng.randint(3, 8))) for _ in range(rng.randint(0, 4))) for _ in range(70)]
    rows = [*enumerate(texts), (200, None), (201, ""), (202, "A b  C\ta b"), (None, "a b c a b"), (5, texts[5]), (203, " ".join(["long"] * 30_000))]
    docs = documents(spark, rows)
    seen, want = [], {}
    for key, text in sorted({(10**9 if i is None else i, t) for i, t in rows if t is not None}):
        for n, line in enumerate(text.split("\n")):
            words = line.lower().split()
            if len(words) >= 5:
                exact = words in seen
                if exact or any(abs(len(w) - len(words)) < 2 and distance(w, words) <= 1 for w in seen):
                    want.setdefault(key, []).append((n, exact))
                seen.append(words)
    report = line_dedup.report(docs).collect()
    assert len(report) == len(rows)
    for r in report:
        lines = want.get(10**9 if r.doc_id is None else r.doc_id, [])
        assert (r.n_exact, r.n_near, r.dropped) == (sum(e for _, e in lines), sum(not e for _, e in lines), ",".join(str(n) for n, _ in lines)), r
    kept = {r.doc_id: r.text for r in line_dedup.drop_lines(docs).collect()}
    for i, text in rows:
        gone = {n for n, _ in want.get(10**9 if i is None else i, [])}
        left = None if text is None else "\n".join(x for n, x in enumerate(text.split("\n")) if n not in gone)
        assert (i not in kept and not left.strip()) if gone and not left.strip() else kept[i] == left
    assert line_dedup.drop_lines(docs).columns == docs.columns and line_dedup.report(docs.limit(0)).count() == 0


def test_short_and_unspaced_lines(spark):
    chinese = "\u6211\u4eec\u4eca\u5929\u53bb\u5b66\u6821"
    rows = [(1, f"All rights reserved.\n\nLes.\n{chinese}"), (2, f"les.\nall  Rights reserved.\n\nall rights\n{chinese[:-1]}\u5bb6"), (3, chinese + "\n" + chinese[:3]), (4, chinese[:3])]
    got = {r.doc_id: (r.n_exact, r.n_near, r.dropped) for r in line_dedup.report(documents(spark, rows), exact_words=1).collect()}
    assert got == {1: (0, 0, ""), 2: (2, 1, "0,1,4"), 3: (1, 0, "0"), 4: (1, 0, "0")}


# 5: SimHash


def reference_fingerprint(text):
    words = [w for w in (text or "").encode().lower().split()]
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_simhash_against_all_pairs(spark):
    rng = random.Random(2)
    base = [prose(rng, 300) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, " ".join(w if rng.random() > 0.004 else "changed" for w in base[i % 12].split())) for i in range(60)]
    rows += [(200, None), (201, ""), (202, " \n "), (203, "one"), (204, "ONE"), (205, base[0] + " é"), (None, base[1]), (3, base[3]), (300, prose(rng, 50_000))]
    fps = [reference_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    want = sorted((str(d), fps[i], min(x for x in groups[find(i)] if x is not None)) for i, (d, _) in enumerate(rows))
    docs = documents(spark, rows)
    got = sorted((str(r.doc_id), r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == want
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted({w[2] for w in want})
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert simhash.near_duplicates(documents(spark, [(None, "a b c d e")])).first().component_id is None


@pytest.mark.parametrize("spread", [0, 3, 64])
def test_trie_join_against_all_pairs(spread):
    rng = np.random.default_rng(spread)
    centres = rng.integers(0, 2**63, 30, dtype=np.uint64)
    fps = np.unique(np.concatenate([c ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (20, max(1, spread // 2)), dtype=np.uint64), axis=1) for c in centres]))
    label = simhash.trie_stars(fps, np.array([0, len(fps)]), 4)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    want = np.arange(len(fps))
    while True:
        new = np.array([want[row].min() for row in near])
        if (new == want).all():
            break
        want = new
    assert (label == want).all()


@pytest.mark.parametrize("most", [5, 1 << 20])
def test_large_tries_are_dealt_out(spark, most):
    rng = np.random.default_rng(40)
    fps = np.unique(rng.integers(0, 2**63, 40, dtype=np.uint64)[rng.integers(0, 40, 600)] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (600, 3), dtype=np.uint64), axis=1))
    fps = np.concatenate((fps, np.arange(1 << 8, dtype=np.uint64) << np.uint64(20)))  # many that share four blocks
    edges = simhash.stars(spark.createDataFrame([(int(v),) for v in fps.view(np.int64)], "fp long"), 4, most=most).collect()
    place = {int(v): i for i, v in enumerate(fps.view(np.int64))}
    want, got = np.arange(len(fps)), np.arange(len(fps))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    links = np.eye(len(fps), dtype=bool)
    for r in edges:
        links[place[r.a], place[r.b]] = links[place[r.b], place[r.a]] = True
    for label, table in ((want, near), (got, links)):
        while True:
            new = np.array([label[row].min() for row in table])
            if (new == label).all():
                break
            label[:] = new
    assert (want == got).all()


def test_similar_documents_against_all_pairs(spark):
    rng = random.Random(12)
    base = [prose(rng, rng.randint(3, 120)) for _ in range(30)]
    rows = list(enumerate(base))
    for i in range(60):  # a changed stretch, and words added or taken away
        words = base[i % 30].split()
        at, n = rng.randrange(len(words)), rng.randint(0, 12)
        rows.append((100 + i, " ".join(words[:at] + prose(rng, n).split() + words[at + rng.randint(0, n) :])))
    rows += [(200, None), (201, ""), (202, base[0].upper()), (None, base[1]), (203, base[2] + " tail")]
    order = sorted({(10**9 if i is None else i, t) for i, t in rows}, key=lambda r: r[0])
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for _, t in order]
    want = {i for k, (i, _) in enumerate(order) if not any(sets[k] and 10 * len(sets[k] & s) >= 8 * len(sets[k] | s) for s in sets[:k])}
    docs = documents(spark, rows)
    kept = similar.keep_unlike(docs)
    assert kept.columns == docs.columns and sorted(10**9 if r.doc_id is None else r.doc_id for r in kept.collect()) == sorted(want)
    assert 20 < len(want) < len(order) - 20 and similar.keep_unlike(docs.limit(0)).count() == 0


# 6: HTML


def test_html(spark):
    page = '<!doctype html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><header>Top</header><nav><ul><li><a href=/>Home</a><li><a>Two</a></ul></nav><div class="ad">Buy now</div><div id=sidebar><p>Side text here</p></div>'
    page += '<article><h1>Head &amp; more</h1><p>First <b>bold</b>\n text&nbsp;&#233;.<br>next<p>Second <a href="x">link</a> with words after it<div class="notice">Notice</div><form><label>Mail</label><input></form><!-- <p>no</p> --><p>Short.</p></article><section class="comments"><p>I agree with all of that</p></section><footer>&copy; x</footer></body></html>'
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "no markup at all but a good number of words in one single plain running line of text"), (5, "u", "<p>" * 3000 + "<article>deep"), (5, "u", "<nav>only</nav>"), (None, "u", "<article>x &lt;b&gt;</article")]
    pages = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = sorted((str(r.page_id), r.text, r.n_chars) for r in html_text.extract(pages).collect())
    want = "Head & more\nFirst bold text é. next\nSecond link with words after it\nShort."
    assert ("1", want, len(want)) in got and ("2", "", 0) in got and ("3", "", 0) in got and ("4", rows[3][2], len(rows[3][2])) in got
    assert ("5", "deep", 4) in got and ("5", "", 0) in got and ("None", "x <b>", 5) in got
    assert html_text.extract(pages.limit(0)).count() == 0


LONG = " ".join(f"word{i}" for i in range(60))


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<div class="layout has-sidebar"><article><p>Text of it</p></article></div>', "Text of it"),
        ('<form id="aspnetForm"><article><p>In a form</p></article></form>', "In a form"),
        ("<article><p title=it's>Some text here</p><p>More</p></article>", "Some text here\nMore"),
        ('<article><p>Real text <span class="promo">here</p><p>Next</p></article>', "Real text\nNext"),
        ('<article><p>A paragraph <span class="share">SHARE THIS</span> goes on</p></article>', "A paragraph goes on"),
        ("<html><head><title>x</title><body><article>no end of head</article>", "no end of head"),
        (f"<form><p>{LONG}</p><p>{LONG}</p></form>", f"{LONG}\n{LONG}"),
        (f"<article>a</article><div id=post-comments><p>{LONG}</p><article>{LONG}</article></div>", "a"),
        (f"<main><p>a</p><aside>{LONG}</aside><form><p>{LONG}</p></form><p>b</main>", "a\nb"),
        (f"<div><p>{LONG}</p><p>short</p><p>{LONG}</p></div><ul><li><a href=/>x</a></ul>", f"{LONG}\nshort\n{LONG}"),
        ('<article data-x="a>b" class=\'c>d\' checked>kept <i title="</article>">too</i></article>', "kept too"),
        ("<article>" + "<b>" * 3000 + "deep" + "</b>" * 3000 + "</x>" * 3000 + "</article>", "deep"),
        (f"<article><p>{LONG}</p><p>b</p></article><div>A notice, {LONG}</div>", f"{LONG}\nb"),
        (f"<article>teaser</article><div><p>{LONG}</p><p>{LONG}</p></div>", f"teaser\n{LONG}\n{LONG}"),
        ("<article><div hidden>no</div><div style='display: none'>no</div>yes</article>", "yes"),
        ("<article>1 < 2 &amp;&lt; 3 <! x>4<", "1 < 2 &< 3 4<"),
    ],
)
def test_html_cases(page, want):
    assert html_text.main_text(page, html_text.trained()) == want


def random_page(rng):
    """A page, and the text of its article by construction."""
    word = lambda: rng.choice(["alpha", "beta", "gamma", "R&amp;D", "&eacute;t&eacute;", "x&lt;y", "d&#233;j&#xe0;", "zeta"])
    text = lambda n: " ".join(word() for _ in range(n))
    plain = lambda t: " ".join(html.unescape(t).split())
    blocks, out = [], []
    for _ in range(rng.randint(1, 8)):
        t, end = text(rng.choice([1, 3, 12, 40, 90])), rng.choice(["</p>", ""])
        kind = rng.randrange(7)
        if kind == 0:
            blocks.append(f"<h2 class='entry title'>{t}</h2>")
        elif kind == 1:
            more = text(4)
            blocks.append(f"<p>{t} <a href=/x>{more}</a>\n\t<b>bold</b>.{end}")
            t = f"{t} {more} bold."
        elif kind == 2:
            blocks.append(f"<p title=it's data-a=\"a>b\">{t}<span class=share>Share this</span> end{end}")
            t = f"{t} end"
        elif kind == 3:
            blocks.append(f"<blockquote>{t}<br>more</blockquote><script>if (a < b) document.write('<p>no</p>')</script>")
            t = f"{t} more"
        elif kind == 4:
            blocks.append(f"<ul><li>{t}<li>last</ul><form class=signup><label>Mail</label> {text(8)}</form>")
            t = [t, "last"]
        elif kind == 5:
            blocks.append(f"<div class='has-sidebar body'>{t}</div><div class=ad>{text(30)}</div><!-- <p>no</p> -->")
        else:
            blocks.append(f"<p>{t}{end}<div hidden>{text(9)}</div><style>p {{}}</style>")
        out += [plain(x) for x in (t if isinstance(t, list) else [t])]
    head = f"<!doctype html><html><head><title>{text(3)}</title><meta charset=utf-8>{rng.choice(['</head><body>', '<body>'])}"
    around = [f"<nav><ul><li><a href=/>{text(2)}</a></ul></nav>", f"<header class=top>{text(20)}</header>", f"<aside><p>{text(60)}</p></aside>", f"<div id=cookie-notice>{text(25)}</div>", f"<div class='ad slot'>{text(70)}</div>"]
    after = [f"<section class=comments><article><p>{text(80)}</p></article></section>", f"<footer>{text(30)} &copy;</footer>", f"<div class=related-posts><a href=/y>{text(5)}</a></div>", f"<form id=search><input><button>{text(1)}</button></form>"]
    rng.shuffle(around)
    rng.shuffle(after)
    wrap = rng.choice([("<article>", "</article>"), ("<main class='site layout'>", "</main>"), ("<form id=aspnetForm><div class=with-sidebar><article>", "</article></div></form>"), ("<div role=main>", "</div>")])
    return head + "".join(around[: rng.randint(0, 5)]) + wrap[0] + "\n".join(blocks) + wrap[1] + "".join(after[: rng.randint(0, 4)]) + "</body></html>", "\n".join(out)


def test_html_of_random_pages():
    rng, tree = random.Random(33), html_text.trained()
    for _ in range(400):
        page, want = random_page(rng)
        assert html_text.main_text(page, tree) == want, page


def test_html_tree_over_all_shapes():
    tree = html_text.trained()
    shapes = [(w, d, pw, pd, nw, nd) for w in (1, 4, 15, 50, 300) for d in (0.0, 0.2, 0.45) for pw in (0, 10, 60) for pd in (0.0, 1.0) for nw in (0, 10, 60) for nd in (0.0, 1.0)]
    assert all(html_text.is_main(tree, (*x, html_text.IN_MAIN)) and not html_text.is_main(tree, (*x, html_text.NONE)) for x in shapes)
    for zone in (html_text.BESIDE_MAIN, html_text.OPEN):
        assert {html_text.is_main(tree, (*x, zone)) for x in shapes} == {True, False}


# 7: WARC


def test_warc_round_trip(spark):
    rng = random.Random(4)
    noise = "".join(chr(rng.randint(32, 0x2000)) for _ in range(60_000))  # barely shrinks, so its member spans ranges
    rows = [(9, "http://a/ b", "same"), (3, "http://a", "same"), (4, None, None), (5, "u", ""), (6, "u", noise), (7, "u", noise), (8, "u", "é"), (8, "u", "é"), (None, "u", "lone"), (10, "u", "WARC/1.1 \x1f gzip")]
    pages = spark.createDataFrame([(*r, "d", "p") for r in rows], "page_id long, url string, html string, digest string, path string")
    got = sorted((str(r.page_id), r.record_type, str(r.refers_to), r.payload_bytes, r.payload_digest, r.payload) for r in warc.round_trip(pages, 0, split_bytes=700).collect())
    want = []
    for i, _, text in rows:
        data = (text or "").encode()
        first = min((j for j, _, t in rows if (t or "") == (text or "") and j is not None), default=None)
        response = first is None or i == first
        want.append((str(i), "response" if response else "revisit", "None" if response else str(first), len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), bytearray(data) if response else None))
    assert got == sorted(want, key=lambda x: x[:5])
    assert {r.record_type for r in warc.round_trip(pages, 1000).where("payload_bytes < 1000").collect()} == {"response"}
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_scan_owns_each_member_once(tmp_path):
    from pyarrow import fs

    records = [warc.member("response", f"http://x/{i}", f"<urn:page:{i}>", "D", None, random.Random(i).randbytes(500) + warc.MAGIC + b"junk" * i) for i in range(30)]
    data = b"".join(records[:10]) + warc.MAGIC + b"not a member" + b"".join(records[10:]) + gzip.compress(b"no record")
    (tmp_path / "x.warc.gz").write_bytes(data)
    for step in (64, 333, 5000, 1 << 20):
        found = []
        for start in range(0, len(data), step):
            with fs.LocalFileSystem().open_input_file(str(tmp_path / "x.warc.gz")) as file:
                found += [f["warc-record-id"] for _, f, _ in warc.scan(file, start, min(start + step, len(data)))]
        assert found == [f"<urn:page:{i}>" for i in range(30)]


# 8: packing


def test_first_fit_against_a_scan():
    rng = np.random.default_rng(1)
    lengths = np.sort(rng.integers(1, 101, 500))[::-1]
    room, want = [], []
    for n in lengths:
        k = next((i for i, r in enumerate(room) if r >= n), len(room))
        if k == len(room):
            room.append(100)
        want.append((k, 100 - room[k]))
        room[k] -= n
    assert list(zip(*(x.tolist() for x in packing.first_fit(lengths, 100)), strict=True)) == want


def test_packing(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer())
    rng = random.Random(6)
    texts = [prose(rng, rng.randint(0, 900)) + rng.choice(["", " Don't STOP,now... déjà-vu 12:30 ÀÉ́ straße ʼn", " <|endoftext|> x", "\x1c a\x85b\xa0c ＡΣ"]) for _ in range(60)]
    rows = [*enumerate(texts), (100, None), (101, ""), (102, prose(rng, 12_000)), (None, "null id"), (7, texts[7]), (103, "a" * 30_000)]
    got = packing.pack(documents(spark, rows), tokenizer(), size=512, group_pieces=40).collect()
    pieces, used = {}, {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    want = {}
    for i, text in rows:
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want.setdefault(i, []).extend((a, len(ids[a : a + 512]), zlib.crc32(ids[a : a + 512].tobytes()), len(ids)) for a in range(0, len(ids), 512))
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in want.items()}
    for spans in used.values():
        spans.sort()
        assert [a for a, _ in spans] == [sum(n for _, n in spans[:i]) for i in range(len(spans))] and sum(n for _, n in spans) <= 512
    assert sum(n for s in used.values() for _, n in s) / (512 * len(used)) > 0.9
    assert packing.pack(documents(spark, rows).limit(0), tokenizer()).count() == 0


def test_ids_equal_the_plain_tokenizers():
    from tokenizers import Tokenizer

    plain, ids, rng = Tokenizer.from_file(tokenizer()), packing.Ids(tokenizer()), random.Random(30)
    signs = [*"aZsteT9 0.,'\"-$<|>_\u201c\u201d\u00e9\u00c9\u00d7\u00f7\u0130\u0131\u0149\u017f\u00df\u0307\u030c\u0308\u0331\u030a\u0345\u1ab0\u20dd\x1c\x85\u00a0\u2028\ufb01\u4e2d\u0e01\u0661\u00bd\U0001f600\x00\n\t", "'s", "'ll", "J\u030c", "H\u0331", "Stra\u00dfe ", "d\u00e9j\u00e0,", "\ud800"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    texts += [None, "", " ", "x" * 3000 + "," + "y" * 300, "J\u030c T\u0308 H\u0331 W\u030a Y\u030a", "<|StartOfText|> a<|endoftext|>", "word " * 300_000, "a" * 30_000 + "1" * 5_000, "no-space" * 2_000]
    want = [plain.encode((t or "").encode("utf-8", "replace").decode(), add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in ids.of(texts)] == want
    again = list(reversed(texts))
    assert [x.tolist() for x in ids.of(again)] == want[::-1]
    ids.clear()
    assert [x.tolist() for t in texts[:50] for x in ids.of([t])] == want[:50]


# 9: language


def test_language(spark):
    rng = random.Random(8)
    sounds = {"aa": ["ba", "ko", "ti", "mu"], "bb": ["sch", "ung", "ö", "er"], "cc": ["ción", "ll", "que", "ar"]}
    rows = [(i, " ".join("".join(rng.choice(sounds[k]) for _ in range(3)) for _ in range(rng.randint(20, 80)))) for i, k in enumerate(list(sounds) * 60)]
    docs = spark.createDataFrame([(i, t, list(sounds)[i % 3]) for i, t in rows] + [(500, None, "aa"), (501, "12 !?", None), (502, "", "bb"), (503, rows[0][1] * 400, None), (0, rows[0][1], "aa"), (None, rows[1][1], "bb")], "doc_id long, text string, lang string")
    net = langid.fit(docs, F.col("doc_id") % 4 != 2)
    got = {r.doc_id: (r["__lang_pred"], r["__score"]) for r in langid.predict(docs, net).collect()}
    held = [i for i in range(180) if i % 4 == 2]
    assert sum(got[i][0] == list(sounds)[i % 3] for i in held) >= 0.95 * len(held)
    assert {langid.has_letter(t) for t in ("\u00bd \u00b2", "\u2167 \u2460", "12 _", "")} == {False} and langid.has_letter("\u00bd \u00e9")
    assert np.array_equal(langid.fit(docs.repartition(7), F.col("doc_id") % 4 != 2).dense, net.dense)
    assert langid.fit(docs, most_langs=2).langs == ["aa", "bb"]
    assert got[500] == got[501] == got[502] == ("und", 0.0) and got[503][0] == "aa" and got[None][0] == "bb"
    kept = langid.drop_unidentified(docs, net)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 3
    assert langid.fit(docs.limit(0)) is None and {r["__lang_pred"] for r in langid.predict(docs, None).collect()} == {"und"}
    assert langid.predict(docs.limit(0), net).count() == 0


def test_tabulated_network_equals_convolution():
    rng = np.random.default_rng(0)
    net = langid.train(rng.integers(0, 256, (40, 24), dtype=np.uint8), np.arange(40) % 2, ["a", "b"], steps=5)
    x = rng.integers(0, 256, (9, 24), dtype=np.uint8)
    pooled = [np.stack([sum(w[o][x[:, p + o]] for o in range(len(w))) for p in range(24 - len(w) + 1)]).max(axis=0) for w in net.filters]
    want = langid.softmax(np.maximum(np.concatenate(pooled, axis=1) + net.bias, 0) @ net.dense + net.out_bias)
    assert np.allclose(net.probabilities(x), want, atol=1e-5)


# 10: decontamination


def brute_hits(text, items, m=13):
    words = decontam.words_of(text)
    hits, found = set(), set()
    for item, other in items:
        w = decontam.words_of(other)
        n = min(m, len(w))
        for a in range(len(w) - n + 1 if n else 0):
            for b in range(len(words) - n + 1):
                if words[b : b + n] == w[a : a + n]:
                    hits |= set(range(b, b + n))
                    found.add(str(item))
    return len(words), len(hits), sorted(found)


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_decontamination_against_all_windows(spark, block_bytes):
    rng = random.Random(12)
    items = [(i, prose(rng, rng.randint(10, 40), 3)) for i in range(12)] + [(50, "one Two"), (51, ""), (52, None), (53, "--"), (54, "naïve"), (None, "x y"), (55, "one two")]
    rows = [(i, prose(rng, rng.randint(0, 120), 3)) for i in range(40)]
    rows += [(i + 100, f"{prose(rng, 30)}; {t}, {prose(rng, 9)}") for i, t in items[:12]] + [(200, None), (201, ""), (202, "ONE-two one_Two"), (203, "Naïve!"), (None, items[0][1]), (3, rows[3][1]), (204, prose(rng, 40_000))]
    docs = documents(spark, rows)
    benchmark = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, n_words int")
    known = [x for x in items if x[0] is not None and x[1]]
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r["items"], r.contaminated) for r in decontam.contamination(docs, benchmark, 13, 5, block_bytes).collect())
    want = sorted((str(i), *(h := brute_hits(t, known)), h[1] > 0 and 20 * h[1] >= h[0]) for i, t in rows)
    assert got == want
    kept = decontam.drop_contaminated(docs, benchmark)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(w[0] for w in want if not w[4])
    assert decontam.contamination(docs.limit(0), benchmark).count() == 0 and decontam.contamination(docs, benchmark.limit(0)).where("n_hit > 0").count() == 0


def test_decontamination_of_items_without_id_equals_sql(spark, tmp_path):
    import duckdb

    from proofline.llm import queries

    spark.createDataFrame([(1, "a b c"), (2, "x y"), (3, "b c; x y"), (4, "q")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, "x y"), (None, "b c"), (7, "b c"), (8, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    db = duckdb.connect()
    for name in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = sorted(tuple(r) for r in queries.op10_decontamination(spark, str(tmp_path)).collect())
    assert got == sorted(db.execute(queries.ORACLES["op10_decontamination"]).fetchall())
    assert [(r[0], r[2], r[3], r[5]) for r in got] == [(1, 2, 2, True), (2, 2, 1, True), (3, 4, 2, True), (4, 0, 0, False)]

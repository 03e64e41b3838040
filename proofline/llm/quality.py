"""Quality classifier: a Bradley-Terry model of documents.

Of a good and a bad document, the good one is preferred. The model gives a document the strength w.x of its features and a pair
the probability sigmoid(w.(x - y)); w minimises the logistic loss over pairs. The threshold is a quantile of the strengths of the
training sample. Scores are a sigmoid of the strength, placed so that the threshold has the score 0.3.

Features are kinds of bytes, lengths, repetition, and how much more often a text's words stand in good documents than in bad ones.
What the words tell is counted in the one half of the training sample for the documents of the other half, so that no document's
own label is in its features.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.llm.common import add_columns, fresh, map_batches, prepare

KINDS = {"lower": range(97, 123), "upper": range(65, 91), "digit": range(48, 58), "space": (32, 9), "newline": (10, 13), "stop": b".,;:", "mark": b"!?", "quote": b"'\"()-", "symbol": b"#$%&*+/<=>@[\\]^_`{|}~", "control": (*range(9), 11, 12, *range(14, 32), 127), "high": range(128, 256)}
KIND = np.zeros((256, len(KINDS)))
for _i, _bytes in enumerate(KINDS.values()):
    KIND[list(_bytes), _i] = 1


#: Words that the lexicon holds, documents of the sample that a word must stand in, and the bound of what one word can tell.
LEXICON, LEAST, BOUND = 20_000, 5, 3.0


def features(text: str | None, lexicon: dict[bytes, float]) -> list[float]:
    """Of the whole text; all zero for null and empty texts. lexicon: what a word tells; all words are in small letters (A-Z)."""
    if not text:
        return [0.0] * N_FEATURES
    data = text.encode("utf-8", "replace")
    n = len(data)
    kinds = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ KIND
    words = data.split()
    w = max(1, len(words))
    lines = data.split(b"\n")
    letters = max(1.0, kinds[0] + kinds[1] + kinds[10])
    repeats = sum(map(eq, words, words[1:])) / w
    distinct = len(set(words))
    told = [x for x in map(lexicon.get, data.lower().split()) if x is not None]
    return [
        sum(told) / w,
        len(told) / w,
        *(kinds / n).tolist(),
        kinds[1] / letters,
        min(1.0, (kinds[6] + kinds[8]) / w),
        repeats,
        math.sqrt(repeats),
        distinct / w,
        math.log(distinct + 1) / math.log(w + 2),
        math.log1p(n / w),
        1 - len(set(lines)) / len(lines),
        math.log1p(n / len(lines)),
        math.log1p(n),
    ]


N_FEATURES = len(KINDS) + 12


@dataclass
class BradleyTerry:
    lexicon: dict[bytes, float]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    spread: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray, at_threshold: float = 0.3) -> np.ndarray:
        """0 to 1; a strength at the threshold has the score at_threshold."""
        z = (self.strength(x) - self.threshold) / self.spread + math.log(at_threshold / (1 - at_threshold))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, lexicon: dict[bytes, float] | None = None, pairs: int = 60_000, steps: int = 300, decay: float = 1e-3, seed: int = 0) -> BradleyTerry:
    """Fit on random pairs of a good (y=1) and a bad (y=0) row, and set the threshold to the quantile that tells them apart best."""
    rng = np.random.default_rng(seed)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.clip((x - mean) / scale, -8, 8)
    difference = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w, m, v = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for step in range(1, steps + 1):
        g = -(difference * (1 / (1 + np.exp(np.clip(difference @ w, -40, 40))))[:, None]).mean(axis=0) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    s = z @ w
    levels = np.quantile(s, np.linspace(0.002, 0.998, 499))
    balanced = np.array([((s[good] >= t).mean() + (s[bad] < t).mean()) / 2 for t in levels])
    best = np.flatnonzero(balanced == balanced.max())
    return BradleyTerry(lexicon or {}, mean, scale, w, float(levels[best].mean()), float(s.std() / 3 + 1e-9))


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, sample: int = 20_000) -> BradleyTerry | None:
    """Train on about `sample` labelled documents, chosen by a hash of their ids; null where one of the labels 0 and 1 is missing.

    learn: a condition on doc_id. Rows of labels with null in doc_id or quality, or another quality, teach nothing; a document
    with both labels counts as either.
    """
    prepare(docs.sparkSession)
    marks = labels.where("doc_id is not null and quality in (0, 1)").select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    marks = marks if learn is None else marks.where(learn)
    n = marks.count()
    chosen = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < min(1.0, sample / max(1, n)) * (1 << 30)).limit(2 * sample)
    half = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2)).alias("half")
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")  # at most 2 * sample rows of 12 bytes
    rows = rows.select("text", "quality", half)
    half_words = map_batches(rows, _distinct_words, "word binary, quality int, half long")
    count = lambda q, h: F.count_if((F.col("quality") == q) & (F.col("half") == h)).alias(f"n{q}{h}")
    counted = half_words.groupBy("word").agg(F.count("*").alias("n"), *[count(q, h) for q in (0, 1) for h in (0, 1)]).where(F.col("n") >= LEAST)
    words = sorted(counted.orderBy(F.desc("n"), "word").limit(LEXICON).collect())
    sizes = {(r["quality"], r["half"]): r["n"] for r in rows.groupBy("quality", "half").agg(F.count("*").alias("n")).collect()}
    other = [lexicon_of(words, sizes, [1 - h]) for h in (0, 1)]

    def measured(batch: pa.RecordBatch) -> dict:
        return {"quality": batch.column("quality"), "x": [features(t.as_py(), other[h.as_py()]) for t, h in zip(batch.column("text"), batch.column("half"), strict=True)]}

    got = sorted(map_batches(rows, measured, "quality int, x array<double>").limit(4 * sample).collect())  # the same sample gives the same model, however it came
    y = np.array([r[0] for r in got], np.int64)
    if not (y == 1).any() or not (y == 0).any():
        return None
    return train(np.array([r[1] for r in got]), y, lexicon_of(words, sizes, [0, 1]))


def _distinct_words(batch: pa.RecordBatch) -> dict:
    words = [sorted(set((t.as_py() or "").encode("utf-8", "replace").lower().split())) for t in batch.column("text")]
    owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
    return {"word": [x for w in words for x in w], "quality": batch.column("quality").take(pa.array(owner)), "half": batch.column("half").take(pa.array(owner))}


def lexicon_of(words: list, sizes: dict[tuple[int, int], int], halves: list[int]) -> dict[bytes, float]:
    """For each word: the logarithm of its share of good documents over that of bad ones, in the halves given, within BOUND."""
    good, bad = (1 + sum(sizes.get((q, h), 0) for h in halves) for q in (1, 0))
    told = lambda r: math.log((1 + sum(r[f"n1{h}"] for h in halves)) / good) - math.log((1 + sum(r[f"n0{h}"] for h in halves)) / bad)
    return {bytes(r["word"]): max(-BOUND, min(BOUND, told(r))) for r in words}


def scorer(model: BradleyTerry | None, threshold: float, name: str) -> Callable[[pa.RecordBatch], dict]:
    def columns(batch: pa.RecordBatch) -> dict:
        x = np.array([features(t.as_py(), model.lexicon if model else {}) for t in batch.column("text")])
        return {name: model.score(x, threshold) if model else np.full(len(x), threshold)}

    return columns


def score(docs: DataFrame, model: BradleyTerry | None, threshold: float = 0.3) -> DataFrame:
    """docs with all its columns and, last, __score, 0 to 1, from the whole text alone.

    Where docs has a column __score, the new one has underscores after its name until none has it.
    Null and empty texts have all features zero and are scored by them. Without a model every score is the threshold. Repeated
    rows get equal scores; an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    (name,) = fresh(docs, "__score")
    return add_columns(docs, scorer(model, threshold, name), f"{name} double")

"""Language identification by a byte convolutional network.

Texts (A-Z in lower case) are cut into windows of a fixed number of bytes. Filters of several widths slide over the bytes, each
filter's largest response in the window is a feature, and a softmax over the features gives the window's languages; a text's are
the mean over its windows, weighted by their bytes. The network is trained in numpy. A filter's response is a sum of one number
for each byte it covers, so for prediction the sums for two neighbouring bytes are tabulated beforehand; the result is the same.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofline.llm.common import add_columns, fresh, prepare

#: A letter, or one of the few other signs that regular expressions count as parts of words.
LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """Whether a character is a letter by Unicode; numerals such as \u00b2, \u00bd and \u2167 are none."""
    found = LETTER.search(text)
    return bool(found) and (found.group().isalpha() or any(map(str.isalpha, text)))


@dataclass
class Network:
    """Weights: for each width an array [offset, byte, filter]; then the dense layer."""

    langs: list[str]
    filters: list[np.ndarray]
    bias: np.ndarray
    dense: np.ndarray
    out_bias: np.ndarray
    window: int
    pairs: list = field(default_factory=list, repr=False)

    def tabulate(self) -> None:
        """For each width, the tables of responses to byte pairs, and that for a last single byte."""
        for weights in self.filters:
            width = len(weights)
            two = [(weights[o][:, None, :] + weights[o + 1][None, :, :]).reshape(65536, -1) for o in range(0, width - 1, 2)]
            self.pairs.append((width, two, weights[width - 1] if width % 2 else None))

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """windows: bytes [n, window], padded with zeros."""
        if not self.pairs:
            self.tabulate()
        n = len(windows)
        pair = windows[:, :-1].astype(np.int32) * 256 + windows[:, 1:]
        features = []
        for width, two, single in self.pairs:
            span = self.window - width + 1
            response = None
            for i, values in enumerate(two):
                part = values.take(pair[:, 2 * i : 2 * i + span].ravel(), axis=0)
                response = part if response is None else np.add(response, part, out=response)
            if single is not None:
                response += single.take(windows[:, width - 1 : width - 1 + span].ravel(), axis=0)
            features.append(response.reshape(n, span, -1).max(axis=1))
        hidden = np.maximum(np.concatenate(features, axis=1) + self.bias, 0)
        return softmax(hidden @ self.dense + self.out_bias)

    def predict(self, texts: list[bytes], rows: int = 2048) -> np.ndarray:
        """Probabilities of each text's languages: the weighted mean over all its windows."""
        counts = [max(1, -(-len(t) // self.window)) for t in texts]
        total = np.zeros((len(texts), len(self.langs)))
        owner = np.repeat(np.arange(len(texts)), counts)
        padded = b"".join(t.ljust(c * self.window, b"\0") for t, c in zip(texts, counts, strict=True))
        windows = np.frombuffer(padded, np.uint8).reshape(-1, self.window)
        for at in range(0, len(windows), rows):
            part = windows[at : at + rows]
            weight = np.maximum((part != 0).sum(axis=1), 1)[:, None]
            np.add.at(total, owner[at : at + rows], self.probabilities(part) * weight)
        return total / total.sum(axis=1, keepdims=True)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(windows: np.ndarray, labels: np.ndarray, langs: list[str], widths: tuple[int, ...] = (2, 3, 4), filters: int = 16, steps: int = 500, batch: int = 128, rate: float = 0.01, seed: int = 0) -> Network:
    """Adam on the cross entropy of single windows, with balanced languages."""
    rng = np.random.default_rng(seed)
    n_features, size = len(widths) * filters, windows.shape[1]
    weights = [rng.normal(0, 0.3, (w, 256, filters)).astype(np.float32) for w in widths]
    net = Network(langs, weights, np.zeros(n_features, np.float32), rng.normal(0, 0.2, (n_features, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32), size)
    params = [*net.filters, net.bias, net.dense, net.out_bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    of_lang = [np.flatnonzero(labels == k) for k in range(len(langs))]
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(rows, -(-batch // len(langs))) for rows in of_lang if len(rows)])
        x, y = windows[pick], labels[pick]
        n = len(x)
        pooled, best = [], []
        for w in net.filters:
            span = size - len(w) + 1
            response = sum(w[o].take(x[:, o : o + span], axis=0) for o in range(len(w)))
            best.append(response.argmax(axis=1))
            pooled.append(np.take_along_axis(response, best[-1][:, None, :], axis=1)[:, 0, :])
        before = np.concatenate(pooled, axis=1) + net.bias
        hidden = np.maximum(before, 0)
        error = softmax(hidden @ net.dense + net.out_bias)
        error[np.arange(n), y] -= 1
        error /= n
        back = (error @ net.dense.T) * (before > 0)
        grads = []
        for i, w in enumerate(net.filters):
            g, part = np.zeros_like(w), back[:, i * filters : (i + 1) * filters]
            for o in range(len(w)):
                seen = np.take_along_axis(x, best[i] + o, axis=1)
                np.add.at(g[o], (seen, np.arange(filters)[None, :]), part)
            grads.append(g)
        grads += [back.sum(axis=0), hidden.T @ error, error.sum(axis=0)]
        for p, g, a, b in zip(params, grads, first, second, strict=True):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return net


def fit(docs: DataFrame, learn: Column | None = None, per_lang: int = 1500, windows_per_doc: int = 4, window: int = 128, most_langs: int = 200) -> Network | None:
    """Train on a bounded sample of the rows with a text, a non-null lang and a true `learn`: at most per_lang different documents
    of each language, chosen by a hash of the text, and windows_per_doc windows spread over each. None if there is no such row.

    Of more than most_langs languages, the most frequent are learned (of equally frequent ones, those first in order). The same
    rows give the same network, however they are dealt to tasks.
    """
    rows = docs.where("lang is not null and text is not null and length(trim(text)) > 0")
    rows = rows if learn is None else rows.where(learn)
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_langs).collect()}
    if not counts:
        return None
    langs = sorted(counts)
    rate = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, per_lang / counts[k]))])
    mark = F.pmod(F.xxhash64("text", F.lit(9)), F.lit(1 << 30))
    chosen = rows.where(F.col("lang").isin(langs) & (mark < F.try_element_at(rate, F.col("lang")) * (1 << 30)))
    cuts = [F.substring("text", F.greatest(F.lit(1), (F.length("text") - window) * i / max(1, windows_per_doc - 1)).cast("int"), F.lit(window)) for i in range(windows_per_doc)]
    # copies of a document are one, so that they push out no other
    once = chosen.select("lang", mark.alias("mark"), F.array(*cuts).alias("cuts")).distinct()
    quota = once.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("mark", "cuts"))).where(F.col("n") <= per_lang)
    sample = sorted(quota.select("lang", "mark", "cuts").collect())
    encoded = [(langs.index(r["lang"]), as_bytes(c)[:window]) for r in sample for c in dict.fromkeys(r["cuts"]) if c and has_letter(c)]
    if not encoded:
        return None
    x = np.frombuffer(b"".join(b.ljust(window, b"\0") for _, b in encoded), np.uint8).reshape(-1, window)
    return train(x, np.array([k for k, _ in encoded]), langs)


def as_bytes(text: str) -> bytes:
    return text.encode("utf-8", "replace").lower().replace(b"\0", b" ")


def predictor(net: Network | None, lang_name: str, score_name: str) -> Callable[[pa.RecordBatch], dict]:
    def columns(batch: pa.RecordBatch) -> dict:
        texts = batch.column("text").to_pylist()
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        rows = [i for i, t in enumerate(texts) if net and t and has_letter(t)]
        at = 0
        while at < len(rows):  # texts of some MB together
            size, end = 0, at
            while end < len(rows) and (end == at or size < 1 << 20):
                size += len(texts[rows[end]])
                end += 1
            p = net.predict([as_bytes(texts[i]) for i in rows[at:end]])
            for i, k, score in zip(rows[at:end], p.argmax(axis=1), p.max(axis=1), strict=True):
                langs[i], scores[i] = net.langs[k], float(score)
            at = end
        return {lang_name: langs, score_name: scores}

    return columns


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """docs with all its columns and, last, __lang_pred and __score (0 to 1).

    Where docs has such columns, the new ones have underscores after their names until none has them.
    Every byte of a text counts. A text that is null or has no letter is `und` with score 0, as is every text if nothing was
    learned. Repeated rows get equal results; an empty table gives no rows. Only text is read.
    """
    prepare(docs.sparkSession)
    lang, score = fresh(docs, "__lang_pred", "__score")
    return add_columns(docs, predictor(net, lang, score), f"{lang} string, {score} double")


def drop_unidentified(docs: DataFrame, net: Network | None, min_score: float = 0.3) -> DataFrame:
    """The rows of docs whose language is identified: not `und`, and with a score of min_score or more."""
    found = predict(docs, net)
    lang, score = found.columns[-2:]
    return found.where((F.col(lang) != "und") & (F.col(score) >= min_score)).select(*docs.columns)

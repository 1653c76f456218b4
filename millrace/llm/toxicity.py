"""Toxicity by multiple-instance learning: documents carry labels, sentences carry the blame.

A sentence's probability is logistic in its words (and their first letters, so that
unseen forms of a stem count); a document is toxic if any sentence is, combined by
noisy-or. The weights are trained from document labels alone, by gradient descent through
the noisy-or; its evidence, the sum of ``-log(1 - p)``, is then calibrated on the same
documents. Only text is an input of a score.

Training takes at most ``SAMPLE`` labelled documents outside the held-out fold, in the
order of a hash of doc_id: one pass counts features by class on the executors, a second
makes those documents' sentences lists of the ``VOCABULARY`` most telling features. The driver
gets at most ``SAMPLE`` rows of them, and ``ENTRIES`` features in all: equal rows are one, and a
document of more than ``LONGEST`` features is not trained on. Scoring covers every whole text.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import flat_map_rows, fold, map_rows
from millrace.session import cut

SAMPLE, VOCABULARY, HELD_OUT, THRESHOLD = 16_000, 2048, (3, 1), 0.7
ENTRIES, LONGEST = 16_000_000, 1_000_000
STEMS = (4, 5, 6, 7)
PARTS = re.compile(r"[^.!?\n]*[.!?\n]*")
#: Bytes: letters in lower case, the ends of sentences as line feeds, all else as spaces.
MAP = bytes(c + 32 if 65 <= c <= 90 else 10 if c in b".!?\n" else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def sentences(text: str | None) -> list[list[bytes]]:
    """Words of each sentence that has one."""
    return [w for s in (text or "").encode("utf-8", "surrogatepass").translate(MAP).split(b"\n") if (w := s.split())]


def word_features(word: bytes) -> list[bytes]:
    """The word and its stems; a stem ends in a star."""
    return [word, *(word[:n] + b"*" for n in STEMS if len(word) >= n)]


def sampled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """``h, text, toxic`` of the sampled labelled rows; the sample's ids (at most ``sample`` longs) are broadcast. Equal rows have one ``h``."""
    m, out = HELD_OUT
    known = labels.where("doc_id is not null and toxic is not null").where(fold("doc_id", m) != out)
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select(F.xxhash64("doc_id", "text").alias("h"), "text", "toxic")


def vocabulary(train: DataFrame, size: int = VOCABULARY) -> list[bytes]:
    """Features with the most information on the class, by document counts."""

    def make():
        def one(text, toxic):
            seen = {f for s in sentences(text) for w in s for f in word_features(w)}
            return [(f, int(toxic)) for f in seen]

        return one

    by = flat_map_rows(train.select("text", "toxic"), make, "f binary, toxic int").groupBy("f").agg(F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg"))
    n = train.agg(F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg")).first()
    pos, neg = n.pos or 0, n.neg or 0
    if not pos or not neg:
        return []
    a, b = (F.col("pos") + 0.05) / (pos + 0.1), (F.col("neg") + 0.05) / (neg + 0.1)
    telling = F.abs(F.log(a / b)) * F.abs(a - b)
    rows = by.where("pos + neg >= 4").orderBy(telling.desc(), "f").limit(size).collect()
    return sorted(bytes(r.f) for r in rows)


def bags(train: DataFrame, words: list[bytes], sample: int = SAMPLE, most: int = ENTRIES, longest: int = LONGEST):
    """The training documents' sentences as sparse rows: ``(sentence of entry, feature of entry, document of sentence, times, empties, y)``.

    In the order of their hashes, as many documents as ``sample`` and ``most`` features allow.
    """
    number = {w: i for i, w in enumerate(words)}

    def make():
        def one(h, text, toxic):
            found, empty = Counter(), 0
            for s in sentences(text):
                ids = sorted(number[f] for w in s for f in word_features(w) if f in number)
                if ids:
                    found[tuple(ids)] += 1
                else:
                    empty += 1
            pack = lambda x: np.fromiter(x, "<i4").tobytes()
            return (h, int(toxic), empty, sum(map(len, found)), pack(f for k in found for f in k), pack(map(len, found)), pack(found.values()))

        return one

    rows = cut(map_rows(train, make, "h long, y int, empty long, n long, features binary, lengths binary, times binary").dropDuplicates(["h"]))
    sizes = rows.where(F.col("n") <= longest).select("h", "n").orderBy("h").limit(sample).collect()
    last = int(np.searchsorted(np.cumsum([r.n for r in sizes] or [0]), most, "right"))
    if not sizes or not last:
        return None
    got = rows.where((F.col("n") <= longest) & (F.col("h") <= sizes[min(last, len(sizes)) - 1].h)).orderBy("h").collect()
    ints = lambda name: [np.frombuffer(r[name], "<i4").astype(np.int64) for r in got]
    lengths = ints("lengths")
    doc = np.repeat(np.arange(len(got)), [len(x) for x in lengths])
    entry = np.repeat(np.arange(len(doc)), np.concatenate(lengths))
    return entry, np.concatenate(ints("features")), doc, np.concatenate(ints("times")), np.array([r.empty for r in got], np.int64), np.array([r.y for r in got], np.int64)


def softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, x)


def loss_and_gradient(w: np.ndarray, data) -> tuple[float, np.ndarray]:
    """The documents' mean loss under noisy-or, and its slope by the weights and the bias (the last of ``w``)."""
    entry, feature, doc, times, empty, y = data
    size, n_docs, n_sent = len(w) - 1, max(1, len(y)), len(doc)
    z = w[-1] + np.bincount(entry, w[feature], n_sent)
    evidence = np.maximum(np.bincount(doc, times * softplus(z), len(y)) + empty * softplus(w[-1]), 1e-9)
    p = -np.expm1(-evidence)
    loss = np.where(y == 1, -np.log(p), evidence).sum() / n_docs
    slope = np.where(y == 1, -(1.0 - p) / p, 1.0) / n_docs  # of the loss by a document's evidence
    d = times * slope[doc] / (1.0 + np.exp(-z))
    return float(loss), np.append(np.bincount(feature, d[entry], size), d.sum() + (slope * empty).sum() / (1.0 + math.exp(-w[-1])))


def fit_noisy_or(data, size: int, steps: int = 300, rate: float = 0.1, ridge: float = 0.3) -> tuple[np.ndarray, float]:
    """Weights and bias that maximise the documents' likelihood under noisy-or (Adam on the whole sample)."""
    n_docs = max(1, len(data[-1]))
    w = np.zeros(size + 1)
    w[-1] = -5.0
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        _, g = loss_and_gradient(w, data)
        g[:-1] += ridge / n_docs * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w[-1] = min(w[-1], -3.0)
    return w[:-1], float(w[-1])


def calibrate(evidence: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """``a, c`` of ``1 / (1 + exp(-(a log(evidence) + c)))``, by Newton steps with a light ridge."""
    x = np.column_stack([np.log(evidence + 1e-3), np.ones(len(y))])
    k = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ k, -30, 30)))
        h = x.T @ (x * (p * (1 - p))[:, None]) + 1e-2 * np.eye(2)
        k -= np.linalg.solve(h, x.T @ (p - y) + 1e-2 * (k - [1.0, 0.0]))
    return max(1e-3, float(k[0])), float(k[1])


class Model:
    """Weights by feature, the bias, and the calibration of the evidence."""

    def __init__(self, words: list[bytes], weights: np.ndarray, bias: float, a: float, c: float):
        self.weights = {w: float(x) for w, x in zip(words, weights, strict=True) if abs(x) > 1e-6}
        self.bias, self.a, self.c = bias, a, c

    def lookup(self, most: int = 400_000):
        """A cache of words' weights; it starts anew when full."""
        weights = self.weights

        class Cache(dict):
            def __missing__(self, word):
                if len(self) >= most:
                    self.clear()
                x = self[word] = sum(weights.get(f, 0.0) for f in word_features(word))
                return x

        return Cache().__getitem__

    def score(self, evidence: float) -> float:
        z = self.a * math.log(evidence + 1e-3) + self.c
        return 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))

    def evidence(self, text: str | None, get) -> float:
        rest = math.log1p(math.exp(self.bias))
        total = 0.0
        for s in (text or "").encode("utf-8", "surrogatepass").translate(MAP).split(b"\n"):
            if x := s.split():
                z = sum(map(get, x)) + self.bias
                total += rest if z == self.bias else max(z, 0.0) + math.log1p(math.exp(-abs(z)))
        return total

    def offending(self, text: str, get, least: float = 0.3) -> list[tuple[int, int, float]]:
        """``(start, end, p)`` in code points of the sentences to blame, the worst first."""
        out = []
        for m in PARTS.finditer(text):
            words = m[0].encode("utf-8", "surrogatepass").translate(MAP).split()
            if words and (p := 1 / (1 + math.exp(-min(500, max(-500, sum(map(get, words)) + self.bias))))) >= least:
                out.append((m.start(), m.end(), p))
        return heapq.nsmallest(len(out), out, key=lambda x: (-x[2], x[0]))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """None where the sample lacks a class."""
    rows = sampled(docs, labels, sample)
    words = vocabulary(rows)
    if not words:
        return None
    data = bags(rows, words, sample)
    if data is None:
        return None
    w, b = fit_noisy_or(data, len(words))
    entry, feature, doc, times, empty, y = data
    z = b + np.bincount(entry, w[feature], len(doc))
    evidence = np.bincount(doc, times * softplus(z), len(y)) + empty * softplus(np.array(b))
    return Model(words, w, b, *calibrate(evidence, y))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """Per row: ``doc_id, held_out, score, predicted, offending`` (spans of sentences, only where predicted is 1).

    Null and empty texts have no evidence and a score near 0; without a model every score
    is 0. A null doc_id gives a null held_out. Extra columns are ignored.
    """

    def make():
        get = model.lookup() if model else None

        def one(i, held, text):
            s = model.score(model.evidence(text, get)) if model else 0.0
            hit = s >= THRESHOLD
            return (i, held, s, int(hit), model.offending(text, get) if hit else [])

        return one

    m, out = HELD_OUT
    own = docs.select("doc_id", (fold("doc_id", m) == out).alias("held_out"), "text")
    return map_rows(own, make, "doc_id long, held_out boolean, score double, predicted int, offending array<struct<start:long,end:long,p:double>>")


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    return score(docs, train(docs, labels, sample))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows predicted toxic; a row is judged by its own text.

    Null and empty texts have no evidence and stay, rows that repeat stay or go alike, and
    without both classes among the labels all stay. All columns stay, whatever their names.
    """
    model = train(docs, labels)
    if model is None:
        return docs
    at = docs.columns.index("text")

    def make():
        get = model.lookup()
        return lambda *row: [row] if model.score(model.evidence(row[at], get)) < THRESHOLD else []

    return flat_map_rows(docs, make, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))

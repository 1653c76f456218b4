"""Quality rules with isolation forests on rule statistics.

``statistics`` counts each rule over the whole text; ratios of these counts are a document's
rule statistics. Each statistic has a forest of its own and all together have one more. A
tree splits a small subsample at random, statistic and cut alike; documents that random
splits isolate after short paths are anomalous. Labels set thresholds only: for each forest
the anomaly from which rejecting pays on rows that ``labels.quality`` marks, the forest that pays
most first and the others on what it leaves; forests that do not pay reject nothing. (In one forest
over all statistics a tenth of bad rows is a cluster that random splits do not isolate,
while rare but harmless values of another statistic are isolated at once.)

Fitting takes at most ``SAMPLE`` labelled rows (in the order of a hash of doc_id); statistics
and verdicts cover every row.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import map_rows
from millrace.session import cut, ship

SAMPLE, TREES, SUBSAMPLE, SEED = 20_000, 64, 256, 7
#: A wrongly rejected good document weighs this many times a wrongly kept bad one.
REJECT_COST = 8.0
SYMBOLS, SPACES = b"#*$%&|<>", b" \t\n\x0b\x0c\r"
CAPITALS, ASCII_LETTERS, SHOUTS = bytes(range(65, 91)), bytes([*range(65, 91), *range(97, 123)]), b"!?"
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_capitals long, n_letters long, n_shouts long, n_distinct long, n_lines long"
FEATURES = 7


def repeated_words(words: list[bytes], window: int = 3) -> int:
    """Words that lie in a 3-word window found twice or more."""
    n = len(words)
    if n <= window:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    pair = ids[:-2] * len(number) + ids[1:-1]
    if len(number) > 2_000_000:  # three factors would not fit in 63 bits
        pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    triple = pair * len(number) + ids[2:]
    order = np.argsort(triple, kind="stable")
    same = triple[order][1:] == triple[order][:-1]
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(window):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def statistics(text: str | None) -> tuple[int, ...]:
    """The counts of ``COUNTS``; null has none."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    without = lambda chars: len(raw) - len(raw.translate(None, chars))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (
        len(words),
        len(text) - without(SPACES),
        without(SYMBOLS),
        len(lines) - len(set(lines)),
        repeated_words(words),
        without(CAPITALS),
        without(ASCII_LETTERS),
        without(SHOUTS),
        len(set(words)),
        len(lines),
    )


def base_failed(p: pd.DataFrame) -> pd.Series:
    return (p.n_words < 50) | (100 * p.n_repeat_words > 50 * p.n_words)


def features(p: pd.DataFrame) -> np.ndarray:
    """Ratios that do not depend on a text's length; short texts are smoothed towards ordinary values."""
    n, chars = p.n_words.to_numpy(float), p.word_chars.to_numpy(float)
    ratio = lambda a, b, prior=0.0, weight=20.0: (a.to_numpy(float) + prior * weight) / (b + weight)
    return np.column_stack([
        ratio(p.word_chars, n, 5.5),
        np.minimum(1.0, ratio(p.n_symbols, n)),
        ratio(p.n_dup_lines, p.n_lines.to_numpy(float), 0.0, 2.0),
        ratio(p.n_repeat_words, n),
        ratio(p.n_capitals, p.n_letters.to_numpy(float), 0.02, 50.0),
        ratio(p.n_shouts, chars, 0.0, 50.0),
        np.minimum(1.0, ratio(p.n_distinct, np.sqrt(n * 50.0), 1.0, 10.0)),
    ])


def path_norm(n: float) -> float:
    """Mean path length of an unsuccessful search in a binary search tree of n points."""
    return 0.0 if n <= 1 else 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n if n > 2 else 1.0


class IsolationForest:
    """Trees as flat arrays: feature (-1: leaf), cut, left child, right child, and path length at leaves."""

    def __init__(self, x: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.size = min(subsample, len(x))
        depth = max(1, math.ceil(math.log2(max(2, self.size))))
        self.trees = [self._grow(x[rng.choice(len(x), self.size, replace=False)], depth, rng) for _ in range(trees)]

    def _grow(self, x: np.ndarray, limit: int, rng: np.random.Generator):
        feature, cut_at, left, right, length = [], [], [], [], []

        def node(rows: np.ndarray, depth: int) -> int:
            me = len(feature)
            for column, value in ((feature, -1), (cut_at, 0.0), (left, me), (right, me), (length, depth + path_norm(len(rows)))):
                column.append(value)
            low, high = rows.min(axis=0), rows.max(axis=0)
            if depth < limit and len(rows) > 1 and (open_ := np.flatnonzero(high > low)).size:
                f = int(rng.choice(open_))
                c = float(rng.uniform(low[f], high[f]))
                below = rows[:, f] < c
                if below.any() and not below.all():
                    feature[me], cut_at[me] = f, c
                    left[me], right[me] = node(rows[below], depth + 1), node(rows[~below], depth + 1)
            return me

        node(x, 0)
        return tuple(np.array(a) for a in (feature, cut_at, left, right, length))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly in (0, 1): 2 ** (- mean path length / expected length)."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, cut_at, left, right, length in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                below = x[rows, np.where(inner, f, 0)] < cut_at[at]
                at = np.where(inner, np.where(below, left[at], right[at]), at)
            total += length[at]
        return 2.0 ** (-total / len(self.trees) / max(path_norm(self.size), 1.0))


def calibrate(score: np.ndarray, good: np.ndarray) -> float:
    """The score from which rejecting costs least on labelled rows; infinite if nothing is gained."""
    order = np.argsort(-score, kind="stable")
    s, g = score[order], good[order].astype(bool)
    gain = np.cumsum(np.where(g, -REJECT_COST, 1.0))
    ends = np.append(s[:-1] != s[1:], True) if len(s) else np.zeros(0, bool)  # ties go together
    gain = np.where(ends, gain, -np.inf)
    if not len(gain) or gain.max() <= 0:
        return math.inf
    k = int(gain.argmax())
    return float(s[k] + s[k + 1]) / 2 if k + 1 < len(s) else float(s[k])


class Verdict:
    """Forests by the statistics that they see, and their thresholds."""

    def __init__(self, x: np.ndarray, good: np.ndarray):
        n = x.shape[1]
        every = [([k], IsolationForest(x[:, [k]], seed=SEED + 1 + k)) for k in range(n)] + [(list(range(n)), IsolationForest(x))]
        scores = [f.score(x[:, c]) for c, f in every]
        self.rules: list[tuple[list[int], IsolationForest, float]] = []
        left = np.ones(len(x), bool)
        while True:
            best = (0.0, 0, math.inf)
            for k, s in enumerate(scores):
                t = calibrate(s[left], good[left])
                hit = left & (s >= t)
                best = max(best, (float((~good[hit]).sum() - REJECT_COST * good[hit].sum()), -k, t))
            if best[0] <= 0:
                break
            _, k, t = best
            self.rules.append((*every[-k], t))
            left &= scores[-k] < t

    def anomaly(self, x: np.ndarray) -> np.ndarray:
        """The largest of the forests' scores, each as a share of its threshold: 1 or more is rejected."""
        return np.max([f.score(x[:, c]) / t for c, f, t in self.rules], axis=0) if self.rules and len(x) else np.zeros(len(x))


def quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per row of ``docs``: doc_id, the counts, base_failed, kept and the anomaly.

    Null or empty text has no words and fails the base rule. Rows of ``labels`` without a
    doc_id or quality are ignored; without any usable label nothing is rejected.
    Null doc_ids and repeated rows are scored like any other, ties alike. Extra columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    counted = cut(map_rows(docs.select("doc_id", "text"), lambda: lambda i, t: (i, *statistics(t)), "doc_id long, " + COUNTS))
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = counted.join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", *[c.split()[0] for c in COUNTS.split(", ")]).limit(sample).toPandas()
    model = None
    rows = rows[~base_failed(rows)]  # the base rule has judged the others
    if len(rows) >= 16:
        model = Verdict(features(rows), rows.quality.to_numpy() == 1)

    def judge(batches):
        for p in batches:
            p["base_failed"] = base_failed(p)
            p["anomaly"] = model.anomaly(features(p)) if model is not None else 0.0
            p["kept"] = ~p.base_failed & (p.anomaly < 1.0)
            yield p

    # doc_id travels as text: a null among longs would make pandas turn all of them into floats
    out = counted.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(judge, "doc_id string, " + COUNTS + ", base_failed boolean, anomaly double, kept boolean")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))

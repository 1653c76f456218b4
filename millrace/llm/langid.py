"""Language ID by a byte convolutional network.

Texts, A-Z lower-cased, are cut into windows of ``WINDOW`` bytes. Filters of widths 2, 3
and 4 over bytes, the maximum of each over a window, and softmax give a window's
languages; a text's are the mean of its windows', weighted by their bytes, with a share
for how it opens that is chosen on the training rows (texts go on in other languages). Training is
plain numpy (Adam) on at most ``QUOTA`` documents of a language (fewer where languages
are so many that all would exceed ``DOCUMENTS``; each learned value keeps some) and ``CROPS`` windows of
each; prediction covers every window of every text. For speed the filters are applied as
sums of tables over byte pairs, which is the same network.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import flat_map_rows, fold, slices
from millrace.session import ship

WINDOW, WIDTHS, FILTERS, HELD_OUT = 128, (2, 3, 4), 8, (5, 0)
#: At most so many documents of a language are learned from, so many windows of each, and so many documents in all, shared evenly.
QUOTA, CROPS, DOCUMENTS, SEED = 1200, 4, 200_000, 5
STEPS, BATCH, RATE = 500, 128, 0.01
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """Whether any character is a letter (the pattern also finds numerals such as superscripts)."""
    m = LETTER.search(text)
    return bool(m) and (m[0].isalpha() or any(map(str.isalpha, text)))


def windows(raw: bytes) -> np.ndarray:
    """The bytes as rows of ``WINDOW``, the last padded with zeros."""
    n = -(-len(raw) // WINDOW)
    return np.frombuffer(raw.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


class Network:
    """Filters ``w[width]`` (width, 256, FILTERS), their biases, and the dense layer."""

    def __init__(self, classes: list[str], seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.classes, self.opening = classes, 0.0
        self.p = {f"w{k}": rng.normal(0, 0.1, (k, 256, FILTERS)) for k in WIDTHS}
        for k in WIDTHS:
            self.p[f"w{k}"][:, 0] = 0.0  # padding
        self.p |= {"b": np.zeros(len(WIDTHS) * FILTERS), "v": rng.normal(0, 0.3, (len(WIDTHS) * FILTERS, len(classes))), "c": np.zeros(len(classes))}

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, seed: int = SEED) -> None:
        """Adam on batches with as many windows of each language, cut to random lengths."""
        rng = np.random.default_rng(seed)
        by = [np.flatnonzero(y == c) for c in range(len(self.classes))]
        m, s = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        for t in range(1, steps + 1):
            label = rng.integers(0, len(by), BATCH)
            batch = x[[by[c][rng.integers(len(by[c]))] for c in label]].copy()
            keep = np.exp(rng.uniform(np.log(8), np.log(WINDOW), BATCH)).astype(int)
            for row, n in zip(batch, keep, strict=True):
                row[n:] = 0
            grad = self._gradient(batch, label)
            for k, g in grad.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.999 * s[k] + 0.001 * g * g
                self.p[k] -= RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)

    def fit_opening(self, x: np.ndarray, y: np.ndarray, doc: np.ndarray) -> None:
        """The share of a document's first window that gets most training documents right; ``doc`` numbers each row's document."""
        q = self.probabilities(x, self.tables())
        first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        mean = np.add.reduceat(q, first) / np.diff(np.append(first, len(doc)))[:, None]
        shares = np.arange(0.0, 0.51, 0.05)
        right = [(((1 - a) * mean + a * q[first]).argmax(axis=1) == y[first]).sum() for a in shares]
        self.opening = float(shares[int(np.argmax(right))])

    def _gradient(self, x: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.p, len(x)
        pooled, where = [], []
        for k in WIDTHS:
            span = WINDOW - k + 1
            conv = sum(p[f"w{k}"][o][x[:, o : o + span]] for o in range(k))
            at = conv.argmax(axis=1)
            where.append(at)
            pooled.append(np.take_along_axis(conv, at[:, None], 1)[:, 0])
        pre = np.concatenate(pooled, axis=1) + p["b"]
        h = np.maximum(pre, 0)
        z = h @ p["v"] + p["c"]
        q = np.exp(z - z.max(axis=1, keepdims=True))
        q /= q.sum(axis=1, keepdims=True)
        q[np.arange(n), label] -= 1
        q /= n
        dh = (q @ p["v"].T) * (pre > 0)
        g = {"v": h.T @ q + 1e-4 * p["v"], "c": q.sum(axis=0), "b": dh.sum(axis=0)}
        f = np.arange(FILTERS)
        for j, k in enumerate(WIDTHS):
            d, at = dh[:, j * FILTERS : (j + 1) * FILTERS], where[j]
            g[f"w{k}"] = 1e-5 * p[f"w{k}"]
            for o in range(k):
                np.add.at(g[f"w{k}"][o], (x[np.arange(n)[:, None], at + o], f[None, :]), d)
            g[f"w{k}"][:, 0] = 0.0
        return g

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Sums of the filters' weights for byte pairs: columns for width 2, the first two of 3 and 4, the last two of 4; and the last of 3."""
        p = self.p
        pair = lambda w, o: (w[o][:, None, :] + w[o + 1][None, :, :]).reshape(65536, FILTERS)
        return np.hstack([pair(p["w2"], 0), pair(p["w3"], 0), pair(p["w4"], 0), pair(p["w4"], 2)]).astype(np.float32), p["w3"][2].astype(np.float32)

    def probabilities(self, x: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        z = self.logits(x, tables).astype(np.float64)
        q = np.exp(z - z.max(axis=1, keepdims=True))
        return q / q.sum(axis=1, keepdims=True)

    def logits(self, x: np.ndarray, tables: tuple[np.ndarray, np.ndarray], rows: int = 64) -> np.ndarray:
        two, last = tables
        out = np.empty((len(x), len(self.classes)), np.float32)
        k = FILTERS
        for i in range(0, len(x), rows):
            b = x[i : i + rows]
            g = two[b[:, :-1].astype(np.int32) * 256 + b[:, 1:]]
            h = np.concatenate([
                g[:, :, :k].max(axis=1),
                (g[:, :-1, k : 2 * k] + last[b[:, 2:]]).max(axis=1),
                (g[:, :-2, 2 * k : 3 * k] + g[:, 2:, 3 * k :]).max(axis=1),
            ], axis=1)
            out[i : i + rows] = np.maximum(h + self.p["b"], 0) @ self.p["v"] + self.p["c"]
        return out


def training(docs: DataFrame, quota: int = QUOTA, most: int = DOCUMENTS) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Languages, windows, their languages, and numbers of their documents; equal rows are one document.

    One row per language reaches the driver and is broadcast. A hash thins large languages to
    about twice their quota before a window over what is left takes the first by that hash.
    """
    m, out = HELD_OUT
    known = docs.select("doc_id", "text", "lang").where("lang is not null and text is not null").where(fold("doc_id", m) != out)
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    none = [], np.empty((0, WINDOW), np.uint8), np.empty(0, int), np.empty(0, int)
    if not counts:
        return none
    quota = max(1, min(quota, most // len(counts)))
    shares = docs.sparkSession.createDataFrame([(lang, min(1.0, (2 * quota + 20) / n)) for lang, n in counts.items()], "lang string, _share double")
    chosen = known.join(F.broadcast(shares), "lang").withColumn("_h", F.xxhash64("doc_id", "text", "lang"))
    chosen = chosen.where(F.pmod("_h", F.lit(1 << 20)) < F.col("_share") * (1 << 20)).select("_h", "lang", "text")

    def make():
        def one(h, lang, text):
            if not has_letter(text):
                return []
            x = windows(text.encode("utf-8", "surrogatepass").translate(LOWER))
            at = sorted({int(k) for k in np.linspace(0, len(x) - 1, CROPS)}) if len(x) else []
            return [(h, lang, x[at].tobytes())]

        return one

    each = flat_map_rows(chosen, make, "h long, lang string, x binary").dropDuplicates(["h", "lang"])
    ranked = each.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("n") <= quota)
    rows = sorted(ranked.select("h", "lang", "x").collect(), key=lambda r: (r.lang, r.h))
    if not rows:
        return none
    classes = sorted({r.lang for r in rows})
    number = {c: i for i, c in enumerate(classes)}
    lengths = [len(r.x) // WINDOW for r in rows]
    x = np.frombuffer(b"".join(bytes(r.x) for r in rows), np.uint8).reshape(-1, WINDOW)
    return classes, x, np.repeat([number[r.lang] for r in rows], lengths), np.repeat(np.arange(len(rows)), lengths)


def train(docs: DataFrame) -> Network | None:
    classes, x, y, doc = training(docs)
    if not classes:
        return None
    net = Network(classes)
    net.fit(x, y)
    net.fit_opening(x, y, doc)
    return net


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """Per row: ``doc_id, held_out, lang_pred, score``.

    Null texts and texts without a letter are ``und`` with score 0, as are all without a
    model. A null doc_id gives a null held_out. Repeated rows are each predicted; extra
    columns are ignored.
    """
    ship(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables() if net else None
        for whole in batches:
            for batch in slices(whole):
                lang, score = ["und"] * batch.num_rows, [0.0] * batch.num_rows
                for i, text in enumerate(batch.column(2).to_pylist()) if net else ():
                    if text is None or not has_letter(text):
                        continue
                    raw = text.encode("utf-8", "surrogatepass").translate(LOWER)
                    z, opens, n = np.zeros(len(net.classes)), 0.0, -(-len(raw) // WINDOW)
                    for at in range(0, n, 4096):  # bounds memory for very long texts
                        part = raw[at * WINDOW : (at + 4096) * WINDOW]
                        weight = np.full(-(-len(part) // WINDOW), float(WINDOW))
                        weight[-1] = len(part) - (len(weight) - 1) * WINDOW
                        q = net.probabilities(windows(part), tables)
                        opens = q[0] if at == 0 else opens
                        z += weight @ q
                    z = (1 - net.opening) * z / len(raw) + net.opening * opens
                    k = int(z.argmax())
                    lang[i], score[i] = net.classes[k], min(1.0, float(z[k]))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())], schema=schema)

    m, out = HELD_OUT
    return docs.select("doc_id", (fold("doc_id", m) == out).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def language(docs: DataFrame) -> DataFrame:
    return predict(docs, train(docs))

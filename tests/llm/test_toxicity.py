from zlib import crc32

import numpy as np

from millrace.llm import queries, toxicity
from tests.llm.conftest import bag


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = queries.op4_toxicity_mil(spark, d).collect()
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    out = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(p == y for p, y in out) / len(out) > 0.97
    assert sum(p for p, y in out if not y) / sum(1 - y for _, y in out) < 0.01


def test_labels_of_the_held_out_fold_do_not_matter(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    from pyspark.sql import functions as F

    from millrace.llm.common import fold

    turned = labels.withColumn("toxic", F.when(fold("doc_id", 3) == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (bag(toxicity.toxicity(docs, x).drop("offending")) for x in (labels, turned))
    assert a == b


def test_offending_sentence_is_found(spark):
    rows = [(i, f"Some fine words here. You {'vile' if i % 2 else 'kind'} one. More words follow!", i % 2) for i in range(200)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t, _ in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    for r in toxicity.toxicity(docs, labels).collect():
        assert r.predicted == r.doc_id % 2
        if r.predicted:
            text = rows[r.doc_id][1]
            assert "vile" in text[r.offending[0].start : r.offending[0].end]
    assert toxicity.without_toxic(docs, labels).count() == 100


def test_odd_rows(odd_docs, no_docs, no_labels, spark):
    labels = spark.createDataFrame([(1, 1, 0), (4, 1, 1), (None, 0, 1), (6, None, None), (2, 0, 1)], "doc_id long, quality int, toxic int")
    for known in (labels, no_labels):
        got = bag(toxicity.toxicity(odd_docs, known))
        assert len(got) == 9 and all(0 <= g[2] <= 1 for g in got)
    kept = toxicity.without_toxic(odd_docs, no_labels)
    assert kept.count() == 9 and kept.columns == odd_docs.columns
    assert toxicity.toxicity(no_docs, no_labels).collect() == []


def test_gradient_is_the_slope_of_the_noisy_or_loss():
    r = np.random.default_rng(0)
    entry, doc = np.sort(r.integers(0, 12, 40)), np.sort(r.integers(0, 5, 12))
    data = (entry, r.integers(0, 6, 40), doc, r.integers(1, 4, 12), r.integers(0, 3, 5), np.array([1, 0, 1, 0, 1]))
    w = np.append(r.normal(size=6), -1.0)
    g = toxicity.loss_and_gradient(w, data)[1]
    for k in range(7):
        step = np.eye(7)[k] * 1e-5
        slope = (toxicity.loss_and_gradient(w + step, data)[0] - toxicity.loss_and_gradient(w - step, data)[0]) / 2e-5
        assert abs(slope - g[k]) < 1e-6


def test_what_reaches_the_driver_is_bounded(spark):
    words = [b"vile", b"vile*", b"kind", b"kind*"]
    rows = [(7, "A vile one. " * 5000, 1)] + [(i, f"{'vile' if i % 2 else 'kind'} {i}.", i % 2) for i in range(20, 60)] * 3
    train = spark.createDataFrame(rows, "h long, text string, toxic int")
    entry, feature, doc, times, empty, y = toxicity.bags(train, words, sample=30)
    assert len(y) == 30 and len(doc) == 30 and times.max() == 5000  # equal rows are one, and equal sentences of a document are counted
    few = toxicity.bags(train, words, most=10)
    assert len(few[0]) <= 10 and len(few[-1]) == 5
    assert toxicity.bags(train, words, longest=1) is None  # a row has two features


def test_ties_and_very_long_texts(spark):
    rows = [(i, f"Fine words here. You {'vile' if i % 2 else 'kind'} one.", i % 2) for i in range(200)]
    long = "Fine words here. " * 50_000
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, long + "You vile one."), (901, long), (1, rows[1][1])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    got = sorted((r.doc_id, r.score, r.predicted) for r in toxicity.toxicity(docs, labels).collect())
    by = {i: (s, p) for i, s, p in got}
    assert by[900][1] == 1 and by[901][0] < by[900][0]
    assert [s for i, s, _ in got if i == 1] == [by[3][0]] * 2  # equal texts, equal scores

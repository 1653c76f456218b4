import re
from collections import Counter

import numpy as np

from millrace.llm import quality, queries
from tests.llm.conftest import bag


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_statistics_are_those_of_the_definition():
    for t in (None, "", "a", "a b c", "a b c a b c", "x\nx\n \n \nx y\nx", "é😀 | <b> é😀 | <b>", "a a a a a", "q\u00a0w\x0be\x1cr"):
        assert quality.statistics(t)[:5] == plain(t)


def test_query_is_brute_force_but_for_the_verdict(spark, sf_dir):
    docs = {d.doc_id: d.text for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op1_quality_forest(spark, sf_dir).collect()}
    for i, t in docs.items():
        r, p = got[i], plain(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == p
        assert r.base_failed == (p[0] < 50 or 100 * p[4] > 50 * p[0])
        assert not (r.base_failed and r.kept)


def test_forest_isolates_outliers():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(0, 1, (500, 3)), rng.normal(9, 1, (20, 3))])
    s = quality.IsolationForest(x, trees=64).score(x)
    assert s[500:].min() > np.quantile(s[:500], 0.97)
    good = np.arange(520) < 500
    t = quality.calibrate(s, good)
    assert (s[500:] >= t).mean() > 0.9 and (s[:500] >= t).mean() < 0.02
    assert quality.calibrate(np.ones(5), np.ones(5, bool)) == float("inf")


def test_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    train, test = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    j = quality.quality(docs, train).join(test, "doc_id").where("n_words >= 50").collect()
    good = [r.kept for r in j if r.quality == 1 and not r.base_failed]
    bad = [r.kept for r in j if r.quality == 0]
    assert sum(good) / len(good) > 0.995
    assert sum(bad) / len(bad) < 0.05


def test_odd_rows(odd_docs, no_docs, no_labels, spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (None, 0, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    got = bag(quality.quality(odd_docs, labels).select("doc_id", "n_words", "base_failed", "kept"))
    assert len(got) == 9 and all(g[2] is True and g[3] is False for g in got if g[1] < 50)
    assert next(g for g in got if g[0] == 4)[1:] == (40_000, True, False)
    assert quality.quality(no_docs, no_labels).collect() == []


def test_labels_set_thresholds_only():
    rng = np.random.default_rng(1)
    x = np.column_stack([rng.normal(5, 1, 600), np.zeros(600), np.where(rng.random(600) < 0.03, rng.random(600), 0.0)])
    x[:60, 1] = rng.uniform(0.3, 1, 60)  # a tenth are bad, and some good rows are rarer than they
    good = np.arange(600) >= 60
    v = quality.Verdict(x, good)
    rejected = v.anomaly(x) >= 1
    assert rejected[:60].mean() > 0.95 and rejected[60:].mean() < 0.01
    again = quality.Verdict(x, good | (np.arange(600) < 2))  # fewer labels of bad rows: the same forests, other thresholds
    same = [(f, g) for c, f, _ in v.rules for d, g, _ in again.rules if c == d]
    assert same and all(np.array_equal(a, b) for f, g in same for t, u in zip(f.trees, g.trees) for a, b in zip(t, u))
    assert quality.Verdict(x, np.ones(600, bool)).rules == [] and not quality.Verdict(x, np.ones(600, bool)).anomaly(x).any()


def test_ties_repeated_rows_and_very_long_texts_with_labels(spark):
    fine = " ".join(f"word{k}" for k in range(80))
    noisy = " ".join(f"wo#rd{k} $$$ &&&" for k in range(80))
    rows = [(i, f"{fine} {i}") for i in range(200)] + [(1000 + i, f"{noisy} {i}") for i in range(20)]
    rows += [(5, rows[5][1])] * 3 + [(2000, " ".join(f"word{k}" for k in range(300_000))), (None, noisy)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(200)] + [(1000 + i, 0) for i in range(20)], "doc_id long, quality int")
    got = quality.quality(docs, labels).collect()
    assert len(got) == len(rows)
    assert all(r.kept for r in got if r.doc_id is not None and r.doc_id < 200) and not any(r.kept for r in got if r.doc_id is None or 1000 <= r.doc_id < 2000)
    assert next(r for r in got if r.doc_id == 2000).n_words == 300_000

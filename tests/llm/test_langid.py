from zlib import crc32

import numpy as np

from millrace.llm import langid, queries
from tests.llm.conftest import bag


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = queries.op5_language_cnn(spark, d).collect()
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    out = [r.lang_pred == docs[r.doc_id].lang for r in rows if r.held_out and docs[r.doc_id].n_chars > 40]
    assert len(out) > 100 and sum(out) / len(out) > 0.95


def test_tables_are_the_same_network():
    net = langid.Network(["a", "b", "c"])
    x = np.random.default_rng(1).integers(1, 256, (5, langid.WINDOW)).astype(np.uint8)
    pooled = []
    for k in langid.WIDTHS:
        w = net.p[f"w{k}"]
        conv = np.array([[sum(w[o][row[i + o]] for o in range(k)) for i in range(langid.WINDOW - k + 1)] for row in x])
        pooled.append(conv.max(axis=1))
    z = np.maximum(np.concatenate(pooled, axis=1) + net.p["b"], 0) @ net.p["v"] + net.p["c"]
    assert np.allclose(net.logits(x, net.tables()), z, atol=1e-3)


def test_gradient_is_the_slope_of_the_loss():
    net = langid.Network(["a", "b"])
    rng = np.random.default_rng(2)
    x, y = rng.integers(1, 256, (4, langid.WINDOW)).astype(np.uint8), np.array([0, 1, 1, 0])

    def loss():
        z = net.logits(x, (net.tables()[0].astype(np.float64), net.tables()[1].astype(np.float64)))
        z = z - z.max(axis=1, keepdims=True)
        return -(z - np.log(np.exp(z).sum(axis=1, keepdims=True)))[np.arange(4), y].mean()

    g = net._gradient(x, y)["c"]
    for k in range(2):
        net.p["c"][k] += 1e-2
        up = loss()
        net.p["c"][k] -= 2e-2
        down = loss()
        net.p["c"][k] += 1e-2
        assert abs((up - down) / 2e-2 - g[k]) < 1e-3


def test_whole_text_counts(spark):
    net = langid.Network(["x", "y"])
    text = "a" * 5000 + "zq" * 5000
    docs = spark.createDataFrame([(0, text), (1, text[:5000]), (2, None), (3, "12 34 ! ² ½"), (4, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.predict(docs, net).collect()}
    assert got[0].score != got[1].score
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (2, 3, 4))


def test_odd_rows(odd_docs, no_docs):
    got = bag(langid.language(odd_docs))
    assert len(got) == 9 and sum(g[2] == "und" for g in got) == 4
    assert langid.language(no_docs).collect() == []


def test_gradient_of_filters_and_biases_is_the_slope_of_the_loss():
    net = langid.Network(["a", "b", "c"])
    rng = np.random.default_rng(3)
    x, y = rng.integers(1, 6, (6, langid.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 0, 1, 2])
    for k in net.p:
        net.p[k] = net.p[k] + rng.normal(0, 0.3, net.p[k].shape)
    for k in langid.WIDTHS:
        net.p[f"w{k}"][:, 0] = 0.0

    def loss():
        p, pooled = net.p, []
        for k in langid.WIDTHS:
            pooled.append(sum(p[f"w{k}"][o][x[:, o : o + langid.WINDOW - k + 1]] for o in range(k)).max(axis=1))
        z = np.maximum(np.concatenate(pooled, axis=1) + p["b"], 0) @ p["v"] + p["c"]
        z = z - z.max(axis=1, keepdims=True)
        decay = 0.5e-4 * (p["v"] ** 2).sum() + sum(0.5e-5 * (p[f"w{k}"] ** 2).sum() for k in langid.WIDTHS)
        return -(z - np.log(np.exp(z).sum(axis=1, keepdims=True)))[np.arange(6), y].mean() + decay

    g = net._gradient(x, y)
    checked = 0
    for name in net.p:
        flat = net.p[name].reshape(-1)
        slope = g[name].reshape(-1)
        for at in [*np.argsort(-np.abs(slope))[:6], *rng.integers(0, len(flat), 3)]:
            if name.startswith("w") and at // langid.FILTERS % 256 == 0:
                continue  # padding is fixed
            old = flat[at]
            flat[at] = old + 1e-6
            up = loss()
            flat[at] = old - 1e-6
            down = loss()
            flat[at] = old
            assert abs((up - down) / 2e-6 - slope[at]) < 1e-4, name
            checked += abs(slope[at]) > 1e-3
    assert checked > 20


def test_quota_is_a_bound_and_rare_languages_are_learned(spark):
    rows = [(i, f"common words number {i} of the large language", "big") for i in range(3000)] + [(9000 + i, f"seltene wörter {i}", f"rare{i % 7}") for i in range(70)]
    docs = spark.createDataFrame(rows + [(5, "the same row again and again", "big")] * 500, "doc_id long, text string, lang string")
    classes, x, y, doc = langid.training(docs, quota=50)
    assert classes == ["big", *(f"rare{k}" for k in range(7))]
    assert sum(classes[k] == "big" for k in dict(zip(doc.tolist(), y.tolist())).values()) == 50
    assert langid.training(docs, most=16)[3].max() < 16  # two of each

import math

import numpy as np

from millrace.llm import covertree, queries
from tests.llm.conftest import bag


def brute(rows, least=0.98):
    fine = [(i, e, l) for i, e, l in rows if i is not None and l is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e)]
    n, root = {}, {}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, *_) in enumerate(fine):
        root[i], n[k] = i, 0
    for a in range(len(fine)):
        for b in range(a + 1, len(fine)):
            (i, e, l), (j, f, m) = fine[a], fine[b]
            if l == m and len(e) == len(f):
                x, y = np.array(e, float), np.array(f, float)
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= least:
                    n[a] += 1
                    n[b] += 1
                    u, v = find(i), find(j)
                    root[max(u, v)] = min(u, v)
    return sorted([(i, n[k], find(i), find(i) == i) for k, (i, *_) in enumerate(fine)], key=str)


def clustered(n, seed=0, dim=8):
    r = np.random.default_rng(seed)
    c = r.normal(size=(max(1, n // 12), dim))
    x = c[r.integers(len(c), size=n)] + r.normal(size=(n, dim)) * r.choice([0.0, 0.02, 0.1, 0.4], size=(n, 1))
    return [(i, x[i].astype(np.float32).tolist(), int(r.integers(2))) for i in range(n)]


def test_dual_walk_finds_exactly_the_pairs():
    for seed in range(6):
        r = np.random.default_rng(seed)
        x, y = (covertree.unit([e for _, e, _ in clustered(int(r.integers(1, 160)), seed + k)]) for k in (0, 1))
        for other in (None, y):
            i, j = covertree.dual_walk(covertree.CoverTree(x), None if other is None else covertree.CoverTree(other), 0.98)
            s = np.einsum("ij,kj->ik", x, x if other is None else y) >= 0.98
            want = set(zip(*np.nonzero(np.triu(s, 1) if other is None else s)))
            assert set(zip(i.tolist(), j.tolist())) == {(int(a), int(b)) for a, b in want} and len(i) == len(want)


def test_query_is_brute_force(spark, sf_dir):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert bag(queries.op7_cover_tree(spark, sf_dir)) == brute(rows)


def test_blocks_and_pivots(spark, monkeypatch):
    monkeypatch.setattr(covertree, "BLOCK", 40)
    rows = clustered(300, 4)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert bag(covertree.near_vectors(df)) == brute(rows)


def test_odd_rows(spark):
    e = [1.0, 0.0, 0.5]
    rows = [(1, e, 0), (2, e, 0), (2, e, 0), (3, e, None), (None, e, 0), (4, None, 0), (5, [0.0, 0.0, 0.0], 0), (6, [float("nan"), 1.0, 0.0], 0), (7, [None, 1.0, 0.0], 0),
            (8, [], 0), (9, [1e38, 0.0, 5e37], 0), (10, e, 1), (11, [1.0, 0.0], 0), (12, [float("inf"), 0.0, 0.0], 0)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<float>, label int, weight string, root string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in covertree.near_vectors(df).collect()}
    assert covertree.near_vectors(df).count() == len(rows)
    assert got[1] == (3, 1, True) and got[2] == (3, 1, False) and got[9] == (3, 1, False)
    assert all(got[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 8, 10, 11, 12)) and got[None] == (0, None, False)
    assert covertree.near_vectors(df.limit(0)).collect() == []


def test_trees_are_nested_nets_of_halving_radii_that_cover_their_points():
    for seed, n in ((1, 300), (2, 40), (3, 1)):
        x = covertree.unit([e for _, e, _ in clustered(n, seed)])
        t = covertree.CoverTree(x)
        assert sorted(t.order.tolist()) == list(range(n))
        for k in range(len(t.centre)):
            d = covertree.distance(x[t.centre[k]][None, :], x[t.points(k)])
            assert abs(d.max() - t.radius[k]) < 1e-6 and t.centre[k] in t.points(k)
            kids = t.below(k)
            if t.count[k]:
                assert sorted(np.concatenate([t.points(c) for c in kids])) == sorted(t.points(k))
                apart = covertree.distance(x[t.centre[kids]], x[t.centre[kids]])[~np.eye(len(kids), dtype=bool)]
                assert apart.min() >= t.radius[kids].max() - 1e-6  # centres are further apart than the level's radius, which covers
        same, ids, weight = covertree.unpacked_tree(covertree.packed_tree(t, x, np.arange(n), np.ones(n, int)))
        assert np.allclose(same.x, x) and all((getattr(same, f) == getattr(t, f)).all() for f in t.FIELDS) and len(ids) == len(weight) == n


def test_radii_prune(monkeypatch):
    """Of two far clusters no pair is brought to the leaves; without covering radii links are lost."""
    r = np.random.default_rng(0)
    x = covertree.unit(np.concatenate([c + 0.02 * r.normal(size=(200, 16)) for c in (np.eye(16)[0], np.eye(16)[1])]))
    seen = []
    plain = covertree.distance
    monkeypatch.setattr(covertree, "distance", lambda a, b: (seen.append(len(a) * len(b)), plain(a, b))[1])
    t = covertree.CoverTree(x)
    seen.clear()
    i, _ = covertree.dual_walk(t, None, 0.9999)
    assert sum(seen) < 0.5 * 400 * 400
    t.radius = np.zeros_like(t.radius)
    assert len(covertree.dual_walk(t, None, 0.9999)[0]) < len(i) or len(i) == 0

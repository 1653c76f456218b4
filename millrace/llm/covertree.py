"""Embedding near-duplicates: all pairs of equal label with cosine over a threshold, by cover trees.

Equal vectors are one point with a weight. Each label's points are routed to pivots (a
net, of halving radius, of a bounded sample) and cut into blocks of about ``BLOCK``
points. A task builds a block's cover tree once, level by level: nested nets of halving
radii, centres found against the points that are left, so that no matrix of all distances
is made. It walks the tree against itself and writes it down. Pairs of blocks whose covering
radii keep them apart never meet; for each other pair a task reads both trees and walks
them at once: a pair of nodes is dropped if its centres are further apart than both
covering radii and the threshold allow; what reaches the leaves is decided by the cosine
in double precision. A task sends out each point's number of links and its component within
the task, never the pairs. Vectors travel in the type that they came in.
"""

from __future__ import annotations

import io
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import components
from millrace.session import cut, ship

COSINE, BLOCK, LEAF = 0.98, 2048, 4
#: So many centres are tried at a time, and so many children are compared at a time.
AT_ONCE, CHILDREN = 64, 512
#: At most so many pivots over all labels, and of one label; so many sampled points for each pivot; so many numbers in all of them.
PIVOTS, LABEL_PIVOTS, PER_PIVOT, NUMBERS = 2048, 32, 8, 4_000_000
SLACK = 1e-7


def unit(rows) -> np.ndarray:
    """Rows as unit vectors in double precision; scaled first, so that no square overflows."""
    x = np.stack([np.asarray(r, np.float64) for r in rows])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def net(x: np.ndarray, rho: float) -> list[tuple[int, np.ndarray, float]]:
    """A greedy net of the rows: ``(centre, rows, covering radius)``, centres over ``rho`` apart."""
    left, out = np.arange(len(x)), []
    while len(left):
        d = distance(x[left[:AT_ONCE]], x[left])
        free = np.ones(len(left), bool)
        for k in range(len(d)):
            if free[k]:
                own = free & (d[k] <= rho)
                own[k] = True
                free &= ~own
                out.append((int(left[k]), left[own], float(d[k][own].max())))
        left = left[free]
    return out


class CoverTree:
    """Nodes as arrays: centre, covering radius, points ``order[start:end]``, and children ``first .. first + count`` (none: a leaf).

    Children are numbered level by level, and the points of a node lie together in ``order``.
    """

    FIELDS = ("centre", "start", "end", "first", "count", "radius")

    def __init__(self, x: np.ndarray):
        self.x, self.order = x, np.arange(len(x))
        radius = float(distance(x[:1], x).max()) if len(x) else 0.0
        nodes, rho = [[0, 0, len(x), 0, 0, radius]], [2.0]
        for n, (_, start, end, _, _, radius) in enumerate(nodes):  # grows meanwhile: level by level
            if end - start <= LEAF or radius <= SLACK:
                continue
            points, half, kids = self.order[start:end].copy(), rho[n], []
            while len(kids) < 2 and half > SLACK:
                half /= 2
                kids = net(x[points], half) if half < radius else []
            if len(kids) < 2:
                continue
            nodes[n][3:5] = len(nodes), len(kids)
            self.order[start:end] = np.concatenate([points[own] for _, own, _ in kids])
            for c, own, r in kids:
                nodes.append([int(points[c]), start, start + len(own), 0, 0, r])
                rho.append(half)
                start += len(own)
        for k, name in enumerate(self.FIELDS):
            setattr(self, name, np.array([node[k] for node in nodes], np.float64 if name == "radius" else np.int64))

    def below(self, n: int) -> np.ndarray:
        """The node's children; a leaf is its own."""
        return np.arange(self.first[n], self.first[n] + self.count[n]) if self.count[n] else np.array([n])

    def points(self, n: int) -> np.ndarray:
        return self.order[self.start[n] : self.end[n]]


def packed_tree(tree: CoverTree, raw: np.ndarray, ids: np.ndarray, weight: np.ndarray) -> bytes:
    """The tree, its vectors as they came, their ids and weights."""
    out = io.BytesIO()
    np.savez(out, raw=raw, ids=ids, weight=weight, order=tree.order, **{f: getattr(tree, f) for f in CoverTree.FIELDS})
    return out.getvalue()


def unpacked_tree(blob: bytes) -> tuple[CoverTree, np.ndarray, np.ndarray]:
    tree = CoverTree.__new__(CoverTree)
    with np.load(io.BytesIO(blob), allow_pickle=False) as z:
        tree.x, tree.order = unit(z["raw"]), z["order"]
        for f in CoverTree.FIELDS:
            setattr(tree, f, z[f])
        return tree, z["ids"], z["weight"]


def dual_walk(a: CoverTree, b: CoverTree | None, least: float = COSINE) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all pairs (of both trees' points, or of the first's alone, then i < j) with a cosine of ``least`` or more."""
    alone = b is None
    b = a if alone else b
    reach = math.sqrt(2.0 - 2.0 * least) + SLACK
    stack, left, right = [(0, 0)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    while stack and len(a.order) and len(b.order):
        p, q = stack.pop()
        ps, qs = a.below(p), b.below(q)
        for at in range(0, len(ps), CHILDREN):
            some = ps[at : at + CHILDREN]
            near = distance(a.x[a.centre[some]], b.x[b.centre[qs]]) <= a.radius[some][:, None] + b.radius[qs][None, :] + reach
            if alone and p == q:
                near &= some[:, None] <= qs[None, :]
            i, j = np.nonzero(near)
            s, t = some[i], qs[j]
            leaves = (a.count[s] == 0) & (b.count[t] == 0)
            one = leaves & (a.end[s] - a.start[s] == 1) & (b.end[t] - b.start[t] == 1)
            left.append(a.centre[s[one]])
            right.append(b.centre[t[one]])
            for u, v in zip(s[leaves & ~one].tolist(), t[leaves & ~one].tolist(), strict=True):
                x, y = a.points(u), b.points(v)
                left.append(np.repeat(x, len(y)))
                right.append(np.tile(y, len(x)))
            stack += zip(s[~leaves].tolist(), t[~leaves].tolist(), strict=True)
    i, j = np.concatenate(left), np.concatenate(right)
    if alone:
        i, j = np.minimum(i, j), np.maximum(i, j)
        i, j = (k[i < j] for k in (i, j))
        i, j = np.divmod(np.unique(i * len(a.x) + j), len(a.x))
    keep = np.empty(len(i), bool)
    for at in range(0, len(i), 65536):
        s = slice(at, at + 65536)
        keep[s] = np.einsum("ij,ij->i", a.x[i[s]], b.x[j[s]]) >= least
    return i[keep], j[keep]


def linked(i: np.ndarray, j: np.ndarray, ids: np.ndarray, weight: np.ndarray) -> pd.DataFrame:
    """``vec_id, links, root`` of points in pairs ``i, j``: the weights of their partners and the smallest id of their component."""
    links = np.bincount(i, weight[j], len(ids)) + np.bincount(j, weight[i], len(ids))
    root = ids.copy()
    while True:
        new = root.copy()
        np.minimum.at(new, i, root[j])
        np.minimum.at(new, j, root[i])
        if (new == root).all():
            break
        root = new
    some = links > 0
    return pd.DataFrame({"vec_id": ids[some], "links": links[some].astype(np.int64), "root": root[some]})


def _pivots(points: DataFrame) -> tuple[dict[tuple[int, int], np.ndarray], list]:
    """Pivots of labels with more than a block, and the distances between them; both of bounded size."""
    counts = points.groupBy("label", "dim").count().where(F.col("count") > BLOCK).orderBy(F.desc("count"), "label", "dim").limit(PIVOTS // 2).collect()
    budget, numbers, want = PIVOTS, NUMBERS, {}
    for r in counts:
        k = min(LABEL_PIVOTS, -(-r["count"] // BLOCK), budget, numbers // (PER_PIVOT * r.dim))
        if k > 1:
            want[(r.label, r.dim)] = (k, min(1.0, PER_PIVOT * k / r["count"]))
            budget -= k
            numbers -= PER_PIVOT * k * r.dim
    if not want:
        return {}, []
    chosen = F.create_map(*[F.lit(v) for (label, dim), (_, share) in want.items() for v in (f"{label}/{dim}", share)])
    share = F.coalesce(chosen[F.concat_ws("/", "label", "dim")], F.lit(0.0))
    rows = points.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < share * (1 << 20)).orderBy(F.xxhash64("vec_id"), "label", "dim").limit(2 * PER_PIVOT * sum(k for k, _ in want.values())).collect()
    pivots, apart = {}, []
    for (label, dim), (k, _) in want.items():
        own = [r.embedding for r in rows if r.label == label and r.dim == dim]
        if len(own) < 2:
            continue
        x = unit(own)
        rho = 2.0
        while len(centres := [c for c, _, _ in net(x, rho)]) < min(k, len(x)) and rho > SLACK:
            rho /= 2
        pivots[(label, dim)] = x[centres[:k]]
        d = distance(pivots[(label, dim)], pivots[(label, dim)])
        apart += [(label, dim, a, b, float(d[a, b])) for a in range(len(d)) for b in range(a, len(d))]
    return pivots, apart


def pairs_by_blocks(points: DataFrame, least: float = COSINE) -> DataFrame:
    """``vec_id, links, root`` from every pair of blocks that may hold a link. ``points``: label, vec_id, weight, embedding, dim."""
    spark = points.sparkSession
    ship(spark)
    pivots, apart = _pivots(points)
    kind = points.schema["embedding"].dataType.simpleString()

    def route(batches):
        for p in batches:
            p["pivot"], p["away"] = 0, 2.0
            for (label, dim), at in p.groupby(["label", "dim"]).groups.items():
                if (label, dim) in pivots:
                    d = distance(unit(p.loc[at, "embedding"]), pivots[(label, dim)])
                    k = d.argmin(axis=1)
                    p.loc[at, "pivot"], p.loc[at, "away"] = k, d[np.arange(len(k)), k]
            yield p

    schema = f"label long, vec_id long, weight long, embedding {kind}, dim int, pivot int, away double"
    routed = cut(points.mapInPandas(route, schema))
    node = ["label", "dim", "pivot"]
    nodes = cut(routed.groupBy(*node).agg(F.count("*").alias("n"), F.max("away").alias("radius")).withColumn("cuts", F.ceil(F.col("n") / BLOCK)))
    own = routed.join(nodes.select(*node, "cuts"), node).withColumn("cut", F.pmod(F.xxhash64("vec_id"), F.col("cuts"))).drop("cuts", "away")

    def plant(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("vec_id", kind="stable")
        raw, ids, weight = np.stack(p.embedding.tolist()), p.vec_id.to_numpy(np.int64), p.weight.to_numpy(np.int64)
        tree = CoverTree(unit(raw))
        out = linked(*dual_walk(tree, None, least), ids, weight)
        first = {c: int(p[c].iloc[0]) for c in (*node, "cut")}
        return pd.concat([out.assign(tree=None), pd.DataFrame([{"vec_id": 0, "links": 0, "root": 0, "tree": packed_tree(tree, raw, ids, weight)}])]).assign(**first)

    found = "vec_id long, links long, root long"
    planted = cut(own.groupBy(*node, "cut").applyInPandas(plant, found + ", tree binary, label long, dim int, pivot int, cut long"))
    trees = planted.where("tree is not null").select(*node, "cut", "tree")
    blocks = trees.select(*node, "cut").join(nodes.select(*node, "radius"), node)
    a = blocks.select("label", "dim", *[F.col(c).alias(f"{c}_a") for c in ("pivot", "cut", "radius")])
    b = blocks.select("label", "dim", *[F.col(c).alias(f"{c}_b") for c in ("pivot", "cut", "radius")])
    both = a.join(b, ["label", "dim"]).where("pivot_a < pivot_b or (pivot_a = pivot_b and cut_a < cut_b)")
    if apart:
        known = spark.createDataFrame(apart, "label long, dim int, pivot_a int, pivot_b int, d double")
        both = both.join(F.broadcast(known), ["label", "dim", "pivot_a", "pivot_b"], "left")  # PIVOTS * LABEL_PIVOTS rows at most
        both = both.where(F.coalesce("d", F.lit(0.0)) <= F.col("radius_a") + F.col("radius_b") + F.lit(math.sqrt(2 - 2 * least) + SLACK))
    key = ["label", "dim", "pivot_a", "cut_a", "pivot_b", "cut_b"]
    side = lambda x: F.struct(F.col(f"pivot_{x}").alias("pivot"), F.col(f"cut_{x}").alias("cut"), F.lit(x).alias("side"))
    member = both.select(*key, F.inline(F.array(side("a"), side("b"))))
    brought = member.join(trees, [*node, "cut"]).select(*key, "side", "tree")

    def compare(p: pd.DataFrame) -> pd.DataFrame:
        (x, ids, weight), (y, ids_y, weight_y) = (unpacked_tree(t) for t in p.sort_values("side").tree)
        i, j = dual_walk(x, y, least)
        return linked(i, j + len(ids), np.append(ids, ids_y), np.append(weight, weight_y))

    return planted.where("tree is null").select("vec_id", "links", "root").union(brought.groupBy(*key).applyInPandas(compare, found))


def near_vectors(vectors: DataFrame, least: float = COSINE) -> DataFrame:
    """Per row: ``vec_id, n_links, component_id, kept``.

    Rows with a null vec_id or label, and vectors that are null, empty, zero or hold null or
    non-finite numbers, link with nothing, nor do vectors of different lengths. A row with a
    null vec_id has a null component and is not kept. Copies link with each other. Rows that
    share a vec_id share its links. Empty tables give no rows; extra columns are ignored.
    """
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite & F.exists(e, lambda x: x != 0), F.lit(False))
    # what tells equal vectors is 96 bits of two hashes wherever the vector itself need not travel
    rows = vectors.select("vec_id", F.col("label").cast("long").alias("label"), "embedding", F.coalesce(fine, F.lit(False)).alias("fine"))
    digest = [F.xxhash64("embedding").alias("k1"), F.hash("embedding").alias("k2")]
    points = rows.where("fine").groupBy("label", "embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("weight"))
    points = cut(points.select("label", "vec_id", "weight", "embedding", F.size("embedding").alias("dim")))
    found = cut(pairs_by_blocks(points, least))
    links = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("vec_id").alias("u"), F.col("root").alias("v")))
    each = points.select("vec_id", F.col("label").alias("_label"), "weight", *digest).join(links, "vec_id", "left").join(roots, F.col("vec_id") == F.col("node"), "left")
    each = each.select("_label", F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("root", "vec_id").alias("c"))
    keyed = rows.select("vec_id", "label", "fine", *digest)
    out = keyed.join(each, F.col("fine") & (F.col("label") == F.col("_label")) & (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")), "left")
    component = F.coalesce("c", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))

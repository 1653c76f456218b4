"""Graph operators as joins: reachability, components and small strongly connected components.

Loops run over edge tables that are cut in shared storage each round; only counts reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import cut, dropped, stored


def reachability(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """``src, dst`` pairs joined by a path, by doubling: paths of length 2^k after k rounds (GRF04, SRC10)."""
    paths = cut(edges.select("src", "dst").distinct())
    n = paths.count()
    for _ in range(most_rounds):
        step = paths.select(F.col("src").alias("dst"), F.col("dst").alias("_to"))
        longer = paths.join(step, "dst").select("src", F.col("_to").alias("dst"))
        paths = cut(paths.union(longer).distinct())
        m = paths.count()
        if m == n:
            return paths
        n = m
    raise RuntimeError("reachability did not settle")


def _trimmed(edges: DataFrame, most_rounds: int) -> DataFrame:
    """Edges between nodes that have edges in and out, as those of a cycle do."""
    e, n = edges, edges.count()
    for _ in range(most_rounds):
        ins, outs = e.select(F.col("dst").alias("src")).distinct(), e.select(F.col("src").alias("dst")).distinct()
        e = cut(e.join(ins, "src", "left_semi").join(outs, "dst", "left_semi").select("src", "dst"))
        m = e.count()
        if m == n:
            break
        n = m
    return e


def _settled(step, state: DataFrame, most_rounds: int) -> DataFrame:
    """``state(node, label)`` after ``step`` has stopped raising labels."""
    for _ in range(most_rounds):
        new = cut(step(state).join(state.select("node", F.col("label").alias("_was")), "node", "left"))
        state = new.select("node", "label")
        if new.where("_was is null or label <> _was").limit(1).count() == 0:
            return state
    raise RuntimeError("labels did not settle")


def strongly_connected(edges: DataFrame, least: int = 2, most: int = 5, most_rounds: int = 1000) -> DataFrame:
    """Strongly connected components of ``least`` to ``most`` nodes: ``component, members`` (GRF01).

    Nodes off all cycles are trimmed. Then the largest node that reaches a node is its colour; a
    node that has its own colour is a root, and its component is what reaches it within that colour.
    Components found so go, and the rest is searched anew: rows are nodes and edges, never
    pairs that a path joins.
    """
    e = _trimmed(cut(edges.select("src", "dst").where("src <> dst").distinct()), most_rounds)
    found = None
    while e.limit(1).count():

        def forward(c: DataFrame, e=e) -> DataFrame:
            near = e.join(c, F.col("src") == F.col("node")).groupBy("dst").agg(F.max("label").alias("_m"))
            return c.join(near, F.col("node") == F.col("dst"), "left").select("node", F.greatest("label", F.coalesce("_m", "label")).alias("label"))

        nodes = e.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
        colour = _settled(forward, cut(nodes.withColumn("label", F.col("node"))), most_rounds)
        a, b = (colour.select(F.col("node").alias(x), F.col("label").alias(f"_{x}")) for x in ("src", "dst"))
        inside = cut(e.join(a, "src").join(b, "dst").where("_src = _dst").select("src", "dst"))

        def backward(c: DataFrame, inside=inside) -> DataFrame:
            more = inside.join(c, F.col("dst") == F.col("node")).select(F.col("src").alias("node"), "label")
            return c.union(more).distinct()

        got = _settled(backward, cut(colour.where("node = label")), most_rounds)
        found = got if found is None else cut(found.union(got))
        left = got.select(F.col("node").alias("_n"))
        e = _trimmed(cut(e.join(left, F.col("src") == F.col("_n"), "left_anti").join(left, F.col("dst") == F.col("_n"), "left_anti")), most_rounds)
    if found is None:
        found = e.select(F.col("src").alias("node"), F.col("src").alias("label"))
    sized = found.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n").between(least, most)).select("label")
    member = found.join(sized, "label")
    return member.groupBy("label").agg(F.min("node").alias("component"), F.array_sort(F.collect_set("node")).alias("members")).drop("label")


def connected(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """``node, component`` with the smallest node reachable (GRF02), by contraction: each node becomes its neighbour, or itself, of the least hash.

    A round leaves about half of the nodes or fewer, whatever the length of paths, as hashes order nodes anew each time; so all rounds read about
    what the first few do. Contracted nodes carry the smallest node in them, and the way back joins each round's nodes once. Rounds are
    written as tables: a checkpoint would keep the constraints and size estimates of all rounds before, which soon take longer to plan than to run.
    """
    spark, paths = edges.sparkSession, []

    def kept(df: DataFrame) -> DataFrame:
        table, path = stored(df)
        paths.append(path)
        return table

    e = kept(edges.select("src", "dst").union(edges.select("dst", "src")).where("src is not null").select("src", F.coalesce("dst", "src").alias("dst")))
    least, rounds = None, []
    for k in range(most_rounds):
        rank = lambda c, k=k: F.struct(F.xxhash64(F.lit(k), c).alias("hash"), F.col(c).alias("node"))
        near = e.groupBy("src").agg(F.min(rank("dst")).alias("_m"))
        near = kept(near.select(F.col("src").alias("node"), F.least("_m", rank("src"))["node"].alias("to")))
        a, b = (near.select(F.col("node").alias(x), F.col("to").alias(f"_{x}")) for x in ("src", "dst"))
        e = kept(e.where("src <> dst").join(a, "src").join(b, "dst").where("_src <> _dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst")).distinct())
        held = near.withColumn("_l", F.col("node")) if least is None else near.join(least, "node")
        least = kept(held.groupBy(F.col("to").alias("node")).agg(F.min("_l").alias("_l")))
        rounds.append((near, least))
        if e.isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    found = None
    for near, least in reversed(rounds):
        # what a later round has not met was whole by then
        known = least if found is None else least.join(found, "node", "left").select("node", F.coalesce("component", "_l").alias("_l"))
        found = kept(near.join(known.select(F.col("node").alias("to"), F.col("_l").alias("component")), "to").select("node", "component"))
    for path in paths[:-1]:
        dropped(spark, path)
    return found


def least_depths(edges: DataFrame, most: int) -> DataFrame:
    """``node, depth`` of the nodes of ``edges(parent, child)`` that have a parent: the edges of the longest way to it, ``most`` at most, which is what nodes on or below a circle have.

    The nodes at depth k or more are the children of those at k - 1 or more, so each round reads fewer of them.
    """
    deep = cut(edges.select(F.col("child").alias("node")).distinct())
    levels = [deep]
    while len(levels) < most and not deep.isEmpty():
        deep = cut(edges.join(deep, F.col("parent") == F.col("node"), "left_semi").select(F.col("child").alias("node")).distinct())
        levels.append(deep)
    every = levels[0].withColumn("depth", F.lit(1))
    for k, nodes in enumerate(levels[1:], 2):
        every = every.union(nodes.withColumn("depth", F.lit(k)))
    return cut(every.groupBy("node").agg(F.max("depth").alias("depth")))


def are_ancestors(edges: DataFrame, pairs: DataFrame, most_depth: int = 64) -> DataFrame:
    """``id, a, b, found``: whether ``a`` is ``b`` or an ancestor of it over ``edges(parent, child)``, for each of ``pairs(id, a, b)`` (GRF04).

    A search of each different pair from both sides, down from ``a`` and up from ``b``, a step of the side with the smaller frontiers at a time, until the
    sides meet or one has nowhere left to go. An ancestor's depth, the longest way to it, is less than its descendant's: nodes that are not deeper than ``a`` or
    not less deep than ``b`` leave the search, and so do pairs that are settled. Depths stop at ``most_depth``, and nodes that have it are kept. Only those can be met
    again for ever, so only those are compared with what a side has seen; others come at most once a round. Frontiers are written once, a round costs what
    they hold, and the driver sees counts only. Ids are different; a null node has no ancestors.
    """
    e = cut(edges.where("parent is not null and child is not null").select("parent", "child").distinct())
    depths = least_depths(e, most_depth)
    circles = not depths.where(F.col("depth") >= most_depth).isEmpty()
    deep = lambda c: F.coalesce(c, F.lit(0))

    def way(here: str, there: str) -> DataFrame:
        to = e.select(F.col(here).alias("node"), F.col(there).alias("next"))
        return cut(to.join(depths.select(F.col("node").alias("next"), "depth"), "next", "left").select("node", "next", deep(F.col("depth")).alias("depth")))

    ways = {"a": way("parent", "child"), "b": way("child", "parent")}
    named = lambda name: depths.select(F.col("node").alias(name), F.col("depth").alias(f"d{name}"))
    asked = pairs.where("a is not null and b is not null").select("a", "b").distinct()
    asked = cut(asked.join(named("a"), "a", "left").join(named("b"), "b", "left").select("a", "b", deep(F.col("da")).alias("da"), deep(F.col("db")).alias("db")))
    found = [asked.where("a = b").select("a", "b")]
    open_ = asked.where((F.col("a") != F.col("b")) & ((F.col("da") < F.col("db")) | (F.col("da") >= most_depth)))
    front = {k: open_.select("a", "b", "da", "db", F.col(k).alias("node"), F.col(f"d{k}").alias("depth")) for k in ("a", "b")}
    seen = {k: [f.select("a", "b", "node", "depth")] for k, f in front.items()}
    sizes = dict.fromkeys(front, open_.count())

    def every(k: str) -> DataFrame:
        out = seen[k][0]
        for more in seen[k][1:]:
            out = out.union(more)
        return out

    last = None
    while all(sizes.values()):
        k = min(sizes, key=lambda x: (sizes[x], x))
        other = "b" if k == "a" else "a"
        if last == other:  # pairs that have been settled since this side's last step
            front[k] = front[k].join(front[other].select("a", "b").distinct(), ["a", "b"], "left_semi")
        last = k
        near = front[k].select("a", "b", "da", "db", "node").join(ways[k], "node").select("a", "b", "da", "db", F.col("next").alias("node"), "depth")
        right = (F.col("depth") < F.col("db")) | (F.col("node") == F.col("b")) if k == "a" else (F.col("depth") > F.col("da")) | (F.col("node") == F.col("a"))
        near = near.where(right | (F.col("depth") >= most_depth)).distinct()
        if circles:
            near = near.join(every(k).where(F.col("depth") >= most_depth).select("a", "b", "node"), ["a", "b", "node"], "left_anti")
        near = cut(near)
        met = cut(near.join(every(other).select("a", "b", "node"), ["a", "b", "node"]).select("a", "b").distinct())
        found.append(met)
        seen[k].append(near.select("a", "b", "node", "depth"))
        front[k] = near.join(met, ["a", "b"], "left_anti")
        sizes[k] = front[k].count()
    all_found = found[0]
    for more in found[1:]:
        all_found = all_found.union(more)
    flagged = all_found.distinct().withColumn("_met", F.lit(True))
    return pairs.join(flagged, ["a", "b"], "left").select("id", "a", "b", F.coalesce("_met", F.lit(False)).alias("found"))


def later_of_two(edges: DataFrame, candidates: DataFrame) -> DataFrame:
    """``id, chosen, source`` for ``candidates(id, head, recorded, committed)`` (GRF04): of the two that are ancestors of ``head`` the recorded one if
    the committed one comes before it, else the committed one; null where neither is one."""
    asked = candidates.select("id", F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("a"), F.col("head").alias("b")) for k in ("recorded", "committed")], F.struct(F.lit("order").alias("kind"), F.col("committed").alias("a"), F.col("recorded").alias("b")))))
    keyed = asked.withColumn("key", F.struct("id", "kind"))
    said = are_ancestors(edges, keyed.select(F.col("key").alias("id"), "a", "b")).select("id.id", "id.kind", "found")
    flag = lambda kind: F.coalesce(F.bool_or(F.when(F.col("kind") == kind, F.col("found"))), F.lit(False)).alias(f"_{kind}")
    flags = said.groupBy("id").agg(flag("recorded"), flag("committed"), flag("order"))
    newer = F.col("_recorded") & (~F.col("_committed") | (F.col("_order") & (F.col("recorded") != F.col("committed"))))
    source = F.when(newer, "record").when(F.col("_committed"), "commit")
    return candidates.join(flags, "id").select("id", F.when(newer, F.col("recorded")).when(F.col("_committed"), F.col("committed")).alias("chosen"), source.alias("source"))

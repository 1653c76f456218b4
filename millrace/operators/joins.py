"""Joins: co-occurrence, band, nearest, enclosing, theta, anti, cascade and fuzzy joins.

All are equi-joins on some key with a residual predicate, so Spark can shuffle on the key
and split skewed keys; nothing here is a nested loop over two large sides.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Interval joins: lengths of a class differ by at most so many times, a power of two.
CLASS = 16


def small_baskets(df: DataFrame, basket: str, item: str, most: int) -> DataFrame:
    """Distinct ``(basket, item)`` of baskets with at most ``most`` items (AGG01: bulk baskets say nothing).

    The bound is what keeps the self-join linear: a basket gives at most most² / 2 pairs.
    """
    one = df.select(basket, item).distinct()
    sizes = one.groupBy(basket).agg(F.count("*").alias("_n")).where(F.col("_n") <= most).select(basket)
    return one.join(sizes, basket, "left_semi")


def co_occurrence(df: DataFrame, basket: str, item: str, most: int = 50, support: int = 3, ratio: float = 0.0) -> DataFrame:
    """Pairs of items that share baskets (JON02): ``a, b, shared, ratio`` with ratio = 2 shared / (n_a + n_b)."""
    one = small_baskets(df, basket, item, most)
    counts = one.groupBy(item).agg(F.count("*").alias("_n"))
    left = one.select(F.col(basket).alias("_basket"), F.col(item).alias("a"))
    right = one.select(F.col(basket).alias("_basket"), F.col(item).alias("b"))
    pairs = left.join(right, "_basket").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared")).where(F.col("shared") >= support)
    for side in ("a", "b"):
        pairs = pairs.join(counts.select(F.col(item).alias(side), F.col("_n").alias(f"_{side}")), side)
    share = 2.0 * F.col("shared") / (F.col("_a") + F.col("_b"))
    return pairs.withColumn("ratio", share).where(F.col("ratio") >= ratio).select("a", "b", "shared", "ratio")


def annotate_pairs(pairs: DataFrame, edges: DataFrame, hubs: DataFrame) -> DataFrame:
    """What kind a pair is, by directed edges either way and hub membership (JON04, JON34)."""
    both = edges.select("src", "dst").union(edges.select("dst", "src")).distinct()
    e = both.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(True).alias("_edge"))
    h = hubs.select(F.col("id").alias("_hub")).distinct()
    out = pairs.join(e, ["a", "b"], "left")
    out = out.join(h.select(F.col("_hub").alias("a"), F.lit(True).alias("_ha")), "a", "left").join(h.select(F.col("_hub").alias("b"), F.lit(True).alias("_hb")), "b", "left")
    hub = F.coalesce("_ha", F.lit(False)) | F.coalesce("_hb", F.lit(False))
    kind = F.when(hub, "hub").when(F.col("_edge"), "explained").otherwise("hidden")
    return out.withColumn("kind", kind).drop("_edge", "_ha", "_hb")


def band_join(left: DataFrame, right: DataFrame, keys: list[str], lo: str, hi: str, rlo: str, rhi: str, slack: float = 0) -> DataFrame:
    """Equal keys and intervals at most ``slack`` apart (JON07, JON16, JON26)."""
    near = (F.col(lo) <= F.col(rhi) + F.lit(slack)) & (F.col(rlo) <= F.col(hi) + F.lit(slack))
    return left.join(right, keys).where(near)


def bucketed_band_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, rat: str, width: float) -> DataFrame:
    """As ``band_join`` for points at most ``width`` apart, also keyed by buckets of the width.

    Each left point looks into three buckets, so a key with many points never meets itself whole.
    """
    bucket = lambda c: F.floor(F.col(c) / F.lit(width))
    l = left.withColumn("_b", F.explode(F.sequence(bucket(at) - 1, bucket(at) + 1)))
    r = right.withColumn("_b", bucket(rat))
    return l.join(r, [*keys, "_b"]).where(F.abs(F.col(at) - F.col(rat)) <= F.lit(width)).drop("_b")


def latest_before(left: DataFrame, right: DataFrame, keys: list[str], at: str, rat: str, rid: str) -> DataFrame:
    """The nearest earlier (or equal) right row of the same keys for each left row (JON12, as-of form); ties: smallest id.

    A union and one window over the keys, instead of a join that pairs all rows of a key.
    ``left`` keeps its columns and gets ``matched_at`` and ``matched_id``, null without a match.
    """
    marks = right.groupBy(*keys, F.col(rat).alias("_at")).agg(F.min(rid).alias("_id"))
    l = left.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(marks.schema["_id"].dataType).alias("_id"))
    r = marks.select(*keys, "_at", F.lit(0).alias("_side"), F.lit(None).cast(l.schema["_row"].dataType).alias("_row"), "_id")
    w = Window.partitionBy(*keys).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    hit = F.last(F.when(F.col("_side") == 0, F.struct("_at", "_id")), ignorenulls=True).over(w)
    return l.unionByName(r).withColumn("_hit", hit).where("_side = 1").select("_row.*", F.col("_hit._at").alias("matched_at"), F.col("_hit._id").alias("matched_id"))


def smallest_enclosing(points: DataFrame, spans: DataFrame, keys: list[str], at: str, lo: str, hi: str, span: str) -> DataFrame:
    """The shortest interval around each point; ties: later start, then larger id (JON20).

    Spans fall into classes by length, a power of two that holds them, and into the one or two
    buckets of that width that they touch; a point looks into one bucket of each class. So a key
    with many of both never meets itself whole. At most 64 class numbers reach the driver.
    """
    size = F.ceil(F.log2(F.greatest(F.col(hi) - F.col(lo), F.lit(0)) + 1)).cast("int")
    bucket = lambda c, k: F.floor(F.col(c) / F.pow(F.lit(2.0), k))
    s = spans.where(F.col(lo) <= F.col(hi)).withColumn("_k", size)
    classes = [r["_k"] for r in s.select("_k").distinct().collect()]
    s = s.withColumn("_b", F.explode(F.sequence(bucket(lo, F.col("_k")), bucket(hi, F.col("_k")))))
    p = points.withColumn("_k", F.explode(F.array(*map(F.lit, classes)).cast("array<int>"))).withColumn("_b", bucket(at, F.col("_k")))
    inside = p.join(s, [*keys, "_k", "_b"]).where((F.col(lo) <= F.col(at)) & (F.col(at) <= F.col(hi)))
    order = F.struct((F.col(hi) - F.col(lo)).alias("len"), (-F.col(lo)).alias("start"), (-F.col(span)).alias("id"))
    return inside.groupBy(*points.columns).agg(F.min_by(span, order).alias(span))


def interval_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """``i, t``: the rows of two sides with equal keys (null equals nothing) whose intervals ``lo`` to ``hi`` overlap, ends included (JON16).

    Both sides fall into classes by length, a power of ``CLASS`` that holds them. A pair is met at the class of the longer of the two, where each
    touches one or two buckets of that width, and in the bucket in which its overlap begins; a side looks into the classes that the other
    side has. So a group's pairs are never all formed, and what meets in a bucket is mostly what overlaps. Wide classes are few, so few copies
    of a row are shuffled, and each carries its columns once. At most 64 class numbers a side reach the driver.
    """
    size = (F.ceil(F.log2(F.col("hi") - F.col("lo") + 1) / math.log2(CLASS)) * int(math.log2(CLASS))).cast("int")
    side = lambda df, name: df.where("lo <= hi").select(*keys, *[F.col(c).alias(f"_{name}_{c}") for c in df.columns if c not in keys], size.alias("_k"))
    sides = {"i": side(left, "i"), "t": side(right, "t")}
    classes = {n: sorted(r[0] for r in d.select("_k").distinct().collect()) for n, d in sides.items()}

    def touched(name: str, level: Column) -> DataFrame:
        bucket = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("_k")))
        at = sides[name].withColumn("_k", level)
        return at.withColumn("_b", F.explode(F.sequence(bucket(f"_{name}_lo"), bucket(f"_{name}_hi"))))

    def longer(name: str, other: str, least: Callable[[Column], Column]) -> DataFrame:
        met = F.exists(F.array(*map(F.lit, classes[other])).cast("array<int>"), least)
        return touched(name, F.explode(F.when(met, F.array("_k")).otherwise(F.array().cast("array<int>"))))

    def shorter(name: str, other: str, least: Column) -> DataFrame:
        levels = F.array(*map(F.lit, classes[other])).cast("array<int>")
        return touched(name, F.explode(F.filter(levels, lambda k: k >= least)))

    def whole(df: DataFrame, name: str) -> Column:
        return F.struct(*[F.col(c) if c in keys else F.col(f"_{name}_{c}").alias(c) for c in df.columns]).alias(name)

    def pairs(a: DataFrame, b: DataFrame) -> DataFrame:
        begins = F.floor(F.greatest("_i_lo", "_t_lo") / F.pow(F.lit(2.0), F.col("_k")))
        met = a.join(b, [*keys, "_k", "_b"]).where((F.col("_i_lo") <= F.col("_t_hi")) & (F.col("_t_lo") <= F.col("_i_hi")) & (begins == F.col("_b")))
        return met.select(whole(left, "i"), whole(right, "t"))

    # the left side is the longer, or as long; then the right side is
    out = pairs(longer("i", "t", lambda k: k <= F.col("_k")), shorter("t", "i", F.col("_k")))
    return out.union(pairs(shorter("i", "t", F.col("_k") + 1), longer("t", "i", lambda k: k < F.col("_k"))))


def theta_match(items: DataFrame, truths: DataFrame, group: str = "grp") -> DataFrame:
    """``i, t``: group equal, path null-safe equal, intervals overlapping where the truth has one (JON13).

    A truth with a list of ``sources`` takes only items one of whose ``producers`` is in it; an entry that ends in ``*`` takes what
    begins like it. Truths with an interval are met by ``interval_join``; one without takes all items of its group and path, which are results.
    """
    keyed = lambda df: df.withColumn("_path", F.concat(F.when(F.col("path").isNull(), "0").otherwise("1"), F.coalesce("path", F.lit(""))))
    i, t = keyed(items), keyed(truths)
    whole = i.select(group, "_path", F.struct(*i.columns).alias("i")).join(t.where("lo is null").select(group, "_path", F.struct(*t.columns).alias("t")), [group, "_path"]).select("i", "t")
    out = whole.union(interval_join(i, t.where("lo is not null"), [group, "_path"]))
    if "sources" in truths.columns and "producers" in items.columns:
        like = lambda s, p: F.when(F.endswith(s, F.lit("*")), F.startswith(p, F.rtrim(s, F.lit("*")))).otherwise(s == p)
        named = F.exists("t.sources", lambda s: F.exists("i.producers", lambda p: like(s, p)))
        out = out.where((F.coalesce(F.size("t.sources"), F.lit(0)) <= 0) | F.coalesce(named, F.lit(False)))
    return out


def suffixes(path: Column, sep: str = "/") -> Column:
    """All segment-aligned suffixes of a path (JON18)."""
    parts = F.split(path, sep)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), sep))


def ancestors(path: Column, sep: str = "/") -> Column:
    """All segment-aligned prefixes of a path, itself included (GRF03)."""
    parts = F.split(path, sep)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), sep))


def nearest_ancestor(paths: DataFrame, known: DataFrame, path: str, value: str) -> DataFrame:
    """The value at the deepest ancestor that ``known(path, value)`` has; null without one (JON29)."""
    up = paths.select(path, F.posexplode(ancestors(F.col(path))).alias("_depth", "_up"))
    hit = up.join(known.select(F.col(path).alias("_up"), F.col(value).alias("_value")), "_up")
    best = hit.groupBy(path).agg(F.max_by("_value", F.struct("_depth", "_value")).alias(value))
    return paths.join(best, path, "left")


def unmatched(left: DataFrame, names: DataFrame, key: str, forms: Column) -> DataFrame:
    """Rows none of whose exploded ``forms`` is among ``names(name)`` (JON14): equi anti-join, no LIKE."""
    hits = left.select(key, F.explode(forms).alias("name")).join(names.select("name").distinct(), "name", "left_semi").select(key).distinct()
    return left.join(hits, key, "left_anti")


def cascade(refs: DataFrame, modes: list[DataFrame], key: str) -> DataFrame:
    """First mode that resolves a reference wins (JON17); ``modes`` hold ``key, target`` from strict to lax.

    ``target`` is the smallest of the winning mode's, ``candidates`` their number. A mode that brings ``candidates`` has been
    reduced to one row a reference already, as ``by_form`` does.
    """
    every = None
    for rank, m in enumerate(modes):
        one = m if "candidates" in m.columns else m.select(key, "target").distinct().groupBy(key).agg(F.min("target").alias("target"), F.count("*").alias("candidates"))
        one = one.select(key, F.lit(rank).alias("mode"), "target", "candidates")
        every = one if every is None else every.unionByName(one)
    best = every.groupBy(key).agg(F.min(F.struct("mode", "target", "candidates")).alias("_b")).select(key, "_b.*")
    return refs.join(best, key, "left")


def by_form(refs: DataFrame, targets: DataFrame, key: str, form: str) -> DataFrame:
    """``key, target, candidates``: the smallest target of the reference's form and their number, for ``cascade``.

    ``targets(target, form)`` are counted by form before references meet them, so a form that many of both share forms no pairs.
    """
    known = targets.select("target", form).distinct().groupBy(form).agg(F.min("target").alias("target"), F.count("*").alias("candidates"))
    return refs.join(known, form).select(key, "target", "candidates")


def resolve_references(refs: DataFrame, definitions: DataFrame, name: str, most: int) -> DataFrame:
    """References by name with a cardinality gate (JON15): one of resolved, ambiguous, unknown.

    Only definitions of the best rank count; more than ``most`` of them are ambiguous. Definitions
    of names that nothing refers to go first, and what is left is counted by name and rank
    before it is shuffled.
    """
    wanted = refs.select(name).distinct()
    ranks = definitions.join(wanted, name, "left_semi").groupBy(name, "rank").agg(F.count("*").alias("_n"), F.min("target").alias("_t"))
    best = ranks.groupBy(name).agg(F.min_by(F.struct("_n", "_t"), "rank").alias("_b")).select(name, "_b._n", "_b._t")
    out = refs.join(best, name, "left")
    status = F.when(F.col("_n").isNull(), "unknown").when(F.col("_n") > most, "ambiguous").otherwise("resolved")
    return out.select(*refs.columns, status.alias("status"), F.when(F.col("_n") <= most, F.col("_t")).alias("target"))


def deletions(word: Column, most: int) -> Column:
    """The word and what it becomes by deleting up to ``most`` (1 or 2) characters: the keys of a fuzzy join."""
    drop = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    out = F.array_union(F.array(word), drop(word))
    if most == 2:
        out = F.array_union(out, F.flatten(F.transform(drop(word), drop)))
    return F.array_distinct(out)


def fuzzy_nearest(words: DataFrame, word: str, most: int = 2) -> DataFrame:
    """Each word's nearest other word within ``most`` edits; ties by word (JON22).

    Two words within k edits share a key from deleting up to k characters each, so this
    is an equi-join on those keys and not all pairs; the distance is then verified.
    """
    one = words.select(F.col(word).alias("word")).where("word is not null").distinct()
    keyed = one.select("word", F.explode(deletions(F.col("word"), most)).alias("_key"))
    pairs = keyed.join(keyed.select(F.col("word").alias("other"), "_key"), "_key").where("word <> other").select("word", "other").distinct()
    near = pairs.withColumn("distance", F.levenshtein("word", "other")).where(F.col("distance") <= most)
    best = near.groupBy("word").agg(F.min(F.struct("distance", "other")).alias("_b"))
    return best.select("word", F.col("_b.other").alias("nearest"), F.col("_b.distance").cast("long").alias("distance"))


def gated_lookup(rows: DataFrame, facts: DataFrame, key: str, value: str) -> DataFrame:
    """A fact's value where the key has exactly one distinct one (JON21); else why not."""
    n = facts.groupBy(key).agg(F.count_distinct(value).alias("_n"), F.min(value).alias("_v"))
    out = rows.join(n, key, "left")
    return out.withColumn("verdict", F.when(F.col("_n").isNull(), "missing").when(F.col("_n") == 1, "matched").otherwise("conflicting")).withColumn(
        value, F.when(F.col("_n") == 1, F.col("_v"))
    ).drop("_n", "_v")


def integrity_problems(checks: list[tuple[str, DataFrame, DataFrame, str, str]]) -> DataFrame:
    """Foreign keys without a row (JON25, PRD19): ``rule, key`` from ``(rule, child, parent, child key, parent key)``."""
    out = None
    for rule, child, parent, ck, pk in checks:
        bad = child.join(parent, F.col(ck) == F.col(pk), "left_anti").select(F.lit(rule).alias("rule"), F.col(ck).cast("string").alias("key"))
        out = bad if out is None else out.unionByName(bad)
    return out

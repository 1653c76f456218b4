"""Predicates and classifiers: globs, first- and last-match rules, expiry, validation, path shapes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def glob_regex(glob: str) -> str:
    """A gitignore-style glob as an anchored regex for ``rlike`` (PRD05).

    Without a slash (but at its end) it matches at any depth; a directory covers its contents;
    ``*`` and ``?`` stay within a segment, ``**`` crosses them.
    """
    anywhere = "/" not in glob.rstrip("/")
    body, i, g = "", 0, glob.strip("/")
    while i < len(g):
        if g.startswith("**/", i):
            body, i = body + "(?:[^/]+/)*", i + 3
        elif g.startswith("**", i):
            body, i = body + ".*", i + 2
        elif g[i] == "*":
            body, i = body + "[^/]*", i + 1
        elif g[i] == "?":
            body, i = body + "[^/]", i + 1
        else:
            body, i = body + re.escape(g[i]), i + 1
    return ("^(?:.*/)?" if anywhere else "^") + body + "(?:/.*)?$"


def first_match(path: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The class of the first rule ``(class, regex)`` that matches (PRD01, PRD02, PRD14)."""
    out = None
    for name, regex in rules:
        out = F.when(path.rlike(regex), name) if out is None else out.when(path.rlike(regex), name)
    return out.otherwise(default) if out is not None else F.lit(default)


def last_match(path: Column, rules: list[tuple[str, bool]]) -> Column:
    """The state of the last rule ``(regex, state)`` that matches; null without one (PRD06)."""
    return F.coalesce(*[F.when(path.rlike(r), F.lit(s)) for r, s in reversed(rules)])


def first_reason(checks: list[tuple[str, Column]]) -> Column:
    """The first failing check's reason, null if all pass (PRD04, PRD10, PRD18, EXT03)."""
    return F.coalesce(*[F.when(c, F.lit(reason)) for reason, c in checks])


def suppressed_if_unclear(until: Column, today: Column) -> Column:
    """Inclusive expiry; a date that cannot be read suppresses (PRD09, merge policy)."""
    return F.coalesce(F.try_to_timestamp(until, F.lit("yyyy-MM-dd")).cast("date") >= today, F.lit(True))


def expired_if_unclear(until: Column, today: Column) -> Column:
    """Inclusive expiry; a date that cannot be read has expired (PRD09, baseline policy)."""
    return F.coalesce(F.try_to_timestamp(until, F.lit("yyyy-MM-dd")).cast("date") < today, F.lit(True))


def canonical_path(path: Column) -> Column:
    """Forward slashes, no ``./``, no double slashes; null if absolute, with a drive, or going up (PRD11)."""
    p = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "/+", "/")
    p = F.regexp_replace(F.regexp_replace(p, r"(^|/)(\./)+", "$1"), r"/\.?$", "")
    bad = p.rlike(r"^/|(^|/)\.\.(/|$)|:") | (p == "")
    return F.when(~bad, p)


def is_path(token: Column) -> Column:
    """Whether a token looks like a file's path: no URL, placeholder, ratio or call (PRD12)."""
    shape = token.rlike(r"^[A-Za-z0-9_.@-]+(/[A-Za-z0-9_.@-]+)*\.[A-Za-z][A-Za-z0-9]{0,5}$|^([A-Za-z0-9_.@-]+/)+[A-Za-z0-9_.@-]*$")
    return shape & ~token.rlike(r"://|[<>{}$*]|^[0-9]+/[0-9]+$|\(\)$")


def name_shape(name: Column) -> Column:
    """upper, mixed, separated or plain (PRD13)."""
    return (
        F.when(name.rlike("^[A-Z][A-Z0-9]*(_[A-Z0-9]+)*$") & name.rlike("[A-Z]{2}"), "upper")
        .when(name.rlike("[a-z][A-Z]"), "mixed")
        .when(name.rlike("[A-Za-z0-9][_.-][A-Za-z0-9]"), "separated")
        .otherwise("plain")
    )


def keyword_label(text: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The label of the first keyword that the text holds (PRD15)."""
    out = None
    for word, label in rules:
        hit = F.contains(text, F.lit(word))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(default)


def family_enabled(df: DataFrame, disabled: DataFrame) -> DataFrame:
    """Rows whose family is not disabled for their path class; ``all`` disables every family (PRD08)."""
    everywhere = disabled.where("family = 'all'").select("path_class").distinct()
    return df.join(disabled.where("family <> 'all'"), ["path_class", "family"], "left_anti").join(everywhere, "path_class", "left_anti")


def top_segment(path: Column) -> Column:
    """The first segment of a path; null at the root (PRD28)."""
    return F.when(F.instr(path, "/") > 0, F.split_part(path, F.lit("/"), F.lit(1)))


def extends_by_one_span(old: Column, new: Column, most: int) -> Column:
    """Whether ``new`` is ``old`` with one span of 1 to ``most`` tokens put in (PRD23).

    Equal ends that meet: the longest common prefix and suffix must cover all of ``old``.
    """
    extra = F.size(new) - F.size(old)
    fits = F.exists(
        F.sequence(F.lit(0), F.size(old)),
        lambda k: (F.slice(new, F.lit(1), k) == F.slice(old, F.lit(1), k))
        & (F.slice(new, k + extra + 1, F.size(old) - k) == F.slice(old, k + 1, F.size(old) - k)),
    )
    return extra.between(1, most) & F.when(extra.between(1, most), fits).otherwise(F.lit(False))


#: What a scenario does that keeps others from running beside it, and the tag that says so.
EXCLUSIVE, ALONE, DEFECT = r"Stubs\.reset\(|Stubs\.load\(|Db\.truncate\(|\btruncate:|\bstubs:", "@parallel=false", "@known-defect"


def effective_scenarios(blocks: DataFrame, key: str) -> DataFrame:
    """Scenarios of feature files ``(key, kind, name, tags, line, body)`` with their feature's tags added: ``tags, unsafe, defect`` (PRD25).

    One is unsafe if it, or a Background of its file, does what ``EXCLUSIVE`` names and no tag says that it runs alone.
    """
    does = F.col("body").rlike(EXCLUSIVE)
    above = blocks.groupBy(key).agg(F.flatten(F.collect_list(F.when(F.col("kind") == "Feature", F.col("tags")))).alias("_above"), F.bool_or((F.col("kind") == "Background") & does).alias("_tainted"))
    s = blocks.where("kind in ('Scenario', 'Scenario Outline')").join(above, key).withColumn("tags", F.array_sort(F.array_union("tags", "_above")))
    name = F.coalesce(F.nullif("name", F.lit("")), F.col("kind"))
    unsafe = ~F.array_contains("tags", F.lit(ALONE)) & (F.col("_tainted") | does)
    return s.select(key, "line", name.alias("name"), "tags", unsafe.alias("unsafe"), F.array_contains("tags", F.lit(DEFECT)).alias("defect"))

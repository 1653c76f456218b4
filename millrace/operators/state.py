"""Keyed state carried across runs, and snapshot differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """``key, status, old, new``: NEW, RESOLVED, CHANGED or UNCHANGED (JON11, SET07); one full outer join."""
    b = before.select(F.col(key).alias("_kb"), F.col(value).alias("old"))
    a = after.select(F.col(key).alias("_ka"), F.col(value).alias("new"))
    j = b.join(a, F.col("_kb") == F.col("_ka"), "full")
    status = F.when(F.col("_kb").isNull(), "NEW").when(F.col("_ka").isNull(), "RESOLVED").when(F.col("old").eqNullSafe(F.col("new")), "UNCHANGED").otherwise("CHANGED")
    return j.select(F.coalesce("_ka", "_kb").alias(key), status.alias("status"), "old", "new")


def upsert(state: DataFrame, seen: DataFrame, key: str, today: Column) -> DataFrame:
    """State rows ``key, first_seen, last_seen, status`` after a run that saw ``seen(key)`` (STM01, SRC25).

    first_seen is kept, last_seen moves, decisions (status other than open) stay; what is
    not seen any more and was open is resolved.
    """
    s = seen.select(F.col(key).alias("_k")).distinct()
    j = state.join(s, F.col(key) == F.col("_k"), "full")
    here = F.col("_k").isNotNull()
    return j.select(
        F.coalesce(key, "_k").alias(key),
        F.coalesce("first_seen", today).alias("first_seen"),
        F.when(here, today).otherwise(F.col("last_seen")).alias("last_seen"),
        F.when(here, F.coalesce("status", F.lit("open"))).when(F.col("status") == "open", "resolved").otherwise(F.col("status")).alias("status"),
    )


def staged(state: DataFrame, now: DataFrame, key: str, digest: str, run: int) -> DataFrame:
    """Three stages of a key whose content does not change: 1, 2, then remove (STM02, STM07).

    A changed digest starts anew; a state from a later run is stale and starts anew; keys
    that are gone leave the state.
    """
    s = state.select(F.col(key).alias("_k"), F.col(digest).alias("_d"), "stage", "run")
    j = now.join(s, F.col(key) == F.col("_k"), "left")
    same = F.col("_k").isNotNull() & (F.col("_d") == F.col(digest)) & (F.col("run") < run)
    stage = F.when(same, F.least(F.col("stage") + 1, F.lit(3))).otherwise(F.lit(1))
    return j.select(key, digest, stage.alias("stage"), F.lit(run).alias("run"), (stage == 3).alias("remove"))


def high_water(marks: DataFrame, source: str, mark: str) -> DataFrame:
    """The furthest checkpoint of each source (STM03)."""
    return marks.groupBy(source).agg(F.max(mark).alias(mark))


def next_pending(queue: DataFrame, group: str, pos: str, done: str) -> DataFrame:
    """The first entry of each group that is not done (STM04)."""
    return queue.where(~F.col(done)).groupBy(group).agg(F.min(pos).alias(pos))


def merged_fields(old: DataFrame, new: DataFrame, key: str, replace: list[str], unite: list[str]) -> DataFrame:
    """Field-wise merge by key: replace where given, unite arrays, new keys appended (SET06, JON30)."""
    n = new.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in replace + unite])
    j = old.join(n, F.col(key) == F.col("_k"), "full")
    out = [F.coalesce(key, "_k").alias(key)]
    out += [F.coalesce(f"_{c}", c).alias(c) for c in replace]
    out += [F.array_sort(F.array_union(F.coalesce(c, F.array()), F.coalesce(f"_{c}", F.array()))).alias(c) for c in unite]
    return j.select(*out)

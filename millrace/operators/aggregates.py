"""Aggregations: histories, modes, roll-ups, histograms, thresholds, evaluation and keyed dedupe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mode_with_share(df: DataFrame, key: str, value: str, pos: str) -> DataFrame:
    """The most frequent value of each key and its share; of equals the first seen (AGG03)."""
    n = df.groupBy(key, value).agg(F.count("*").alias("_n"), F.min(pos).alias("_first"))
    best = F.max_by(value, F.struct("_n", (-F.col("_first")).alias("f")))
    return n.groupBy(key).agg(best.alias(value), (F.max("_n") / F.sum("_n")).alias("share"), F.sum("_n").alias("n"))


def normalised(value: Column, over=None) -> Column:
    """A value by its global maximum; a maximum of zero gives zero (AGG05)."""
    top = F.max(value).over(over or Window.partitionBy())
    return F.when(top > 0, value / top).otherwise(F.lit(0.0))


def normalised_by(df: DataFrame, columns: list[str]) -> DataFrame:
    """``<c>_norm`` for each column by its global maximum, joined as a single row (AGG05)."""
    top = df.agg(*[F.max(c).alias(f"_max_{c}") for c in columns])
    out = df.join(F.broadcast(top))  # one row
    for c in columns:
        out = out.withColumn(f"{c}_norm", F.when(F.col(f"_max_{c}") > 0, F.col(c) / F.col(f"_max_{c}")).otherwise(F.lit(0.0)))
    return out.drop(*[f"_max_{c}" for c in columns])


def instability(edges: DataFrame) -> DataFrame:
    """Fan-in, fan-out and out / (in + out) of each node, 0 where it has neither (AGG04)."""
    ends = edges.where("src <> dst").select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(
        edges.where("src <> dst").select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    )
    return ends.groupBy("node").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out")).withColumn(
        "instability", F.coalesce(F.try_divide(F.col("fan_out").cast("double"), F.col("fan_in") + F.col("fan_out")), F.lit(0.0))
    )


def histogram(df: DataFrame, band: Column, bands: list[str]) -> DataFrame:
    """Rows in each band, empty bands as 0 (AGG06)."""
    spark = df.sparkSession
    order = spark.createDataFrame(list(enumerate(bands)), "band_no int, band string")
    n = df.select(band.alias("band")).groupBy("band").agg(F.count("*").alias("_n"))
    return order.join(n, "band", "left").select("band_no", "band", F.coalesce("_n", F.lit(0)).alias("n"))


def count_threshold(df: DataFrame, value: str, fraction: float = 0.1) -> DataFrame:
    """The value of the row that closes the top fraction by count; null without spread (AGG07).

    Found from the counts of each value, so ranks come from a window over distinct values.
    """
    n = df.groupBy(value).agg(F.count("*").alias("_n"))
    total = n.agg(F.sum("_n").alias("_all"), F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    above = n.withColumn("_rank", F.sum("_n").over(Window.orderBy(F.desc(value)))).join(F.broadcast(total))
    k = F.greatest(F.lit(1), F.ceil(F.lit(fraction).cast("double") * F.col("_all")))
    floor_ = above.where(F.col("_rank") >= k).agg(F.max(value).alias("threshold"))
    return floor_.join(F.broadcast(total)).select(F.when(F.col("_lo") != F.col("_hi"), F.col("threshold")).alias("threshold"))


def evaluation(marked: DataFrame, group: str) -> DataFrame:
    """Precision and recall by group; null on an empty denominator (AGG11). ``marked``: predicted, actual booleans."""
    tp = F.count_if(F.col("predicted") & F.col("actual"))
    out = marked.groupBy(group).agg(
        tp.alias("tp"), F.count_if("predicted").alias("n_predicted"), F.count_if("actual").alias("n_actual"), F.count_if(F.col("predicted") & ~F.col("actual")).alias("decoys")
    )
    share = lambda a, b: F.round(F.try_divide(F.col(a).cast("double"), F.col(b)), 3)
    return out.withColumn("precision", share("tp", "n_predicted")).withColumn("recall", share("tp", "n_actual"))


def keep_one(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in ``order`` (AGG18); combined before the shuffle, so a hot key is no hot task.

    ``order`` holds ascending sort expressions and should end in a tie-break.
    """
    best = F.min_by(F.struct(*df.columns), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]))
    return df.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(best.alias("_row")).select("_row.*")


def failure_groups(df: DataFrame, signature: Column, pos: str, attributes: list[str]) -> DataFrame:
    """Groups by normalised signature with the first row's attributes, largest first (AGG12)."""
    g = df.withColumn("signature", signature).groupBy("signature").agg(
        F.count("*").alias("n"), F.min(pos).alias("first_pos"), F.min_by(F.struct(*attributes), pos).alias("_a")
    )
    return g.select("signature", "n", "first_pos", *[F.col(f"_a.{a}").alias(a) for a in attributes])


def collapse_hits(hits: DataFrame, keys: list[str], severity: str, pos: str, note: str) -> DataFrame:
    """One row per key: worst severity, the first hit with it, notes and ids in order (AGG16)."""
    return hits.groupBy(*keys).agg(
        F.max(severity).alias("severity"),
        F.max_by(note, F.struct(severity, (-F.col(pos)).alias("p"))).alias("primary_note"),
        F.array_join(F.array_sort(F.collect_set(note)), ", ").alias("notes"),
    )


def bag_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` beyond their number in ``b`` (AGG19)."""
    return a.exceptAll(b)

"""Priorities of findings from severity, interest, tier and effort, every term rounded so that a reader can work it out again (FUN05)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights of tiers; a finding without a known one is taken as B.
TIERS, OTHER_TIER = {"A": 1.0, "B": 0.7, "C": 0.35}, 0.7


def looked_up(c: Column, of: Mapping[str, float], other: float) -> Column:
    out = F.lit(other)
    for name, value in of.items():
        out = F.when(c == name, F.lit(value)).otherwise(out)
    return out


def priorities(findings: DataFrame, files: DataFrame, weights: Mapping[str, float], efforts: Mapping[str, float]) -> DataFrame:
    """``H, C, F, interest, tier_weight, tractability, priority`` beside ``findings(severity, tier, effort, hotspot, coupling, fan_in, mode)``.

    A signal counts as its share of the largest of ``files(hotspot, coupling, fan_in, mode)``; fan-in counts only where it comes from
    ``import-lines``, in the findings and in the maximum. ``weights`` are of H, C and F, ``efforts`` the ease of S, M and L, M for any other. Null signals and
    maxima of zero are shares of zero, a null severity is zero. The maxima are one row.
    """
    counted = F.coalesce("mode", F.lit("import-lines")) == "import-lines"
    top = files.agg(F.max("hotspot").alias("_h"), F.max("coupling").alias("_c"), F.max(F.when(counted, F.col("fan_in"))).alias("_f"))
    share = lambda c, most: F.when(F.coalesce(most, F.lit(0)) > 0, F.round(F.coalesce(c, F.lit(0)).cast("double") / most, 4)).otherwise(F.lit(0.0))
    out = findings.join(F.broadcast(top))
    out = out.withColumn("H", share(F.col("hotspot"), F.col("_h"))).withColumn("C", share(F.col("coupling"), F.col("_c")))
    out = out.withColumn("F", F.when(counted, share(F.col("fan_in"), F.col("_f"))).otherwise(F.lit(0.0)))
    # sums and products of terms of four places are exact as decimals, so a half is one on every engine and goes up
    exact = lambda c: (F.lit(c) if isinstance(c, float) else F.col(c)).cast("decimal(9,4)")
    out = out.withColumn("interest", F.round(1 + sum((exact(float(weights[k])) * exact(k) for k in "CF"), exact(float(weights["H"])) * exact("H")), 4).cast("double"))
    out = out.withColumn("tier_weight", looked_up(F.col("tier"), TIERS, OTHER_TIER)).withColumn("tractability", looked_up(F.col("effort"), efforts, efforts["M"]))
    score = F.round(F.coalesce("severity", F.lit(0)).cast("decimal(9,0)") * exact("interest") * (exact("tier_weight") * exact("tractability")).cast("decimal(12,8)"), 4)
    return out.withColumn("priority", score.cast("double")).drop("_h", "_c", "_f")

"""Settings in layers over typed defaults, scope by scope (SET08, PRD24): the joins of what ``config`` does for one program."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.config import DEFAULTS

#: What a value of a type looks like.
FORMS = {"int": r"^[+-]?[0-9]+$", "float": r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$", "bool": "^(true|false)$", "str": ""}


def typed(defaults: dict[str, Any], at: str = "") -> list[tuple[str, str, str]]:
    """``(key, type, value)`` of nested defaults, keys with dots; lists are left out."""
    out = []
    for k, v in defaults.items():
        if isinstance(v, dict):
            out += typed(v, f"{at}{k}.")
        elif not isinstance(v, list):
            out.append((f"{at}{k}", type(v).__name__, str(v).lower() if isinstance(v, bool) else str(v)))
    return out


def layered(rows: DataFrame, defaults: dict[str, Any] | None = None) -> DataFrame:
    """``scope, key, value, warning``: every default of every scope of ``rows(scope, layer, key, value)``, overridden by the highest layer.

    Of one layer the largest value wins. A value that is not of the default's type leaves the default and has a warning, as has a key without a default,
    whose value is null. Each scope's rows are reduced to one for a key before they meet the few defaults.
    """
    spark = rows.sparkSession
    known = spark.createDataFrame(typed(DEFAULTS if defaults is None else defaults), "key string, type string, fallback string")
    top = rows.where("key is not null").groupBy("scope", "key").agg(F.max_by("value", F.struct("layer", "value")).alias("value"))
    given = top.join(F.broadcast(known), "key", "left")
    fits = F.lit(False)
    for name, form in FORMS.items():
        fits = fits | ((F.col("type") == name) & F.col("value").rlike(form))
    wrong = F.concat("key", F.lit(" should be "), "type")
    said = given.select("scope", "key", F.when(F.col("type").isNull(), F.lit(None)).when(F.coalesce(fits, F.lit(False)), F.col("value")).otherwise(F.col("fallback")).alias("value"), F.when(F.col("type").isNull(), F.concat(F.lit("unknown key "), "key")).when(~F.coalesce(fits, F.lit(False)), wrong).alias("warning"))
    # a scope has each default once, so its rows are the defaults
    every = rows.select("scope").distinct().select("scope", F.inline(F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, _, v in typed(DEFAULTS if defaults is None else defaults)])))
    rest = every.join(top.select("scope", "key"), ["scope", "key"], "left_anti").select("scope", "key", "value", F.lit(None).cast("string").alias("warning"))
    return said.union(rest)

"""Findings: edges from names, quotes found again, keys that migrate, replies unwrapped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stem_edges(tokens: DataFrame, stems: DataFrame, word: str, src: str, dst: str) -> DataFrame:
    """``src, dst, n``: tokens whose stem has one holder only point to it (JON03); no self edges."""
    only = stems.groupBy(word).agg(F.count("*").alias("_n"), F.min(dst).alias("dst")).where("_n = 1").select(word, "dst")
    return tokens.join(only, word).where(F.col(src) != F.col("dst")).groupBy(F.col(src).alias("src"), "dst").agg(F.count("*").alias("n"))


def locate_quotes(quotes: DataFrame, lines: DataFrame) -> DataFrame:
    """``doc_id, cited, found, places``: first line with the quote's text and how many there are (JON06)."""
    l = lines.select("doc_id", "n", F.col("t").alias("quote"))
    return quotes.join(l, ["doc_id", "quote"]).groupBy("doc_id", "cited").agg(F.min("n").alias("found"), F.count("*").alias("places"))


def migrate_keys(new: DataFrame, old: DataFrame, reach: int) -> DataFrame:
    """``new_id, old_id``: the nearest old row of the same entity within ``reach`` lines that shares half its words (JON12).

    Rows meet by entity and a bucket of lines, each new row looking into three buckets.
    """
    bucket = lambda c: F.floor(F.col(c) / reach)
    n = new.withColumn("_b", F.explode(F.sequence(bucket("line") - 1, bucket("line") + 1)))
    j = n.join(old.withColumn("_b", bucket("old_line")), ["k", "_b"])
    near = (F.abs(F.col("line") - F.col("old_line")) <= reach) & (2 * F.size(F.array_intersect("t", "old_t")) >= F.size("old_t"))
    return j.where(near).groupBy("new_id").agg(F.min_by("old_id", F.struct(F.abs(F.col("line") - F.col("old_line")).alias("d"), "old_id")).alias("old_id"))


def unwrapped(reply: Column) -> Column:
    """The JSON of a reply, with or without a fence around it (FUN38); null where none parses."""
    inner = F.nullif(F.regexp_extract(reply, r"(?s)```(?:json)?\s*(.*?)\s*```", 1), F.lit(""))
    body = F.coalesce(inner, F.trim(reply))
    return F.when(F.try_parse_json(body).isNotNull(), body)


def redacted_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nested columns with every string in them redacted, by way of their JSON (NRM13)."""
    from millrace.functions.text import redacted

    for c in columns:
        df = df.withColumn(c, F.from_json(redacted(F.to_json(c)), df.schema[c].dataType))
    return df


def coverage_problems(claims: DataFrame, texts: DataFrame) -> DataFrame:
    """``doc, line, times`` of lines that claims ``(doc, lo, hi)`` do not cover exactly once (EXT07)."""
    covered = claims.select("doc", F.explode(F.sequence("lo", "hi")).alias("line")).groupBy("doc", "line").agg(F.count("*").alias("times"))
    every = texts.select("doc", F.explode(F.sequence(F.lit(1), "n_lines")).alias("line"))
    return every.join(covered, ["doc", "line"], "full").select("doc", "line", F.coalesce("times", F.lit(0)).alias("times")).where("times <> 1")


def citation_subject(citations: DataFrame, names: DataFrame, reach: int = 120) -> DataFrame:
    """The name a citation is about: the nearest before it within reach, else the nearest after (JON19)."""
    j = citations.join(names, "doc").where((F.col("name_at") >= F.col("at") - reach) & (F.col("name_at") <= F.col("at") + reach))
    order = F.struct((F.col("name_at") > F.col("at")).alias("after"), F.abs(F.col("at") - F.col("name_at")).alias("d"), "name")
    best = j.groupBy("doc", "at").agg(F.min_by("name", order).alias("name"))
    return citations.join(best, ["doc", "at"], "left")


def work_plan(df: DataFrame, role: str, order: list[str], most: int) -> DataFrame:
    """``id, role`` and the rows' columns: numbered work items, at most ``most`` (EXT09, SRT08)."""
    from pyspark.sql import Window

    first = df.orderBy(*order).limit(most)
    n = F.row_number().over(Window.orderBy(*order))  # over at most ``most`` rows
    return first.select(F.format_string(f"{role}-%03d", n).alias("id"), F.lit(role).alias("role"), *df.columns)

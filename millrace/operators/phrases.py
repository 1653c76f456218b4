"""Names of one to a few words in texts, by word n-grams and equi-joins instead of a pattern for each pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a word is for a kind of name: hyphens and underscores belong to flags and parameters, not to other names.
WORDS = {"flag": "[a-z0-9_-]+", "param": "[a-z0-9_-]+", "name": "[a-z0-9]+"}


def words(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(0))


def grams(found: Column, n: int) -> Column:
    """The different runs of ``n`` words, joined by a space."""
    runs = F.transform(F.sequence(F.lit(1), F.size(found) - (n - 1)), lambda i: F.array_join(F.slice(found, i, n), " "))
    return F.when(F.size(found) >= n, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def named_phrases(names: DataFrame, pattern: str) -> DataFrame:
    return names.withColumn("phrase", F.array_join(words(F.col("name"), pattern), " ")).withColumn("n", F.size(words(F.col("name"), pattern))).where("n > 0")


def phrases_in_texts(sections: DataFrame, names: DataFrame) -> DataFrame:
    """``doc, section, id``: the names that each section says (JON23).

    ``sections(doc, section, heading, text)`` and ``names(id, name, kind, parent)``. A name stands where its words stand one after another, whole,
    in any case; what a word is follows from its kind. One with a parent counts only in sections whose heading says the parent. Words of a section that begin
    some name meet the first words of names, and only from those are runs of the lengths of such names made, which meet names by the run; a section that says a name
    twice says it once. Nothing reaches the driver. Null and empty texts say nothing, and a name without a word is nowhere.
    """
    out = None
    for pattern in sorted(set(WORDS.values())):
        kinds = [k for k, p in WORDS.items() if p == pattern]
        own = F.col("kind").isin(*kinds) if pattern != WORDS["name"] else ~F.coalesce(F.col("kind").isin(*[k for k in WORDS if k not in kinds]), F.lit(False))
        some = named_phrases(names.where(own), pattern)
        some = some.withColumn("first", F.element_at(F.split("phrase", " "), 1))
        heads = some.groupBy("first").agg(F.collect_set("n").alias("lengths"))
        said = sections.select(F.monotonically_increasing_id().alias("_row"), "doc", "section", "heading", words(F.col("text"), pattern).alias("_words"))
        at = said.select("_row", "doc", "section", "heading", "_words", F.posexplode("_words").alias("_at", "first")).join(heads, "first")
        runs = at.select("_row", "doc", "section", "heading", "_words", "_at", F.explode("lengths").alias("n")).where(F.col("_at") + F.col("n") <= F.size("_words"))
        runs = runs.select("_row", "doc", "section", "heading", F.array_join(F.slice("_words", F.col("_at") + 1, F.col("n")), " ").alias("phrase"))
        parent = F.array_join(words(F.col("parent"), WORDS["name"]), " ")
        met = runs.join(some.select("id", "phrase", parent.alias("_parent")), "phrase")
        under = F.concat(F.lit(" "), F.array_join(words(F.col("heading"), WORDS["name"]), " "), F.lit(" "))
        kept = met.where((F.col("_parent") == "") | F.contains(under, F.concat(F.lit(" "), F.col("_parent"), F.lit(" ")))).select("_row", "doc", "section", "id").distinct().drop("_row")
        out = kept if out is None else out.union(kept)
    return out


def hidden_phrases(found: DataFrame, names: DataFrame) -> DataFrame:
    """``doc, section, name, rejected`` for the texts of ``phrases_in_texts``: rejected where all entries that the same words name are ``hidden`` (JON39)."""
    entry = names.select("id", F.lower("name").alias("name"), F.coalesce("hidden", F.lit(False)).alias("hidden"))
    return found.join(entry, "id").groupBy("doc", "section", "name").agg(F.bool_and("hidden").alias("rejected"))

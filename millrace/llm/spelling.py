"""Spelling variants: words one edit apart, and the frequent form that a rare word stands for.

Candidates come from a rare-first filter on positional bigrams. All bigrams of the vocabulary are
ordered by frequency, rarest first; one edit spoils at most two bigrams of a word, so two words one
edit apart share one of their three rarest, at the same place or one further on in the longer word.
Words are joined on ``(bigram, length, place)`` and verified by edit distance.

A key that more than ``CROWDED`` words hold is not paired within. Its words meet on what they are with
one code point left out (two words of one length at the same place, a word with a longer one by its
whole), where at most as many words meet as there are letters for a place. The answer is the same.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import CRC_TABLE, sql_bytes, sql_crc32
from millrace.session import cut

LEAST, MOST_OFTEN, EDITED, RARE, CROWDED = 7, 10, 31, 3, 32
#: Letters a to z and U+00E0 to U+00FF and, as only A to Z are lower-cased, U+00C0 to U+00DF.
LETTERS = 26 + 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def occurrences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``word``: a row for each run of at least ``LEAST`` letters, lower-cased, some with a letter left out by their hash."""
    # a run shorter than that cannot be a word, and a greedy match of that many is a maximal run
    runs = F.explode(F.regexp_extract_all(F.col(f"`{text}`"), F.lit(f"[A-Za-zÀ-ÿ]{{{LEAST},}}"), F.lit(0)))
    found = docs.select(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("key"), runs.alias("run"))
    low = found.select("key", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run")).alias("run"))
    h = low.select("run", F.crc32(F.concat("key", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    without = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    return h.select(F.when(F.col("h") % EDITED == 0, without).otherwise(F.col("run")).alias("word")).where(F.length("word") >= LEAST)


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 2) -> DataFrame:
    """``word, n`` of words with at least ``least`` occurrences, counted before the shuffle."""
    return occurrences(docs, key, text).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def bigrams(word: str = "word") -> Column:
    """A number below ``LETTERS`` squared for each bigram of the word, in order."""
    number = lambda c: F.when(F.ascii(c) < 128, F.ascii(c) - 97).otherwise(F.ascii(c) - 192 + 26)
    letters = F.transform(F.split(word, ""), number)
    n = F.length(word)
    return F.zip_with(F.slice(letters, F.lit(1), n - 1), F.slice(letters, F.lit(2), n - 1), lambda a, b: a * LETTERS + b)


def entries(words: DataFrame) -> DataFrame:
    """``word, n, length, gram, place``: the three rarest bigrams of each word, with places.

    The driver sees the frequencies, at most ``LETTERS`` squared numbers whatever the vocabulary.
    """
    often = dict(words.select(F.explode(bigrams()).alias("gram")).groupBy("gram").count().collect())
    counts = F.split(F.lit(",".join(str(often.get(g, 0)) for g in range(LETTERS * LETTERS))), ",").cast("array<long>")
    grams = bigrams()
    ranked = F.transform(grams, lambda g, i: F.struct(F.get(counts, g).alias("often"), g.alias("gram"), i.alias("place")))
    rarest = words.select("word", "n", F.length("word").alias("length"), F.explode(F.slice(F.array_sort(ranked), 1, RARE)).alias("x"))
    return rarest.select("word", "n", "length", "x.gram", "x.place")


def near_pairs(words: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """``a, a_n, b, b_n``: each two of the distinct words ``word, n`` that are one edit apart, once."""
    key = ["gram", "length", "place"]
    own = entries(words)
    held = cut(own.join(own.groupBy(*key).agg(F.count("*").alias("held")), key))
    # what a word looks up: its own keys, and those of words one letter longer
    more = F.array(*[F.struct((F.col("length") + a).alias("length"), (F.col("place") + b).alias("place")) for a, b in ((0, 0), (1, 0), (1, 1))])
    looks = held.select(F.col("word").alias("a"), F.col("n").alias("a_n"), "gram", F.col("length").alias("a_length"), F.inline(more))
    kept = held.where(F.col("held") <= crowded).select(F.col("word").alias("b"), F.col("n").alias("b_n"), *key)
    plain = looks.join(kept, key).where((F.col("a_length") < F.col("length")) | (F.col("a") < F.col("b")))
    # words of crowded keys, by what is left of them without a letter
    full = held.where(F.col("held") > crowded)
    longer = full.select("word", "n").distinct()
    shorter = looks.join(full.select(*key).distinct(), key, "left_semi").select(F.col("a").alias("word"), F.col("a_n").alias("n")).distinct()
    left_out = F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.xxhash64(F.concat(F.substr("word", F.lit(1), i - 1), F.substr("word", i + 1))))
    cuts = longer.select("word", "n", F.posexplode(left_out).alias("place", "rest"))
    b = cuts.select(F.col("word").alias("b"), F.col("n").alias("b_n"), "place", "rest")
    same = cuts.select(F.col("word").alias("a"), F.col("n").alias("a_n"), "place", "rest").join(b, ["place", "rest"]).where("a < b")
    added = shorter.select(F.col("word").alias("a"), F.col("n").alias("a_n"), F.xxhash64("word").alias("rest")).join(b, "rest")
    columns = ["a", "a_n", "b", "b_n"]
    met = plain.select(*columns).union(same.select(*columns)).union(added.select(*columns))
    # a pair may meet at several keys: verified first, then made one
    return met.where(F.levenshtein("a", "b", 1) == 1).distinct()


def roots(forms: DataFrame, most: int) -> DataFrame:
    """``word, root`` of ``word, form``: where forms lead; each step multiplies n by ``MOST_OFTEN``, so ``most`` bounds the steps."""
    steps = max(1, math.floor(math.log(max(most, 1), MOST_OFTEN)) + 1)
    at = forms.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps))):
        at = cut(at)
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        at = at.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
    return at


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of the vocabulary.

    A word's form is the most frequent word one edit away (ties: the first in code-point order) if that
    is at least ``MOST_OFTEN`` times as frequent; its root is where forms lead. Null and empty texts have
    no words, repeated rows count each, a null key is an empty text in the hash, texts and words may be
    of any length, an empty table has no words, and other columns are not read whatever their names.
    """
    words = cut(vocabulary(docs, key, text))
    pairs = cut(near_pairs(words))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("other_n")).union(pairs.select("b", "a", "a_n"))
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("m"), F.col("other").alias("form"))).alias("best"))
    known = cut(words.join(near, "word", "left"))
    n = -F.col("best.m")
    has = F.col("best").isNotNull() & (n >= MOST_OFTEN * F.col("n"))
    known = known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best.form")).alias("form"), F.when(has, n).alias("form_n"))
    most = words.agg(F.max("n")).first()[0] or 0
    led = roots(known.where("form is not null"), most)
    return known.join(led, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def oracle() -> str:
    """SQL for ``documents``: pairs by words without a letter, roots by recursion."""
    return f"""
WITH RECURSIVE {CRC_TABLE},
o AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{{LEAST},}}')), '{UPPER}', '{LOWER}') AS run FROM documents),
r AS (SELECT run, n, {sql_crc32("data")} AS h FROM (SELECT run, count(*) AS n, any_value({sql_bytes("coalesce(doc_id::VARCHAR, '') || ':' || run")}) AS data FROM o GROUP BY doc_id, run), crc),
w AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, CASE WHEN h % {EDITED} = 0 THEN run[1 : h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word FROM r) WHERE length(word) >= {LEAST} GROUP BY word HAVING sum(n) >= 2),
d AS MATERIALIZED (SELECT word, i, word[1 : i - 1] || word[i + 1 :] AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (SELECT a.word, b.word AS other FROM d a JOIN d b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
 UNION SELECT d.word, w.word FROM d JOIN w ON d.rest = w.word UNION SELECT w.word, d.word FROM d JOIN w ON d.rest = w.word),
b AS (SELECT p.word, count(*) AS n_near, max(o.n) AS most, arg_min(other, struct_pack(n := -o.n, w := other)) AS best FROM p JOIN w o ON o.word = other GROUP BY p.word),
f AS MATERIALIZED (SELECT w.word, CASE WHEN most >= {MOST_OFTEN} * n THEN best END AS form, n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, CASE WHEN most >= {MOST_OFTEN} * n THEN most END AS form_n FROM w LEFT JOIN b USING (word)),
c AS (SELECT word, word AS at FROM f UNION ALL SELECT c.word, f.form FROM c JOIN f ON f.word = c.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n FROM f JOIN c ON c.word = f.word JOIN f e ON e.word = c.at WHERE e.form IS NULL"""

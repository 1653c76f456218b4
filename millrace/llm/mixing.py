"""Mixing sources to target weights, in blocks of words.

Each source's documents, one after another in a fixed order, are a stream of words cut
into blocks of ``BLOCK``. An output shard is a run of slots whose sources are drawn by a
multinomial over the targets: first counts for groups of ``TOGETHER`` sources, then, within a
group, for its sources. A source's slots, numbered over all shards, pass through
pseudorandom permutations of its block numbers (one for each time through the source),
and the slots are joined with the blocks by index. What the draws give a source beyond
its target goes to the sources that fell short, so each ends on its target, and since a
permutation meets a block once and no target is above twice its source, no document is
taken more than twice.

Sources are a table like any other: targets, quotas, draws and running offsets are distributed.
The driver gets one number for each ``TOGETHER`` sources.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import flat_map_rows, row_hash
from millrace.operators.windows import numbered
from millrace.session import cut, ship

WORD = r"[^\x20\x09-\x0D]+"
BLOCK, SHARD_SLOTS, SLOTS_PER_TASK, ROUNDS, SEED, TOGETHER = 128, 2048, 200_000, 16, 17, 256
#: Slots that change their source meet the sources that fell short in stretches of so many.
STRETCH = 1024
#: A source's stream is put in order by at least so many buckets.
LEAST_BUCKETS = 64
WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2.0


def n_words(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> list[dict]:
    """Targets of the sources by code point, null last: shares by weight, none above ``most`` times its size.

    The definition, in one place for a list of sources; ``plan`` gives the same for a table of any number.
    """
    rows = [
        {"source": s, "source_size": n, "weight": weights[i % len(weights)], "target": 0.0}
        for i, (s, n) in enumerate(sorted(sizes, key=lambda x: (x[0] is None, x[0] or "")))
    ]
    left, open_ = share * sum(n for _, n in sizes), list(rows)
    while open_:
        unit = left / sum(r["weight"] for r in open_)
        full = [r for r in open_ if unit * r["weight"] > most * r["source_size"]]
        for r in full or open_:
            r["target"] = most * r["source_size"] if full else unit * r["weight"]
        if not full:
            break
        left -= sum(r["target"] for r in full)
        open_ = [r for r in open_ if r not in full]
    return rows


def running_start(df: DataFrame, key: str, bucket: str, order: list[str], value: str, name: str) -> DataFrame:
    """Sum of ``value`` over the key's earlier rows, in two levels: no key's rows meet in one task, only its buckets' sums."""
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(key, bucket).agg(F.sum(value).alias("_s"))
    base = sums.select(key, bucket, F.coalesce(F.sum("_s").over(before(Window.partitionBy(key).orderBy(bucket))), F.lit(0)).alias("_base"))
    local = df.withColumn("_local", F.coalesce(F.sum(value).over(before(Window.partitionBy(key, bucket).orderBy(*order))), F.lit(0)))
    return local.join(base, [key, bucket]).withColumn(name, F.col("_base") + F.col("_local")).drop("_base", "_local")


def permuted(x: Column, n: Column, *salt: Column) -> Column:
    """A pseudorandom bijection of 0 .. n-1: rounds that swap x with (k - x) mod n or not, by a hash of the larger."""

    def one(at: Column, r: Column) -> Column:
        k = F.pmod(F.xxhash64(*salt, r, F.lit(SEED)), n)
        other = F.pmod(k - at, n)
        return F.when(F.xxhash64(*salt, r, F.greatest(at, other)) % 2 == 0, at).otherwise(other)

    return F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), x.cast("long"), one)


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size, tie`` of every row; ``tie`` tells rows of one doc_id apart."""
    return docs.select("doc_id", "source", n_words("text").alias("size"), F.xxhash64("doc_id", "source", "text").alias("tie"))


def plan(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``src, source, source_size, target, blocks, slots, part``: a row for each source, in order of ``src``.

    ``part`` is what the last slot takes of its block. Raising the words that a unit of weight
    gets, until no further source reaches its cap, takes an aggregate of three numbers a round.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = numbered(sizes.withColumn("_none", F.col("source").isNull()), [F.asc("_none"), F.asc("source")], "src")
    n = len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("src", F.lit(n)).cast("int") + 1)
    ranked = cut(ranked.withColumn("src", F.col("src") - 1).select("src", "source", "source_size", weight.alias("weight")))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    unit, before = 0.0, -1
    while True:
        full = F.col("weight") * F.lit(unit) > F.lit(most) * F.col("source_size")
        r = ranked.agg(F.sum(full.cast("long")), F.sum(F.when(full, F.col("source_size")).otherwise(0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if not r[2] or r[0] == before:
            break
        unit, before = (share * total - most * r[1]) / r[2], r[0]
    capped = F.lit(most) * F.col("source_size")
    target = F.when(F.col("weight") * F.lit(unit) > capped, capped).otherwise(F.col("weight") * F.lit(unit))
    out = ranked.withColumn("target", target).withColumn("blocks", F.ceil(F.col("source_size") / BLOCK))
    exact = F.when(F.col("source_size") > 0, F.col("target") * F.col("blocks") / F.col("source_size")).otherwise(0.0)
    out = out.withColumn("_exact", exact).withColumn("slots", F.ceil(F.col("_exact") - 1e-9))
    return cut(out.select("src", "source", "source_size", "target", "blocks", "slots", (F.col("_exact") - (F.col("slots") - 1)).alias("part")))


def drawn(sources: DataFrame, seed: int = SEED) -> tuple[DataFrame, int]:
    """``shard, src, n``: how many slots of each shard the draw gives a source; and the number of all slots."""
    spark = sources.sparkSession
    ship(spark)
    group = F.floor(F.col("src") / TOGETHER).alias("part")
    quota = np.array([r.n for r in sources.groupBy(group).agg(F.sum("slots").alias("n")).orderBy("part").collect()], np.int64)
    total = int(quota.sum())
    if not total:
        return spark.createDataFrame([], "shard long, src long, n long"), 0
    shards, share = -(-total // SHARD_SLOTS), quota / total

    def groups(batches):
        for p in batches:
            for shard in p.id:
                n = min(SHARD_SLOTS, total - shard * SHARD_SLOTS)
                counts = np.random.default_rng([seed, shard]).multinomial(n, share)
                at = np.flatnonzero(counts)
                yield pd.DataFrame({"shard": shard, "part": at.astype(np.int64), "n": counts[at]})

    def within(batches):
        for p in batches:
            for shard, part, n, slots in zip(p.shard, p.part, p.n, p.slots, strict=True):
                counts = np.random.default_rng([seed, shard, part]).multinomial(n, slots / slots.sum())
                at = np.flatnonzero(counts)
                yield pd.DataFrame({"shard": shard, "src": at + part * TOGETHER, "n": counts[at]})

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by_group = spark.range(0, shards, 1, min(shards, parts)).mapInPandas(groups, "shard long, part long, n long")
    lists = sources.groupBy(group).agg(F.transform(F.sort_array(F.collect_list(F.struct("src", "slots"))), lambda x: x["slots"]).alias("slots"))
    return by_group.join(lists, "part").select("shard", "part", "n", "slots").mapInPandas(within, "shard long, src long, n long"), total


def slots(sources: DataFrame, seed: int = SEED) -> DataFrame:
    """``shard, src, j, of``: the source of every slot of every shard, its number within the source, and what ``plan`` says of the source.

    What is known of a source joins its drawn rows before these become slots: Spark takes exploded rows to be as few as those they
    come from, and would send them to every executor by way of the driver. What joins slots later is told to shuffle.
    """
    spark = sources.sparkSession
    draws, total = drawn(sources, seed)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    draws = cut(running_start(draws.withColumn("bucket", F.floor(F.col("shard") / 256)), "src", "bucket", ["shard"], "n", "first"))
    # the draws' excess over each quota, in order, is handed to the sources that are short
    got = sources.join(draws.groupBy("src").agg(F.sum("n").alias("got")), "src", "left").select("src", F.struct("blocks", "slots", "part", "source_size").alias("of"), "slots", F.coalesce("got", F.lit(0)).alias("got"))
    got = got.withColumn("over", F.greatest(F.col("got") - F.col("slots"), F.lit(0))).withColumn("under", F.greatest(F.col("slots") - F.col("got"), F.lit(0)))
    got = got.withColumn("_all", F.lit(0)).withColumn("bucket", F.floor(F.col("src") / TOGETHER))
    excess = running_start(got, "_all", "bucket", ["src"], "over", "start").select("src", "of", F.col("slots").alias("quota"), "start")
    short = running_start(got, "_all", "bucket", ["src"], "under", "low").where("under > 0").select(F.col("src").alias("to"), F.col("of").alias("to_of"), "got", "low", (F.col("low") + F.col("under")).alias("high"))
    # a drawn row stands for many slots: dealt out by number of slots, not by its few bytes
    dealt = draws.select("shard", "src", "first", "n").join(excess, "src").repartition(max(parts, total // SLOTS_PER_TASK), "shard", "src")
    every = dealt.select("shard", "src", "of", "quota", "start", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("j"))
    tagged = every.withColumn("x", F.when(F.col("j") >= F.col("quota"), F.col("start") + F.col("j") - F.col("quota")))
    met = short.select("*", F.explode(F.sequence(F.floor(F.col("low") / STRETCH), F.floor((F.col("high") - 1) / STRETCH))).alias("stretch"))
    moved = tagged.where("x is not null").select("shard", "x", F.floor(F.col("x") / STRETCH).alias("stretch")).hint("merge").join(met, "stretch").where("x >= low and x < high")
    return tagged.where("x is null").select("shard", "src", "j", "of").union(moved.select("shard", F.col("to").alias("src"), (F.col("got") + F.col("x") - F.col("low")).alias("j"), F.col("to_of").alias("of")))


def places(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """``src, doc_id, tie, size, a``: each document's place in its source's stream."""
    # the bucket is part of the order, so it follows from the rows alone and not from a setting
    buckets = max(LEAST_BUCKETS, rows.count() // 20_000)
    known = sources.select("src", F.col("source").alias("_s"))
    numbered = rows.join(known, F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "source")
    dealt = numbered.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(buckets)))
    return running_start(dealt, "src", "bucket", ["doc_id", "tie", "size"], "size", "a").drop("bucket")


def blocks(placed: DataFrame) -> DataFrame:
    """``src, block, doc_id, tie, a, size, word, within, words``: a row for each document in each block."""
    number = F.sequence(F.floor(F.col("a") / BLOCK), F.floor((F.col("a") + F.col("size") - 1) / BLOCK))
    first = F.greatest(F.col("a"), F.col("block") * BLOCK)
    last = F.least(F.col("a") + F.col("size"), (F.col("block") + 1) * BLOCK)
    return placed.where("size > 0").select("src", "doc_id", "tie", "a", "size", F.explode(number).alias("block")).select(
        "*", (first - F.col("a")).alias("word"), (first - F.col("block") * BLOCK).alias("within"), (last - first).alias("words")
    )


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED):
    """``(placed, mixed, sources)``.

    ``placed``: a row per document, ``doc_id, tie, src, size, a`` (its place in its source's stream).
    ``mixed``: ``shard, src, j, epoch, doc_id, tie, a, size, word, words``: what each slot takes, as
    words ``word .. word + words - 1`` of a document. ``sources``: the table of ``plan``.

    Null texts have size 0 and are in no block; a null source is a source of its own, the
    last; null doc_ids and repeated rows each have their own place in the stream. An empty
    table gives an empty mix. Extra columns are ignored.
    """
    rows = cut(sized(docs))
    sources = plan(rows, weights, share, most)
    placed = cut(places(rows, sources))
    taken = slots(sources, seed).select("shard", "src", "j", "of.*").withColumn("epoch", F.floor(F.col("j") / F.col("blocks")))
    block = permuted(F.pmod("j", "blocks"), F.col("blocks"), F.col("src"), F.col("epoch"))
    length = F.least(F.lit(BLOCK), F.col("source_size") - F.col("block") * BLOCK)
    taken = taken.withColumn("block", block).select(
        "shard", "src", "j", "epoch", "block", F.when(F.col("j") == F.col("slots") - 1, F.round(F.col("part") * length).cast("long")).otherwise(F.lit(BLOCK)).alias("most")
    )
    n = F.least("words", F.col("most") - F.col("within")).alias("words")
    mixed = taken.hint("merge").join(blocks(placed), ["src", "block"]).select("shard", "src", "j", "epoch", "doc_id", "tie", "a", "size", "word", n).where("words > 0")
    return placed, mixed, sources


def taken_words(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: ``doc_id, size, source_size, target, taken``."""
    placed, mixed, sources = mix(docs)
    key = ["doc_id", "src", "a", "size"]
    none = placed.select(*key, F.lit(0).cast("long").alias("words"))
    summed = none.union(mixed.select(*key, "words")).groupBy(*key).agg(F.sum("words").alias("taken"))
    # repeated rows of no words share a place: they are counted, not merged
    copies = placed.where("size = 0").groupBy(*key).agg(F.count("*").alias("n"))
    full = summed.where("size > 0").union(copies.select(*key, F.explode(F.array_repeat(F.lit(0).cast("long"), F.col("n").cast("int"))).alias("taken")))
    return full.join(sources.select("src", "source_size", "target"), "src").select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as rows with the columns of ``docs``: for each time through a source, a document's
    runs of taken words, each cut from its text with the white space inside it; ``n_chars`` is
    counted anew. A document that is taken whole keeps its text as it is.

    Null and empty texts are in no run and give no row. Of rows that share doc_id, source and text
    the one that is first by a hash of its other columns lends them to each taken copy.
    """
    _, mixed, _ = mix(docs)
    runs = mixed.groupBy("doc_id", "tie", "a", "epoch").agg(F.sort_array(F.collect_list(F.struct("word", "words"))).alias("runs"))
    columns = docs.columns
    own = docs.select("doc_id", F.xxhash64("doc_id", "source", "text").alias("tie"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), row_hash(docs).alias("order"))
    one = own.groupBy("doc_id", "tie").agg(F.min_by("row", "order").alias("row"))
    runs = runs.select(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie"), "runs")
    joined = one.join(runs, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie"))).select(*[F.col("row")[c].alias(c) for c in columns], "runs")
    kind = docs.schema
    names, at = list(columns), columns.index("text")
    n_at = names.index("n_chars") if "n_chars" in names else None

    def make():
        import re

        word = re.compile(WORD)

        def f(*row):
            *row, got = row
            text = row[at]
            spans = [m.span() for m in word.finditer(text)]
            out, runs = [], []
            for x in got:
                if runs and runs[-1][1] == x["word"]:
                    runs[-1][1] += x["words"]
                else:
                    runs.append([x["word"], x["word"] + x["words"]])
            for a, b in runs:
                new = list(row)
                if (a, b) != (0, len(spans)):
                    new[at] = text[spans[a][0] : spans[b - 1][1]]
                    if n_at is not None:
                        new[n_at] = len(new[at])
                out.append(tuple(new))
            return out

        return f

    return flat_map_rows(joined, make, ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in kind))

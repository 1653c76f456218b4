"""SimHash near-duplicates by multi-index hashing.

Fingerprints: A-Z lower-cased, words of ``[^\\x20\\x09-\\x0D]+``, 3-word shingles with
repeats, XXH64 (seed 42) of each, majority vote per bit (a tie gives 0).

Links: the 64 bits are two segments of 32. Of two fingerprints within 2 bits, either the
second segments are equal or the first differ by at most one bit; so the balls have radius 1
in the first segment and 0 in the second (the radii need only sum to bits - segments + 1).
Each segment's table is keyed by its value; every value in a fingerprint's ball is looked up
in it, and the complete distance of what it holds is verified.

A group of near copies fills an entry, as all agree in that segment. An entry of more than
``CROWDED`` fingerprints is therefore not compared pair by pair: those that look it up go to
a table whose key is the whole value, all other segments included, with the ball of radius 1
over all 64 bits. Any two within 2 bits share such a key, and it holds at most 65
fingerprints; each is linked to the smallest.

Near copies (``near_copies``, which the pipeline takes out) are texts whose sets of
``COPY_SHINGLE``-word shingles have a Jaccard similarity of ``SIMILARITY`` or more. Their
fingerprints differ by up to a dozen bits, where no multi-index search is selective; so
candidates meet by ``BANDS`` min-hash bands as well as by links, and each is confirmed
on the texts themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import components, flat_map_rows, map_rows, row_hash
from millrace.session import cut

BITS, SHINGLE, SEED, DISTANCE = 64, 3, 42, 2
#: Radius of the ball in each of the segments; the most fingerprints of a table entry that are compared one by one.
RADII, CROWDED = (1, 0), 64
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


#: Words of a shingle and least similarity of near copies. Two texts at 0.8 share a band with a probability of 0.9996.
COPY_SHINGLE, SIMILARITY, BANDS, BAND_ROWS = 5, 0.8, 20, 5
_DRAWN = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * BAND_ROWS, 1), np.uint64)
FACTORS, TERMS = _DRAWN[0] | np.uint64(1), _DRAWN[1]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()


def shingle_hashes(words: list[bytes], size: int, step: int = 65536) -> Iterator[np.ndarray]:
    """Hashes of the shingles of at least one word, repeats included, at most ``step`` at a time; fewer words than ``size``: all of them are one."""
    whole = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = ends - np.fromiter(map(len, words), np.int64, len(words)) - 1
    k = max(1, len(words) - size + 1)
    digest = xxhash.xxh64_intdigest
    lasts = (ends[size - 1 :] if len(words) >= size else ends[-1:]) - 1
    firsts, lasts = starts[:k].tolist(), lasts.tolist()
    for at in range(0, k, step):  # bounds memory for very long texts
        n = len(firsts[at : at + step])
        yield np.fromiter((digest(whole[a:b], SEED) for a, b in zip(firsts[at : at + step], lasts[at : at + step], strict=True)), "<u8", n)


def fingerprint_of(words: list[bytes]) -> int:
    if not words:
        return 0
    votes, n = np.zeros(BITS, np.int64), 0
    for h in shingle_hashes(words, SHINGLE):
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    bits = np.packbits(2 * votes > n, bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprint(text: str | None) -> int:
    """The fingerprint as a signed 64-bit integer; no words or null: 0."""
    return fingerprint_of(words_of(text))


def node_of(words: list[bytes]) -> int:
    """What texts of the same words, case of A-Z aside, have in common."""
    return xxhash.xxh64_intdigest(b" ".join(words)) - (1 << 63)


def bands_of(words: list[bytes]) -> list[int]:
    """A hash of each band of the text's min-hashes; none for no words."""
    if not words:
        return []
    low = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    for h in shingle_hashes(words, COPY_SHINGLE, 2048):
        np.minimum(low, (h.astype(np.uint64) * FACTORS + TERMS).min(axis=1), out=low)
    return [xxhash.xxh64_intdigest(band.tobytes(), seed=k) - (1 << 63) for k, band in enumerate(low.reshape(BANDS, BAND_ROWS))]


def similarity(a: str | None, b: str | None) -> float:
    """The Jaccard similarity of the two texts' sets of ``COPY_SHINGLE``-word shingles; of no words and no words 1."""
    x, y = (np.unique(np.concatenate([*shingle_hashes(w, COPY_SHINGLE)])) if (w := words_of(t)) else np.zeros(0, np.uint64) for t in (a, b))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / n if (n := len(x) + len(y) - both) else 1.0


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, fp)`` for each row; one pass over the texts, no shuffle."""
    return map_rows(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), lambda: lambda i, t: (i, fingerprint(t)), "doc_id long, fp long")


def close(a: str, b: str) -> F.Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= DISTANCE


def looked_up(distinct: DataFrame, radii=RADII) -> DataFrame:
    """``fp, other, crowded``: what fingerprints find in the segments' tables, not yet verified; ``other`` is null for a crowded entry."""
    width = BITS // len(radii)
    value = lambda s: F.shiftrightunsigned("fp", (len(radii) - 1 - s) * width).bitwiseAND(F.lit((1 << width) - 1))
    own = [F.struct(F.lit(s).cast("tinyint").alias("segment"), value(s).alias("value")) for s in range(len(radii))]
    flips = [F.struct(F.lit(s).cast("tinyint").alias("segment"), value(s).bitwiseXOR(F.lit(1 << b)).alias("value")) for s, r in enumerate(radii) if r for b in range(width)]
    key = ["segment", "value"]
    entries = distinct.select("fp", F.inline(F.array(*own)))
    sizes = entries.groupBy(*key).agg(F.count("*").alias("n"))
    members = entries.join(sizes.where(F.col("n") <= CROWDED), key).groupBy(*key).agg(F.collect_list("fp").alias("members"))
    crowded = sizes.where(F.col("n") > CROWDED).select(*key, F.lit(None).cast("array<long>").alias("members"))
    probes = distinct.select("fp", F.inline(F.array(*own, *flips)))
    return probes.join(members.union(crowded), key).select("fp", F.explode_outer("members").alias("other"), F.col("members").isNull().alias("crowded"))


def whole_values(distinct: DataFrame) -> DataFrame:
    """``(u, v)`` within 2 bits whose closure is that of all such pairs, by keys of all 64 bits with at most one changed."""
    ball = [F.lit(BITS).cast("tinyint"), *(F.lit(b).cast("tinyint") for b in range(BITS))]
    flipped = F.expr(f"case when b = {BITS} then 0L else shiftleft(1L, cast(b as int)) end")
    probes = distinct.select("fp", F.explode(F.array(*ball)).alias("b")).select(F.col("fp").bitwiseXOR(flipped).alias("entry"), "b")
    table = probes.withColumn("fp", F.col("entry").bitwiseXOR(flipped)).withColumn("hub", F.min("fp").over(Window.partitionBy("entry")))
    return table.where((F.col("fp") != F.col("hub")) & close("fp", "hub")).select(F.col("fp").alias("u"), F.col("hub").alias("v"))


def links(distinct: DataFrame, radii=RADII) -> DataFrame:
    """``(u, v)`` fingerprints within 2 bits whose closure is that of all such pairs; ``distinct(fp)`` holds each once."""
    found = cut(looked_up(distinct, radii).where(F.col("crowded") | ((F.col("fp") != F.col("other")) & close("fp", "other"))).distinct())
    near = found.where("not crowded").select(F.col("fp").alias("u"), F.col("other").alias("v"))
    return near.union(whole_values(found.where("crowded").select("fp").distinct()))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, fp, component_id`` (the smallest doc_id reachable by links).

    Null and empty texts have fingerprint 0 and link like any other. Rows with a null
    key take part; they never name a component unless all of it is null (then null).
    Repeated rows give repeated results. Extra columns are ignored.
    """
    prints = cut(fingerprints(docs, key, text))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(distinct.select("fp")))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    linked = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "root").select(F.col("fp").alias("fp_"), "component_id")
    return prints.join(linked, F.col("fp") == F.col("fp_")).select("doc_id", "fp", "component_id")


def candidates(distinct: DataFrame) -> DataFrame:
    """``(u, v)``, u < v: nodes that may be near copies; ``distinct(node, fp, bands)`` holds each node once.

    Those that share a band meet its smallest and its largest node and those of linked
    fingerprints the smallest of theirs, so pairs grow with a group's size and not its square.
    """
    banded = distinct.select("node", F.explode("bands").alias("band"))
    ends = banded.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    met = banded.join(ends, "band").select("node", F.explode(F.array("low", "high")).alias("hub"))
    lowest = cut(distinct.groupBy("fp").agg(F.min("node").alias("hub")))
    same = distinct.join(lowest, "fp").select("node", "hub")
    one, two = (lowest.select(F.col("fp").alias(x), F.col("hub").alias(n)) for x, n in (("u", "node"), ("v", "hub")))
    linked = links(lowest.select("fp")).join(one, "u").join(two, "v").select("node", "hub")
    every = met.union(same).union(linked).where("node <> hub")
    return every.select(F.least("node", "hub").alias("u"), F.greatest("node", "hub").alias("v")).distinct()


def confirmed(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of ``pairs(u, v)`` whose texts are alike.

    A task sends the text of a node once, so that copies do not meet in the shuffle; it remembers a number for each of its nodes.
    """
    needed = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()

    def once():
        seen: set[int] = set()

        def one(t):
            node = node_of(words_of(t))
            if node in seen:
                return []
            seen.add(node)
            return [(node, t)]

        return one

    texts = flat_map_rows(docs.select("text"), once, "node long, text string")
    texts = cut(texts.join(needed, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text")))
    one, two = (texts.select(F.col("node").alias(x), F.col("text").alias(t)) for x, t in (("u", "a"), ("v", "b")))

    def make():
        return lambda u, v, a, b: [(u, v)] if similarity(a, b) >= SIMILARITY else []

    return flat_map_rows(pairs.join(one, "u").join(two, "v").select("u", "v", "a", "b"), make, "u long, v long")


def near_copies(docs: DataFrame, *extra: F.Column) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, component_id`` (the smallest doc_id reachable by near copies), ``root`` (the component's own number) and ``extra`` columns.

    Null keys as in ``near_duplicates``; components whose rows all lack a key differ by ``root``.
    """

    def make():
        def one(i, t, *more):
            words = words_of(t)
            return i, node_of(words), fingerprint_of(words), bands_of(words), *more

        return one

    own = docs.select("doc_id", "text", *extra)
    more = [f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[2:]]
    prints = cut(map_rows(own, make, ", ".join(["doc_id long", "node long", "fp long", "bands array<long>", *more])))
    distinct = cut(prints.groupBy("node").agg(F.min("doc_id").alias("first"), F.first("fp").alias("fp"), F.first("bands").alias("bands")))
    roots = components(confirmed(docs, cut(candidates(distinct)))).withColumnRenamed("node", "_node")
    rooted = distinct.join(roots, F.col("node") == F.col("_node"), "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    linked = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "root").select(F.col("node").alias("_node"), "component_id", "root")
    return prints.join(linked, F.col("node") == F.col("_node")).select("doc_id", "component_id", "root", *own.columns[2:])


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near copies: that with the smallest doc_id.

    Of rows that repeat that doc_id, or of a group without any, the first by a hash of
    the row stays; other rows of the same doc_id stay where they are no near copies. All columns stay.
    """
    row = docs.select("doc_id", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), row_hash(docs).alias("_hash"))
    found = near_copies(docs, row_hash(docs).alias("_hash"))
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_hash")).alias("f"))
    chosen = first.select(F.col("f.doc_id").alias("_id"), F.col("f._hash").alias("_h"))
    once = row.join(chosen, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_h")), "left_semi").groupBy("doc_id", "_hash").agg(F.first("row").alias("row"))
    return once.select(*[F.col("row")[c].alias(c) for c in docs.columns])

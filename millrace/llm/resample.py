"""Importance resampling of documents towards a target's distribution of hashed word n-grams.

Features are all runs of one to ``MOST_WORDS`` words, hashed to ``BUCKETS`` buckets. A bucket's gain is
the log ratio of its smoothed shares in the target and in the documents, a document's weight the mean
gain of its features, and its score the weight with Gumbel noise from its id, so that the highest
scores are a draw without replacement.

Texts above ``CHUNK`` bytes are cut at word boundaries into chunks that are dealt over the tasks. A
chunk carries the next ``MOST_WORDS - 1`` words and owns the features that start in its own words, so each
feature is counted once; counts and gains of chunks are summed by document. Other texts stay where they
are read. Both passes read the texts; nothing else grows with them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import CRC_TABLE, flat_map_rows, map_rows, slices, sql_bytes, sql_crc32
from millrace.operators.windows import numbered
from millrace.session import cut, ship

MOST_WORDS, BUCKETS, CHUNK, SEED = 2, 10_000, 1 << 15, 7
LEAST_WORDS, SHARE = 20, 25
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def lowered(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER)


def chunks(text: str | None, size: int = CHUNK, most: int = MOST_WORDS) -> list[tuple[int, bytes, int]]:
    """``(number, lower-cased bytes, carried)``: parts of about ``size`` bytes cut at word boundaries, each with the
    next ``most - 1`` words appended, of which ``carried`` there are. At least one part; a word is never cut."""
    whole = lowered(text)
    starts = [0]
    while (at := starts[-1] + size) < len(whole):
        word = WORD.match(whole, at) if WORD.match(whole[at - 1 : at]) else None
        starts.append(word.end() if word else at)
    out, carry = [], []
    for k in range(len(starts) - 1, -1, -1):
        own = whole[starts[k] : starts[k + 1] if k + 1 < len(starts) else len(whole)]
        out.append((k, b" ".join([own, *carry]), len(carry)))
        first = [m[0] for _, m in zip(range(most - 1), WORD.finditer(own), strict=False)]
        carry = (first + carry)[: most - 1]
    return out[::-1]


def buckets(words: list[bytes], own: int, most: int = MOST_WORDS) -> np.ndarray:
    """The bucket of every run of at most ``most`` words that starts in the first ``own``, repeats included."""
    state = [crc32(w) for w in words]
    found = state[:own]
    spaced = [b" " + w for w in words]
    for k in range(1, most):
        # a run's hash goes on from that of the run without its last word
        state = [crc32(w, c) for w, c in zip(spaced[k:], state, strict=False)]
        found += state[:own]
    return np.array(found, np.int64) % BUCKETS


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """``(short, long)``, both ``doc_id, tie, chunk, piece, carried``: whole texts in place, and chunks of long texts dealt anew."""
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    is_long = F.coalesce(F.octet_length("text") > size, F.lit(False))
    short = rows.where(~is_long).select("doc_id", F.lit(None).cast("long").alias("tie"), F.lit(0).alias("chunk"), F.col("text").cast("binary").alias("piece"), F.lit(0).alias("carried"))
    many = rows.where(is_long).select("doc_id", F.xxhash64("text", F.octet_length("text")), "text")

    def make():
        return lambda i, tie, t: [(i, tie, *c) for c in chunks(t, size)]

    long = flat_map_rows(many, make, "doc_id long, tie long, chunk int, piece binary, carried int")
    return short, long.repartition("doc_id", "tie", "chunk")


def counted(df: DataFrame) -> DataFrame:
    """``bucket, n`` over all pieces; a task sends at most one row for a bucket."""
    ship(df.sparkSession)
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in slices(batch):
                found = [buckets(w, len(w) - c) for t, c in zip(*(x.to_pylist() for x in part.columns), strict=True) for w in [WORD.findall((t or b"").translate(LOWER))]]
                total += np.bincount(np.concatenate(found), minlength=BUCKETS)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held])], schema=schema)

    return df.select("piece", "carried").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame) -> DataFrame:
    """``bucket, gain`` for each of the ``BUCKETS`` buckets, from ``bucket, n`` of both sides."""
    every = source.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(source.select("bucket", F.col("n").alias("s")), "bucket", "left").join(target.select("bucket", F.col("n").alias("t")), "bucket", "left")
    both = both.select("bucket", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("s", "t")])
    sums = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    ratio = (F.col("t") + 1) * (F.col("all_s") + BUCKETS) / ((F.col("s") + 1) * (F.col("all_t") + BUCKETS))
    return both.join(F.broadcast(sums)).select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))  # sums: one row


def weighed(short: DataFrame, long: DataFrame, gain: np.ndarray) -> DataFrame:
    """``doc_id, n_words, n_features, total``: sums over each document's features, a row for each row of the documents."""

    def make():
        def f(i, tie, chunk, piece, carried):
            words = WORD.findall((piece or b"").translate(LOWER))
            own = len(words) - carried
            found = buckets(words, own)
            return i, tie, chunk, own, len(found), int(gain[found].sum())

        return f

    schema = "doc_id long, tie long, chunk int, n_words long, n_features long, total long"
    kept = ["doc_id", "n_words", "n_features", "total"]
    sums = [F.sum(c).alias(c) for c in kept[1:]]
    parts = map_rows(long, make, schema).groupBy("doc_id", "tie").agg(F.sum(F.when(F.col("chunk") == 0, 1).otherwise(0)).alias("copies"), *sums)
    # rows that repeat share id and text: each has its part of the sums
    each = parts.select("doc_id", *[F.expr(f"{c} div copies").alias(c) for c in kept[1:]], F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return map_rows(short, make, schema).select(*kept).union(each.select(*kept))


def resampled(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", share: int = SHARE, seed: int = SEED, chunk: int = CHUNK) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` for each row of ``docs``; ``share`` percent of those with ``LEAST_WORDS`` words are drawn.

    Equal scores go by doc_id, then n_features and weight; rows that repeat have ranks of their own. Null
    and empty texts have no features and weigh 0; a null doc_id hashes as an empty text and comes last among
    equals. Texts may be of any length; an empty target or table of documents gives even gains or no rows;
    other columns are not read, whatever their names.
    """
    short, long = pieces(docs, key, text, chunk)
    aim_short, aim_long = pieces(target.select(F.lit(None).cast("long").alias("doc_id"), F.col("`text`").alias("text")), size=chunk)
    found = gains(counted(short.union(long)), counted(aim_short.union(aim_long))).collect()  # BUCKETS rows
    gain = np.zeros(BUCKETS, np.int64)
    gain[[r["bucket"] for r in found]] = [r["gain"] for r in found]
    n, total = F.col("n_features"), F.col("total")
    weight = F.when(n > 0, F.expr("(total - pmod(total, n_features)) div n_features")).otherwise(F.lit(0)).cast("long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = cut(weighed(short, long, gain).select("doc_id", "n_words", n, weight.alias("weight"), (weight + noise).alias("score")))
    able = scored.where(F.col("n_words") >= LEAST_WORDS)
    most = able.count() * share // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight")]
    columns = ["doc_id", "n_features", "weight", "score"]
    ranked = numbered(able.select(*columns), order, "rank").select(*columns, F.when(F.col("rank") <= most, F.col("rank")).cast("long").alias("rank"))
    return ranked.union(scored.where(F.col("n_words") < LEAST_WORDS).select(*columns, F.lit(None).cast("long").alias("rank")))


def oracle() -> str:
    """SQL for ``documents`` and ``benchmark``: features listed text by text, hashed once each."""
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = f"regexp_extract_all({low}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"
    runs = "unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f"
    return f"""
WITH {CRC_TABLE},
d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, {words} AS w FROM documents),
fd AS MATERIALIZED (SELECT row, {runs} FROM d), fb AS MATERIALIZED (SELECT {runs} FROM (SELECT {words} AS w FROM benchmark)),
h AS MATERIALIZED (SELECT f, {sql_crc32("data")} % {BUCKETS} AS bucket FROM (SELECT f, {sql_bytes("f")} AS data FROM (SELECT f FROM fd UNION SELECT f FROM fb)), crc),
s AS (SELECT bucket, count(*) AS s FROM fd JOIN h USING (f) GROUP BY 1), t AS (SELECT bucket, count(*) AS t FROM fb JOIN h USING (f) GROUP BY 1),
g AS (SELECT s.bucket, floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * ((SELECT coalesce(sum(s), 0) FROM s) + {BUCKETS}) / ((s + 1.0::DOUBLE) * ((SELECT coalesce(sum(t), 0) FROM t) + {BUCKETS}))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
m AS (SELECT row, count(*) AS n, CAST(sum(gain) AS BIGINT) AS total FROM fd JOIN h USING (f) JOIN g USING (bucket) GROUP BY 1),
x AS (SELECT doc_id, len(w) AS words, coalesce(n, 0) AS n_features, CASE WHEN n > 0 THEN (total - ((total % n) + n) % n) // n ELSE 0 END AS weight, ('0x' || sha256('{SEED}:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT AS h FROM d LEFT JOIN m USING (row)),
y AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY words >= {LEAST_WORDS} ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS place FROM y)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
 CASE WHEN words >= {LEAST_WORDS} AND place <= {SHARE} * (SELECT count(*) FROM y WHERE words >= {LEAST_WORDS}) // 100 THEN place END AS rank FROM z"""

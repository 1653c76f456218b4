"""Document fingerprints: digests of hashed byte triplets by quartile, and how alike two of them are.

The triplets of a window of ``WINDOW`` bytes that begin with its first are hashed into ``BUCKETS``
buckets. A bucket's code, 0 to 3, says how many of the three quartiles of all counts it exceeds. A
fingerprint is the length on a scale of eight steps to a doubling (three hex digits) and the codes, two
to a hex digit. The difference of two is the sum over buckets of their codes' distance (3 counts as
``FAR``) and of steps in length beyond the first, and is bounded: from ``BOUND`` on nothing is alike.

For each document and the next by id, texts are dealt once by ranges of ids and read in order; a range
gets the first text of the one after it as a guest. Ranges are set by quantiles of the ids before any text moves, so
that a task that runs again reads the same rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import slices, sql_bytes
from millrace.session import ship

WINDOW, BUCKETS, FAR, STEP, BOUND = 5, 256, 6, 6, 384
#: Places of the second and third byte of each triplet that begins with a window's first.
TRIPLETS = tuple((i, j) for j in range(2, WINDOW) for i in range(1, j))
FACTOR, SHIFT = 2654435761, 24
#: Bytes of a text whose triplets are hashed at a time.
PART = 1 << 18
#: Ranges of ids for each shuffle partition.
RANGES = 4

Digest = tuple[int, np.ndarray]


def steps(n: int) -> int:
    """A length on a scale of eight steps to a doubling, in integers; 0 for none."""
    e = n.bit_length()
    return 8 * e + ((n >> (e - 4)) & 7 if e >= 4 else (n << (4 - e)) & 7)


def counts(data: bytes) -> np.ndarray:
    """How many triplets fall into each bucket."""
    out = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(data), PART):
        b = np.frombuffer(data, np.uint8, min(PART + WINDOW - 1, len(data) - at), at).astype(np.uint32)
        for kind, (i, j) in enumerate(TRIPLETS, 1):
            n = min(PART, len(b) - j)  # those that begin in this part
            if n > 0:
                v = b[:n] | (b[i : i + n] << np.uint32(8)) | (b[j : j + n] << np.uint32(16))
                v += np.uint32(kind << 24)
                v *= np.uint32(FACTOR)
                out += np.bincount(v >> np.uint32(SHIFT), minlength=BUCKETS)
    return out


def digest(text: str | None) -> Digest:
    """``(steps, codes)`` of a text's UTF-8 bytes. A null text is an empty one; texts without a triplet differ by length only."""
    data = (text or "").encode("utf-8", "surrogatepass")
    n = counts(data)
    low = np.sort(n)
    return steps(len(data)), sum((n > low[k * BUCKETS // 4 - 1]).astype(np.int64) for k in (1, 2, 3))


def written(d: Digest) -> str:
    return f"{d[0]:03x}" + "".join("0123456789abcdef"[c] for c in d[1][0::2] * 4 + d[1][1::2])


def read(fingerprint: str) -> Digest:
    digits = np.array([int(c, 16) for c in fingerprint[3:]], np.int64)
    return int(fingerprint[:3], 16), np.stack([digits >> 2, digits & 3], axis=1).ravel()


def alike(a: Digest, b: Digest) -> float:
    """1 for equal digests, 0 from a difference of ``BOUND`` on."""
    apart = np.abs(a[1] - b[1])
    apart[apart == 3] = FAR
    return 1 - min(BOUND, int(apart.sum()) + STEP * max(0, abs(a[0] - b[0]) - 1)) / BOUND


def edited(text: str, after: str) -> str:
    """The text with its last quarter of code points replaced by the first as many of ``after``."""
    k = len(text) // 4
    return text[: len(text) - k] + after[:k] if k else text


def range_of(bounds: list[int], none: int):
    """A function of ``(doc_id or 0, whether it is null, tie)``: the number of the row's range. An id that is several bounds has as many ranges by
    its tie, a uniform number, and rows without an id have ``none``."""

    @F.pandas_udf("int")
    def number(ids: pd.Series, missing: pd.Series, tie: pd.Series) -> pd.Series:
        known = np.array(bounds, np.int64)
        part = (tie.to_numpy().astype(np.float64) + 2.0**63) / 2.0**64
        low, high = np.searchsorted(known, ids), np.searchsorted(known, ids, "right")
        first, own = np.where(missing.to_numpy(), len(known) + 1, low), np.where(missing, none, np.maximum(1, high - low))
        return pd.Series(first + np.minimum(own - 1, (part * own).astype(np.int64)))

    return number


def in_order(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``range, guest, doc_id, text``, partitioned by range and sorted within: by id, null ids last, then a hash of the text.

    The first row of each range is also the guest, and last, of the range before it, that of the first range of the last
    one. The driver holds a few numbers for each range, of which there are ``RANGES`` a shuffle partition.
    """
    spark = docs.sparkSession
    ship(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    many = RANGES * parts
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    at = [k / many for k in range(1, many)]
    seen = rows.agg(F.count("*").alias("n"), F.count("doc_id").alias("ids"), F.percentile_approx("doc_id", at, 10_000).alias("q")).first()
    none = max(1, round(many * (seen["n"] - seen["ids"]) / max(1, seen["n"])))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    rows = rows.withColumn("range", range_of(seen["q"] or [], none)(F.coalesce("doc_id", F.lit(0)), F.isnull("doc_id"), "tie"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")).alias("first")
    firsts = sorted((r["range"], r["first"]["doc_id"], r["first"]["tie"]) for r in rows.groupBy("range").agg(first).collect())
    before = [(*x, firsts[k - 1][0]) for k, x in enumerate(firsts)]
    guests = F.broadcast(spark.createDataFrame(before, "_range int, _id long, _tie long, before int"))
    met = rows.join(guests, (F.col("range") == F.col("_range")) & F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie")), "left")
    own, guest = (F.struct(F.col(c).alias("range"), F.lit(g).alias("guest")) for c, g in (("range", False), ("before", True)))
    sent = met.select("doc_id", "text", "tie", F.inline(F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, guest))))
    laid = sent.repartition(parts, "range").sortWithinPartitions("range", "guest", F.asc_nulls_last("doc_id"), "tie", "text")
    return laid.select("range", "guest", "doc_id", "text")


SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
)


def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``in_order`` to one row for each that is no guest, against the row after it; one text is held."""
    held: tuple | None = None
    for batch in batches:
        for part in slices(batch):
            out = []
            for number, guest, doc_id, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if held and held[0] != number:
                    held = None
                if guest and not held:
                    continue
                text = text or ""
                own = digest(text)
                if held:
                    _, i, t, d = held
                    new = edited(t, text)
                    e = digest(new)
                    sha = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((i, len(t), sha, written(d), written(e), alike(d, e), alike(d, own)))
                held = None if guest else (number, doc_id, text, own)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), SCHEMA, strict=True)], schema=SCHEMA)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.

    The edited text has its last quarter of code points replaced by the first as many of the next document
    by id, the first after the last. Rows of one id follow each other by a hash of their texts, so the next
    of a repeated row is its copy; rows without an id come last. Null texts are empty ones; equal texts have equal
    fingerprints, and no text at all is alike to none. Texts may be of any length: their triplets are counted part by part.
    A single row is next to itself, an empty table gives none, and other columns are not read, whatever their names.
    """
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_order(docs, key, text).mapInArrow(compared, schema)


def oracle() -> str:
    """SQL for ``documents`` with different ids: lists of bytes, triplets by place, quartiles of sorted counts."""
    triplet = "SELECT k, kind, unnest(list_transform(range(1, len(l) - {j} + 1), lambda p: (l[p] + l[p + {i}] * 256 + l[p + {j}] * 65536 + {salt}) * {f} % 4294967296 >> {shift})) AS bucket FROM b"
    triplets = " UNION ALL ".join(triplet.format(i=i, j=j, salt=kind << 24, f=FACTOR, shift=SHIFT) for kind, (i, j) in enumerate(TRIPLETS, 1))
    code = " + ".join(f"(n > q[{k * BUCKETS // 4}])::INT" for k in (1, 2, 3))
    apart = f"sum(CASE abs(a.code - b.code) WHEN 3 THEN {FAR} ELSE abs(a.code - b.code) END) + {STEP} * greatest(0, abs(any_value(a.steps) - any_value(b.steps)) - 1)"
    near = f"1 - least({BOUND}, {apart})::DOUBLE / {BOUND}"
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER o AS k, doc_id, coalesce(text, '') AS text, count(*) OVER () AS many FROM documents WINDOW o AS (ORDER BY doc_id)),
u AS MATERIALIZED (SELECT k, 0 AS kind, text FROM d UNION ALL SELECT d.k, 1, left(d.text, length(d.text) - length(d.text) // 4) || left(a.text, length(d.text) // 4) FROM d JOIN d a ON a.k = d.k % d.many + 1),
b AS MATERIALIZED (SELECT k, kind, {sql_bytes("text")} AS l FROM u),
c AS (SELECT k, kind, bucket, count(*) AS n FROM ({triplets}) GROUP BY ALL),
f AS MATERIALIZED (SELECT u.k, u.kind, r.bucket, coalesce(n, 0) AS n FROM u CROSS JOIN range({BUCKETS}) r(bucket) LEFT JOIN c ON c.k = u.k AND c.kind = u.kind AND c.bucket = r.bucket),
q AS (SELECT k, kind, list_sort(list(n)) AS q FROM f GROUP BY ALL),
l AS (SELECT k, kind, CASE WHEN strlen(text) = 0 THEN 0 ELSE 8 * length(bin(strlen(text))) + (strlen(text) * 16 >> length(bin(strlen(text)))) % 8 END AS steps FROM u),
e AS MATERIALIZED (SELECT k, kind, bucket, steps, {code} AS code FROM f JOIN q USING (k, kind) JOIN l USING (k, kind)),
w AS (SELECT k, kind, printf('%03x', any_value(steps)) || string_agg(digit, '' ORDER BY pair) AS word FROM (SELECT k, kind, any_value(steps) AS steps, bucket // 2 AS pair, printf('%x', CAST(sum(CASE bucket % 2 WHEN 0 THEN 4 * code ELSE code END) AS INT)) AS digit FROM e GROUP BY k, kind, bucket // 2) GROUP BY k, kind),
ne AS (SELECT a.k, {near} AS near FROM e a JOIN e b ON a.k = b.k AND a.bucket = b.bucket AND a.kind = 0 AND b.kind = 1 GROUP BY a.k),
nn AS (SELECT a.k, {near} AS near FROM d JOIN e a ON a.k = d.k AND a.kind = 0 JOIN e b ON b.k = d.k % d.many + 1 AND b.bucket = a.bucket AND b.kind = 0 GROUP BY a.k)
SELECT d.doc_id, CAST(length(d.text) AS BIGINT) AS n_chars, sha256(u.text) AS edited_sha256, wa.word AS fingerprint, wb.word AS edited_fingerprint, ne.near AS near_edited, nn.near AS near_next
FROM d JOIN u ON u.k = d.k AND u.kind = 1 JOIN w wa ON wa.k = d.k AND wa.kind = 0 JOIN w wb ON wb.k = d.k AND wb.kind = 1 JOIN ne ON ne.k = d.k JOIN nn ON nn.k = d.k"""

import hashlib

import numpy as np
import pytest
from conftest import DOCS, bag
from pyspark.sql import functions as F

from millrace.llm import digest
from millrace.llm.queries import op13_quartile_digest
from millrace.sources.tables import table


def slowly(text):
    data, n = text.encode(), [0] * 256
    for at in range(len(data)):
        for kind, (i, j) in enumerate(((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4)), 1):
            if at + j < len(data):
                v = data[at] + data[at + i] * 256 + data[at + j] * 65536 + kind * 2**24
                n[v * 2654435761 % 2**32 >> 24] += 1
    low = sorted(n)
    e = len(data).bit_length()
    return 8 * e + (len(data) * 16 // 2**e % 8 if data else 0), [sum(x > low[k] for k in (63, 127, 191)) for x in n]


def words(d):
    return f"{d[0]:03x}" + "".join(f"{4 * a + b:x}" for a, b in zip(d[1][::2], d[1][1::2], strict=True))


def near(a, b):
    d = sum(6 if abs(x - y) == 3 else abs(x - y) for x, y in zip(a[1], b[1], strict=True)) + 6 * max(0, abs(a[0] - b[0]) - 1)
    return 1 - min(384, d) / 384


def expected(rows):
    """Of rows ``(doc_id, text)`` in order."""
    found, out = [slowly(t) for _, t in rows], []
    for k, (i, t) in enumerate(rows):
        after, q = rows[(k + 1) % len(rows)][1], len(t) // 4
        new = t[: len(t) - q] + after[:q]
        d = slowly(new)
        out.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), words(found[k]), words(d), near(found[k], d), near(found[k], found[(k + 1) % len(rows)])))
    return sorted(out, key=str)


def in_order(df):
    """Rows as the operator orders them: ids, null ids last, then a hash of the text."""
    got = df.select("doc_id", F.coalesce("text", F.lit("")), F.xxhash64("text"), "text").collect()
    return [tuple(r)[:2] for r in sorted(got, key=lambda r: (r[0] is None, r[0] or 0, r[2], r[3] or ""))]


def test_query_is_brute_force(spark, sf_dir):
    assert bag(op13_quartile_digest(spark, sf_dir)) == expected(in_order(table(spark, sf_dir, "documents")))


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_ranges_do_not_matter(spark, parts):
    # one id of a third of all rows, rows without an id, copies, and more ranges than rows
    rows = [(k if k % 3 else 21, f"text {k * 7919 % 101} of some length {'x' * (k % 9)}", "en", "a", 0) for k in range(60)]
    rows += [(None, f"without {k % 4}", None, None, None) for k in range(20)] + [((1 << 60) + k, f"large {k}", "en", "a", 0) for k in range(5)]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        assert bag(digest.fingerprints(docs)) == expected(in_order(docs))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_odd_rows(spark, odd_docs, no_docs):
    short = odd_docs.where("doc_id is null or doc_id <> 4")
    assert bag(digest.fingerprints(short)) == expected(in_order(short))
    long = {r["doc_id"]: r for r in digest.fingerprints(odd_docs).collect() if r["doc_id"] in (2, 3, 4)}
    assert long[4]["n_chars"] == 240_000 and long[2]["fingerprint"] == long[3]["fingerprint"]
    assert bag(digest.fingerprints(no_docs)) == []


def test_one_row_is_next_to_itself(spark):
    docs = spark.createDataFrame([(9, "alone in here", "en", "a", 13)], DOCS)
    assert bag(digest.fingerprints(docs)) == expected([(9, "alone in here")])


def test_parts_of_a_long_text_count_each_triplet_once(monkeypatch):
    data = np.random.default_rng(3).integers(0, 256, 5_000, np.uint8).tobytes()
    whole = digest.counts(data)
    for part in (1, 2, 5, 999, 5_000):
        monkeypatch.setattr(digest, "PART", part)
        assert (digest.counts(data) == whole).all()
    assert whole.sum() == sum(len(data) - j for _, j in digest.TRIPLETS)


def test_fingerprints_are_read_back_and_tell_edits_from_others(spark, sf_dir):
    rows = op13_quartile_digest(spark, sf_dir).collect()
    for r in rows[:20]:
        a, b = digest.read(r["fingerprint"]), digest.read(r["edited_fingerprint"])
        assert digest.written(a) == r["fingerprint"] and digest.alike(a, b) == r["near_edited"]
    edits, others = np.array([r["near_edited"] for r in rows]), np.array([r["near_next"] for r in rows])
    assert (edits[:, None] > others[None, :]).mean() > 0.97

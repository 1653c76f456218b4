import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from conftest import DOCS, bag

from millrace.llm import resample
from millrace.llm.queries import op12_importance_resample
from millrace.sources.tables import table


def features(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return words, [zlib.crc32(f.encode()) % 10_000 for f in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))]]


def expected(rows, target):
    found = [(i, *features(t)) for i, t in rows]
    s, t = Counter(b for r in found for b in r[2]), Counter(b for x in target for b in features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in range(10_000)]
    out = []
    for i, words, own in found:
        weight = sum(gain[b] for b in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for k, r in enumerate(able[: 25 * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def both(spark, sf_dir):
    docs = [tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    return docs, [r[0] for r in table(spark, sf_dir, "benchmark").select("text").collect()]


def test_query_is_brute_force(spark, sf_dir):
    assert bag(op12_importance_resample(spark, sf_dir)) == expected(*both(spark, sf_dir))


def test_chunks_change_nothing(spark, sf_dir):
    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    assert bag(resample.resampled(docs, target, chunk=100)) == expected(*both(spark, sf_dir))


@pytest.mark.parametrize("text", ["", "   ", "one", "a b c d e f g", "x" * 90 + " y", "é" * 50 + " ü1 " * 9, "a" + " " * 80 + "b c", "Word, word; WORD!" * 9])
@pytest.mark.parametrize("size", [1, 2, 7, 30])
def test_chunks_own_each_start_once(text, size):
    whole = resample.WORD.findall(resample.lowered(text))
    for most in (1, 2, 3):
        got = Counter()
        for _, piece, carried in resample.chunks(text, size, most):
            words = resample.WORD.findall(piece)
            own = len(words) - carried
            got.update(b" ".join(words[k : k + n]) for n in range(1, most + 1) for k in range(own) if k + n <= len(words))
        assert got == Counter(b" ".join(whole[k : k + n]) for n in range(1, most + 1) for k in range(len(whole) - n + 1))


def test_odd_rows(spark, odd_docs, no_docs):
    target = spark.createDataFrame([(1, "plain words in a text"), (2, None)], "item_id long, text string")
    rows = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    for chunk in (16, 1 << 15):
        assert bag(resample.resampled(odd_docs, target, chunk=chunk)) == expected(rows, ["plain words in a text", None])
    assert bag(resample.resampled(no_docs, target)) == []
    assert bag(resample.resampled(odd_docs, target.limit(0))) == expected(rows, [])


def test_ties_and_copies(spark):
    long = "some words that are said again and again " * 9
    rows = [(k // 3, long if k % 2 else long + "ever", "en", "a", 0) for k in range(60)]
    target = spark.createDataFrame([(1, "again and ever")], "item_id long, text string")
    got = bag(resample.resampled(spark.createDataFrame(rows, DOCS), target, chunk=64))
    assert got == expected([r[:2] for r in rows], ["again and ever"])
    assert sorted(r[4] for r in got if r[4]) == list(range(1, 16))

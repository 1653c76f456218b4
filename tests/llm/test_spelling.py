import re
import zlib
from collections import Counter, defaultdict

import pytest
from conftest import DOCS, bag

from millrace.llm import spelling
from millrace.llm.queries import op11_spelling_variants
from millrace.sources.tables import table


def vocabulary_of(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if k >= 2 and len(w) >= 7}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(a) + 1 == len(b) and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def expected(n):
    near = defaultdict(set)
    by_length = defaultdict(list)
    for w in n:
        by_length[len(w)].append(w)
    for w in n:
        near[w] = {v for k in (-1, 0, 1) for v in by_length[len(w) + k] if one_apart(w, v)}
    best = {w: min(near[w], key=lambda v: (-n[v], v), default=None) for w in n}
    form = {w: v if v and n[v] >= 10 * n[w] else None for w, v in best.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def test_query_is_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    assert set(bag(op11_spelling_variants(spark, sf_dir))) == expected(vocabulary_of(rows))


def some_docs(spark):
    # a chain of forms, ties, an insertion at each end, accents, and ids whose hashes leave a letter out
    words = ["grammars"] * 1200 + ["grammarz"] * 110 + ["grammarzx"] * 9 + ["ygrammars"] * 2 + ["grämmars"] * 3 + ["GRAMMARS"] * 5 + ["straßen÷"] * 2
    words += ["abcdefgh"] * 30 + ["abcdefgi"] * 30 + ["abcdefgj"] * 2 + ["aaaaaaaa"] * 4 + ["aaaaaaa"] * 3 + ["aaaaaaaaa"] * 2 + ["ÀÀÀÀÀÀÀ"] * 2 + ["short"] * 9
    rows = [(k % 97, " ".join(words[k::97]), "en", "a", 0) for k in range(97)]
    return rows, spark.createDataFrame(rows, DOCS)


def test_forms_lead_to_roots(spark):
    rows, docs = some_docs(spark)
    got = set(bag(spelling.variants(docs)))
    assert got == expected(vocabulary_of([r[:2] for r in rows]))
    at = {r[0]: r for r in got}
    assert at["grammarzx"][1:3] == ("grammarz", "grammars") and at["abcdefgj"][1] == "abcdefgh"


@pytest.mark.parametrize("crowded", [0, 1, 3])
def test_crowded_keys_give_the_same_pairs(spark, crowded):
    letters = "abcdefghijk"
    words = [f"q{a}tuvwx{b}z" for a in letters for b in letters] + [f"q{a}tuvwxz" for a in letters] + ["aaaaaaa", "aaaaaaaa", "aaaaaaab", "éaaaaaaa"]
    table_ = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    want = sorted((a, b) if (len(a), a) < (len(b), b) else (b, a) for k, a in enumerate(words) for b in words[:k] if one_apart(a, b))
    got = sorted((r["a"], r["b"]) if (len(r["a"]), r["a"]) < (len(r["b"]), r["b"]) else (r["b"], r["a"]) for r in spelling.near_pairs(table_, crowded).collect())
    assert got == want


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    got = set(bag(spelling.variants(odd_docs)))
    assert got == expected(vocabulary_of(rows))
    assert bag(spelling.variants(no_docs)) == []
    assert bag(spelling.variants(odd_docs.where("text is null"))) == []


def test_a_very_long_run_is_a_word(spark):
    long = "ab" * 20_000
    docs = spark.createDataFrame([(k, f"{long} {long[:-1]}c", "en", "a", 0) for k in range(4)], DOCS)
    assert set(bag(spelling.variants(docs))) == expected(vocabulary_of([(k, f"{long} {long[:-1]}c") for k in range(4)]))

import re

import xxhash

from millrace.llm import queries, simhash
from tests.llm.conftest import bag


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def closure(prints):
    """Smallest id reachable by links of all pairs within two bits."""
    root = {i: i for i, _ in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in prints:
        for j, b in prints:
            if (a ^ b).bit_count() <= 2:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in prints}


def test_fingerprint_is_that_of_the_definition():
    for t in (None, "", " \n", "One", "one TWO", "a b c d e f a b c", "É é straße 😀 x\u00a0y z", "x " * 5000):
        assert simhash.fingerprint(t) % (1 << 64) == plain_fingerprint(t)


def test_links_close_over_all_pairs_within_two_bits(spark):
    import random

    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(30)]
    every = set(base)
    for b in base[:20]:
        for _ in range(6):
            b ^= sum(1 << k for k in r.sample(range(64), r.randint(0, 3)))
            every.add(b)
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in every)
    from millrace.llm.common import components

    got = {r.node: r.root for r in components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"))).collect()}
    want = closure([(x, x % (1 << 64)) for x in signed])
    assert {x: got.get(x, x) for x in signed} == want


def test_query_is_brute_force_on_a_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    prints = [(d.doc_id, plain_fingerprint(d.text)) for d in docs]
    want = closure(prints)
    got = queries.op2_simhash_mih(spark, sf_dir).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(i, f"{f:016x}", want[i]) for i, f in prints}
    assert len(got) == len(docs)


def test_odd_rows(odd_docs, no_docs):
    got = bag(simhash.near_duplicates(odd_docs))
    assert len(got) == 9
    by = {i: (f, c) for i, f, c in got}
    assert by[2] == by[3] == by[5] == (0, 2)  # no words: one fingerprint, linked
    assert by[1][1] == 1
    assert simhash.near_duplicates(no_docs).collect() == []
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 2, 4, 6]
    assert simhash.keep_one(no_docs).collect() == []


def plain_similarity(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := t.lower().split()) else set() for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


def test_near_copies_are_those_of_five_word_shingles(spark):
    import random

    r = random.Random(5)
    texts = []
    for _ in range(12):
        words = [f"w{r.randrange(5000)}" for _ in range(r.choice((40, 120, 400)))]
        texts.append(words)
        for share in (0.005, 0.01, 0.02, 0.04, 0.1):
            texts.append([f"x{r.randrange(5000)}" if r.random() < share else w for w in words])
    texts = [" ".join(w) for w in texts] + ["Two words", "two  WORDS", "", " "]
    root = list(range(len(texts)))
    far = 0
    for i, a in enumerate(texts):
        for j, b in enumerate(texts[:i]):
            if plain_similarity(a, b) >= 0.8:
                far += ((simhash.fingerprint(a) ^ simhash.fingerprint(b)) % (1 << 64)).bit_count() > 2
                x, y = root[i], root[j]
                root = [min(x, y) if k in (x, y) else k for k in root]
    assert far > 10  # pairs that links of two bits do not hold
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {x.doc_id: x.component_id for x in simhash.near_copies(docs).collect()} == dict(enumerate(root))
    assert sorted(x.doc_id for x in simhash.keep_one(docs).collect()) == sorted(set(root))


def test_repeated_and_null_ids_lose_no_text(spark):
    one, two, three = ("".join(f"{w}{i} " for i in range(40)) for w in "abc")
    rows = [(7, one), (7, two), (7, one), (3, two), (None, three), (None, three), (None, one), (None, "alone")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(3, two), (7, one), (None, three), (None, "alone")], key=str)


def test_segments_balls_and_verification_carry_the_links(spark, monkeypatch):
    import random

    from millrace.llm.common import components

    r = random.Random(11)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    # each link differs in one bit of either segment: an exact look-up alone finds none of them
    base = [r.getrandbits(64) for _ in range(40)]
    apart = [b ^ (1 << r.randrange(32)) ^ (1 << 32 + r.randrange(32)) for b in base]
    far = [b ^ 0b10101 for b in base]  # same first segment, three bits away: found in the table, refused by the distance
    one = spark.createDataFrame([(signed(x),) for x in {*base, *apart, *far}], "fp long")
    got = {(r.u, r.v) for r in simhash.links(one).collect()}
    every = sorted({*base, *apart, *far})
    assert got == {(signed(x), signed(y)) for x in every for y in every if x != y and (x ^ y).bit_count() <= 2}
    assert len(got) >= 80
    assert simhash.looked_up(one).where("fp <> other").count() > len(got)
    assert simhash.links(one, radii=(0, 0)).count() < len(got) - 79
    # a crowded entry: many share a segment
    left = r.getrandbits(32) << 32
    crowd = {left | r.getrandbits(9) for _ in range(400)} | {left ^ (1 << 40) | r.getrandbits(9) for _ in range(5)}
    monkeypatch.setattr(simhash, "CROWDED", 16)
    df = spark.createDataFrame([(signed(x),) for x in crowd], "fp long")
    assert simhash.looked_up(df).where("crowded").count() > 0
    roots = {r.node: r.root for r in components(simhash.links(df)).collect()}
    want = closure([(signed(x), x) for x in crowd])
    assert {x: roots.get(x, x) for x in want} == want

import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from millrace.llm import packing, queries
from tests.llm.conftest import bag


def test_encoder_gives_the_library_ids():
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = packing.encoder()
    for t in ["Hello  world\n\n x", "<|endoftext|>", "a<|endoftext|> b", "日本語 текст", "é😀\u00a0x\x1c\x85y", "it's we'll  \t\r\n 123abc", "a" * 5000, "x\u2028y\u3000z", "ſtraße ﬁ"]:
        assert ids(t).tolist() == slow.encode(t, add_special_tokens=False).ids


def test_cuts():
    assert packing.cuts(1) == [(0, 1)] and packing.cuts(1024) == [(0, 1024)]
    assert packing.cuts(2500) == [(0, 452), (452, 1024), (1476, 1024)]


def test_local_search_empties_bins():
    r = np.random.default_rng(0)
    emptied = 0
    for _ in range(20):
        lengths = r.integers(1, r.integers(100, 1024), int(r.integers(1, 400)))
        first, plain = packing.best_fit(lengths), packing.best_fit(lengths, decreasing=False)
        bad = [[i] for i in range(len(lengths))]
        for bins in (first, plain, packing.local_search(lengths, first), packing.local_search(lengths, plain), packing.local_search(lengths, bad)):
            assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
            assert all(lengths[b].sum() <= 1024 for b in bins)
        assert len(packing.local_search(lengths, first)) <= len(first)
        emptied += len(plain) - len(packing.local_search(lengths, plain))
        least = -(-int(lengths.sum()) // 1024)
        assert len(packing.local_search(lengths, bad)) <= 1.06 * least + 1
    assert emptied > 20


def test_search_ends_where_no_exchange_helps():
    """Brute force over all bins and all one or two pieces of each, where the bound is not reached."""
    from itertools import combinations

    r = np.random.default_rng(4)
    for _ in range(10):
        lengths = r.integers(250, 800, 40)
        bins = packing.local_search(lengths, packing.best_fit(lengths, decreasing=False))
        if len(bins) <= -(-int(lengths.sum()) // 1024):
            continue
        some = lambda b: [(), *((i,) for i in b), *combinations(b, 2)]
        total = lambda x: int(sum(lengths[i] for i in x))
        for s in bins:
            for b in bins:
                for give in some(s) if b is not s and total(b) < 1024 else ():
                    for back in some(b) if give else ():
                        more = total(give) - total(back)
                        if len(give) < 2 or len(back) < 2:
                            assert not (0 < more <= 1024 - total(b) and 2 * more * (total(b) - total(s) + more) > 0)


def test_one_for_one_and_two_for_one():
    assert len(packing.local_search(np.array([600, 400, 500, 300, 200]), [[0, 4], [1, 2], [3]])) == 2
    assert len(packing.local_search(np.array([1000, 24, 500, 500, 24]), [[0], [2, 3, 1], [4]])) == 2


def test_repeated_rows_are_dealt_evenly(spark):
    """A group of copies is many groups of the packing, not one."""
    docs = spark.createDataFrame([(5, "the same words in every row")] * 3000, "doc_id long, text string").repartition(4)
    rows = packing.pack_documents(docs, group=100).collect()
    sizes = Counter(r.sequence_id >> 32 for r in rows)
    assert len(rows) == 3000 and len(sizes) >= 30 and max(sizes.values()) < 160
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    assert all(sum(n for _, n in b) <= 1024 and sorted(o for o, _ in b) == [k * b[0][1] for k in range(len(b))] for b in bins.values())


def test_fast_ids_are_the_library_ids_of_every_document():
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = packing.encoder()
    for (t,) in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet' WHERE text IS NOT NULL").fetchall():
        assert ids(t).tolist() == slow.encode(t, add_special_tokens=False).ids


def test_round_trip_on_a_table(spark, sf_dir):
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = {d.doc_id: d.text for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op8_best_fit_pack(spark, sf_dir).collect()
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    for i, t in docs.items():
        ids = [*slow.encode(t, add_special_tokens=False).ids, 2]
        own = sorted(pieces[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids)
        assert len(own) == -(-len(ids) // 1024) and all(r.length == 1024 for r in own[1:])
        for r in own:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    for b in bins.values():
        b.sort()
        assert b[0][0] == 0 and all(x[0] + x[1] == y[0] for x, y in zip(b, b[1:])) and sum(n for _, n in b) <= 1024
    assert len(bins) <= 1.02 * sum(r.length for r in rows) / 1024 + 1


def test_odd_rows(odd_docs, no_docs):
    rows = packing.pack_documents(odd_docs).collect()
    assert sum(r.length == 1 for r in rows) == 3  # two null texts and an empty one: the end token alone
    assert sum(r.doc_id is None for r in rows) == 2 and sum(r.doc_id == 1 for r in rows) == 2
    assert packing.pack_documents(no_docs).collect() == []
    with_ids = bag(packing.tokenised(odd_docs.where("doc_id = 1"), with_ids=True))
    assert with_ids[0][5][-1] == 2

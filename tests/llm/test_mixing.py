import random
from collections import defaultdict

import pytest

from millrace.llm import mixing, queries
from tests.llm.conftest import DOCS, bag


def test_targets_stop_at_the_cap_and_reshare():
    rows = mixing.targets([("b", 10), ("a", 100), (None, 40), ("c", 50)])
    assert [r["source"] for r in rows] == ["a", "b", "c", None]
    assert abs(sum(r["target"] for r in rows) - 300) < 1e-9
    assert all(r["target"] <= 2 * r["source_size"] + 1e-9 for r in rows)
    free = [r["target"] / r["weight"] for r in rows if r["target"] < 2 * r["source_size"] - 1e-9]
    assert not free or max(free) - min(free) < 1e-9
    assert mixing.targets([]) == [] and mixing.targets([("a", 0)])[0]["target"] == 0


@pytest.mark.parametrize("n", [1, 2, 7, 64])
def test_permutation_is_a_bijection(spark, n):
    from pyspark.sql import functions as F

    df = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3), F.lit(1)).alias("p"))
    assert sorted(r.p for r in df.collect()) == list(range(n))


def test_query_meets_targets_and_limits(spark, sf_dir):
    source = {d.doc_id: d.source for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op3_source_mix(spark, sf_dir).collect()
    assert len(rows) == len(source)
    assert all(0 <= r.taken <= 2 * r["size"] for r in rows)
    taken, target, size = defaultdict(int), {}, defaultdict(int)
    for r in rows:
        s = source[r.doc_id]
        taken[s] += r.taken
        size[s] += r["size"]
        target[s] = r.target
    assert {r.doc_id: r.source_size for r in rows} == {r.doc_id: size[source[r.doc_id]] for r in rows}
    assert all(abs(taken[s] - target[s]) <= mixing.BLOCK for s in target)
    assert bag(queries.op3_source_mix(spark, sf_dir)) == sorted(map(tuple, rows), key=str)


def test_mixed_documents_hold_the_words_that_were_taken(spark):
    r = random.Random(1)
    docs = [(i, "  ".join(f"w{i}x{k}" for k in range(r.randint(0, 900))), "en", f"s{i % 3}", 0) for i in range(40)]
    df = spark.createDataFrame(docs, DOCS)
    taken = {x.doc_id: x.taken for x in mixing.taken_words(df).collect()}
    got = defaultdict(int)
    for row in mixing.mixed_documents(df).collect():
        assert row.text in docs[row.doc_id][1] and row.n_chars in (len(row.text), 0)
        got[row.doc_id] += len(row.text.split())
    assert {i: got[i] for i in taken} == taken


def test_odd_rows(odd_docs, no_docs):
    rows = mixing.taken_words(odd_docs).collect()
    assert len(rows) == 9 and all(r.taken <= 2 * r["size"] for r in rows)
    assert sorted(r["size"] for r in rows) == [0, 0, 0, 0, 6, 6, 7, 7, 40_000]
    out = mixing.mixed_documents(odd_docs)
    assert out.columns == odd_docs.columns and sum(len(r.text.split()) for r in out.collect()) == sum(r.taken for r in rows)
    assert mixing.taken_words(no_docs).collect() == [] and mixing.mixed_documents(no_docs).collect() == []


def test_plan_of_a_table_is_that_of_the_definition(spark):
    r = random.Random(3)
    sizes = [(f"é{r.randrange(10**6)}", int(10 ** r.uniform(0, 6))) for _ in range(700)] + [(None, 50), ("", 0), ("A", 3), ("a", 10**7)]
    rows = spark.createDataFrame([(s, n) for s, n in sizes], "source string, size long")
    got = mixing.plan(rows).orderBy("src").collect()
    want = mixing.targets(sizes)
    assert [(x.source, x.source_size) for x in got] == [(w["source"], w["source_size"]) for w in want]
    assert all(abs(x.target - w["target"]) <= 1e-9 * max(1.0, w["target"]) for x, w in zip(got, want))


def test_slots_fill_every_quota_over_many_sources(spark):
    r = random.Random(4)
    rows = spark.createDataFrame([(f"s{k:04}", int(10 ** r.uniform(1, 5))) for k in range(900)], "source string, size long")
    sources = mixing.plan(rows)
    quota = {x.src: x.slots for x in sources.collect()}
    got = defaultdict(list)
    for x in mixing.slots(sources).collect():
        got[x.src].append(x.j)
    assert {s: n for s, n in quota.items() if n} == {s: len(js) for s, js in got.items()}
    assert all(sorted(js) == list(range(len(js))) for js in got.values())
    assert len({x.shard for x in mixing.slots(sources).collect()}) > 1


def test_taken_is_what_slots_and_permutations_replayed_by_hand_take(spark):
    from pyspark.sql import functions as F

    r = random.Random(7)
    docs = [(i, " ".join(f"w{i}x{k}" for k in range(r.choice((0, 1, 5, 130, 700)))), "en", f"s{i % 4}", 0) for i in range(60)]
    df = spark.createDataFrame(docs, DOCS)
    placed, _, sources = mixing.mix(df)
    sources = {x.src: x for x in sources.collect()}
    streams = defaultdict(dict)  # the source's words, each with its document
    for p in placed.collect():
        streams[p.src].update({p.a + k: p.doc_id for k in range(p["size"])})
    assert all(sorted(words) == list(range(sources[s].source_size)) for s, words in streams.items())
    want = dict.fromkeys((d[0] for d in docs), 0)
    for s, x in sources.items():
        order = {}
        for epoch in range(-(-x.slots // x.blocks) if x.blocks else 0):
            each = spark.range(x.blocks).select("id", mixing.permuted(F.col("id"), F.lit(x.blocks), F.lit(s).cast("long"), F.lit(epoch).cast("long")).alias("p"))
            order[epoch] = {y.id: y.p for y in each.collect()}
        for j in range(x.slots):
            first = order[j // x.blocks][j % x.blocks] * mixing.BLOCK
            own = [streams[s][k] for k in range(first, min(first + mixing.BLOCK, x.source_size))]
            for i in own[: int(x.part * len(own) + 0.5)] if j == x.slots - 1 else own:
                want[i] += 1
    assert {t.doc_id: t.taken for t in mixing.taken_words(df).collect()} == want


def test_a_plan_without_loops_over_all_pairs(spark, sf_dir):
    plan = queries.op3_source_mix(spark, sf_dir)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_the_mix_does_not_hang_on_settings(spark, sf_dir):
    before, got = spark.conf.get("spark.sql.shuffle.partitions"), []
    for parts in (4, 16, 64):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got.append(bag(queries.op3_source_mix(spark, sf_dir)))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1] == got[2]


def test_slots_are_not_sent_by_way_of_the_driver(spark):
    docs = [(i, " ".join(f"w{k % 50}" for k in range(900)), "en", f"s{i % 3}", 0) for i in range(300)]
    _, mixed, _ = mixing.mix(spark.createDataFrame(docs, DOCS))
    assert mixed.count() and len(mixed.collect()) > 2000
    final = mixed._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "isFinalPlan=true" in final
    for line in final.splitlines():
        if "BroadcastHashJoin" in line:
            assert "block#" not in line.split("],")[0] and "stretch#" not in line.split("],")[0], line

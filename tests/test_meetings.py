import random

import pytest

from millrace.operators import graph, joins, phrases


@pytest.mark.parametrize("seed", [1, 2])
def test_interval_join_is_all_pairs_that_overlap_once(spark, seed):
    r = random.Random(seed)

    def side(n):
        rows = []
        for k in range(n):
            lo = r.randrange(-50, 2000)
            rows.append((k, r.choice((None, "a", "b")), lo, lo + r.choice((0, 0, 1, 2, 3, 7, 8, 100, 1500, -1))))
        return rows

    a, b = side(150), side(150)
    frame = lambda rows: spark.createDataFrame(rows, "id long, g string, lo long, hi long")
    got = sorted((x["a"], x["b"]) for x in joins.interval_join(frame(a), frame(b), ["g"]).selectExpr("i.id AS a", "t.id AS b").collect())
    assert got == sorted((x[0], y[0]) for x in a for y in b if x[1] and x[1] == y[1] and x[2] <= x[3] and y[2] <= y[3] and x[2] <= y[3] and y[2] <= x[3])
    assert joins.interval_join(frame([]), frame(b), ["g"]).collect() == []


def test_phrases_by_kind_and_section(spark):
    sections = [("d", 1, "The Fetch tool", "run the --dry-run flag, or dry run"), ("d", 2, "Other", "Dry  Run! limit"), ("d", 3, "fetch", "limits; limit_x"), ("e", 1, None, None), ("d", 4, "fetch", "the limit")]
    names = [(1, "--dry-run", "flag", None), (2, "dry run", "name", None), (3, "limit", "param", "fetch"), (4, "run the dry run now", "name", None), (5, " - ", "name", None), (6, None, "name", None), (7, "Run", None, None)]
    got = phrases.phrases_in_texts(spark.createDataFrame(sections, "doc string, section int, heading string, text string"), spark.createDataFrame(names, "id int, name string, kind string, parent string"))
    assert sorted(map(tuple, got.collect())) == [("d", 1, 1), ("d", 1, 2), ("d", 1, 7), ("d", 2, 2), ("d", 2, 7), ("d", 4, 3)]
    assert phrases.phrases_in_texts(spark.createDataFrame(sections, "doc string, section int, heading string, text string"), spark.createDataFrame([], "id int, name string, kind string, parent string")).collect() == []


def test_hidden_only_if_all_are(spark):
    found = spark.createDataFrame([("d", 1, 1), ("d", 1, 2), ("d", 1, 3)], "doc string, section int, id int")
    names = spark.createDataFrame([(1, "Get", True), (2, "get", False), (3, "put", True)], "id int, name string, hidden boolean")
    assert sorted(map(tuple, phrases.hidden_phrases(found, names).collect())) == [("d", 1, "get", False), ("d", 1, "put", True)]


def test_search_from_both_sides(spark):
    r = random.Random(4)
    edges = list({(r.randrange(60), r.randrange(60)) for _ in range(80)} | {(k, k + 1) for k in range(100, 140)})
    up = {}
    for p, c in edges:
        up.setdefault(c, set()).add(p)

    def ancestor(a, b):
        seen, todo = {b}, [b]
        while todo:
            for p in up.get(todo.pop(), ()):
                if p not in seen:
                    seen.add(p)
                    todo.append(p)
        return a in seen

    pairs = [(k, r.randrange(60), r.randrange(60)) for k in range(40)] + [(50, 100, 140), (51, 140, 100), (52, 100, 100), (53, None, 1)]
    got = graph.are_ancestors(spark.createDataFrame(edges + [(None, 1)], "parent long, child long"), spark.createDataFrame(pairs, "id long, a long, b long")).collect()
    assert {x["id"]: x["found"] for x in got} == {k: a is not None and ancestor(a, b) for k, a, b in pairs}


def test_nodes_that_cannot_lie_between_leave_the_search(spark, monkeypatch):
    """Every node by half and by third: frontiers stay below a bound that a search without depths passes."""
    sizes, keep = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: (out := keep(df), sizes.append(out.count()))[0])
    e = spark.range(2, 3000).selectExpr("id div 2 AS parent", "id AS child").union(spark.range(3, 3000).selectExpr("id div 3", "id"))
    pairs = spark.range(1000, 1100).selectExpr("id", "(id * 7 % 2999 + 1) div 2 AS a", "id * 7 % 2999 + 1 AS b").union(spark.range(100).selectExpr("id", "id + 1000", "id + 1"))
    assert {r["id"] for r in graph.are_ancestors(e, pairs).collect() if r["found"]} == set(range(1000, 1100))
    search = sizes[len(sizes) - sizes[::-1].index(5994) :]  # after the edges with depths
    assert max(search) <= 200 and sum(search) <= 1000, sizes


@pytest.mark.parametrize("most", [1, 3, 64])
def test_depths_stop_and_circles_are_searched(spark, most):
    edges = [(k, k + 1) for k in range(8)] + [(8, 4), (20, 21), (21, 20), (8, 30)]
    pairs = [(0, 0, 30), (1, 30, 0), (2, 5, 4), (3, 21, 21), (4, 20, 30), (5, 3, 99), (6, 99, 99), (7, 4, 3), (8, 0, 30)]
    got = graph.are_ancestors(spark.createDataFrame(edges, "parent long, child long"), spark.createDataFrame(pairs, "id long, a long, b long"), most)
    assert {r["id"] for r in got.collect() if r["found"]} == {0, 2, 3, 6, 8}


def test_runs_are_made_only_where_a_name_begins(spark, monkeypatch):
    monkeypatch.setattr(phrases, "grams", None)
    sections = spark.createDataFrame([(1, 1, "h", "to be or not to be, to Be"), (1, 1, "h", "to be"), (2, 1, "h", "be to"), (3, 1, "h", "to")], "doc int, section int, heading string, text string")
    names = spark.createDataFrame([(1, "to be", "name", None), (2, "to", "name", None), (3, "be to be", "name", None), (4, "to be", "flag", None)], "id int, name string, kind string, parent string")
    got = sorted(map(tuple, phrases.phrases_in_texts(sections, names).collect()))
    assert got == [(1, 1, 1), (1, 1, 1), (1, 1, 2), (1, 1, 2), (1, 1, 3), (1, 1, 4), (1, 1, 4), (2, 1, 2), (3, 1, 2)]


def test_an_interval_of_one_length_is_copied_to_few_classes(spark):
    from tests.test_standing import most_rows

    i = spark.createDataFrame([(k, 1, 10 * k, 10 * k + 2 ** (k % 8) - 1) for k in range(64)], "a int, grp int, lo long, hi long")
    t = spark.createDataFrame([(k, 1, 2 * k, 2 * k) for k in range(400)], "b int, grp int, lo long, hi long")
    out = joins.interval_join(i, t, ["grp"]).select("i.a", "t.b")
    assert most_rows(spark, out, "Generate") <= 3 * 400  # with a class for each power of two, eight times
    assert sorted(map(tuple, out.collect())) == sorted((a, b) for a in range(64) for b in range(400) if 10 * a <= 2 * b <= 10 * a + 2 ** (a % 8) - 1)

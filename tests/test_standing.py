from millrace.operators import names, scores, settings


def test_priority_terms_round_step_by_step(spark):
    files = spark.createDataFrame([(4.0, 10, 9, "import-lines"), (None, 5, 50, "anywhere")], "hotspot double, coupling int, fan_in int, mode string")
    rows = [(1, 4, "A", "S", 1.0, 5, 3, None), (2, 4, "Z", None, None, None, 3, "anywhere"), (3, None, "C", "L", 4.0, 10, 9, "import-lines")]
    found = spark.createDataFrame(rows, "id int, severity int, tier string, effort string, hotspot double, coupling int, fan_in int, mode string")
    got = scores.priorities(found, files, {"H": 1.0, "C": 0.5, "F": 0.5}, {"S": 1.0, "M": 0.75, "L": 0.5}).select("id", "H", "C", "F", "interest", "tier_weight", "tractability", "priority")
    assert sorted(map(tuple, got.collect())) == [(1, 0.25, 0.5, 0.3333, 1.6667, 1.0, 1.0, 6.6668), (2, 0.0, 0.0, 0.0, 1.0, 0.7, 0.75, 2.1), (3, 1.0, 1.0, 1.0, 3.0, 0.35, 0.5, 0.0)]
    none = scores.priorities(found, files.limit(0), {"H": 1.0, "C": 0.5, "F": 0.5}, {"S": 1.0, "M": 0.75, "L": 0.5}).collect()
    assert {r["interest"] for r in none} == {1.0}


def test_names_by_rank_by_part_and_by_owner(spark):
    definitions = [(1, "run", "function", ["app"]), (2, "run", "literal", ["app"]), (3, "run", "reg", ["cli"]), (4, "app", "class", None), (5, "load", "function", ["app", "cli"]), (6, "load", "function", ["db"])] + [(k, "many", "function", ["x"]) for k in range(10, 21)]
    references = [(1, "run", True, None), (2, "app.load", True, []), (3, "none.load", True, None), (4, "load", False, ["cli", "cli"]), (5, "load", False, ["web"]), (6, "gone", False, ["cli"]), (7, "many", True, None), (8, "run", False, ["app", "cli"]), (9, "app/x.load", True, None), (10, "many", None, ["x"]), (11, None, True, None)]
    got = names.anchored(spark.createDataFrame(references, "ref int, name string, specific boolean, context array<string>"), spark.createDataFrame(definitions, "id int, name string, kind string, owners array<string>"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        [(1, 1, None), (2, 5, None), (2, 6, None), (3, None, "unknown"), (4, 5, None), (5, None, "ambiguous"), (6, None, "unknown"), (7, None, "ambiguous"), (8, 1, None), (8, 2, None), (8, 3, None), (9, None, "unknown"), (10, None, "ambiguous"), (11, None, "unknown")],
        key=str,
    )


def test_settings_in_layers(spark):
    rows = [(1, 0, "a.n", "3"), (1, 1, "a.n", "x"), (1, 1, "b", "TRUE"), (1, 2, "b", "false"), (1, 0, "odd", "1"), (2, 0, None, "1"), (2, 0, "f", "2"), (2, 0, "s", None)]
    got = settings.layered(spark.createDataFrame(rows, "scope int, layer int, key string, value string"), {"a": {"n": 1}, "b": True, "f": 0.5, "s": "t", "l": []})
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        [(1, "a.n", "1", "a.n should be int"), (1, "b", "false", None), (1, "f", "0.5", None), (1, "s", "t", None), (1, "odd", None, "unknown key odd"), (2, "a.n", "1", None), (2, "b", "true", None), (2, "f", "2", None), (2, "s", "t", "s should be str")],
        key=str,
    )


def most_rows(spark, df, kind):
    """The most rows that a step of ``df`` whose name has ``kind`` puts out, as its first run tells."""
    df.collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store = spark._jsparkSession.sharedState().statusStore()
    last = store.executionsList().apply(store.executionsList().size() - 1).executionId()
    values, nodes, most = store.executionMetrics(last), store.planGraph(last).allNodes(), 0
    for node in (nodes.apply(i) for i in range(nodes.size())):
        for m in (node.metrics().apply(i) for i in range(node.metrics().size() if kind in node.name() else 0)):
            if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                most = max(most, int(values.get(m.accumulatorId()).get().replace(",", "")))
    return most


def test_bare_names_of_many_definitions_meet_them_as_one_row(spark):
    d = [(i, "often", "class", ["a", "b"] if i == 7 else ["b"]) for i in range(500)]
    r = [(k, "often", False, ["b", "c"]) for k in range(300)] + [(300, "often", False, ["a"]), (301, "often", False, ["a", "b"]), (302, "often", False, None)]
    out = names.anchored(spark.createDataFrame(r, "ref int, name string, specific boolean, context array<string>"), spark.createDataFrame(d, "id int, name string, kind string, owners array<string>"))
    assert most_rows(spark, out, "Join") < 2000
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(k, None, "ambiguous") for k in [*range(300), 301, 302]] + [(300, 7, None)], key=str)

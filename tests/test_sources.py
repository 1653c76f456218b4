"""File sources on small literals and folders."""

import pytest

from millrace.sources import files


def lines(spark, text, key="id"):
    return spark.createDataFrame([("x", i, v) for i, v in enumerate(text.split("\n"))], f"{key} string, n int, value string")


def test_tree(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.txt").write_bytes(b"one\ntwo")
    (tmp_path / "b.bin").write_bytes(b"\0x")
    got = {r.path: r for r in files.decoded(files.scan_tree(spark, str(tmp_path))).collect()}
    assert set(got) == {"d/a.txt", "b.bin"} and got["d/a.txt"].text == "one\ntwo" and got["b.bin"].skipped and got["b.bin"].text is None
    h = files.heads(files.decoded(files.scan_tree(spark, str(tmp_path))), {"one": "one"}).collect()
    assert {r.path: r.one for r in h} == {"d/a.txt": True, "b.bin": False}


def test_log_refs_blame_hunks(spark):
    log = spark.createDataFrame([("\x1eabc\tAnn\ta@x\t2024-01-02T03:04:05+00:00\tfix\tit\na.py\nb.py\n\x1edef\tBob\tb@x\tbad\ts\n",)], "value string")
    got = files.commits(log).collect()
    assert [(r.sha, r.subject, r.files) for r in got] == [("abc", "fix\tit", ["a.py", "b.py"]), ("def", "s", [])] and got[1].ts is None
    r = spark.createDataFrame([("main\t2024-01-01\t",), ("HEAD\t2024-01-01\trefs/main",)], "value string")
    assert [(x.name, x.merged) for x in files.refs(r).collect()] == [("main", None)]
    b = lines(spark, f"{'a' * 40} 1 1 1\nauthor Ann\nauthor-time 5\n\tcode\n{'b' * 40} 2 2\nauthor Bob\nauthor-time 6\n\tmore", "file")
    assert [(x.line, x.author, x.epoch) for x in files.blame(b).orderBy("line").collect()] == [(1, "Ann", 5), (2, "Bob", 6)]
    d = lines(spark, "diff --git a/f b/f\n--- a/f\n+++ b/f\n@@ -3 +3,2 @@ def\n-x\n+y\n+z\n@@ -9,0 +11 @@\n+w")
    assert [(x.file, x.old_start, x.old_end, x.new_start, x.new_end, x.text) for x in files.hunks(d).orderBy("new_start").collect()] == [("f", 3, 3, 3, 4, "-x\n+y\n+z"), ("f", 9, 8, 11, 11, "+w")]
    m = spark.createDataFrame([("s1", "t\n\nBase-Commit: abc\n"), ("s2", "none")], "sha string, message string")
    assert [tuple(x) for x in files.trailers(m, "Base-Commit").collect()] == [("s1", "abc")]
    i = spark.createDataFrame([("100644 x 0\ta",), ("120000 x 0\tl",), ("160000 x 0\tm",)], "value string")
    assert [x.kind for x in files.index_listing(i).collect()] == ["file", "link", "module"]


def test_json_csv_logs(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    files.write_json(df, str(tmp_path / "j"))
    assert files.read_json(spark, str(tmp_path / "j"), "k int, v string").collect() == df.collect()
    assert files.read_json(spark, str(tmp_path / "none"), "k int", required=False).count() == 0
    with pytest.raises(FileNotFoundError):
        files.read_json(spark, str(tmp_path / "none"), "k int")
    (tmp_path / "r.csv").write_text("a,b\n1,2\n")
    assert files.read_rules(spark, str(tmp_path / "r.csv"), ["a", "b"]).first().b == "2"
    with pytest.raises(Exception):
        files.read_rules(spark, str(tmp_path / "r.csv"), ["a", "c"]).collect()
    for k in (1, 2):
        files.append_log(spark.createDataFrame([(k,)], "k int"), str(tmp_path / "l"))
    assert [tuple(r) for r in files.read_log(spark, str(tmp_path / "l"), "k int", "k").collect()] == [(1, 1), (2, 2)]


def test_build_and_routes(spark):
    mk = lambda text: spark.createDataFrame([("f", i, v) for i, v in enumerate(text.split("\n"), 1)], "path string, lineno int, line string")
    assert sorted(r.target for r in files.make_targets(mk("all test: dep\n.PHONY: all\nX := 1\n%.o: %.c")).collect()) == ["all", "test"]
    p = spark.createDataFrame([("p", '{"scripts":{"a":"x","b":"y"}}')], "path string, text string")
    assert sorted(r.target for r in files.script_names(p).collect()) == ["a", "b"]
    d = files.dockerfile(mk("FROM a AS x\nEXPOSE 80\nFROM b\nUSER me")).first()
    assert (d.base, d.ports, d.user, d.workdir) == ("b", ["80"], "me", None)
    r = files.routes(mk('@RequestMapping("/api")\nclass A\n@GetMapping("/x")\n@PostMapping'))
    assert [(x.method, x.route) for x in r.orderBy("lineno").collect()] == [("GET", "/api/x"), ("POST", "/api")]
    s = spark.createDataFrame([("env", "k", "1"), ("yaml", "k", "2"), ("yaml", "j", "3")], "source string, key string, value string")
    assert sorted(map(tuple, files.flattened(s, {"yaml": 0, "env": 1}).collect())) == [("j", "3", "yaml"), ("k", "2", "yaml")]
    t = spark.createDataFrame([("f", i, f"l{i}") for i in range(12)], "path string, lineno int, line string")
    assert files.tail(t, "path", 2).first().tail == "l10\nl11"


def test_snapshots_artefacts_environment(spark):
    t = spark.createDataFrame([("s1", "a", "x"), ("s2", "a", "y")], "snapshot string, path string, content string")
    assert [tuple(r) for r in files.at_snapshot(t, "s2").collect()] == [("a", "y")]
    f = spark.createDataFrame([("n.ipynb", '{"cells":[{"cell_type":"code"},{"cell_type":"x"}]}'), ("m.bin", "version https://git-lfs.github.com"), ("o.txt", "t")], "path string, text string")
    got = {r.path: (r["class"], r.pointer, r.n_cells) for r in files.artefacts(f, [("notebook", "ipynb$"), ("large", "bin$")]).collect()}
    assert got == {"n.ipynb": ("notebook", None, 2), "m.bin": ("large", True, None)}
    e = lambda *x: spark.createDataFrame(list(x), "name string, value string")
    out = files.environment(e(("DB_URL", "1")), e(("db.url", "2"), ("PORT", "3")), e(("port", "4"), ("z", "5")))
    assert sorted(map(tuple, out.collect())) == [("DB_URL", "1", "manifest"), ("PORT", "3", "image"), ("Z", "5", "config")]

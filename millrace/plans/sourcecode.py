"""Queries of source code: each order is a file that holds one of some texts, some lines down; the SQL says by hand what each text holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import tables
from millrace.operators import code
from millrace.plans.markdown import values
from millrace.plans.registry import query
from millrace.sources.tables import table


def _files(spark: SparkSession, sf_dir: str, texts: list[str], *more: tuple[str, list[str]]) -> DataFrame:
    """``file, text`` and further columns: an order's text by its key, below none to two blank lines."""
    pick = lambda xs: F.get(F.array(*map(F.lit, xs)), F.expr(f"int(o_orderkey div 4 % {len(xs)})"))
    blank = F.repeat(F.lit("\n"), F.expr("int(o_orderkey div 64 % 3)"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file"), F.concat(blank, pick(texts)).alias("text"), *[pick(xs).alias(name) for name, xs in more])


def _told(n: int, rows: list[tuple], names: str) -> str:
    """SQL of ``rows``, which begin with the number of their text, for the files that hold it; ``down`` is how far down."""
    return f"(SELECT o_orderkey AS file, CAST(o_orderkey // 64 % 3 AS INTEGER) AS down, v.* FROM orders JOIN {values(rows, 'part, ' + names)} ON v.part = o_orderkey // 4 % {n})"


#: Texts of three languages with tests, and the line and name of each test in which nothing asserts.
_TESTS: list[tuple[str, list[tuple[int, str]]]] = [
    ("def test_a():\n    x = 1\n\n    assert x\n\ndef test_b():\n    run()\n\ndef helper():\n    assert True", [(6, "test_b")]),
    ("class TestX:\n    def test_one(self):\n        go()\n    async def test_two(self):\n        with pytest.raises(E):\n            go()\n    def test_three(self):\n        go()", [(2, "test_one"), (7, "test_three")]),
    ("func TestLoad(t *testing.T) {\n\tload()\n}\n\nfunc TestSave(t *testing.T) {\n\tif bad {\n\t\tt.Fatal(1)\n\t}\n}\nfunc check() { t.Error(2) }", [(1, "TestLoad")]),
    ("it('adds', () => {\n  add(1);\n});\ntest.only(\"takes\", () => {\n  expect(take(1)).toBe(2);\n});\nit(`odd`)", [(1, "adds"), (7, "odd")]),
    ("public class A {\n    @Test\n    public void b() {\n        c();\n    }\n    @Test\n    public void d() {\n        Assert.equal(1, 1);\n    }\n}", [(2, "@Test")]),
    ("[Fact]\npublic void A() { x.Should().Be(1); }\n  [Test] // below\n  public void B() { }", [(1, "[Fact]"), (3, "[Test] // below")]),
    ("def test_long():\n    pass\n}\n    should_not = 1\nvalue = 1\nassert value", [(1, "test_long")]),
]


@query(f"SELECT file, CAST(line + down AS INTEGER) AS line, test FROM {_told(len(_TESTS), [(k, *r) for k, (_, rows) in enumerate(_TESTS) for r in rows], 'line, test')}")
def assertion_free_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tests of several languages without an assertion up to the next test or the next line at the margin (FUN33, §2.13 assert-free)."""
    return code.unasserted_tests(_files(spark, sf_dir, [t for t, _ in _TESTS]), "file")


#: Language, text, its comments as ``(line, c0, c1, kind, text)``, and its marks of debt as ``(line, marker, ticket)``.
_COMMENTED: list[tuple[str, str, list[tuple], list[tuple]]] = [
    ("python", 'x = "# TODO no"  # fixme: JIRA-12\n"""\n# TODO in a string\n"""\nf\'# no\' # it\'s "ugly\n', [(1, 19, 33, "line", "fixme: JIRA-12"), (5, 10, 20, "line", 'it\'s "ugly')], [(1, "fixme", True), (5, "ugly", False)]),
    (
        "go", 'a := "/* no todo"\n/* one\n * quick   fix #12\n\n three */ b // hack\nc := `// no\n// todo`\n',
        [(2, 3, 6, "block", "one"), (3, 3, 18, "block", "quick   fix #12"), (5, 1, 6, "block", "three"), (5, 15, 19, "line", "hack")], [(3, "quick fix", True), (5, "hack", False)],
    ),
    ("markdown", "# todo\n<!-- for now\n\nhttps://x/issues/7 is broken -->\n'<!-- xxx -->'", [(2, 5, 12, "block", "for now"), (4, 0, 28, "block", "https://x/issues/7 is broken"), (5, 6, 9, "block", "xxx")], [(2, "for now", False), (4, "broken", True), (5, "xxx", False)]),
    ("php", "$a = '// todo'; # legacy\n/* nasty */ // hacky", [(1, 18, 24, "line", "legacy"), (2, 3, 8, "block", "nasty"), (2, 15, 20, "line", "hacky")], [(1, "legacy", False), (2, "nasty", False), (2, "hacky", False)]),
    ("yaml", "it's: a # isn't TODO\nb: 'x # todo' -- smell\nc: /* untested", [(1, 10, 20, "line", "isn't TODO"), (2, 17, 22, "line", "smell"), (3, 6, 14, "block", "untested")], [(1, "todo", False), (2, "smell", False), (3, "untested", False)]),
    ("rust", "fn f<'a>(x: &'a str) { // see #9, remove me\n  let s = \"\\\"// todo\"; }", [(1, 26, 43, "line", "see #9, remove me")], [(1, "remove me", True)]),
]
_C = len(_COMMENTED)


@query(f"SELECT file, CAST(line + down AS INTEGER) AS line, c0, c1, kind, said AS text FROM {_told(_C, [(k, *r) for k, x in enumerate(_COMMENTED) for r in x[2]], 'line, c0, c1, kind, said')}")
def comment_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments of six languages, line by line with columns; marks in strings begin none (FUN11)."""
    files = _files(spark, sf_dir, [x[1] for x in _COMMENTED], ("language", [x[0] for x in _COMMENTED]))
    return tables.apply(files, "comment_spans", ["language", "text"], ["file"])


@query(f"SELECT file, CAST(line + down AS INTEGER) AS line, marker, ticket FROM {_told(_C, [(k, *r) for k, x in enumerate(_COMMENTED) for r in x[3]], 'line, marker, ticket')}")
def debt_in_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks of debt in comments, with whether a ticket is named (FUN27, §2.13 satd-marker)."""
    files = _files(spark, sf_dir, [x[1] for x in _COMMENTED], ("language", [x[0] for x in _COMMENTED]))
    return code.debt_markers(files, "file")


#: SQL texts and their definitions as ``(name, kind, owner, l0, l1)``.
_SQL: list[tuple[str, list[tuple]]] = [
    (
        "CREATE TABLE items (\n  id INTEGER PRIMARY KEY,\n  \"body\" TEXT\n);\n\nCREATE VIRTUAL TABLE items_fts USING fts5(body);\nCREATE INDEX idx ON items(body);\nALTER TABLE items ADD COLUMN created_at TEXT;\n",
        [("items", "sql", None, 1, 4), ("id", "sqlcol", "items", 2, 2), ("body", "sqlcol", "items", 3, 3), ("items_fts", "sql", None, 6, 6), ("idx", "sql", None, 7, 7), ("created_at", "sqlcol", "items", 8, 8)],
    ),
    (
        "create table if not exists Main.Users (\n  email VARCHAR(255) NOT NULL, -- unique; checked, by (the app\n  active BOOLEAN DEFAULT 'yes;''no, (',\n  CONSTRAINT u UNIQUE (email),\n  PRIMARY KEY (email, active)\n);",
        [("Main.Users", "sql", None, 1, 6), ("email", "sqlcol", "main.users", 2, 2), ("active", "sqlcol", "main.users", 3, 3)],
    ),
    ("CREATE TRIGGER touch AFTER UPDATE ON users\nBEGIN\n  UPDATE users SET a = CASE WHEN 1 THEN 1 ELSE 0 END;\n  INSERT INTO log VALUES ('x;y');\nEND;\nCREATE TABLE t (id INTEGER, name TEXT);", [("touch", "sql", None, 1, 5), ("t", "sql", None, 6, 6), ("id", "sqlcol", "t", 6, 6), ("name", "sqlcol", "t", 6, 6)]),
    ("-- CREATE TABLE no (x INT);\n/* CREATE VIEW no;\n*/\nCREATE OR REPLACE TEMP VIEW [v w] AS\nSELECT $q$ ; CREATE TABLE no (x INT) $q$;\nSELECT 1", [("v w", "sql", None, 4, 5)]),
    ("CREATE TABLE long (\n" + "  -- filler\n" * 40 + "  late INT\n);\nDROP TABLE long;", [("long", "sql", None, 1, 30), ("late", "sqlcol", "long", 42, 42)]),
]


@query(f"SELECT file, name, kind, owner, CAST(l0 + down AS INTEGER) AS l0, CAST(l1 + down AS INTEGER) AS l1 FROM {_told(len(_SQL), [(k, *r) for k, (_, rows) in enumerate(_SQL) for r in rows], 'name, kind, owner, l0, l1')}")
def sql_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects and columns that SQL statements define, with their lines (EXT05)."""
    return tables.apply(_files(spark, sf_dir, [t for t, _ in _SQL]), "sql_definitions", "text", ["file"])


#: Path, text, and the line and number of writes to the console where the repository has a logger.
_WRITES: list[tuple[str, str, tuple[int, int] | None]] = [
    ("src/a.py", "import os\nprint(1)\nx = 2\nprint(x)", (2, 2)),
    ("tools/b.py", "print(1)", None),
    ("src/c.go", "func main() {}\nfmt.Println(1)", None),
    ("src/d.js", "console.log(1); console.log(2)", (1, 1)),
    ("lib/bin/deep/e.rb", "puts 1", None),
    ("cli", "  echo hello", (1, 1)),
    ("src/f.py", "reprint(1)", None),
]


@query(f"""
SELECT file, CAST(line + down AS INTEGER) AS line, CAST(n AS BIGINT) AS count FROM {_told(len(_WRITES), [(k, *r) for k, (_, _, r) in enumerate(_WRITES) if r], 'line, n')} w
JOIN orders o ON o.o_orderkey = w.file WHERE EXISTS (SELECT 1 FROM orders p WHERE p.o_custkey = o.o_custkey AND p.o_orderpriority = '1-URGENT')""")
def console_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First writes to the console of files that are no commands, of customers with an urgent order, whose first line imports a logger (§2.13 stdout-write)."""
    files = _files(spark, sf_dir, [x[1] for x in _WRITES], ("path", [x[0] for x in _WRITES]))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file"), F.col("o_custkey").alias("repository"), (F.col("o_orderpriority") == "1-URGENT").alias("urgent"))
    placed = files.join(o, "file").withColumn("text", F.concat("text", F.when(F.col("urgent"), "\nimport logging").otherwise("")))
    return code.stdout_writes(placed, "file")

from millrace.functions.code import comment_spans, sql_definitions
from millrace.operators import code, linescan


def test_comments_of_odd_texts():
    for text in (None, "", "\n", "x"):
        assert list(comment_spans("go", text)) == [] and list(comment_spans(None, text)) == []
    assert list(comment_spans("c", "/* a\n\n * b")) == [(1, 3, 4, "block", "a"), (3, 3, 4, "block", "b")]
    assert list(comment_spans("c", "\"open // no\n// yes")) == [(1, 9, 11, "line", "no"), (2, 3, 6, "line", "yes")]
    assert list(comment_spans("Python", "r'\\' # a' # b")) == [(1, 12, 13, "line", "b")]
    assert len(list(comment_spans("python", "# x\n" * 50_000))) == 50_000


def test_sql_of_odd_texts():
    for text in (None, "", ";;", "CREATE", "CREATE TABLE", "ALTER TABLE x", "ALTER TABLE x ADD COLUMN", "END; END;", "CREATE TABLE t (", "$$ open"):
        list(sql_definitions(text))
    assert list(sql_definitions("CREATE TABLE t (a int")) == [("t", "sql", None, 1, 1), ("a", "sqlcol", "t", 1, 1)]
    assert list(sql_definitions("CREATE TABLE a.b.`c` (d numeric(1, 2), e text);")) == [("a.b.c", "sql", None, 1, 1), ("d", "sqlcol", "a.b.c", 1, 1), ("e", "sqlcol", "a.b.c", 1, 1)]


def test_a_marker_in_a_string_is_none_and_one_in_a_block_is(spark):
    rows = [(1, "java", 's = "todo";\n/*\n\n   FIXME\n*/'), (2, None, None), (3, "java", None)]
    assert [tuple(r) for r in code.debt_markers(spark.createDataFrame(rows, "f long, language string, text string"), "f").collect()] == [(1, 4, "fixme", False)]


def test_spans_end_at_the_margin(spark):
    text = "def test_a():\n  x\n\nvalue\n  assert 1\ndef test_b():\n  y\n}\n  assert 2"
    lines = linescan.explode_lines(spark.createDataFrame([(1, text), (2, None)], "f long, text string"), "f", "text")
    assert [tuple(r) for r in code.tests_without_assertion(lines, "f").collect()] == [(1, 1, "test_a")]


def test_tests_are_read_in_their_texts_without_a_shuffle(spark):
    texts = ["def test_a():\n  x\n\nvalue\n  assert 1\ndef test_b():\n  y\n}\n  assert 2", None, "", "  x\n  def test_c():\n    assert 1\n  def test_d():\n", "it('e')\nit('f')\n\n", "x\n" * 50, "def test_g():\n\né\n  assert 1"]
    files = spark.createDataFrame(list(enumerate(texts)), "f long, text string")
    out = code.unasserted_tests(files, "f")
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    got = sorted(map(tuple, out.collect()))
    assert got == [(0, 1, "test_a"), (3, 4, "test_d"), (4, 1, "e"), (4, 2, "f"), (6, 1, "test_g")]
    assert got == sorted(map(tuple, code.tests_without_assertion(linescan.explode_lines(files, "f", "text"), "f").collect()))

"""Rules over source code that look at more than a line: spans of tests, comments as the language has them, and writes to the console."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import tables
from millrace.functions import text as T
from millrace.operators import linescan

#: Heads of tests, their names, what an assertion is, tickets, entry points, folders of commands, and names of loggers.
TEST_HEAD = r"^\s*(?:async\s+)?def\s+test_\w+|^\s*func\s+Test\w+\(|^\s*(?:it|test)(?:\.only|\.skip)?\s*\(|^\s*@Test\b|^\s*\[(?:Fact|Test)\]"
TEST_NAME = r"(?:def|func)\s+(\w+)|(?:it|test)(?:\.\w+)?\s*\(\s*[\"'`]([^\"'`]*)"
ASSERTION = r"\bassert\w*\b|\bexpect\(|\bAssert\.|\brequire\.|\bt\.(?:Error|Errorf|Fatal|Fatalf|Fail|FailNow)\b|\bshould\b|\.toBe|\.toEqual|pytest\.raises|\.Should\("
TICKET = r"#\d+|\b[A-Z][A-Z0-9]+-\d+\b|https?://\S+/issues/\d+"
ENTRY = r"if __name__ == [\"']__main__[\"']|func main\(\)|static void Main|fn main\(\)|process\.argv"
COMMAND_FOLDERS = ("cli", "cmd", "bin", "scripts", "tools")
LOGGER = r"\b(?:log|logging|structlog|loguru|winston|pino|bunyan|log4js|loglevel|serilog|nlog|log4net|logrus|zap|zerolog|slog|log4j|slf4j|logback|tracing)\b"


def spans_by_dedent(lines: DataFrame, key: str, starts: Column, holds: Column) -> DataFrame:
    """``key, lo, hi, head, holds``: from each line that starts a span to the line before the next start or the next line at the
    margin, and whether a line in it holds (FUN33).

    A closing brace at the margin belongs to the span. Lines at the margin begin segments of their own, so one running sum numbers
    all segments and an aggregate tells which begin with a start; a text's lines are in one task, in order.
    """
    margin = F.coalesce(F.col("line").rlike(r"^[^\s}]"), F.lit(False))
    running = Window.partitionBy(key).orderBy("lineno").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.select(key, "lineno", "line", F.coalesce(starts, F.lit(False)).alias("start"), F.coalesce(holds, F.lit(False)).alias("hold"))
    marked = marked.withColumn("segment", F.sum((F.col("start") | margin).cast("int")).over(running))
    first = F.min(F.struct("lineno", "line", "start")).alias("first")
    spans = marked.where("segment > 0").groupBy(key, "segment").agg(first, F.max("lineno").alias("hi"), F.bool_or("hold").alias("holds"))
    return spans.where("first.start").select(key, F.col("first.lineno").alias("lo"), "hi", F.col("first.line").alias("head"), "holds")


def spans_in_texts(files: DataFrame, key: str, text: str, starts: Callable[[Column], Column], holds: Callable[[Column], Column]) -> DataFrame:
    """``spans_by_dedent`` of whole texts, read where they are: lines are neither shuffled nor sorted, and a task holds those of one text."""
    mark = lambda x, i: F.struct((i + 1).alias("n"), F.coalesce(starts(x), F.lit(False)).alias("start"), x.rlike(r"^[^\s}]").alias("margin"), F.coalesce(holds(x), F.lit(False)).alias("hold"), x.alias("line"))

    def spans(marks: Column, begins: Column) -> Column:
        def span(b: Column, j: Column) -> Column:
            hi = F.coalesce(F.get(begins, j + 1)["n"] - 1, F.size(marks))
            return F.struct(b["start"].alias("start"), b["n"].alias("lo"), hi.alias("hi"), b["line"].alias("head"), F.exists(F.slice(marks, b["n"], hi - b["n"] + 1), lambda m: m["hold"]).alias("holds"))

        return F.filter(F.transform(begins, span), lambda s: s["start"])

    # arrays of one element bind what is used more than once
    marked = F.transform(F.array(F.transform(T.lines(F.coalesce(F.col(text), F.lit(""))), mark)), lambda ms: F.struct(ms.alias("marks"), F.filter(ms, lambda m: m["start"] | m["margin"]).alias("begins")))
    found = F.flatten(F.transform(marked, lambda x: spans(x["marks"], x["begins"])))
    return files.select(key, F.explode(found).alias("s")).select(key, "s.lo", "s.hi", "s.head", "s.holds")


def tests_without_assertion(lines: DataFrame, key: str) -> DataFrame:
    """``key, line, test`` of tests in whose span nothing asserts, named as they are called, else by their first line (assert-free)."""
    return _without(spans_by_dedent(lines, key, F.col("line").rlike(TEST_HEAD), F.col("line").rlike(ASSERTION)), key)


def unasserted_tests(files: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``tests_without_assertion`` of whole texts, without a shuffle."""
    return _without(spans_in_texts(files, key, text, lambda x: x.rlike(TEST_HEAD), lambda x: x.rlike(ASSERTION)), key)


def _without(spans: DataFrame, key: str) -> DataFrame:
    free = spans.where("not holds")
    named = lambda g: F.nullif(F.regexp_extract("head", TEST_NAME, g), F.lit(""))
    return free.select(key, F.col("lo").alias("line"), F.coalesce(named(1), named(2), F.left(F.trim("head"), F.lit(60))).alias("test"))


def debt_markers(files: DataFrame, key: str) -> DataFrame:
    """``key, line, marker, ticket`` of marks of debt in the comments of ``files(key, language, text)``: satd-marker, FUN27.

    A mark is sought in what a comment says only, so one in a string or in code is none and one inside a block comment is.
    """
    comments = tables.apply(files, "comment_spans", ["language", "text"], [key])
    # the first that stands, as longer ones may begin with a shorter one
    marker = F.regexp_replace(F.lower(F.regexp_extract("text", r"(?i)\b(?:" + linescan.SATD.replace(" ", r"\s+") + r")\b", 0)), r"\s+", " ")
    return comments.select(key, "line", marker.alias("marker"), F.col("text").rlike(TICKET).alias("ticket")).where("marker <> ''")


def stdout_writes(files: DataFrame, key: str) -> DataFrame:
    """``key, line, count`` of the first write to the console in each of ``files(key, repository, path, text)`` (stdout-write).

    Only where a source of the repository imports a logger, and not in folders of commands or files with an entry point. Files are joined with
    the few repositories that have a logger; lines are read where they are.
    """
    rule = next(r for r in linescan.RULES if r.name == "stdout-write")
    lines = linescan.explode_lines(files, key, "text", "repository")
    seen = lines.where(F.col("line").rlike(r"^\s*(?:import|from|using|use|require|const|let|var|#include)\b") & F.col("line").rlike(LOGGER)).select("repository").distinct()
    folders = F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0)))
    plain = files.where(~F.arrays_overlap(folders, F.array(*map(F.lit, COMMAND_FOLDERS))) & ~F.col("text").rlike(ENTRY)).join(seen, "repository", "left_semi")
    hits = linescan.explode_lines(plain, key, "text").where(F.col("line").rlike(rule.pattern))
    return hits.groupBy(key).agg(F.min("lineno").alias("line"), F.count("*").alias("count"))

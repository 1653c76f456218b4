"""Scans over the lines of texts: explode, metrics, rule tables and segments."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T


def explode_lines(docs: DataFrame, key: str, text: str, *more: str) -> DataFrame:
    """``key, lineno, line`` with 1-based line numbers (SRC04); a narrow step, no shuffle."""
    return docs.select(key, *more, F.posexplode(T.lines(F.coalesce(F.col(text), F.lit(""))))).select(key, *more, (F.col("pos") + 1).alias("lineno"), F.col("col").alias("line"))


@dataclass(frozen=True)
class Rule:
    """A line rule: what must match and what must not, and where it applies (empty: everywhere).

    ``needles`` are lower-case strings of which every line that matches has one: the cheap test that
    comes first, and one of ``marks``, if it has any. Where the pattern has a group, the first match's must match ``holds`` and not
    ``lacks``. ``words``: one of these must stand in the line as a word, camel case and underscores cut.
    """

    name: str
    family: str
    pattern: str
    needles: tuple[str, ...]
    scope: tuple[str, ...] = ()
    exclude: str | None = None
    holds: str | None = None
    lacks: str | None = None
    words: tuple[str, ...] = ()
    marks: tuple[str, ...] = ()


def scan_rules(lines: DataFrame, rules: list[Rule], line: str = "line", scope: str | None = None) -> DataFrame:
    """A row for each line and rule that matches: the columns of ``lines`` with rule and family (§2.13, EXT01).

    Lines without any rule's needle go before an expression is tried on them; on the others
    each rule's expression runs only where one of its needles stands.
    """
    c, low = F.col(line), F.col("_low")
    some = lambda xs: reduce(lambda x, y: x | y, [F.contains(low, F.lit(n)) for n in xs])
    has = lambda r: some(r.marks) & some(r.needles) if r.marks else some(r.needles)

    def hit(r: Rule):
        ok = has(r)
        if r.scope and scope:
            ok = ok & F.col(scope).isin(*r.scope)
        ok = ok & c.rlike(r.pattern)
        if r.exclude:
            ok = ok & ~c.rlike(r.exclude)
        if r.holds:
            ok = ok & F.regexp_extract(c, r.pattern, 1).rlike(r.holds)
        if r.lacks:
            ok = ok & ~F.regexp_extract(c, r.pattern, 1).rlike(r.lacks)
        if r.words:
            ok = ok & F.arrays_overlap(F.split(F.lower(F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1 $2")), "[^a-z0-9]+"), F.array(*map(F.lit, r.words)))
        return F.when(ok, F.struct(F.lit(r.name).alias("rule"), F.lit(r.family).alias("family")))

    plain = sorted({n for r in rules if not r.marks for n in r.needles})
    open_ = lines.withColumn("_low", F.lower(c)).where(reduce(lambda x, y: x | y, [has(r) for r in rules if r.marks], some(plain) if plain else F.lit(False)))
    return open_.select(*lines.columns, F.explode(F.array_compact(F.array(*map(hit, rules)))).alias("_h")).select(*lines.columns, "_h.rule", "_h.family")


def commented_code(lines: DataFrame, key: str, marker: str = r"^\s*(?:#|//)\s?", least: int = 3) -> DataFrame:
    """``key, lo, hi, code_like, total`` of runs of comment lines that are mostly code, with balanced brackets (commented-out-code)."""
    body = F.trim(F.regexp_replace("line", marker, ""))
    c = lines.where(F.col("line").rlike(marker)).select(key, "lineno", body.alias("body"))
    c = c.withColumn("run", F.col("lineno") - F.row_number().over(Window.partitionBy(key).orderBy("lineno")))
    count = lambda x: F.length("body") - F.length(F.translate("body", x, ""))
    uneven = [(F.sum(count(x)) - F.sum(count(y))).alias(f"_{i}") for i, (x, y) in enumerate(("()", "[]", "{}"))]
    g = c.groupBy(key, "run").agg(F.min("lineno").alias("lo"), F.max("lineno").alias("hi"), F.count_if(F.col("body").rlike(CODE_LINE)).alias("code_like"), F.count("*").alias("total"), *uneven)
    return g.where((F.col("total") >= least) & (2 * F.col("code_like") > F.col("total")) & (F.col("_0") == 0) & (F.col("_1") == 0) & (F.col("_2") == 0)).select(key, "lo", "hi", "code_like", "total")


def line_metrics(lines: DataFrame, key: str, deep: int = 4) -> DataFrame:
    """Lines of code, sum and maximum of indents, deep lines, longest line (AGG21)."""
    ind = F.when(F.trim("line") != "", T.indent_units(F.col("line")))
    return lines.groupBy(key).agg(
        F.count("*").alias("n_lines"),
        F.count_if(F.trim("line") != "").alias("loc"),
        F.coalesce(F.sum(ind), F.lit(0)).cast("long").alias("indent_sum"),
        F.coalesce(F.max(ind), F.lit(0)).cast("long").alias("indent_max"),
        F.count_if(ind >= deep).alias("n_deep"),
        F.max(F.length("line")).cast("long").alias("longest"),
    )


def segments(lines: DataFrame, key: str, starts: F.Column, holds: F.Column) -> DataFrame:
    """Segments from one start line to the next and whether any line in them holds (FUN33, WIN22)."""
    w = Window.partitionBy(key).orderBy("lineno").rowsBetween(Window.unboundedPreceding, 0)
    s = lines.withColumn("segment", F.sum(starts.cast("int")).over(w)).where("segment > 0")
    return s.groupBy(key, "segment").agg(F.min("lineno").cast("long").alias("lo"), F.max("lineno").cast("long").alias("hi"), F.bool_or(holds).alias("holds"))


#: Scopes.
SOURCE, TESTS, SOURCE_TESTS, SOURCE_CI_CONFIG = ("source",), ("tests",), ("source", "tests"), ("source", "ci", "config")
ALL_TEXT = ("source", "tests", "docs", "ci", "config", "build", "manifest", "container", "iac", "sql", "runtime_version", "governance")
#: Markers of debt that comments own up to.
SATD = (
    "todo|fixme|xxx|hack|hacky|kludge|kluge|workaround|work around|temporary|temp fix|quick fix|quick and dirty|band-aid|bandaid|stopgap|"
    "stop-gap|not implemented|unimplemented|needs work|needs refactor|refactor this|refactor me|clean up later|cleanup later|remove this|remove me|"
    "get rid of|rewrite this|should be rewritten|should be refactored|should be fixed|must be fixed|to be fixed|fix later|fix me later|revisit|for now|someday|"
    "eventually|ugly|nasty|broken|known bug|known issue|known problem|this is wrong|this is bad|this isn't right|doesn't work|does not work|"
    "won't work|not sure why|no idea why|not tested|untested|unsafe|dangerous|deprecated|obsolete|legacy|smell"
)
#: What a line of code starts or ends with.
CODE_LINE = (
    "^(?:if|for|while|return|def|function|class|var|let|const|int|string|public|private|static|fn|func|import|using|switch|case|"
    r"try|catch|elif|else|foreach)\b|^[A-Za-z_][\w.]*\s*(?:=[^=]|\()|[;{]$"
)
DEFINITION = r"^\s*(?:export\s+)?(?:async\s+)?(?:def|function|func|class|fn|struct|interface|type|public|private|protected|internal|static|const|let|var)\b"

#: Ids, families, patterns and scopes of the line rules. ``\\w`` is ASCII here.
RULES = [
    Rule("satd-marker", "half-finished", r"(?i)(?:#|//|/\*|^\s*\*|<!--|--).*\b(?:" + SATD.replace(" ", r"\s+") + r")\b", tuple(max(x.split(" "), key=len) for x in SATD.split("|")), ALL_TEXT, marks=("#", "//", "*", "<!--", "--")),
    Rule("stub", "half-finished", r"(?i)NotImplementedError|NotImplementedException|\bnot implemented\b|unimplemented!|panic\(\"not implemented|throw new Error\(\"not implemented|\bTODO\(\)", ("notimplemented", "not implemented", "unimplemented!", "todo()"), SOURCE_TESTS),
    Rule("skip-marker", "half-finished", r"\bxfail\b|expectedFailure|@pytest\.mark\.skip|@Ignore\b|@Disabled\b|\bit\.skip\(|\btest\.skip\(|\[Ignore\]|\bt\.Skip\(", ("xfail", "expectedfailure", "@pytest.mark.skip", "@ignore", "@disabled", ".skip(", "[ignore]"), SOURCE_TESTS),
    Rule("assertions-disabled", "error-masking", r"\bNDEBUG\b|\bpython[\d.]*\s+-OO?\b|(?<![\w-])-da\b|enableassertions\s*=\s*false|\bassert(?:ions)?[\"']?\s*:\s*false|^\s*(?:#|//)\s*assert\b", ("ndebug", "python", "-da", "assert"), SOURCE_CI_CONFIG),
    Rule("legacy-name", "dead-code", DEFINITION, ("old", "bak", "v1", "legacy"), SOURCE, words=("old", "bak", "v1", "legacy")),
    Rule("deprecation", "dead-code", r"@deprecated\b|\[Obsolete\]|@Deprecated\b|DeprecationWarning|#\[deprecated\]|^\s*(?://|#|\*|///)\s*Deprecated:|@available\(\*,\s*deprecated", ("deprecat", "[obsolete]"), SOURCE),
    Rule("flag-sdk", "dead-code", r"\b(?:bool)?[vV]ariation\(|\bisEnabled\(|\bIsEnabled\(|\bis_active\(|\bgetFeatureFlag\(|\bgetBooleanValue\(|\bFEATURE_[A-Z0-9_]+\b", ("variation(", "isenabled(", "is_active(", "getfeatureflag(", "getbooleanvalue(", "feature_"), SOURCE),
    Rule("credential", "security", r"(?i)\b\w*(?:password|passwd|secret|token|api_key|apikey|access_key)\w*[\"']?\s*(?:=|:=|:)\s*[\"']([^\"'\n]{8,})[\"']", ("password", "passwd", "secret", "token", "api_key", "apikey", "access_key"), SOURCE_CI_CONFIG, lacks=r"(?i)^[$<%]|^\{\{|fake|dummy|example|placeholder|changeme|your_|xxx"),
    Rule("string-sql", "security", r"\b(?:execute|query|Query|ExecuteSqlRaw|Raw|createStatement|executeQuery|Exec)\s*\(([^\n]*)", ("execute", "query", "raw", "createstatement", "exec"), SOURCE, holds=r"\+\s*\w|\w\s*\+|\bf[\"']|\$\{|String\.format|\$\"|[\"']\s*%\s*[\w(]|\.format\("),
    Rule("dynamic-eval", "security", r"\beval\(|\bexec\(|shell\s*=\s*True|shell:\s*true|child_process\.exec\(|Runtime\.exec\(|Process\.Start\(|exec\.Command\(|\bsystem\(", ("eval(", "exec(", "shell", "process.start(", "exec.command(", "system("), SOURCE_CI_CONFIG),
    Rule("tls-disabled", "security", r"verify\s*=\s*False|rejectUnauthorized:\s*false|InsecureSkipVerify:\s*true|ServerCertificateValidationCallback|VERIFY_NONE|(?<!\w)--insecure\b", ("verify", "rejectunauthorized", "servercertificatevalidationcallback", "--insecure"), SOURCE_CI_CONFIG),
    Rule("weak-hash", "security", r"\bmd5\(|\bsha1\(|MD5\.Create|getInstance\(\"MD5\"\)|createHash\(['\"]md5['\"]\)|Digest::MD5|\bmd5\.(?:Sum|New)\(|\bsha1\.(?:Sum|New)\(", ("md5", "sha1"), SOURCE),
    Rule("permissive-cors", "security", r"Access-Control-Allow-Origin[\"']?\s*[:,]\s*[\"']?\*", ("access-control-allow-origin",), SOURCE_CI_CONFIG),
    Rule("security-suppression", "security", r"\bnosec\b|eslint-disable[^\n]*security|nolint:gosec|pragma\s+warning\s+disable[^\n]*\bCA\d+", ("nosec", "eslint-disable", "nolint:gosec", "pragma"), SOURCE_CI_CONFIG),
    Rule("sleep", "test-quality", r"\bsleep\(|Thread\.Sleep|setTimeout\(|time\.Sleep\(", ("sleep", "settimeout("), TESTS),
    Rule("retry-marker", "test-quality", r"@retry\b|\bflaky\b|\breruns\b|\bretries\s*[=:(]|jest\.retryTimes|\[Retry\]|@Repeat\b", ("retr", "flaky", "reruns", "@repeat"), TESTS),
    Rule("wall-clock", "test-quality", r"\bnow\(\)|Date\.now\(|DateTime\.(?:Now|UtcNow)|time\.Now\(|Time\.now|new Date\(\)", ("now", "new date()"), TESTS),
    Rule("unseeded-random", "test-quality", r"\brandom\.\w+\(|Math\.random\(|\brand\.\w+\(|new Random\(\)", ("random", "rand."), TESTS, exclude="(?i)seed"),
    Rule("try-in-test", "test-quality", r"^\s*try\s*[:{]?\s*$|\bcatch\s*\(", ("try", "catch"), TESTS),
    Rule("conditional-in-test", "test-quality", r"^\s*(?:if|elif|else if|switch)\b", ("if", "switch"), TESTS),
    Rule("numeric-assert", "test-quality", r"\b(?:assert\w*|expect|Assert\.\w+|require\.\w+|should)\b[^\n]*?(?<![\w.])(?:\d{2,}|\d+\.\d+)\b", ("assert", "expect", "require.", "should"), TESTS),
    Rule("stdout-write", "pipeline-infra", r"\bprint\(|console\.log\(|System\.out\.println\(|fmt\.Print(?:ln|f)?\(|^\s*puts\s|^\s*echo\s|Console\.WriteLine\(|\bprintf\(", ("print", "console.", "puts", "echo"), SOURCE),
    Rule("inline-disable", "lint", r"\bnoqa\b|eslint-disable|pragma\s+warning\s+disable|SuppressWarnings|\bnolint\b|rubocop:disable|#\[allow\(|\bnosec\b", ("noqa", "eslint-disable", "pragma", "suppresswarnings", "nolint", "rubocop:disable", "#[allow(", "nosec"), SOURCE),
]
#: Our own, of the prose that the test tables hold.
PROSE = [
    Rule("licence-line", "provenance", r"(?i)released under the [A-Z0-9.-]+ licen[sc]e|all rights reserved|copyright", ("released under the ", "all rights reserved", "copyright")),
    Rule("shouting", "style", r"^[^a-z]*[A-Z]{3,}[^a-z]*!![^a-z]*$", ("!!",)),
    Rule("bar-table", "style", r"^([^|\n]+\|){5,}", ("|",)),
]

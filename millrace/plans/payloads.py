"""Nested payloads: built from whole tables as the tools would write them, then normalised."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import normalise
from millrace.plans.registry import query
from millrace.sources.tables import table

_CODES = ("E722", "C901", "F401", "PERF401", "X999")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int").alias("q"))


def by_order(rows: DataFrame, record: F.Column) -> DataFrame:
    """One JSON array for each order."""
    return rows.groupBy("l_orderkey").agg(F.to_json(F.collect_list(record)).alias("payload"))


@query("""
WITH c AS (SELECT *, list_extract(['E722', 'C901', 'F401', 'PERF401', 'X999'], CAST(l_partkey % 5 + 1 AS INTEGER)) AS code FROM lineitem)
SELECT code, CASE code WHEN 'E722' THEN 'error-masking' WHEN 'C901' THEN 'complex-units' WHEN 'F401' THEN 'dead-code' ELSE 'performance' END AS family, 'src/p' || l_partkey || '.py' AS file,
 l_linenumber AS line_start, CASE WHEN l_suppkey % 2 = 0 THEN l_linenumber + 3 ELSE l_linenumber END AS line_end, CAST(count(*) AS BIGINT) AS n FROM c WHERE code <> 'X999' AND l_suppkey % 7 <> 0 GROUP BY ALL""")
def normalise_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linter records per order: known codes, relative paths, end lines that may lack (NRM01, SRC15)."""
    l = lines(spark, sf_dir)
    code = F.element_at(F.array(*[F.lit(c) for c in _CODES]), (F.col("l_partkey") % 5 + 1).cast("int"))
    name = F.concat(F.when(F.col("l_suppkey") % 7 == 0, "../").otherwise("C:\\repo\\"), F.lit("src\\p"), F.col("l_partkey").cast("string"), F.lit(".py"))
    row = lambda c: F.struct(c.alias("row"))
    end = F.when(F.col("l_suppkey") % 2 == 0, row(F.col("l_linenumber") + 3))
    p = by_order(l, F.struct(code.alias("code"), name.alias("filename"), F.lit("m").alias("message"), row(F.col("l_linenumber")).alias("location"), end.alias("end_location")))
    s = normalise.checked(normalise.ruff(p, "c:/repo"))
    return s.groupBy(F.col("extra")["code"].alias("code"), "family", "file", "line_start", "line_end").agg(F.count("*").alias("n"))


@query("""
WITH a AS (SELECT l_partkey, l_suppkey, l_linenumber, l_orderkey FROM lineitem)
SELECT CASE WHEN l_suppkey % 3 = 0 THEN 'dependency-debt' ELSE 'dead-code' END AS family, CASE WHEN l_suppkey % 3 = 0 THEN 'dependencies' WHEN l_suppkey % 3 = 1 THEN 'files' ELSE 'exports' END AS issue,
 CAST(CASE WHEN l_suppkey % 3 <> 1 THEN l_linenumber END AS INTEGER) AS line_start, CAST(count(*) AS BIGINT) AS n FROM a GROUP BY ALL""")
def normalise_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays by category unpivoted into rows (NRM06)."""
    entry = F.struct(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("name"), F.col("l_linenumber").alias("line"))
    own = lambda k: F.collect_list(F.when(F.col("l_suppkey") % 3 == k, entry))
    g = lines(spark, sf_dir).groupBy("l_orderkey").agg(own(0).alias("dependencies"), own(1).alias("files"), own(2).alias("exports"))
    issue = F.struct(F.concat(F.lit("f"), F.col("l_orderkey").cast("string"), F.lit(".ts")).alias("file"), "dependencies", "files", "exports")
    s = normalise.knip(g.select(F.to_json(F.struct(F.array(issue).alias("issues"))).alias("payload")))
    return s.groupBy("family", F.col("extra")["issue"].alias("issue"), "line_start").agg(F.count("*").alias("n"))


@query("""
WITH v AS (SELECT l_orderkey, l_partkey, l_suppkey % 5 AS k, l_quantity / 5 AS score FROM lineitem)
SELECT 'o' || l_orderkey || '.lock' AS file, CAST(CASE WHEN k = 0 THEN 5 WHEN k = 1 THEN 3 WHEN k IN (2, 3) THEN CASE WHEN score >= 9 THEN 5 WHEN score >= 7 THEN 4 WHEN score >= 4 THEN 3 WHEN score > 0 THEN 2 ELSE 1 END END AS INTEGER) AS severity, CAST(count(*) AS BIGINT) AS n FROM v GROUP BY ALL""")
def normalise_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three nested levels and the severity cascade: label, score, group (NRM07)."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_partkey", "l_suppkey", F.col("l_linenumber").alias("n"), (F.col("l_quantity") / 5).cast("string").alias("score")).alias("x"))
    key = lambda x: F.concat_ws("-", F.lit("V"), F.col("l_orderkey").cast("string"), *[x[c].cast("string") for c in ("n", "l_partkey", "l_suppkey", "score")])
    k = lambda x: x["l_suppkey"] % 5
    label = lambda x: F.struct(F.when(k(x) == 0, "critical").when(k(x) == 1, "Moderate").alias("severity"))
    scores = lambda x: F.when(k(x) == 2, F.array(F.struct(F.lit("CVSS:3.1/AV:N").alias("score")), F.struct(x["score"].alias("score"))))
    vuln = lambda x: F.struct(key(x).alias("id"), F.lit("s").alias("summary"), label(x).alias("database_specific"), scores(x).alias("severity"))
    group = lambda x: F.struct(F.array(key(x)).alias("ids"), F.when(k(x) == 3, x["score"]).alias("max_severity"))
    # lines meet by order as a few numbers, and become advisories there
    g = l.groupBy("l_orderkey").agg(F.collect_list("x").alias("x")).select("l_orderkey", F.transform("x", vuln).alias("vulnerabilities"), F.transform("x", group).alias("groups"))
    package = F.struct(F.struct(F.lit("p").alias("name"), F.lit("1").alias("version"), F.lit("npm").alias("ecosystem")).alias("package"), "vulnerabilities", "groups")
    source = F.struct(F.concat(F.lit("./o"), F.col("l_orderkey").cast("string"), F.lit(".lock")).alias("path"), F.lit("lockfile").alias("type"))
    p = g.select(F.to_json(F.struct(F.array(F.struct(source.alias("source"), F.array(package).alias("packages"))).alias("results"))).alias("payload"))
    return normalise.osv_scanner(p, wanted=("severity",)).groupBy("file", F.col("extra")["severity"].cast("int").alias("severity")).agg(F.count("*").alias("n"))


@query("""
SELECT 'v' || l_suppkey || '.py' AS file, l_linenumber AS line_start, CASE WHEN l_partkey % 2 = 0 THEN 'p' || l_partkey END AS symbol, CAST(count(*) AS BIGINT) AS n FROM lineitem WHERE l_partkey % 9 <> 0 GROUP BY ALL""")
def normalise_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of text in a two-level grammar; lines that do not parse are dropped (NRM02)."""
    s = lambda c: F.col(c).cast("string")
    message = F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit("unused function 'p"), s("l_partkey"), F.lit("'"))).otherwise(F.lit("unreachable code after 'return'"))
    tail = F.when(F.col("l_partkey") % 9 == 0, F.lit("")).otherwise(F.lit(" (60% confidence)"))
    p = lines(spark, sf_dir).select(F.concat(F.lit("v"), s("l_suppkey"), F.lit(".py:"), s("l_linenumber"), F.lit(": "), message, tail).alias("payload"))
    out = normalise.vulture(p)
    return out.groupBy("file", "line_start", F.col("extra")["symbol"].alias("symbol")).agg(F.count("*").alias("n"))


@query("""
SELECT CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE 'd/' || l_partkey END AS file, CAST(CASE l_suppkey % 5 WHEN 0 THEN 4 WHEN 1 THEN 3 WHEN 2 THEN 2 ELSE 1 END AS INTEGER) AS severity, CAST(count(*) AS BIGINT) AS n
FROM lineitem WHERE l_suppkey % 4 = 0 OR l_partkey % 3 <> 0 GROUP BY ALL""")
def normalise_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels as severities, unknown the lowest; vendored paths off, rows without a file stay (NRM09, NRM12)."""
    k = F.col("l_suppkey") % 5
    level = F.when(k == 0, "Error").when(k == 1, "warning").when(k == 2, "info").when(k == 3, "odd")
    name = F.concat(F.when(F.col("l_partkey") % 3 == 0, "vendor/").otherwise("d/"), F.col("l_partkey").cast("string"))
    p = by_order(lines(spark, sf_dir), F.struct(name.alias("file"), F.col("l_linenumber").alias("line"), level.alias("level"), F.lit("DL1").alias("code"), F.col("l_suppkey").cast("string").alias("message")))
    s = normalise.hadolint(p)
    s = s.withColumn("file", F.when(F.regexp_extract("message", "([0-9]+)$", 1).cast("int") % 4 != 0, F.col("file")))
    return normalise.without_vendored(s).groupBy("file", F.col("extra")["severity"].cast("int").alias("severity")).agg(F.count("*").alias("n"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(len(json_keys(props)) AS BIGINT) AS n_keys FROM events""")
def json_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON text with a declared schema (SRC12, SRC15)."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.from_json("props", "k long")["k"].alias("k"), F.size(F.json_object_keys("props")).cast("long").alias("n_keys"))


@query("""
WITH u AS (UNPIVOT (SELECT l_returnflag, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem) ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME metric VALUE v)
SELECT l_returnflag, metric, CAST(count(*) AS BIGINT) AS n, round(max(v), 4) AS top FROM u GROUP BY 1, 2""")
def unpivot_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide metrics as long rows (NRM06): one expand below a combined aggregate."""
    l = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    long = l.unpivot(["l_returnflag"], ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "metric", "v")
    return long.groupBy("l_returnflag", "metric").agg(F.count("*").alias("n"), F.round(F.max("v"), 4).alias("top"))


@query("""
SELECT o_orderkey, printf('%s order %d for %s', CASE o_orderstatus WHEN 'F' THEN 'Finish' WHEN 'O' THEN 'Open' ELSE 'Plan' END, o_orderkey, o_orderpriority) AS message FROM orders""")
def rendered_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages by kind of row (SRC27, SRC28)."""
    verb = F.when(F.col("o_orderstatus") == "F", "Finish").when(F.col("o_orderstatus") == "O", "Open").otherwise("Plan")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.format_string("%s order %d for %s", verb, "o_orderkey", "o_orderpriority").alias("message"))


@query("""
WITH m AS (SELECT conv_id, turn, role, CASE WHEN turn > 2 AND role = 'assistant' THEN 'failed' WHEN length(text) < 40 THEN 'skipped' ELSE 'passed' END AS result FROM conversations)
SELECT conv_id, CAST(count(*) FILTER (WHERE result = 'passed') AS BIGINT) AS passed, CAST(count(*) FILTER (WHERE result = 'failed') AS BIGINT) AS failed, CAST(count(*) FILTER (WHERE result = 'skipped') AS BIGINT) AS skipped, min(turn) FILTER (WHERE result = 'failed') AS first_failed FROM m GROUP BY 1""")
def test_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested report of steps: counts by result, the first failed step decides (SRC16, AGG20)."""
    result = F.when((F.col("turn") > 2) & (F.col("role") == "assistant"), "failed").when(F.length("text") < 40, "skipped").otherwise("passed")
    steps = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.to_json(F.sort_array(F.collect_list(F.struct("turn", result.alias("result"))))).alias("report"))
    r = steps.select("conv_id", F.explode(F.from_json("report", "array<struct<turn long, result string>>")).alias("s")).select("conv_id", "s.*")
    n = lambda k: F.count_if(F.col("result") == k).alias(k)
    return r.groupBy("conv_id").agg(n("passed"), n("failed"), n("skipped"), F.min(F.when(F.col("result") == "failed", F.col("turn"))).alias("first_failed"))

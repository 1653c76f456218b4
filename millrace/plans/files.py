"""Queries of the file sources, text grammars and tool records: texts that tables stand in for are written, then read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import tables, text
from millrace.operators import classify, findings, joins, normalise, settings
from millrace.plans.payloads import by_order, lines
from millrace.plans.registry import query
from millrace.session import scratch
from millrace.sources import files
from millrace.sources.tables import table


def s(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def cat(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.to_date("o_orderdate").alias("day"))


def texts(rows: DataFrame, key: str, order: str, line: Column, sep: str = "\n") -> DataFrame:
    """``key, t``: a text of the key's lines in order."""
    g = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, line.alias("_l")))).alias("ls"))
    return g.select(key, F.array_join(F.transform("ls", lambda x: x["_l"]), sep).alias("t"))


@query("""
SELECT 's' || o_orderkey AS sha, 'A' || o_custkey % 9 AS author, CASE WHEN o_orderkey % 10 <> 0 THEN CAST(o_orderdate AS DATE) END AS day, 'fix' || chr(9) || o_orderkey AS subject,
 CASE WHEN o_orderkey % 3 = 0 THEN ['p' || o_custkey % 7, 'q'] ELSE ['p' || o_custkey % 7] END AS files FROM orders""")
def log_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits read from log text, a customer's orders each (SRC05)."""
    k = F.col("o_orderkey")
    day = F.when(k % 10 == 0, "bad").otherwise(F.date_format("day", "yyyy-MM-dd'T'00:00:00+00:00"))
    head = F.concat_ws("\t", cat("s", s(k)), cat("A", s(F.col("o_custkey") % 9)), F.lit("a@x"), day, F.lit("fix"), s(k))
    record = cat("\x1e", head, "\np", s(F.col("o_custkey") % 7), F.when(k % 3 == 0, "\nq").otherwise(""))
    log = texts(orders(spark, sf_dir), "o_custkey", "o_orderkey", record)
    return files.commits(log.select(F.col("t").alias("value"))).select("sha", "author", F.to_date("ts").alias("day"), "subject", "files")


@query("""
SELECT 'b' || s_suppkey AS name, CASE WHEN s_suppkey % 4 <> 0 THEN DATE '2024-01-01' + CAST(s_suppkey % 300 AS INTEGER) END AS day, s_suppkey % 5 = 0 AS merged FROM supplier WHERE s_suppkey % 6 <> 0""")
def ref_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branches from a listing, symbolic ones off, and which are merged (SRC06)."""
    k = F.col("s_suppkey")
    t = table(spark, sf_dir, "supplier").select("s_suppkey", cat("b", s(k)).alias("name"))
    day = F.when(k % 4 == 0, "").otherwise(s(F.date_add(F.lit("2024-01-01").cast("date"), (k % 300).cast("int"))))
    listing = t.select(F.concat_ws("\t", "name", day, F.when(k % 6 == 0, "refs/heads/b1").otherwise("")).alias("value"))
    return files.refs(listing, t.where("s_suppkey % 5 = 0")).select("name", F.to_date("ts").alias("day"), "merged")


@query("""
SELECT 'f' || o_custkey AS file, CAST(o_orderkey % 1000 + 1 AS INTEGER) AS line, sha1(CAST(o_orderkey AS VARCHAR)) AS sha, 'A ' || o_orderkey % 9 AS author, CAST(o_orderkey * 10 AS BIGINT) AS epoch FROM orders""")
def blame_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who wrote each line, from porcelain text (SRC07)."""
    k = F.col("o_orderkey")
    parts = F.array(cat(F.sha1(s(k).cast("binary")), " 1 ", s(k % 1000 + 1), " 1"), cat("author A ", s(k % 9)), cat("author-time ", s(k * 10)), F.lit("summary author x"), F.lit("\tcode"))
    o = orders(spark, sf_dir).select(cat("f", s("o_custkey")).alias("file"), "o_orderkey", F.posexplode(parts).alias("i", "value"))
    return files.blame(o.select("file", (k * 5 + F.col("i")).alias("n"), "value"))


@query("""
WITH o AS (SELECT o_custkey AS id, o_orderkey AS k, o_orderkey % 500 + 1 AS pos, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE o_orderkey % 4 END AS n FROM orders)
SELECT id, 'f' || k AS file, CAST(pos AS INTEGER) AS old_start, CAST(pos + n - 1 AS INTEGER) AS old_end, CAST(pos + 2 AS INTEGER) AS new_start, CAST(pos + 3 AS INTEGER) AS new_end, '-x' || k || chr(10) || '+y' AS text FROM o""")
def diff_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hunks with their spans and text from unified diffs (SRC08)."""
    k = F.col("o_orderkey")
    old = F.when(k % 3 == 0, "").otherwise(cat(",", s(k % 4)))
    parts = F.array(F.lit("diff --git a/f b/f"), F.lit("--- a/f"), cat("+++ b/f", s(k)), cat("@@ -", s(k % 500 + 1), old, " +", s(k % 500 + 3), ",2 @@ def f"), cat("-x", s(k)), F.lit("+y"))
    o = orders(spark, sf_dir).select(F.col("o_custkey").alias("id"), "o_orderkey", F.posexplode(parts).alias("i", "value"))
    return files.hunks(o.select("id", (k * 6 + F.col("i")).alias("n"), "value"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS sha, 'c' || o_custkey AS value FROM orders WHERE o_orderkey % 3 = 0")
def commit_trailers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trailers of commit messages (SRC10)."""
    k = F.col("o_orderkey")
    m = cat("Title Base-Commit: no\n\n", F.when(k % 3 == 0, cat("Base-Commit: c", s("o_custkey"), "  \n")).otherwise("none\n"))
    return files.trailers(orders(spark, sf_dir).select(s(k).alias("sha"), m.alias("message")), "Base-Commit")


@query("SELECT 'd/' || s_suppkey AS path, CASE s_suppkey % 3 WHEN 0 THEN 'module' WHEN 1 THEN 'link' ELSE 'file' END AS kind FROM supplier")
def index_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, links and modules of an index listing (SRC17)."""
    k = F.col("s_suppkey")
    mode = F.when(k % 3 == 0, "160000").when(k % 3 == 1, "120000").otherwise("100644")
    return files.index_listing(table(spark, sf_dir, "supplier").select(cat(mode, " x 0\td/", s(k)).alias("value")))


@query("SELECT o_orderkey AS path, o_custkey AS content FROM orders WHERE o_orderstatus = 'F'")
def snapshot_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One snapshot of a table of snapshots (SRC09)."""
    tree = orders(spark, sf_dir).select(F.col("o_orderkey").alias("path"), F.col("o_custkey").alias("content"), F.col("o_orderstatus").alias("snapshot"))
    return files.at_snapshot(tree, "F")


@query("""
WITH s AS (SELECT 'k' || p_size AS key, p_brand AS value, CASE p_partkey % 3 WHEN 0 THEN 'env' WHEN 1 THEN 'file' ELSE 'default' END AS source, p_partkey % 3 AS r FROM part), b AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY r, source, value) AS rn FROM s)
SELECT key, value, source FROM b WHERE rn = 1""")
def settings_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A setting's value from the first source that has it (SRC21)."""
    k = F.col("p_partkey") % 3
    p = table(spark, sf_dir, "part").select(cat("k", s("p_size")).alias("key"), F.col("p_brand").alias("value"), F.when(k == 0, "env").when(k == 1, "file").otherwise("default").alias("source"))
    return files.flattened(p, {"env": 0, "file": 1, "default": 2})


@query("""
WITH o AS (SELECT o_custkey, o_orderkey, o_orderkey % 5 AS k FROM orders)
SELECT 'c' || o_custkey AS path, 'b' || max(o_orderkey) FILTER (WHERE k = 0) AS base, coalesce(list_sort(list(DISTINCT CAST(8000 + o_orderkey % 7 AS VARCHAR)) FILTER (WHERE k = 1)), []) AS ports, 'u' || max(o_orderkey) FILTER (WHERE k = 2) AS user, '/w' || max(o_orderkey) FILTER (WHERE k = 3) AS workdir FROM o GROUP BY o_custkey""")
def dockerfile_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last base, ports, user and folder of each Dockerfile (SRC22)."""
    o = F.col("o_orderkey")
    line = F.when(o % 5 == 0, cat("FROM b", s(o), " AS x")).when(o % 5 == 1, cat("expose ", s(8000 + o % 7))).when(o % 5 == 2, cat("  USER u", s(o))).when(o % 5 == 3, cat("WORKDIR /w", s(o))).otherwise("RUN x")
    return files.dockerfile(orders(spark, sf_dir).select(cat("c", s("o_custkey")).alias("path"), o.alias("lineno"), line.alias("line")))


@query("""
SELECT DISTINCT path, target FROM (SELECT 'm' || s_nationkey AS path, unnest(CASE s_suppkey % 4 WHEN 0 THEN ['all', 't' || s_suppkey] WHEN 1 THEN ['x' || s_suppkey] ELSE [] END) AS target FROM supplier)
UNION ALL SELECT 'p' || s_suppkey, 'build' FROM supplier""")
def build_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets of makefiles and scripts of manifests (SRC29)."""
    k = F.col("s_suppkey")
    t = table(spark, sf_dir, "supplier")
    line = F.when(k % 4 == 0, cat("all t", s(k), ": dep")).when(k % 4 == 1, cat("x", s(k), ":")).when(k % 4 == 2, "V := 1").otherwise(".PHONY %.o: x")
    made = files.make_targets(t.select(cat("m", s("s_nationkey")).alias("path"), k.alias("lineno"), line.alias("line")))
    scripts = files.script_names(t.select(cat("p", s(k)).alias("path"), cat('{"scripts":{"build":"', s(k), '"}}').alias("text")))
    return made.select("path", "target").unionByName(scripts.select("path", "target"))


@query("""
WITH o AS (SELECT o_custkey, o_orderkey, o_orderkey // 4 % 4 AS k FROM orders), p AS (SELECT *, max(CASE WHEN k = 0 THEN o_orderkey END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pre FROM o)
SELECT 'c' || o_custkey AS path, o_orderkey AS lineno, CASE k WHEN 1 THEN 'GET' WHEN 2 THEN 'POST' ELSE 'DELETE' END AS method, coalesce('/api' || pre, '') || CASE k WHEN 1 THEN '/x' || o_orderkey WHEN 2 THEN CASE WHEN pre IS NULL THEN '/' ELSE '' END ELSE '/y' END AS route FROM p WHERE k <> 0""")
def code_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes of code with the prefix of the class above them (SRC23)."""
    o = F.col("o_orderkey")
    k = F.floor(o / 4) % 4
    line = F.when(k == 0, cat('@RequestMapping("/api', s(o), '/")')).when(k == 1, cat('@GetMapping("x', s(o), '")')).when(k == 2, "@PostMapping").otherwise("router.delete('/y', f)")
    return files.routes(orders(spark, sf_dir).select(cat("c", s("o_custkey")).alias("path"), o.alias("lineno"), line.alias("line")))


@query("""
WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders) SELECT o_custkey, string_agg('l' || o_orderkey, chr(10) ORDER BY o_orderkey) AS tail FROM o WHERE rn <= 3 GROUP BY 1""")
def log_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three lines of each log (SRC35)."""
    return files.tail(orders(spark, sf_dir).select("o_custkey", F.col("o_orderkey").alias("lineno"), cat("l", s("o_orderkey")).alias("line")), "o_custkey", 3)


@query("SELECT doc_id AS path, contains(left(text, 65536), 'the') AS the, contains(left(text, 65536), 'token') AS token FROM documents")
def head_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which marks stand in the first part of each text (SRC31)."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text")
    return files.heads(d, {"the": "the", "token": "token"}, 65_536)


@query("""
SELECT 'f' || p_partkey || CASE p_partkey % 3 WHEN 0 THEN '.ipynb' ELSE '.bin' END AS path, CASE p_partkey % 3 WHEN 0 THEN 'notebook' ELSE 'large' END AS class, CASE WHEN p_partkey % 3 = 1 THEN p_partkey % 2 = 0 END AS pointer, CAST(CASE WHEN p_partkey % 3 = 0 THEN p_size % 3 END AS INTEGER) AS n_cells FROM part WHERE p_partkey % 3 <> 2""")
def artefact_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notebooks with their cells and pointers to large files (SRC30)."""
    k = F.col("p_partkey")
    path = cat("f", s(k), F.when(k % 3 == 0, ".ipynb").when(k % 3 == 1, ".bin").otherwise(".py"))
    cells = F.to_json(F.struct(F.array_repeat(F.struct(F.lit("code").alias("cell_type")), (F.col("p_size") % 3).cast("int")).alias("cells")))
    body = F.when(k % 3 == 0, cells).when(k % 2 == 0, "version https://git-lfs.github.com/spec/v1").otherwise("x")
    p = table(spark, sf_dir, "part").select(path.alias("path"), body.alias("text"))
    return files.artefacts(p, [("notebook", r"\.ipynb$"), ("large", r"\.bin$")])


@query("""
WITH e AS (SELECT 'DB_' || p_size AS name, p_brand AS value, 'manifest' AS source, 0 AS r FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT 'DB_' || p_size, p_type, 'image', 1 FROM part WHERE p_partkey % 3 = 1 UNION ALL SELECT 'DB_' || p_size, p_name, 'config', 2 FROM part WHERE p_partkey % 3 = 2),
b AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY r, value) AS rn FROM e) SELECT name, value, source FROM b WHERE rn = 1""")
def environment_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A service's settings by environment name, the first of manifest, image and configuration (SRC36, EXT08)."""
    p = table(spark, sf_dir, "part")
    part = lambda k, sep, c: p.where(F.col("p_partkey") % 3 == k).select(cat(f"db{sep}", s("p_size")).alias("name"), F.col(c).alias("value"))
    return files.environment(part(0, ".", "p_brand"), part(1, "-", "p_type"), part(2, "_", "p_name"))


@query("""
SELECT 'src/l' || l_suppkey || '.py' AS file, CAST(l_linenumber AS INTEGER) AS line_start, CAST(l_linenumber + 9 AS INTEGER) AS line_end, 'f has cyclomatic complexity ' || l_partkey % 20 || ' over ' || l_suppkey % 90 || ' lines' AS message, CAST(count(*) AS BIGINT) AS n
FROM lineitem WHERE (l_partkey % 20 >= 10 OR l_suppkey % 90 >= 60) AND l_partkey % 7 <> 0 GROUP BY ALL""")
def normalise_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard or long units from rows without a header; rows that are no numbers go (NRM03)."""
    p, q = F.col("l_partkey"), F.col("l_suppkey")
    c = [s(q % 90), F.when(p % 7 == 0, "x").otherwise(s(p % 20)), F.lit("5"), F.lit("2"), F.lit("3"), F.lit("loc"), cat("./src/l", s(q), ".py"), F.lit("f"), F.lit("f()"), s("l_linenumber"), s(F.col("l_linenumber") + 9)]
    out = normalise.lizard(lines(spark, sf_dir).select(*[x.alias(f"c{i}") for i, x in enumerate(c)]))
    return out.groupBy("file", "line_start", "line_end", "message").agg(F.count("*").alias("n"))


@query("""
WITH o AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN 'm' || o_orderkey || '.ts' END AS m FROM orders), g AS (SELECT o_custkey, list(m ORDER BY o_orderkey) FILTER (WHERE m IS NOT NULL) AS kept FROM o GROUP BY 1)
SELECT kept[1] AS file, 'import cycle through ' || len(kept) || ' modules: ' || array_to_string(kept, ' -> ') AS message FROM g WHERE len(kept) > 0""")
def normalise_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Import cycles, a customer's orders each, without members outside the tree (NRM04)."""
    k = F.col("o_orderkey")
    g = orders(spark, sf_dir).groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", cat(F.when(k % 4 == 0, "../m").otherwise("./m"), s(k), ".ts").alias("m")))).alias("ms"))
    p = g.select(F.to_json(F.array(F.transform("ms", lambda x: x["m"]))).alias("payload"))
    return normalise.madge(p).select("file", "message")


@query("""
SELECT 'a' || l_partkey AS file, CAST(l_linenumber AS INTEGER) AS line_start, CAST(l_linenumber + 5 AS INTEGER) AS line_end, l_suppkey || ' duplicated lines shared with b' || l_suppkey AS message, CAST(count(*) AS BIGINT) AS n FROM lineitem WHERE l_suppkey % 6 <> 0 GROUP BY ALL""")
def normalise_clones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clone pairs, without their text, whose other side is in the tree (NRM05)."""
    side = lambda name, at: F.struct(name.alias("name"), at.alias("start"), (at + 5).alias("end"))
    other = cat(F.when(F.col("l_suppkey") % 6 == 0, "/abs/b").otherwise("b"), s("l_suppkey"))
    pair = F.struct(side(cat("a", s("l_partkey")), F.col("l_linenumber")).alias("firstFile"), side(other, F.col("l_linenumber")).alias("secondFile"), F.col("l_suppkey").alias("lines"), F.lit(50).alias("tokens"), F.lit("py").alias("format"), F.lit("SECRET").alias("fragment"))
    p = lines(spark, sf_dir).groupBy("l_orderkey").agg(F.to_json(F.struct(F.collect_list(pair).alias("duplicates"))).alias("payload"))
    return normalise.jscpd(p).groupBy("file", "line_start", "line_end", "message").agg(F.count("*").alias("n"))


@query("""
SELECT 'gitleaks' AS tool, 'g' || l_partkey AS file, CAST(l_linenumber AS INTEGER) AS line_start, CAST(CASE WHEN l_suppkey % 2 = 0 THEN l_linenumber + 1 ELSE l_linenumber END AS INTEGER) AS line_end, 'r' || l_suppkey % 9 || ': possible committed secret' AS message, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY ALL
UNION ALL SELECT 'actionlint', 'w' || l_partkey, CAST(l_linenumber AS INTEGER), CAST(l_linenumber AS INTEGER), 'm' || l_suppkey % 9, CAST(count(*) AS BIGINT) FROM lineitem WHERE l_suppkey % 5 <> 0 GROUP BY ALL""")
def normalise_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets without their value and workflow diagnostics without a snippet as one checked table (NRM08, NRM10, NRM11, EXT02)."""
    l = lines(spark, sf_dir)
    leak = F.struct(cat("r", s(F.col("l_suppkey") % 9)).alias("RuleID"), cat("g", s("l_partkey")).alias("File"), F.col("l_linenumber").alias("StartLine"), F.when(F.col("l_suppkey") % 2 == 0, F.col("l_linenumber") + 1).alias("EndLine"), F.lit("hunter2").alias("Secret"))
    flow = F.struct(cat("m", s(F.col("l_suppkey") % 9)).alias("message"), cat("w", s("l_partkey")).alias("filepath"), F.when(F.col("l_suppkey") % 5 != 0, F.col("l_linenumber")).alias("line"), F.lit("SECRET").alias("snippet"))
    every = normalise.union_all([normalise.NORMALISERS["gitleaks"](by_order(l, leak)), normalise.NORMALISERS["actionlint"](by_order(l, flow))])
    return normalise.checked(every).groupBy("tool", "file", "line_start", "line_end", "message").agg(F.count("*").alias("n"))


@query(r"""
SELECT p_partkey, ':' || p_size || CASE WHEN p_partkey % 2 = 0 THEN '-' || (p_size + 3) ELSE '' END || CASE WHEN p_partkey % 3 = 0 THEN '@7' ELSE '' END AS span, lower(string_split(p_name, ' ')[1]) AS stem, list_sort(list_distinct(list_filter(regexp_extract_all(p_name || ' ab a_b1', '[A-Za-z_][A-Za-z0-9_]*'), lambda x: length(x) >= 3))) AS ids,
 greatest(0, CAST(p_size AS INTEGER) - 20) AS lag, CASE p_partkey % 3 WHEN 0 THEN '/a/{}/b_c' WHEN 1 THEN 'dry_run' ELSE '/u/{}' END AS name FROM part""")
def small_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Span suffixes, stems, identifiers, lags and names of routes and options (FUN02, FUN07, FUN13, FUN16)."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("int")
    name = F.when(k % 3 == 0, "/a/{id}/b-c").when(k % 3 == 1, "--dry-run").otherwise("/u/:name")
    day = F.lit("2024-01-21").cast("date")
    return table(spark, sf_dir, "part").select(
        "p_partkey", text.span_suffix(size, F.when(k % 2 == 0, size + 3), F.when(k % 3 == 0, F.lit(7))).alias("span"), text.stem(cat("d/x/", F.split_part("p_name", F.lit(" "), F.lit(1)), ".test.py")).alias("stem"),
        F.array_sort(text.identifiers(cat(F.col("p_name"), " ab a_b1"))).alias("ids"), text.lag_days(F.date_add(F.lit("2024-01-01").cast("date"), size), day).alias("lag"), text.route_name(name).alias("name"),
    )


@query("SELECT p_partkey, CASE WHEN contains(p_type, 'STEEL') THEN 'metal' WHEN contains(p_type, 'BRASS') THEN 'alloy' WHEN contains(p_type, 'TIN') THEN 'soft' ELSE 'other' END AS label FROM part")
def keyword_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first keyword's label, else a default (PRD15)."""
    return table(spark, sf_dir, "part").select("p_partkey", classify.keyword_label(F.col("p_type"), [("STEEL", "metal"), ("BRASS", "alloy"), ("TIN", "soft")], "other").alias("label"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P' AND NOT (o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '5-LOW'))")
def family_disables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose family is on for their class; ``all`` turns a class off (PRD08)."""
    off = spark.createDataFrame([("P", "all"), ("F", "1-URGENT"), ("F", "5-LOW")], "path_class string, family string")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("path_class"), F.col("o_orderpriority").alias("family"))
    return classify.family_enabled(o, off).select("o_orderkey")


@query("""
WITH o AS (SELECT o_custkey, o_orderkey FROM orders), f AS (SELECT o_custkey, o_custkey % 5 = 0 AS alone, o_custkey % 4 = 0 AS tainted FROM o GROUP BY 1)
SELECT o_custkey, 'S' || o_orderkey AS name, alone OR o_orderkey % 3 = 0 AS tagged, NOT (alone OR o_orderkey % 3 = 0) AND (tainted OR o_orderkey % 2 = 0) AS unsafe, o_orderkey % 7 = 0 AS defect FROM o JOIN f USING (o_custkey)""")
def parallel_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenarios that may not run beside others, by their own and their feature's tags and Background (PRD25, SRC19)."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    one = cat(F.when(k % 3 == 0, "@parallel=false\n").otherwise(""), F.when(k % 7 == 0, "@known-defect @x\n").otherwise(""), "Scenario: S", s(k), "\n  * ", F.when(k % 2 == 0, "Stubs.reset()").otherwise("print 1"))
    head = cat(F.when(c % 5 == 0, "@parallel=false @all\n").otherwise("@all\n"), "Feature: F\nBackground:\n  * ", F.when(c % 4 == 0, "Db.truncate('x')").otherwise("url u"), "\n")
    t = texts(orders(spark, sf_dir), "o_custkey", "o_orderkey", one).select("o_custkey", F.concat(head, "t").alias("t"))
    out = classify.effective_scenarios(tables.apply(t, "gherkin_blocks", "t", ["o_custkey"]), "o_custkey")
    return out.select("o_custkey", "name", F.array_contains("tags", F.lit("@parallel=false")).alias("tagged"), "unsafe", "defect")


@query("""
WITH c AS (SELECT o_custkey AS doc, o_orderkey AS pos FROM orders WHERE o_orderkey % 2 = 0), n AS (SELECT o_custkey AS doc, o_orderkey AS name_at, 'n' || o_orderkey AS name FROM orders WHERE o_orderkey % 3 = 0),
j AS (SELECT c.doc, c.pos, name, row_number() OVER (PARTITION BY c.doc, c.pos ORDER BY CASE WHEN name_at > c.pos THEN 1 ELSE 0 END, abs(c.pos - name_at), name) AS rn FROM c LEFT JOIN n ON n.doc = c.doc AND name_at BETWEEN c.pos - 2000 AND c.pos + 2000) SELECT doc, pos AS "at", name FROM j WHERE rn = 1""")
def citation_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name that each citation is about: nearest before it, else after (JON19)."""
    o = orders(spark, sf_dir).select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("at"))
    names = o.where("at % 3 = 0").select("doc", F.col("at").alias("name_at"), cat("n", s("at")).alias("name"))
    return findings.citation_subject(o.where("at % 2 = 0"), names, 2000)


@query("""
WITH l AS (SELECT o_custkey AS f, o_orderkey AS lo FROM orders), m AS (SELECT f, lo AS at FROM l WHERE lo % 5 = 0) SELECT f, lo, EXISTS (SELECT 1 FROM m WHERE m.f = l.f AND m.at BETWEEN l.lo - 300 AND l.lo + 300) AS near FROM l""")
def near_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a marker stands near each cited line (JON26): a band join keyed by buckets of its width."""
    l = orders(spark, sf_dir).select(F.col("o_custkey").alias("f"), F.col("o_orderkey").alias("lo"))
    hit = joins.bucketed_band_join(l, l.where("lo % 5 = 0").select("f", F.col("lo").alias("at")), ["f"], "lo", "at", 300.0).select("f", "lo").distinct().withColumn("near", F.lit(True))
    return l.join(hit, ["f", "lo"], "left").select("f", "lo", F.coalesce("near", F.lit(False)).alias("near"))


@query("""
WITH t AS (SELECT o_custkey AS doc, CAST(count(*) AS INTEGER) AS n FROM orders GROUP BY 1), c AS (SELECT o_custkey AS doc, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS lo, o_orderkey % 3 AS w FROM orders),
x AS (SELECT doc, unnest(range(lo, lo + w + 1)) AS line FROM c WHERE w > 0), g AS (SELECT doc, line, count(*) AS times FROM x GROUP BY 1, 2), e AS (SELECT doc, unnest(range(1, n + 1)) AS line FROM t)
SELECT coalesce(e.doc, g.doc) AS doc, coalesce(e.line, g.line) AS line, CAST(coalesce(times, 0) AS BIGINT) AS times FROM e FULL JOIN g ON e.doc = g.doc AND e.line = g.line WHERE coalesce(times, 0) <> 1""")
def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that claims do not cover exactly once (EXT07)."""
    o = orders(spark, sf_dir)
    lo = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    claims = o.select(F.col("o_custkey").alias("doc"), lo.alias("lo"), (F.col("o_orderkey") % 3).cast("int").alias("w")).where("w > 0").select("doc", "lo", (F.col("lo") + F.col("w")).alias("hi"))
    t = o.groupBy(F.col("o_custkey").alias("doc")).agg(F.count("*").cast("int").alias("n_lines"))
    return findings.coverage_problems(claims, t).select("doc", F.col("line").cast("long").alias("line"), "times")


@query("SELECT 'scout-' || lpad(CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS VARCHAR), 3, '0') AS id, 'scout' AS role, o_orderkey FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 40)")
def work_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered work items up to a cap, which is the feature (EXT09)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", (-F.col("o_totalprice")).alias("p"))
    return findings.work_plan(o, "scout", ["p", "o_orderkey"], 40).select("id", "role", "o_orderkey")


@query("""
WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)
SELECT o_custkey, CAST(2 * n - 1 AS INTEGER) AS l0, CAST(2 * n AS INTEGER) AS l1, 'f(' || o_orderkey || ', 1)' AS text FROM o WHERE o_orderkey % 2 = 0
UNION ALL SELECT o_custkey, CAST(2 * n - 1 AS INTEGER), CAST(2 * n - 1 AS INTEGER), 'x = ' || o_orderkey FROM o WHERE o_orderkey % 2 = 1 UNION ALL SELECT o_custkey, CAST(2 * n AS INTEGER), CAST(2 * n AS INTEGER), 'y' FROM o WHERE o_orderkey % 2 = 1""")
def joined_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements over several lines as one (WIN11, FUN39)."""
    k = F.col("o_orderkey")
    t = texts(orders(spark, sf_dir), "o_custkey", "o_orderkey", F.when(k % 2 == 0, cat("f(", s(k), ",\n 1)")).otherwise(cat("x = ", s(k), "\ny")))
    return tables.apply(t, "joined_lines", "t", ["o_custkey"]).toDF("o_custkey", "l0", "l1", "text")


def code(spark: SparkSession, sf_dir: str, line: Column) -> DataFrame:
    """A customer's orders as a file of code, two lines or more each."""
    return texts(orders(spark, sf_dir), "o_custkey", "o_orderkey", line)


@query("""
WITH o AS (SELECT o_custkey, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)
SELECT o_custkey, CAST(4 * n - 3 AS INTEGER) AS line, CASE k // 4 % 7 WHEN 0 THEN 'pass' WHEN 1 THEN 'log' WHEN 2 THEN 'handled' WHEN 3 THEN 'empty' WHEN 4 THEN 'return' WHEN 5 THEN 'handled' ELSE 'return' END AS body, CASE k // 4 % 7 WHEN 0 THEN NULL WHEN 1 THEN 'e' || k WHEN 2 THEN 'e' || k WHEN 3 THEN 'ex' WHEN 4 THEN NULL WHEN 5 THEN 'err' ELSE 'err' END AS name FROM o""")
def code_handlers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What handlers of three languages do with an error (FUN12, FUN28)."""
    k = F.col("o_orderkey")
    r = F.floor(k / 4) % 7
    one = (
        F.when(r == 0, "except ValueError:\n    # why\n    pass\n").when(r == 1, cat("except E as e", s(k), ":\n    logger.info('x')\n\n")).when(r == 2, cat("except E as e", s(k), ":\n    logger.info(e", s(k), ")\n\n"))
        .when(r == 3, "} catch (IOException ex) {\n  // nothing\n}\n").when(r == 4, "} catch {\n  return null;\n}\n").when(r == 5, "if err != nil {\n  return fmt.Errorf(x)\n}\n").otherwise("if err != nil {\n  return nil\n}\n")
    )
    return tables.apply(code(spark, sf_dir, one), "swallowed", "t", ["o_custkey"])


@query("""
WITH o AS (SELECT o_custkey, o_orderkey // 4 % 6 AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)
SELECT o_custkey, CASE k WHEN 0 THEN 'io-in-loop' WHEN 1 THEN 'regex-in-loop' WHEN 2 THEN 'sort-in-loop' ELSE 'membership-in-loop' END AS rule, CAST(4 * n - 1 AS INTEGER) AS line, CAST(4 * n - 3 AS INTEGER) AS loop FROM o WHERE k < 4""")
def code_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costly calls in loops, against the outermost (FUN29)."""
    r = F.floor(F.col("o_orderkey") / 4) % 6
    one = (
        F.when(r == 0, "for x in y:\n  while z:\n    open(f)\n").when(r == 1, "for (;;) {\n  x();\n  new RegExp(s);\n}").when(r == 2, "xs.forEach(x => {\n  y\n  ys.sort();\n})")
        .when(r == 3, "while a:\n  b\n  if c in ['d']: e\n").when(r == 4, "for x in y:\n  # open(f)\n  z\n").otherwise("open(f)\nsorted(x)\n\n")
    )
    return tables.apply(code(spark, sf_dir, one), "loop_smells", "t", ["o_custkey"])


@query("""
WITH o AS (SELECT o_custkey, o_orderkey // 4 % 6 AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)
SELECT o_custkey, CAST(3 * n - 2 AS INTEGER) AS line, CASE k WHEN 0 THEN 'requests/httpx' WHEN 1 THEN 'curl' ELSE 'http.Client' END AS client FROM o WHERE k < 3""")
def code_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that set no limit of time, over several lines (FUN30)."""
    r = F.floor(F.col("o_orderkey") / 4) % 6
    one = F.when(r == 0, "requests.get(u,\n  headers=h)\nx").when(r == 1, "curl -s u\n\n").when(r == 2, "c := &http.Client{\n}\n").when(r == 3, "httpx.post(u,\n  json=j,\n  timeout=3)").when(r == 4, "curl -m 5 u\n# fetch(u)\n").otherwise("c := &http.Client{\n  Timeout: t,\n}")
    return tables.apply(code(spark, sf_dir, one), "no_timeout", "t", ["o_custkey"])


@query("""
WITH o AS (SELECT o_custkey, o_orderkey AS k, o_orderkey // 4 % 5 AS r, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)
SELECT o_custkey, CASE r WHEN 0 THEN 'C' || k WHEN 1 THEN 'f' || k WHEN 2 THEN 'T.m' || k WHEN 3 THEN 'g' || k ELSE 'S' || k END AS name, CASE WHEN r IN (0, 4) THEN 'class' ELSE 'function' END AS kind, CAST(4 * n - 3 AS INTEGER) AS l0, CAST(4 * n AS INTEGER) AS l1 FROM o
UNION ALL SELECT o_custkey, 'C' || k || '.run', 'function', CAST(4 * n - 2 AS INTEGER), CAST(4 * n - 1 AS INTEGER) FROM o WHERE r = 0""")
def code_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types, functions and methods of code with braces (EXT05)."""
    k = F.col("o_orderkey")
    r = F.floor(k / 4) % 5
    one = (
        F.when(r == 0, cat("public class C", s(k), " {\n  public void run(int a) {\n  }\n}")).when(r == 1, cat("export async function f", s(k), "(a) {\n  if (a) {\n  }\n}")).when(r == 2, cat("func (t *T) m", s(k), "(a int) {\n  for {\n  }\n}"))
        .when(r == 3, cat("const g", s(k), " = (a) => {\n  return new A(b)\n\n}")).otherwise(cat("type S", s(k), " struct {\n  a int\n\n}"))
    )
    return tables.apply(code(spark, sf_dir, one), "declared", "t", ["o_custkey"])


@query("""
WITH o AS (SELECT o_custkey, 'f' || o_orderkey AS field, o_orderkey % 90 + 1 AS k, o_orderkey // 4 % 4 AS r FROM orders),
l AS (SELECT o_custkey, field, 'ge' AS rule, k FROM o WHERE r IN (0, 2) UNION ALL SELECT o_custkey, field, 'le', k + 9 FROM o WHERE r = 2 UNION ALL SELECT o_custkey, field, 'max_length', k FROM o WHERE r IN (1, 3) UNION ALL SELECT o_custkey, field, 'min_length', 1 FROM o WHERE r = 1)
SELECT o_custkey, field, rule, CAST(k AS VARCHAR) AS value, 'accept' AS expected FROM l UNION ALL SELECT o_custkey, field, rule, CAST(CASE WHEN rule IN ('ge', 'min_length') THEN k - 1 ELSE k + 1 END AS VARCHAR), 'reject' FROM l""")
def declared_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values at and beyond the limits that three languages declare (EXT04)."""
    k = F.col("o_orderkey")
    r, n = F.floor(k / 4) % 4, k % 90 + 1
    one = (
        F.when(r == 0, cat("f", s(k), ": int = Field(ge=", s(n), ")")).when(r == 1, cat("@Size(min = 1, max = ", s(n), ")\n@NotNull\nprivate String f", s(k), ";"))
        .when(r == 2, cat("[Range(", s(n), ", ", s(n + 9), ")]\npublic int f", s(k), " { get; set; }")).otherwise(cat("[StringLength(", s(n), ")] public string f", s(k), " = x;"))
    )
    return tables.apply(code(spark, sf_dir, one), "boundaries", "t", ["o_custkey"])


@query("""
WITH o AS (SELECT o_custkey, o_orderkey AS k, o_orderkey // 4 % 4 AS r, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)
SELECT o_custkey, CASE r WHEN 0 THEN 'heading2' WHEN 1 THEN 'code' WHEN 2 THEN 'item' ELSE 'para' END AS kind, CAST(4 * n - 3 AS INTEGER) AS l0, CAST(4 * n - 3 + CASE r WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 0 ELSE 1 END AS INTEGER) AS l1, CASE r WHEN 0 THEN 'H' || k WHEN 1 THEN 'c' || k WHEN 2 THEN 'i' || k ELSE 'p' || k || chr(10) || 'q' END AS text FROM o""")
def markdown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings, code, items and paragraphs with their lines (SRC18, EXT01)."""
    k = F.col("o_orderkey")
    r = F.floor(k / 4) % 4
    one = F.when(r == 0, cat("## H", s(k), " ##\n\n\n")).when(r == 1, cat("```py\nc", s(k), "\n```\n")).when(r == 2, cat("- i", s(k), "\n\n\n")).otherwise(cat("p", s(k), "\n  q\n\n"))
    return tables.apply(code(spark, sf_dir, one), "md_blocks", "t", ["o_custkey"]).select("o_custkey", "kind", "l0", "l1", "text")


@query("""
WITH o AS (SELECT o_custkey, o_orderkey AS k, o_orderkey // 4 % 4 AS r, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)
SELECT o_custkey, CAST(2 * n - 1 AS INTEGER) AS line, CASE r WHEN 0 THEN 'code' WHEN 1 THEN 'link' WHEN 2 THEN 'image' ELSE 'link' END AS kind, CASE r WHEN 0 THEN 'c' || k WHEN 1 THEN 'l' || k WHEN 2 THEN 'i' ELSE 'https://h/' || k END AS text, CASE r WHEN 1 THEN 'd/' || k || '.md#x' WHEN 2 THEN k || '.png' WHEN 3 THEN 'https://h/' || k END AS target FROM o""")
def markdown_inlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code spans, links and images with their targets (SRC18, SRC33)."""
    k = F.col("o_orderkey")
    r = F.floor(k / 4) % 4
    one = F.when(r == 0, cat("a `` c", s(k), " `` b\n")).when(r == 1, cat("[l", s(k), "](d/", s(k), '.md#x "t")\n')).when(r == 2, cat("![i](", s(k), ".png)\n")).otherwise(cat("<https://h/", s(k), ">\n"))
    return tables.apply(code(spark, sf_dir, one), "md_inlines", "t", ["o_custkey"]).select("o_custkey", "line", "kind", "text", "target")


@query("""
SELECT o_custkey, 'k' AS name, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS row, CAST(o_orderkey AS VARCHAR) AS cell FROM orders
UNION ALL SELECT o_custkey, 'v', CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER), 'a|' || o_orderstatus FROM orders""")
def markdown_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of a table by column and row (SRC34)."""
    t = code(spark, sf_dir, cat("| ", s("o_orderkey"), " | a\\|", F.col("o_orderstatus"), " |")).select("o_custkey", cat("text\n\n| k | v |\n|---|:-:|\n", F.col("t"), "\n").alias("t"))
    return tables.apply(t, "md_tables", "t", ["o_custkey"]).select("o_custkey", "name", "row", "cell")


@query("SELECT p_partkey, unnest(['name', 'size']) AS key, unnest([p_name, CAST(p_size AS VARCHAR)]) AS value FROM part WHERE p_partkey % 4 <> 0")
def front_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of front matter; a text that does not begin with it has none (SRC20)."""
    t = cat(F.when(F.col("p_partkey") % 4 == 0, "x\n").otherwise(""), "---\nname: '", F.col("p_name"), "'\nsize:  ", s("p_size"), " \n- no\n---\nafter: 1")
    return tables.apply(table(spark, sf_dir, "part").select("p_partkey", t.alias("t")), "front_matter", "t", ["p_partkey"])


@query("""
SELECT p_partkey, '--size' AS name, CAST(p_size AS VARCHAR) AS "default", ['a', p_brand] AS choices, CASE WHEN p_partkey % 2 = 0 THEN true END AS required FROM part WHERE p_partkey % 5 <> 0 UNION ALL SELECT p_partkey, 'path', NULL, [], NULL FROM part WHERE p_partkey % 5 <> 0""")
def command_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options of command lines with default, choices and need; code that does not parse has none (FUN36, FUN37)."""
    k = F.col("p_partkey")
    t = cat("p.add_argument('-s', '--size', default=", s("p_size"), ", choices=['a', '", F.col("p_brand"), "']", F.when(k % 2 == 0, ", required=True").otherwise(""), ")\np.add_argument('path')\n", F.when(k % 5 == 0, "def (").otherwise(""))
    return tables.apply(table(spark, sf_dir, "part").select("p_partkey", t.alias("t")), "cli_options", "t", ["p_partkey"])


@query("""
WITH p AS (SELECT p_size AS key, p_partkey AS k, p_partkey % 6 AS r FROM part), b AS (SELECT key, min(r) AS r FROM p GROUP BY 1)
SELECT 'a.k' || p.key AS key, 'v' || min(k) AS value, ['f.env', 'f.properties', 'f.json', 'f.toml', 'f.ini', 'f.yml'][CAST(p.r + 1 AS INTEGER)] AS source FROM p JOIN b ON b.key = p.key AND b.r = p.r GROUP BY p.key, p.r""")
def settings_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A setting's value from files of six formats, the first in rank order (SRC21)."""
    k = F.col("p_partkey")
    names = ("f.env", "f.properties", "f.json", "f.toml", "f.ini", "f.yml")
    one = table(spark, sf_dir, "part").groupBy(F.col("p_size").alias("key"), (k % 6).cast("int").alias("r")).agg(F.min("p_partkey").alias("k"))
    key, v = cat("k", s("key")), cat("v", s("k"))
    line = (
        F.when(F.col("r") == 0, cat("export a.", key, "='", v, "'")).when(F.col("r") == 1, cat("a.", key, " : ", v)).when(F.col("r") == 2, cat('"', key, '": "', v, '"'))
        .when(F.col("r") == 3, cat(key, ' = "', v, '"')).when(F.col("r") == 4, cat(key, "=", v)).otherwise(cat("  ", key, ": ", v, "  # why"))
    )
    whole = texts(one.withColumn("_r", F.col("r")), "r", "key", line, "\n")
    t = F.col("t")
    body = F.when(F.col("r") == 2, cat('{"a": {', F.replace(t, F.lit("\n"), F.lit(", ")), "}}")).when(F.col("r").isin(3, 4), cat("[a]\n", t)).when(F.col("r") == 5, cat("a:\n", t)).otherwise(t)
    files_ = whole.select(F.element_at(F.array(*map(F.lit, names)), F.col("r") + 1).alias("path"), body.alias("text"))
    return files.flattened(tables.read_settings(files_), {n: i for i, n in enumerate(names)})


@query("""
SELECT 'p' || p_partkey AS path, 'c' || p_partkey AS name, p_brand AS image, CAST(CASE WHEN p_partkey % 3 <> 0 THEN 8000 + p_size END AS INTEGER) AS port, CASE WHEN p_partkey % 4 = 0 THEN '/health' END AS ready, CASE p_partkey % 5 WHEN 0 THEN [] WHEN 1 THEN ['A', 'cfg'] ELSE ['A'] END AS env FROM part WHERE p_partkey % 7 <> 0""")
def deployment_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Port, readiness and environment of the first container (SRC22)."""
    k = F.col("p_partkey")
    c = F.struct(
        cat("c", s(k)).alias("name"), F.col("p_brand").alias("image"), F.when(k % 3 != 0, F.array(F.struct((8000 + F.col("p_size")).alias("containerPort")))).alias("ports"), F.when(k % 4 == 0, F.struct(F.struct(F.lit("/health").alias("path")).alias("httpGet"))).alias("readinessProbe"),
        F.when(k % 5 != 0, F.array(F.struct(F.lit("A").alias("name")))).alias("env"), F.when(k % 5 == 1, F.array(F.struct(F.struct(F.lit("cfg").alias("name")).alias("configMapRef")))).alias("envFrom"),
    )
    other = F.struct(*[F.lit(None).cast(t).alias(n) for n, t in (("name", "string"), ("image", "string"), ("ports", "array<struct<containerPort:int>>"), ("readinessProbe", "struct<httpGet:struct<path:string>>"), ("env", "array<struct<name:string>>"), ("envFrom", "array<struct<configMapRef:struct<name:string>>>"))])
    pods = F.when(k % 7 == 0, F.slice(F.array(other), 1, 0)).otherwise(F.array(c, other))
    doc = F.to_json(F.struct(F.struct(F.struct(F.struct(pods.alias("containers")).alias("spec")).alias("template")).alias("spec")))
    return files.deployments(table(spark, sf_dir, "part").select(cat("p", s(k)).alias("path"), doc.alias("doc")))


@query("""
WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders), t AS (SELECT o_custkey, string_agg('l' || o_orderkey, chr(10) ORDER BY o_orderkey) AS tail FROM o WHERE rn <= 2 GROUP BY 1)
SELECT c_custkey, coalesce(tail, 'no output') AS tail FROM customer LEFT JOIN t ON o_custkey = c_custkey""")
def log_fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The end of each log, or that there is none (SRC35)."""
    l = orders(spark, sf_dir).select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("lineno"), cat("l", s("o_orderkey")).alias("line"))
    return files.tail(l, "c_custkey", 2, table(spark, sf_dir, "customer"), "no output")


@query("""
SELECT replace('[ ' || string_agg('{~  "key" : ' || r_regionkey || ',~  "name" : "' || r_name || '"~}', ', ' ORDER BY r_name) || ' ]', '~', chr(10)) AS document FROM region""")
def pretty_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as one indented document with sorted keys (SRC11)."""
    return files.document(table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("key")), ["name"])


@query("""
WITH o AS (SELECT o_custkey, o_orderkey AS k, o_orderkey // 4 % 4 AS r, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)
SELECT o_custkey, CAST(2 * n - 1 AS INTEGER) AS line, CASE r WHEN 0 THEN 'a' || k || ' = 1;' WHEN 1 THEN 'f(' || repeat(' ', length(CAST(k AS VARCHAR)) + 2) || ', b)' WHEN 2 THEN 'x' ELSE 'SELECT a' || k END AS code FROM o
UNION ALL SELECT o_custkey, CAST(2 * n AS INTEGER), CASE r WHEN 0 THEN 'b' WHEN 1 THEN 'c' WHEN 2 THEN repeat(' ', length(CAST(k AS VARCHAR)) + 3) || 'y' ELSE 'd' END FROM o""")
def masked_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code with its comments and strings blanked in place (FUN36)."""
    k = F.col("o_orderkey")
    r = F.floor(k / 4) % 4
    one = F.when(r == 0, cat("a", s(k), " = 1; // it's\nb")).when(r == 1, cat('f("', s(k), '", b)\nc')).when(r == 2, cat("x /* '\n ", s(k), "*/y")).otherwise(cat("SELECT a", s(k), " -- \"no\nd"))
    return tables.apply(code(spark, sf_dir, one), "masked_lines", "t", ["o_custkey"]).select("o_custkey", "line", "code")


@query("""
WITH o AS (SELECT o_custkey, o_orderkey AS k, o_orderkey // 4 % 7 AS r, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)
SELECT o_custkey, CAST(2 * n - 1 AS INTEGER) AS line, CASE r WHEN 0 THEN 'cite' WHEN 1 THEN 'version' WHEN 2 THEN 'script' WHEN 3 THEN 'path' WHEN 4 THEN 'name' ELSE 'anchor' END AS kind, CASE r WHEN 0 THEN 'src/a.py:' || k WHEN 1 THEN 'v1.' || k WHEN 2 THEN 'npm run t' || k WHEN 3 THEN 'src/' || k WHEN 4 THEN 'word' || k ELSE '#h' || k END AS text FROM o WHERE r < 6""")
def markdown_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations, versions, scripts, paths and anchors in a text (SRC33)."""
    k = F.col("o_orderkey")
    r = F.floor(k / 4) % 7
    one = F.when(r == 0, cat("see `src/a.py:", s(k), "`")).when(r == 1, cat("`v1.", s(k), "`")).when(r == 2, cat("`npm run t", s(k), "`")).when(r == 3, cat("[x](src/", s(k), ")")).when(r == 4, cat("`word", s(k), "`")).when(r == 5, cat("[y](#h", s(k), ")")).otherwise("<https://h/x>")
    return tables.apply(code(spark, sf_dir, F.concat(one, F.lit("\n"))), "md_tokens", "t", ["o_custkey"]).select("o_custkey", "line", "kind", "text")


@query("""
WITH o AS (SELECT o_custkey, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
a AS (SELECT o_custkey, CASE WHEN k % 3 = 0 THEN 's' || k % 2 ELSE 'title-' || k END AS slug, k FROM o WHERE k // 4 % 5 <> 0)
SELECT o_custkey, slug, list_sort(list('h' || k)) AS files, count(*) > 1 AS repeated FROM a GROUP BY 1, 2""")
def report_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings in fenced blocks of a report, by their own or their heading's slug, and slugs that come twice (SRC20)."""
    k = F.col("o_orderkey")
    block = cat("```", F.when(F.floor(k / 4) % 5 == 0, "text").otherwise("finding"), "\n", F.when(k % 3 == 0, cat("slug: s", s(k % 2), "\n")).otherwise(""), "file: 'h", s(k), "'\nnot a pair\n```\n")
    a = tables.apply(code(spark, sf_dir, cat("# Title: ", s(k), "!\n", block)), "md_anchors", "t", ["o_custkey"])
    return a.where("key = 'file'").groupBy("o_custkey", "slug").agg(F.array_sort(F.collect_list("value")).alias("files"), (F.count("*") > 1).alias("repeated"))


@query("""SELECT source AS folder, CAST(sum(length(text) - length(replace(text, chr(10), '')) + 1) AS BIGINT) AS n_lines FROM documents GROUP BY 1""")
def scanned_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as text files in a folder for each source, found and read again by a tree scan (SRC01, SRC32)."""
    at = scratch(spark, "tree")
    table(spark, sf_dir, "documents").select("source", "text").write.partitionBy("source").option("maxRecordsPerFile", 256).text(at)
    t = files.scan_tree(spark, at, "*.txt").select(F.regexp_extract("path", "^source=([^/]*)/", 1).alias("folder"), F.decode("content", "UTF-8").alias("text"))
    return t.groupBy("folder").agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))).alias("n_lines"))


@query("""
WITH d(key, type, fallback) AS (VALUES ('coupling.bulk', 'int', '50'), ('coupling.support', 'int', '3'), ('coupling.ratio', 'float', '0.3'), ('ranking.top', 'int', '25'), ('ranking.spread', 'float', '0.5'), ('hotspots.fraction', 'float', '0.1'), ('hotspots.least', 'int', '5'), ('hotspots.most', 'int', '50')),
r AS (SELECT o_custkey AS scope, o_orderpriority AS layer, CASE o_orderkey // 4 % 7 WHEN 0 THEN 'coupling.bulk' WHEN 1 THEN 'coupling.ratio' WHEN 2 THEN 'ranking.top' WHEN 3 THEN 'hotspots.fraction' WHEN 4 THEN 'hotspots.most' WHEN 5 THEN 'odd.key' ELSE 'ranking' END AS key,
 CASE o_orderkey // 28 % 4 WHEN 0 THEN CAST(o_orderkey % 90 AS VARCHAR) WHEN 1 THEN '0.' || (o_orderkey % 9) WHEN 2 THEN 'x' ELSE '-7' END AS value FROM orders),
t AS (SELECT scope, key, arg_max(value, struct_pack(l := layer, v := value)) AS value FROM r GROUP BY 1, 2),
j AS (SELECT t.*, type, fallback, (type = 'int' AND try_cast(value AS BIGINT) IS NOT NULL AND NOT contains(value, '.')) OR (type = 'float' AND try_cast(value AS DOUBLE) IS NOT NULL) AS fits FROM t LEFT JOIN d USING (key))
SELECT scope, key, CASE WHEN fits THEN value ELSE fallback END AS value, CASE WHEN type IS NULL THEN 'unknown key ' || key WHEN NOT fits THEN key || ' should be ' || type END AS warning FROM j
UNION ALL SELECT s.scope, d.key, fallback, NULL FROM (SELECT DISTINCT scope FROM r) s CROSS JOIN d WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.scope = s.scope AND t.key = d.key)""")
def merged_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of each customer's orders in layers over typed defaults, and what is wrong with them (SET08, PRD24)."""
    key = F.expr("CASE o_orderkey div 4 % 7 WHEN 0 THEN 'coupling.bulk' WHEN 1 THEN 'coupling.ratio' WHEN 2 THEN 'ranking.top' WHEN 3 THEN 'hotspots.fraction' WHEN 4 THEN 'hotspots.most' WHEN 5 THEN 'odd.key' ELSE 'ranking' END")
    value = F.expr("CASE o_orderkey div 28 % 4 WHEN 0 THEN string(o_orderkey % 90) WHEN 1 THEN '0.' || (o_orderkey % 9) WHEN 2 THEN 'x' ELSE '-7' END")
    return settings.layered(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("scope"), F.col("o_orderpriority").alias("layer"), key.alias("key"), value.alias("value")))

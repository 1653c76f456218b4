"""Snapshot, state and graph queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import classify, graph, joins, state
from millrace.plans.coupling import flows
from millrace.plans.registry import query
from millrace.sources.tables import table

_CUT = "1998-01-01"


@query(f"""
WITH b AS (SELECT o_orderkey, round(o_totalprice, 2) AS p FROM orders WHERE o_orderdate < TIMESTAMP '{_CUT}'),
a AS (SELECT o_orderkey, round(CASE WHEN o_orderkey % 10 = 0 THEN o_totalprice + 1 ELSE o_totalprice END, 2) AS p FROM orders WHERE o_orderkey % 7 <> 0)
SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'NEW' WHEN a.o_orderkey IS NULL THEN 'RESOLVED' WHEN a.p IS NOT DISTINCT FROM b.p THEN 'UNCHANGED' ELSE 'CHANGED' END AS status, b.p AS old, a.p AS "new"
FROM b FULL JOIN a ON a.o_orderkey = b.o_orderkey""")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders before a date against a changed later state (JON11, SET07)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    b = o.where(F.col("o_orderdate") < F.lit(_CUT).cast("timestamp_ntz")).select("o_orderkey", F.round("o_totalprice", 2).alias("p"))
    a = o.where("o_orderkey % 7 <> 0").select("o_orderkey", F.round(F.when(F.col("o_orderkey") % 10 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")), 2).alias("p"))
    return state.snapshot_diff(b, a, "o_orderkey", "p")


@query("""
WITH s AS (SELECT c_custkey, DATE '2024-01-01' AS first_seen, DATE '2024-02-01' AS last_seen, CASE WHEN c_custkey % 5 = 0 THEN 'accepted' ELSE 'open' END AS status FROM customer WHERE c_custkey % 3 <> 0),
n AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O')
SELECT coalesce(c_custkey, k) AS c_custkey, coalesce(first_seen, DATE '2024-03-01') AS first_seen, CASE WHEN k IS NOT NULL THEN DATE '2024-03-01' ELSE last_seen END AS last_seen,
 CASE WHEN k IS NOT NULL THEN coalesce(status, 'open') WHEN status = 'open' THEN 'resolved' ELSE status END AS status FROM s FULL JOIN n ON k = c_custkey""")
def state_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyed state table after another run (STM01, SRC25)."""
    c = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0")
    day = lambda s: F.lit(s).cast("date")
    s = c.select("c_custkey", day("2024-01-01").alias("first_seen"), day("2024-02-01").alias("last_seen"), F.when(F.col("c_custkey") % 5 == 0, "accepted").otherwise("open").alias("status"))
    seen = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey"))
    return state.upsert(s, seen, "c_custkey", day("2024-03-01"))


@query("""
WITH s AS (SELECT doc_id AS k, substr(sha256(CASE WHEN doc_id % 4 = 0 THEN 'old' ELSE text END), 1, 8) AS d, 1 + doc_id % 2 AS stage, 3 + doc_id % 5 AS run FROM documents WHERE doc_id % 6 <> 0),
j AS (SELECT doc_id, substr(sha256(text), 1, 8) AS digest, CASE WHEN k IS NOT NULL AND d = substr(sha256(text), 1, 8) AND run < 6 THEN least(stage + 1, 3) ELSE 1 END AS stage FROM documents LEFT JOIN s ON k = doc_id)
SELECT doc_id, digest, CAST(stage AS BIGINT) AS stage, CAST(6 AS INTEGER) AS run, stage = 3 AS remove FROM j""")
def staged_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content that stays the same moves through three stages (STM02, STM06, STM07)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    digest = lambda c: F.substring(F.sha2(c, 256), 1, 8)
    old = d.where("doc_id % 6 <> 0").select("doc_id", digest(F.when(F.col("doc_id") % 4 == 0, F.lit("old")).otherwise(F.col("text"))).alias("digest"), (1 + F.col("doc_id") % 2).alias("stage"), (3 + F.col("doc_id") % 5).alias("run"))
    return state.staged(old, d.select("doc_id", digest(F.col("text")).alias("digest")), "doc_id", "digest", 6)


@query("""SELECT source, CAST(max(doc_id) AS BIGINT) AS doc_id FROM documents GROUP BY 1""")
def high_water_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The furthest mark of each source (STM03)."""
    return state.high_water(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id")


@query("""SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1""")
def next_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's first order that is not finished (STM04)."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderstatus") == "F").alias("done"))
    return state.next_pending(o, "o_custkey", "o_orderkey", "done")


@query("""
WITH a AS (SELECT s_suppkey, s_name AS name, ['a', 's' || s_nationkey] AS tags FROM supplier WHERE s_suppkey % 3 <> 0), b AS (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN upper(s_name) END AS name, ['b', 's' || s_nationkey] AS tags FROM supplier WHERE s_suppkey % 4 <> 0)
SELECT coalesce(a.s_suppkey, b.s_suppkey) AS s_suppkey, coalesce(b.name, a.name) AS name, list_sort(list_distinct(list_concat(coalesce(a.tags, []), coalesce(b.tags, [])))) AS tags FROM a FULL JOIN b ON a.s_suppkey = b.s_suppkey""")
def field_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of rows merged by field (SET06, JON30)."""
    s = table(spark, sf_dir, "supplier")
    tags = lambda x: F.array(F.lit(x), F.concat(F.lit("s"), F.col("s_nationkey").cast("string"))).alias("tags")
    a = s.where("s_suppkey % 3 <> 0").select("s_suppkey", F.col("s_name").alias("name"), tags("a"))
    b = s.where("s_suppkey % 4 <> 0").select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.upper("s_name")).alias("name"), tags("b"))
    return state.merged_fields(a, b, "s_suppkey", ["name"], ["tags"])


@query("""
SELECT doc_id, source FROM documents d WHERE doc_id % 3 <> 0 AND source IN (SELECT source FROM documents WHERE doc_id % 3 = 0) AND NOT EXISTS (SELECT 1 FROM documents p WHERE p.doc_id % 3 = 0 AND p.text = d.text) AND NOT regexp_matches(source, '^src(0|1)$')""")
def new_since_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows new against an earlier snapshot, in its sources, with an allow-list (SET03)."""
    d = table(spark, sf_dir, "documents")
    before, now = d.where("doc_id % 3 = 0"), d.where("doc_id % 3 <> 0")
    new = now.join(before.select("text"), "text", "left_anti").join(before.select("source").distinct(), "source", "left_semi")
    return new.where(~F.col("source").rlike("^src(0|1)$")).select("doc_id", "source")


@query("""
WITH u AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'soon' WHEN o_orderkey % 5 = 1 THEN NULL ELSE strftime(o_orderdate + INTERVAL 90 DAY, '%Y-%m-%d') END AS until FROM orders)
SELECT o_orderkey, coalesce(try_cast(until AS DATE) >= DATE '1998-06-01', true) AS suppressed, coalesce(try_cast(until AS DATE) < DATE '1998-06-01', true) AS expired FROM u""")
def suppression_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inclusive expiry under both policies for dates that cannot be read (PRD09)."""
    k = F.col("o_orderkey")
    until = F.when(k % 5 == 0, "soon").when(k % 5 != 1, F.date_format(F.date_add(F.to_date("o_orderdate"), 90), "yyyy-MM-dd"))
    today = F.lit("1998-06-01").cast("date")
    o = table(spark, sf_dir, "orders").select("o_orderkey", until.alias("until"))
    return o.select("o_orderkey", classify.suppressed_if_unclear(F.col("until"), today).alias("suppressed"), classify.expired_if_unclear(F.col("until"), today).alias("expired"))


@query("""
SELECT 'order without customer' AS rule, CAST(o_orderkey AS VARCHAR) AS key FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
UNION ALL SELECT 'line without part', CAST(l_orderkey * 100 + l_linenumber AS VARCHAR) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 49)
UNION ALL SELECT 'line not unique', CAST(l_orderkey * 100 + l_linenumber AS VARCHAR) FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def contract_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Referential and uniqueness rules as one problems table (PRD19, JON25, AGG17)."""
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    c = table(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey")
    p = table(spark, sf_dir, "part").where("p_size < 49").select("p_partkey")
    key = (F.col("l_orderkey") * 100 + F.col("l_linenumber")).cast("string")
    one = o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select(F.lit("order without customer").alias("rule"), F.col("o_orderkey").cast("string").alias("key"))
    two = l.join(p, F.col("l_partkey") == F.col("p_partkey"), "left_anti").select(F.lit("line without part").alias("rule"), key.alias("key"))
    three = l.groupBy("l_orderkey", "l_linenumber").count().where("count > 1").select(F.lit("line not unique").alias("rule"), key.alias("key"))
    return one.unionByName(two).unionByName(three)


@query("""
SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 350000) AND c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0)""")
def ignore_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that neither they nor their ancestors rule out (PRD03, JON14)."""
    big = table(spark, sf_dir, "orders").where("o_totalprice > 350000").select("o_custkey")
    off = table(spark, sf_dir, "nation").where("n_regionkey = 0").select("n_nationkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return c.join(big, F.col("o_custkey") == F.col("c_custkey"), "left_anti").join(off, F.col("n_nationkey") == F.col("c_nationkey"), "left_anti").select("c_custkey")


_TOP = "SELECT src, arg_max(dst, w * 1000 - dst) AS dst FROM (SELECT c_nationkey AS src, s_nationkey AS dst, count(*) AS w FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2) WHERE src <> dst GROUP BY 1"


def largest_partner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge from each nation to the other one that it has most lines with; ties: the smaller."""
    best = flows(spark, sf_dir).where("src <> dst").groupBy("src").agg(F.max_by("dst", F.struct("w", (-F.col("dst")).alias("k"))).alias("dst"))
    return best.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))


@query(f"""
WITH RECURSIVE e AS ({_TOP}), r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON e.src = r.dst) SELECT CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst FROM r""")
def reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which nations reach which from largest partner to largest partner, over all lines (GRF04)."""
    return graph.reachability(largest_partner(spark, sf_dir))


@query(f"""
WITH RECURSIVE e AS ({_TOP}), r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON e.src = r.dst),
m AS (SELECT a.src, a.dst FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst), c AS (SELECT src, least(src, min(dst)) AS component, count(*) + 1 AS n FROM m GROUP BY src)
SELECT CAST(component AS BIGINT) AS component, list_sort(list(CAST(src AS BIGINT))) AS members FROM c WHERE n BETWEEN 2 AND 30 GROUP BY 1""")
def scc_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Circles of largest partners, as strongly connected components within a size (GRF01)."""
    return graph.strongly_connected(largest_partner(spark, sf_dir), 2, 30)


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT p_partkey AS src, p_partkey - p_partkey % 7 AS dst FROM part UNION SELECT p_partkey, p_partkey + 100 FROM part WHERE p_partkey % 50 = 0 AND p_partkey + 100 <= (SELECT max(p_partkey) FROM part)),
s AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), r AS (SELECT src AS node, src AS seen FROM s UNION SELECT r.node, s.dst FROM r JOIN s ON s.src = r.seen)
SELECT node, min(seen) AS component FROM r GROUP BY 1""")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected components over part links (GRF02)."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("src"))
    top = p.agg(F.max("src").alias("_top"))
    up = p.where("src % 50 = 0").join(F.broadcast(top)).where("src + 100 <= _top").select("src", (F.col("src") + 100).alias("dst"))  # one row
    return graph.connected(p.select("src", (F.col("src") - F.col("src") % 7).alias("dst")).union(up))


@query("""
WITH t AS (SELECT doc_id % 7 AS grp, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 'p' || doc_id % 11 END AS path, doc_id % 100 AS lo, doc_id % 100 + n_chars % 9 AS hi, doc_id FROM documents),
g AS (SELECT item_id % 7 AS grp, CASE WHEN item_id % 3 = 0 THEN NULL ELSE 'p' || item_id % 11 END AS path, CASE WHEN item_id % 4 = 0 THEN NULL ELSE item_id END AS lo, item_id + 5 AS hi, item_id FROM benchmark)
SELECT doc_id, item_id FROM t JOIN g ON t.grp = g.grp AND t.path IS NOT DISTINCT FROM g.path AND (g.lo IS NULL OR (t.lo <= g.hi AND g.lo <= t.hi))""")
def interval_overlap_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth matching with null-safe paths and intervals (JON13, JON16)."""
    i, b = F.col("doc_id"), F.col("item_id")
    path = lambda k, n: F.when(k % n != 0, F.concat(F.lit("p"), (k % 11).cast("string"))).alias("path")
    t = table(spark, sf_dir, "documents").select((i % 7).alias("grp"), path(i, 5), (i % 100).alias("lo"), (i % 100 + F.col("n_chars") % 9).alias("hi"), "doc_id")
    g = table(spark, sf_dir, "benchmark").select((b % 7).alias("grp"), path(b, 3), F.when(b % 4 != 0, b).alias("lo"), (b + 5).alias("hi"), "item_id")
    return joins.theta_match(t, g).select("i.doc_id", "t.item_id")

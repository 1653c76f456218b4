"""Co-occurrence, history and hotspot queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators import aggregates, joins
from millrace.plans.registry import query
from millrace.sources.tables import table


@query("""
WITH one AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem),
ok AS (SELECT l_orderkey FROM one GROUP BY 1 HAVING count(*) <= 6),
s AS (SELECT one.* FROM one JOIN ok USING (l_orderkey)),
n AS (SELECT l_suppkey, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.l_suppkey AS a, y.l_suppkey AS b, count(*) AS shared FROM s x JOIN s y ON x.l_orderkey = y.l_orderkey AND x.l_suppkey < y.l_suppkey GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT a, b, CAST(shared AS BIGINT) AS shared, round(2.0::DOUBLE * shared / (na.n + nb.n), 6) AS ratio
FROM p JOIN n na ON na.l_suppkey = a JOIN n nb ON nb.l_suppkey = b WHERE 2.0::DOUBLE * shared / (na.n + nb.n) >= 0.0""")
def co_occurrence_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers that share orders, bulk orders left out (JON02, AGG01)."""
    pairs = joins.co_occurrence(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey", most=6, support=3)
    return pairs.withColumn("ratio", F.round("ratio", 6))


@query("""
WITH one AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem),
ok AS (SELECT l_orderkey FROM one GROUP BY 1 HAVING count(*) <= 6),
s AS (SELECT one.* FROM one JOIN ok USING (l_orderkey)),
p AS (SELECT x.l_suppkey AS a, y.l_suppkey AS b FROM s x JOIN s y ON x.l_orderkey = y.l_orderkey AND x.l_suppkey < y.l_suppkey GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT item, CAST(count(*) AS BIGINT) AS degree FROM (SELECT a AS item FROM p UNION ALL SELECT b FROM p) GROUP BY 1""")
def co_occurrence_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partners of each supplier (JON02, then a second-level count)."""
    pairs = joins.co_occurrence(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey", most=6, support=3)
    return pairs.select(F.explode(F.array("a", "b")).alias("item")).groupBy("item").agg(F.count("*").alias("degree"))


@query("""
WITH one AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem),
ok AS (SELECT l_orderkey FROM one GROUP BY 1 HAVING count(*) <= 6),
s AS (SELECT one.* FROM one JOIN ok USING (l_orderkey)),
p AS (SELECT x.l_suppkey AS a, y.l_suppkey AS b, count(*) AS shared FROM s x JOIN s y ON x.l_orderkey = y.l_orderkey AND x.l_suppkey < y.l_suppkey GROUP BY 1, 2 HAVING count(*) >= 3),
e AS (SELECT DISTINCT s_suppkey AS src, c.m AS dst FROM supplier JOIN (SELECT s_nationkey AS k, min(s_suppkey) AS m FROM supplier GROUP BY 1) c ON c.k = s_nationkey WHERE s_suppkey <> c.m),
both_ways AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
h AS (SELECT s_suppkey AS id FROM supplier WHERE s_acctbal > 8000)
SELECT p.a, p.b, CAST(shared AS BIGINT) AS shared,
 CASE WHEN p.a IN (SELECT id FROM h) OR p.b IN (SELECT id FROM h) THEN 'hub' WHEN w.a IS NOT NULL THEN 'explained' ELSE 'hidden' END AS kind
FROM p LEFT JOIN both_ways w ON w.a = p.a AND w.b = p.b""")
def pair_edge_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs explained by a known edge, made by a hub, or hidden (JON04, JON34)."""
    pairs = joins.co_occurrence(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey", most=6, support=3).drop("ratio")
    s = table(spark, sf_dir, "supplier")
    lead = s.groupBy("s_nationkey").agg(F.min("s_suppkey").alias("dst"))
    edges = s.join(lead, "s_nationkey").where("s_suppkey <> dst").select(F.col("s_suppkey").alias("src"), "dst")
    return joins.annotate_pairs(pairs, edges, s.where("s_acctbal > 8000").select(F.col("s_suppkey").alias("id")))


@query("""
WITH l AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem),
b AS (SELECT l_orderkey, count(*) AS n FROM l GROUP BY 1),
h AS (SELECT l_partkey, count(*) AS churn, count(DISTINCT o_custkey) AS authors, min_by(o_orderdate, o_orderkey) AS first_date, max_by(o_orderdate, o_orderkey) AS last_date,
 sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS fixes FROM l JOIN b USING (l_orderkey) JOIN orders ON o_orderkey = l_orderkey WHERE b.n <= 6 GROUP BY 1)
SELECT p_partkey, CAST(coalesce(churn, 0) AS BIGINT) AS churn, CAST(coalesce(authors, 0) AS BIGINT) AS authors, first_date, last_date,
 round(coalesce(fixes::DOUBLE / churn, 0.0), 6) AS fix_share, round(fixes::DOUBLE / churn, 6) AS fix_share_or_null
FROM part LEFT JOIN h ON l_partkey = p_partkey""")
def entity_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's history over orders that are no bulk orders; parts without any stay with zeros (JON01, AGG01, AGG13)."""
    l = joins.small_baskets(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey", 6)
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    h = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_partkey").agg(
        F.count("*").alias("churn"),
        F.count_distinct("o_custkey").alias("authors"),
        F.min_by("o_orderdate", "o_orderkey").alias("first_date"),
        F.max_by("o_orderdate", "o_orderkey").alias("last_date"),
        F.count_if(F.col("o_orderstatus") == "F").alias("fixes"),
    )
    share = F.try_divide(F.col("fixes").cast("double"), F.col("churn"))
    p = table(spark, sf_dir, "part").select("p_partkey")
    return p.join(h, F.col("p_partkey") == F.col("l_partkey"), "left").select(
        "p_partkey",
        F.coalesce("churn", F.lit(0)).alias("churn"),
        F.coalesce("authors", F.lit(0)).alias("authors"),
        "first_date",
        "last_date",
        F.round(F.coalesce(share, F.lit(0.0)), 6).alias("fix_share"),
        F.round(share, 6).alias("fix_share_or_null"),
    )


@query("""
SELECT c_custkey, CAST(count(o_orderkey) AS BIGINT) AS n_orders, max_by(o_orderdate, o_orderkey) AS last_active, min_by(o_orderpriority, o_orderkey) AS first_priority
FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def author_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity of each customer, in log order rather than by date (AGG02)."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey")
    return c.join(o, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_custkey").agg(
        F.count("o_orderkey").alias("n_orders"), F.max_by("o_orderdate", "o_orderkey").alias("last_active"), F.min_by("o_orderpriority", "o_orderkey").alias("first_priority")
    )


_FLOW = "SELECT l_suppkey, c_nationkey, l_orderkey * 100 + l_linenumber AS pos FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey"


@query(f"""
WITH f AS ({_FLOW}),
g AS (SELECT l_suppkey, c_nationkey, count(*) AS n, min(pos) AS first FROM f GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, first) AS rn, sum(n) OVER (PARTITION BY l_suppkey) AS total FROM g)
SELECT l_suppkey, c_nationkey, round(n::DOUBLE / total, 6) AS share, CAST(total AS BIGINT) AS n FROM r WHERE rn = 1""")
def top_owner_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nation that buys most from each supplier and its share; ties by first seen (AGG03)."""
    l = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("pos"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    f = l.join(o, F.col("o_orderkey") == F.col("l_orderkey")).join(c, F.col("c_custkey") == F.col("o_custkey"))
    return aggregates.mode_with_share(f, "l_suppkey", "c_nationkey", "pos").withColumn("share", F.round("share", 6))


_SCORE = """
WITH h AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1),
b AS (SELECT p_partkey, p_brand, coalesce(n, 0)::DOUBLE AS n, p_retailprice FROM part LEFT JOIN h ON l_partkey = p_partkey),
s AS (SELECT p_partkey, p_brand, CASE WHEN max(n) OVER () > 0 THEN n / max(n) OVER () ELSE 0 END * CASE WHEN max(p_retailprice) OVER () > 0 THEN p_retailprice / max(p_retailprice) OVER () ELSE 0 END AS raw FROM b)
"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").cast("double").alias("n"))
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice")
    base = p.join(n, F.col("l_partkey") == F.col("p_partkey"), "left").select("p_partkey", "p_brand", "p_retailprice", F.coalesce("n", F.lit(0.0)).alias("n"))
    out = aggregates.normalised_by(base, ["n", "p_retailprice"])
    return out.select("p_partkey", "p_brand", F.round(F.col("n_norm") * F.col("p_retailprice_norm"), 6).alias("score"))


@query(_SCORE + "SELECT p_partkey, p_brand, round(raw, 6) AS score FROM s")
def hotspot_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Churn times size, each by its maximum (AGG05)."""
    return scored(spark, sf_dir)


@query(_SCORE + "SELECT p_partkey, p_brand, round(raw, 6) AS score FROM s ORDER BY round(raw, 6) DESC, p_partkey LIMIT 20")
def hotspots_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 hottest, ties by key (SRT01): a take-ordered, no full sort."""
    return scored(spark, sf_dir).orderBy(F.desc("score"), "p_partkey").limit(20)


@query(_SCORE + """, r AS (SELECT p_partkey, round(raw, 6) AS score, row_number() OVER (ORDER BY round(raw, 6) DESC, p_partkey) AS rn FROM s)
SELECT p_partkey, score FROM r WHERE rn <= least(greatest(CAST(ceil(0.1::DOUBLE * (SELECT count(*) FROM supplier)) AS BIGINT), 5), 50)""")
def hotspot_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top tenth of another population's size, between 5 and 50 (WIN04).

    The bound is known to be at most 50, so the order is a take-ordered of 50 rows.
    """
    k = table(spark, sf_dir, "supplier").agg(F.least(F.greatest(F.ceil(F.lit(0.1).cast("double") * F.count("*")), F.lit(5)), F.lit(50)).alias("_k"))
    top = scored(spark, sf_dir).select("p_partkey", "score").orderBy(F.desc("score"), "p_partkey").limit(50)
    w = F.row_number().over(Window.orderBy(F.desc("score"), "p_partkey"))
    return top.withColumn("_r", w).join(F.broadcast(k)).where("_r <= _k").select("p_partkey", "score")


_EDGES = """
WITH e AS (SELECT c_nationkey AS src, s_nationkey AS dst, count(*) AS w FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2),
k AS (SELECT src, dst FROM (SELECT src, dst, w, avg(w) OVER (PARTITION BY src) AS usual FROM e WHERE src <> dst) WHERE w > usual),
d AS (SELECT node, CAST(sum(i) AS BIGINT) AS fan_in, CAST(sum(o) AS BIGINT) AS fan_out FROM (SELECT src AS node, 1 AS o, 0 AS i FROM k UNION ALL SELECT dst, 0, 1 FROM k) GROUP BY 1)
"""


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("src"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("dst"))
    f = l.join(o, F.col("o_orderkey") == F.col("l_orderkey")).join(c, F.col("c_custkey") == F.col("o_custkey")).join(s, F.col("s_suppkey") == F.col("l_suppkey"))
    return f.groupBy("src", "dst").agg(F.count("*").alias("w"))


def strong(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows between nations above the usual one of their source, out of all flows of all lines."""
    f = flows(spark, sf_dir).where("src <> dst").withColumn("usual", F.avg("w").over(Window.partitionBy("src")))
    return f.where("w > usual").select("src", "dst")


@query(_EDGES + "SELECT node, fan_in, fan_out, round(fan_out::DOUBLE / (fan_in + fan_out), 6) AS instability FROM d")
def node_instability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fan-in, fan-out and instability of nations by their strong flows (AGG04)."""
    return aggregates.instability(strong(spark, sf_dir)).withColumn("instability", F.round("instability", 6))


@query(_EDGES + """SELECT k.src, k.dst FROM k JOIN d a ON a.node = k.src JOIN d b ON b.node = k.dst
WHERE a.fan_out::DOUBLE / (a.fan_in + a.fan_out) < 0.5 AND b.fan_out::DOUBLE / (b.fan_in + b.fan_out) > 0.5""")
def instability_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from stable to unstable nodes (AGG04)."""
    e = strong(spark, sf_dir)
    n = aggregates.instability(e).select("node", "instability")
    a = n.select(F.col("node").alias("src"), F.col("instability").alias("_a"))
    b = n.select(F.col("node").alias("dst"), F.col("instability").alias("_b"))
    return e.join(a, "src").join(b, "dst").where("_a < 0.5 and _b > 0.5").select("src", "dst")


@query("""
SELECT r_name, CAST(count(DISTINCT n_nationkey) AS BIGINT) AS n_dirs, CAST(count(s_suppkey) AS BIGINT) AS n_files, round(coalesce(sum(s_acctbal), 0), 2) AS total
FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1""")
def directory_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers rolled up through nations to regions, empty ones kept (AGG04, AGG27)."""
    r, n, s = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    j = r.join(n, F.col("n_regionkey") == F.col("r_regionkey"), "left").join(s, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return j.groupBy("r_name").agg(
        F.count_distinct("n_nationkey").alias("n_dirs"), F.count("s_suppkey").alias("n_files"), F.round(F.coalesce(F.sum("s_acctbal"), F.lit(0.0)), 2).alias("total")
    )


@query("""
WITH d AS (SELECT l_suppkey, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1),
r AS (SELECT n, row_number() OVER (ORDER BY n DESC) AS rn, count(*) OVER () AS total, min(n) OVER () AS lo, max(n) OVER () AS hi FROM d)
SELECT CAST(CASE WHEN lo <> hi THEN n END AS BIGINT) AS threshold FROM r WHERE rn = greatest(1, CAST(ceil(0.1::DOUBLE * total) AS BIGINT))""")
def decile_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The degree that closes the top tenth of suppliers, by count and not by percentile (AGG07)."""
    d = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("n"))
    return aggregates.count_threshold(d, "n", 0.1)

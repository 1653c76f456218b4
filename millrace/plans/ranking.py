"""Ranking, limiting, set and selection queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import aggregates, folds, windows
from millrace.plans.registry import query
from millrace.sources.tables import table

_PRIORITY = "SELECT p_partkey, p_brand, round(p_size * (1 + 0.5::DOUBLE * p_retailprice / 2100.0::DOUBLE), 4) AS priority FROM part"


def priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", "p_brand", F.round(F.col("p_size") * (1 + F.lit(0.5) * F.col("p_retailprice") / F.lit(2100.0)), 4).alias("priority"))


@query(f"""
WITH p AS ({_PRIORITY}), r AS (SELECT *, row_number() OVER (ORDER BY priority DESC, p_partkey) AS position, row_number() OVER (PARTITION BY p_brand ORDER BY priority DESC, p_partkey) AS g FROM p),
c AS (SELECT *, sum(CASE WHEN g <= 8 THEN 1 ELSE 0 END) OVER (ORDER BY position ROWS UNBOUNDED PRECEDING) AS c FROM r)
SELECT p_partkey, p_brand, priority, CAST(position AS BIGINT) AS position, g <= 8 AND c <= 40 AS in_top, NOT g <= 8 AND c < 40 AS spread_capped FROM c""")
def greedy_topn_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 40 with at most a fifth of a brand, flags on every row (WIN01, WIN02, FUN05)."""
    return windows.greedy_top(priorities(spark, sf_dir), "priority", "p_partkey", "p_brand", 40, 0.2)


@query("""
WITH r AS (SELECT event_id, event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM events)
SELECT event_id, event_type, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= 40""")
def cap_per_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 40 of each kind (WIN03): a window group limit, most rows never leave their task."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return windows.cap_per_group(e, "event_type", [F.desc("value"), F.asc("event_id")], 40).select("event_id", "event_type", "rank")


@query(f"""
WITH p AS ({_PRIORITY}), r AS (SELECT *, row_number() OVER (ORDER BY priority DESC, p_partkey) AS rn FROM p),
s AS (SELECT *, row_number() OVER (ORDER BY rn) AS k FROM r WHERE rn <= 30 OR p_brand = 'Brand#11')
SELECT p_partkey, rn <= 30 AS by_rank, CAST(k AS BIGINT) AS k FROM s WHERE k <= 60""")
def select_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prefix of 30 by rank together with rows that always count, cut at 60 (SRT03).

    Both parts are take-ordered to their bounds before any global window.
    """
    p = priorities(spark, sf_dir)
    order = [F.desc("priority"), F.asc("p_partkey")]
    top = p.orderBy(*order).limit(30).withColumn("by_rank", F.lit(True))
    always = p.where("p_brand = 'Brand#11'").orderBy(*order).limit(60).withColumn("by_rank", F.lit(False))
    every = top.unionByName(always).groupBy("p_partkey", "priority").agg(F.bool_or("by_rank").alias("by_rank"))
    k = F.row_number().over(Window.orderBy(*order)).cast("long")
    return every.withColumn("k", k).where("k <= 60").select("p_partkey", "by_rank", "k")


@query("SELECT p_partkey, p_size FROM (SELECT * FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 100) WHERE p_size >= 25")
def limit_then_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limit comes before the predicate (SRT02); a filter is not pushed through a limit."""
    top = table(spark, sf_dir, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(100)
    return top.where("p_size >= 25").select("p_partkey", "p_size")


@query("SELECT o_orderkey, CAST((row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1) // 25 AS BIGINT) AS batch_no FROM orders")
def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of 25 within each priority (WIN08)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return windows.batches(o, "o_orderpriority", ["o_orderkey"], 25).select("o_orderkey", "batch_no")


@query("SELECT s_suppkey, printf('R%03d', row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey)) AS rule_id FROM supplier")
def sequential_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zero-padded ids in sort order (WIN16)."""
    n = F.row_number().over(Window.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.format_string("R%03d", n).alias("rule_id"))


@query("""
WITH g AS (SELECT p_type, count(*) AS n, CAST(sum(CASE WHEN p_size > 25 THEN 1 ELSE 0 END) AS BIGINT) AS hits FROM part GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY hits DESC, n DESC, p_type) AS rn FROM g)
SELECT p_type, CAST(n AS BIGINT) AS n, hits, rn <= 10 AS kept FROM r""")
def group_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups by hits, count and name; ten kept, the rest reported as dropped (WIN18, AGG15). The window runs over groups only."""
    g = table(spark, sf_dir, "part").groupBy("p_type").agg(F.count("*").alias("n"), F.count_if(F.col("p_size") > 25).alias("hits"))
    rank = F.row_number().over(Window.orderBy(F.desc("hits"), F.desc("n"), "p_type"))
    return g.select("p_type", "n", "hits", (rank <= 10).alias("kept"))


@query("""
WITH a AS (SELECT p_brand, p_type FROM part WHERE p_size <= 25), b AS (SELECT p_brand, p_type FROM part WHERE p_size > 25)
SELECT p_brand, p_type, CAST(count(*) AS BIGINT) AS n FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) GROUP BY 1, 2""")
def bag_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brand and type pairs of small parts beyond those of large ones, as a bag (AGG19)."""
    p = table(spark, sf_dir, "part")
    cols = ["p_brand", "p_type"]
    d = aggregates.bag_difference(p.where("p_size <= 25").select(*cols), p.where("p_size > 25").select(*cols))
    return d.groupBy(*cols).agg(F.count("*").alias("n"))


@query("""
WITH a AS (SELECT p_partkey FROM part WHERE p_size < 30), b AS (SELECT p_partkey FROM part WHERE p_retailprice > 1200)
SELECT p_partkey, 'removed' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT p_partkey, 'added' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def symmetric_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What only one of two key sets has, labelled (SET02): one aggregate instead of two anti-joins."""
    p = table(spark, sf_dir, "part")
    sides = p.select("p_partkey", F.col("p_size").alias("s"), F.col("p_retailprice").alias("r")).select(
        "p_partkey", F.expr("s < 30").alias("a"), F.expr("r > 1200").alias("b")
    )
    g = sides.groupBy("p_partkey").agg(F.count_if("a").alias("a"), F.count_if("b").alias("b"))
    only = g.where("(a > 0) <> (b > 0)")
    return only.select("p_partkey", F.when(F.col("a") > 0, "removed").otherwise("added").alias("side"))


@query("""
WITH u AS (SELECT 0 AS src, p_partkey AS pos, p_name AS k FROM part WHERE p_size < 20 UNION ALL SELECT 1, p_partkey, p_name FROM part WHERE p_retailprice > 1000),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY src, pos) AS rn FROM u)
SELECT k, CAST(src AS INTEGER) AS src, pos FROM r WHERE rn = 1""")
def ordered_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union in order on a key, first occurrence wins (SET01, SRT07, SRT10)."""
    p = table(spark, sf_dir, "part")
    part = lambda n, where: p.where(where).select(F.col("p_name").alias("k"), F.lit(n).alias("src"), F.col("p_partkey").alias("pos"))
    u = part(0, "p_size < 20").unionByName(part(1, "p_retailprice > 1000"))
    return aggregates.keep_one(u, ["k"], [F.col("src"), F.col("pos")])


@query("""
SELECT p_partkey, list_sort(list_distinct(list_concat(string_split(p_name, ' '), string_split(lower(p_type), ' ')))) AS words,
 CAST(len(list_intersect(string_split(p_name, ' '), string_split(lower(p_type), ' '))) AS BIGINT) AS common FROM part""")
def array_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted union and intersection of token arrays (SET04, SET05, AGG24)."""
    a, b = F.split("p_name", " "), F.split(F.lower("p_type"), " ")
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.array_sort(F.array_union(a, b)).alias("words"), F.size(F.array_intersect(a, b)).cast("long").alias("common")
    )


@query("""
WITH p(preset, ws, wp) AS (VALUES ('balanced', 1.0::DOUBLE, 1.0::DOUBLE), ('size', 2.0::DOUBLE, 0.5::DOUBLE), ('price', 0.5::DOUBLE, 2.0::DOUBLE), ('flat', 0.0::DOUBLE, 0.0::DOUBLE)),
s AS (SELECT preset, p_partkey, round(ws * p_size + wp * p_retailprice / 100, 4) AS score FROM part, p),
r AS (SELECT *, row_number() OVER (PARTITION BY preset ORDER BY score DESC, p_partkey) AS rank FROM s)
SELECT preset, p_partkey, score, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= 10""")
def preset_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks under named presets of weights, four rows of literals exploded on each part (SRT09)."""
    presets = F.array(*[F.struct(F.lit(n).alias("preset"), F.lit(a).alias("ws"), F.lit(b).alias("wp")) for n, a, b in (("balanced", 1.0, 1.0), ("size", 2.0, 0.5), ("price", 0.5, 2.0), ("flat", 0.0, 0.0))])
    s = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice", F.explode(presets).alias("w"))
    s = s.select(F.col("w.preset").alias("preset"), "p_partkey", F.round(F.col("w.ws") * F.col("p_size") + F.col("w.wp") * F.col("p_retailprice") / 100, 4).alias("score"))
    return windows.cap_per_group(s, "preset", [F.desc("score"), F.asc("p_partkey")], 10).select("preset", "p_partkey", "score", "rank")


@query("""
WITH l AS (SELECT o_orderkey, coalesce(try_cast(left(o_orderpriority, 1) AS INTEGER), 0) AS p, o_totalprice FROM orders)
SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY p ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS rank, CAST(p AS INTEGER) AS p FROM l""")
def tolerant_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order by a number in text, bad values as 0 (SRT04, SRT06)."""
    p = F.coalesce(F.substring("o_orderpriority", 1, 1).try_cast("int"), F.lit(0))
    o = table(spark, sf_dir, "orders").select("o_orderkey", p.alias("p"), "o_totalprice")
    w = Window.partitionBy("p").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return o.select("o_orderkey", F.row_number().over(w).cast("long").alias("rank"), "p")


@query("""
WITH RECURSIVE d AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents),
r AS (SELECT source, doc_id, n_chars, rn, CAST(n_chars AS BIGINT) AS used, CAST(0 AS BIGINT) AS pack_no FROM d WHERE rn = 1
 UNION ALL SELECT d.source, d.doc_id, d.n_chars, d.rn, CASE WHEN r.used > 0 AND r.used + d.n_chars > 20000 THEN d.n_chars ELSE r.used + d.n_chars END, r.pack_no + CASE WHEN r.used > 0 AND r.used + d.n_chars > 20000 THEN 1 ELSE 0 END
 FROM r JOIN d ON d.source IS NOT DISTINCT FROM r.source AND d.rn = r.rn + 1)
SELECT source, doc_id, n_chars, pack_no FROM r""")
def budget_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each source packed in order into groups of at most 20,000 characters; longer ones alone (WIN10, STM05)."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return folds.pack_in_order(d, "source", "doc_id", "n_chars", 20_000)


@query("""
WITH RECURSIVE o AS (SELECT o_custkey, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS lo, o_orderkey FROM orders), n AS (SELECT *, lo + 60 AS hi, row_number() OVER (PARTITION BY o_custkey ORDER BY lo, o_orderkey) AS rn FROM o),
r AS (SELECT o_custkey, lo, hi, o_orderkey, rn, hi AS top, true AS kept FROM n WHERE rn = 1
 UNION ALL SELECT n.o_custkey, n.lo, n.hi, n.o_orderkey, n.rn, CASE WHEN n.lo > r.top THEN n.hi ELSE r.top END, n.lo > r.top FROM r JOIN n ON n.o_custkey = r.o_custkey AND n.rn = r.rn + 1)
SELECT o_custkey, lo, hi, o_orderkey, kept FROM r""")
def greedy_non_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's 60-day intervals that overlap none kept before (WIN13)."""
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date")).cast("long")
    o = table(spark, sf_dir, "orders").select("o_custkey", day.alias("lo"), (day + 60).alias("hi"), "o_orderkey")
    return folds.keep_non_overlapping(o, "o_custkey", "lo", "hi", "o_orderkey")


@query("""
WITH RECURSIVE p AS (SELECT p_brand, p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')[1:64] AS base, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn FROM part),
r AS (SELECT p_brand, p_partkey, base, rn, base AS name, [base] AS taken FROM p WHERE rn = 1
 UNION ALL SELECT p_brand, p_partkey, base, rn, name, list_append(before, name) FROM (SELECT p.p_brand, p.p_partkey, p.base, p.rn, r.taken AS before,
  CASE WHEN NOT list_contains(r.taken, p.base) THEN p.base ELSE p.base || '-' || list_filter(range(2, len(r.taken) + 3), lambda k: NOT list_contains(r.taken, p.base || '-' || k))[1] END AS name FROM r JOIN p ON p.p_brand = r.p_brand AND p.rn = r.rn + 1))
SELECT p_brand, p_partkey, base, name FROM r""")
def unique_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs of part names by brand, with suffixes that avoid names already taken (WIN06, FUN10)."""
    p = table(spark, sf_dir, "part").select("p_brand", "p_partkey", text.slug(F.col("p_name")).alias("base"))
    return folds.unique_names(p, "p_brand", "p_partkey", "base")

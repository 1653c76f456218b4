"""Reference resolution queries: cascades, suffixes, gates, fuzzy and interval matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import folds, joins
from millrace.plans.registry import query
from millrace.sources.tables import table

_PAGE = r"regexp_extract(url, '^[a-z]+://([^?#]*)', 1)"


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^[a-z]+://([^?#]*)", 1).alias("path"))


@query(f"""
WITH p AS (SELECT page_id, {_PAGE} AS path FROM pages), s AS (SELECT page_id, string_split(path, '/') AS s FROM p),
x AS (SELECT page_id, unnest(list_transform(range(1, len(s) + 1), lambda i: array_to_string(s[i:], '/'))) AS suffix FROM s)
SELECT suffix, CAST(count(*) AS BIGINT) AS n, min(page_id) AS first FROM x GROUP BY 1""")
def suffix_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segment-aligned suffixes of page paths and the pages that have them (JON18)."""
    x = page_paths(spark, sf_dir).select("page_id", F.explode(joins.suffixes(F.col("path"))).alias("suffix"))
    return x.groupBy("suffix").agg(F.count("*").alias("n"), F.min("page_id").alias("first"))


@query(f"""
WITH p AS (SELECT page_id, {_PAGE} AS path FROM pages), r AS (SELECT page_id AS ref_id, CASE page_id % 4 WHEN 0 THEN path WHEN 1 THEN regexp_replace(path, '^[^/]+/', '') WHEN 2 THEN regexp_extract(path, '[^/]+$') ELSE 'nowhere/' || page_id END AS ref FROM p),
x AS (SELECT page_id, unnest(list_transform(range(1, len(string_split(path, '/')) + 1), lambda i: array_to_string(string_split(path, '/')[i:], '/'))) AS suffix FROM p),
m AS (SELECT DISTINCT ref_id, 0 AS mode, page_id AS target FROM r JOIN p ON p.path = ref UNION SELECT ref_id, 1, page_id FROM r JOIN x ON suffix = ref UNION SELECT ref_id, 2, page_id FROM r JOIN p ON regexp_extract(p.path, '[^/]+$') = regexp_extract(ref, '[^/]+$')),
b AS (SELECT ref_id, min(mode) AS mode FROM m GROUP BY 1)
SELECT r.ref_id, r.ref, CAST(b.mode AS INTEGER) AS mode, min(m.target) AS target, CAST(CASE WHEN b.mode IS NULL THEN NULL ELSE count(m.target) END AS BIGINT) AS candidates
FROM r LEFT JOIN b ON b.ref_id = r.ref_id LEFT JOIN m ON m.ref_id = b.ref_id AND m.mode = b.mode GROUP BY r.ref_id, r.ref, b.mode""")
def resolve_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References resolved whole, by suffix, then by base name; the first mode that finds any wins (JON17, JON35, JON41)."""
    p = page_paths(spark, sf_dir)
    i = F.col("page_id")
    base = lambda c: F.regexp_extract(c, "[^/]+$", 0)
    ref = F.when(i % 4 == 0, F.col("path")).when(i % 4 == 1, F.regexp_replace("path", "^[^/]+/", "")).when(i % 4 == 2, base("path")).otherwise(F.concat(F.lit("nowhere/"), i.cast("string")))
    r = p.select(i.alias("ref_id"), ref.alias("ref"))
    t = p.select(F.col("page_id").alias("target"), "path")
    whole = joins.by_form(r.withColumn("form", F.col("ref")), t.withColumn("form", F.col("path")), "ref_id", "form")
    suffix = joins.by_form(r.withColumn("form", F.col("ref")), t.select("target", F.explode(joins.suffixes(F.col("path"))).alias("form")), "ref_id", "form")
    name = joins.by_form(r.withColumn("form", base("ref")), t.withColumn("form", base("path")), "ref_id", "form")
    return joins.cascade(r, [whole, suffix, name], "ref_id")


@query("""
WITH w AS (SELECT DISTINCT item_id, unnest(string_split(lower(text), ' ')) AS name FROM benchmark), d AS (SELECT DISTINCT doc_id, unnest(string_split(lower(text), ' ')) AS name FROM documents),
u AS (SELECT name, CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 1 END AS rank, doc_id AS target FROM d), b AS (SELECT name, min(rank) AS rank FROM u GROUP BY 1), t AS (SELECT name, count(*) AS n, min(target) AS target FROM u JOIN b USING (name, rank) GROUP BY 1)
SELECT item_id, name, CASE WHEN n IS NULL THEN 'unknown' WHEN n > 10 THEN 'ambiguous' ELSE 'resolved' END AS status, CASE WHEN n <= 10 THEN target END AS target FROM w LEFT JOIN t USING (name)""")
def reference_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words resolved to documents of the best rank, with a gate on their number (JON15, GRF05, AGG14)."""
    words = lambda df, k: df.select(k, F.explode(F.array_distinct(F.split(F.lower("text"), " "))).alias("name"))
    refs = words(table(spark, sf_dir, "benchmark"), "item_id")
    defs = words(table(spark, sf_dir, "documents"), "doc_id").select("name", (F.col("doc_id") % 2).alias("rank"), F.col("doc_id").alias("target"))
    return joins.resolve_references(refs, defs, "name", 10)


@query("""
WITH w AS (SELECT DISTINCT unnest(string_split(p_name || ' ' || lower(p_type), ' ')) AS word FROM part), p AS (SELECT a.word, b.word AS other, levenshtein(a.word, b.word) AS d FROM w a JOIN w b ON a.word <> b.word AND levenshtein(a.word, b.word) <= 2),
r AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY d, other) AS rn FROM p)
SELECT word, other AS nearest, CAST(d AS BIGINT) AS distance FROM r WHERE rn = 1""")
def fuzzy_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each word's nearest other word within two edits (JON22, FUN26), keyed by deletions."""
    w = table(spark, sf_dir, "part").select(F.explode(F.split(F.concat_ws(" ", "p_name", F.lower("p_type")), " ")).alias("word"))
    return joins.fuzzy_nearest(w, "word", 2)


@query("""
WITH n AS (SELECT l_partkey, count(DISTINCT l_returnflag) AS n, min(l_returnflag) AS v FROM lineitem GROUP BY 1)
SELECT p_partkey, CASE WHEN n IS NULL THEN 'missing' WHEN n = 1 THEN 'matched' ELSE 'conflicting' END AS verdict, CASE WHEN n = 1 THEN v END AS l_returnflag FROM part LEFT JOIN n ON l_partkey = p_partkey""")
def gated_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fact counts only if a key has exactly one (JON21, JON27)."""
    facts = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_returnflag")
    return joins.gated_lookup(table(spark, sf_dir, "part").select("p_partkey"), facts, "p_partkey", "l_returnflag").select("p_partkey", "verdict", "l_returnflag")


@query("""
WITH v AS (SELECT doc_id, max_by(toxic, quality * 10 + toxic) AS verdict, count(*) AS n FROM labels GROUP BY 1)
SELECT d.doc_id, verdict, CASE WHEN v.doc_id IS NULL THEN 'missing' WHEN verdict = 1 THEN 'rejected' ELSE 'confirmed' END AS tier FROM documents d LEFT JOIN v ON v.doc_id = d.doc_id""")
def verdict_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts joined to rows, missing ones said (JON10, AGG23, JON33)."""
    v = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("_d")).agg(F.max_by("toxic", F.col("quality") * 10 + F.col("toxic")).alias("verdict"))
    tier = F.when(F.col("_d").isNull(), "missing").when(F.col("verdict") == 1, "rejected").otherwise("confirmed")
    return table(spark, sf_dir, "documents").select("doc_id").join(v, F.col("doc_id") == F.col("_d"), "left").select("doc_id", "verdict", tier.alias("tier"))


@query("""
WITH now AS (SELECT DISTINCT item_id, unnest(string_split(text, ' ')) AS w FROM benchmark), s AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS w FROM documents WHERE doc_id % 2 = 0), t AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS w FROM documents WHERE doc_id % 2 = 1)
SELECT item_id, w FROM now WHERE w NOT IN (SELECT w FROM t) AND w IN (SELECT w FROM s)""")
def lost_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References that an earlier snapshot resolved and the present one does not (JON36)."""
    words = lambda df, *k: df.select(*k, F.explode(F.array_distinct(F.split("text", " "))).alias("w")).distinct()
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    now = words(table(spark, sf_dir, "benchmark"), "item_id")
    return now.join(words(d.where("doc_id % 2 = 1")), "w", "left_anti").join(words(d.where("doc_id % 2 = 0")), "w", "left_semi").select("item_id", "w")


@query("""
WITH r(pattern, owner) AS (VALUES ('Brand#[12]', 'a'), ('Brand#3[0-5]', 'b'), ('Brand#4', 'c'))
SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM r WHERE regexp_matches(p_brand, pattern))""")
def unowned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that no owner rule matches (JON28): the rules as one predicate, no join."""
    return table(spark, sf_dir, "part").where(~F.col("p_brand").rlike("Brand#[12]|Brand#3[0-5]|Brand#4")).select("p_partkey")


@query("""
WITH o AS (SELECT o_custkey, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS lo, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) + o_orderkey % 40 AS hi, o_orderkey FROM orders),
t AS (SELECT *, max(hi) OVER (PARTITION BY o_custkey ORDER BY lo, hi, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM o),
i AS (SELECT *, sum(CASE WHEN top IS NULL OR lo > top + 10 THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY lo, hi, o_orderkey) AS island FROM t)
SELECT o_custkey, min(lo) AS lo, max(hi) AS hi, min(o_orderkey) AS cluster, CAST(count(*) AS BIGINT) AS n FROM i GROUP BY o_custkey, island""")
def cluster_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' orders merged into clusters whose window grows with each (AGG09)."""
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date")).cast("long")
    o = table(spark, sf_dir, "orders").select("o_custkey", day.alias("lo"), (day + F.col("o_orderkey") % 40).alias("hi"), "o_orderkey")
    return folds.merge_clusters(o, "o_custkey", "lo", "hi", "o_orderkey", 10)

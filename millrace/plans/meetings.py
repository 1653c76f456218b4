"""Queries of interval joins, phrases and searches from both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import graph, joins, phrases
from millrace.plans.registry import query
from millrace.sources.tables import table


@query("""
WITH o AS (SELECT o_orderkey, o_orderkey % 3 AS grp, o_orderkey * 3 AS lo, o_orderkey * 3 + (o_custkey % 7) * (o_custkey % 7) AS hi FROM orders),
l AS (SELECT l_orderkey, l_linenumber, (l_orderkey + l_partkey) % 3 AS grp, l_orderkey * 3 + l_linenumber AS lo, l_orderkey * 3 + l_linenumber + l_partkey % 5 + CASE WHEN l_partkey % 97 = 0 THEN 300 ELSE 0 END AS hi FROM lineitem)
SELECT o_orderkey, l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber FROM o JOIN l ON o.grp = l.grp AND o.lo <= l.hi AND l.lo <= o.hi""")
def interval_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping intervals of two large sides, of very different lengths, in three groups (JON16)."""
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_orderkey % 3 AS grp", "o_orderkey * 3 AS lo", "o_orderkey * 3 + (o_custkey % 7) * (o_custkey % 7) AS hi")
    at = "l_orderkey * 3 + l_linenumber"
    l = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "bigint(l_linenumber) AS l_linenumber", "(l_orderkey + l_partkey) % 3 AS grp", f"{at} AS lo", f"{at} + l_partkey % 5 + CASE WHEN l_partkey % 97 = 0 THEN 300 ELSE 0 END AS hi")
    return joins.interval_join(o, l, ["grp"]).select("i.o_orderkey", "t.l_orderkey", "t.l_linenumber")


@query("""
WITH t AS (SELECT doc_id, doc_id % 7 AS grp, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 'p' || doc_id % 11 END AS path, doc_id % 100 AS lo, doc_id % 100 + n_chars % 9 AS hi, ['tool:' || source, 'lang:' || lang] AS made FROM documents),
g AS (SELECT item_id, item_id % 7 AS grp, CASE WHEN item_id % 3 = 0 THEN NULL ELSE 'p' || item_id % 11 END AS path, CASE WHEN item_id % 4 = 0 THEN NULL ELSE item_id END AS lo, item_id + 5 AS hi, CASE item_id % 4 WHEN 1 THEN ['tool:src1*', 'lang:de'] WHEN 2 THEN [] ELSE NULL END AS src FROM benchmark)
SELECT doc_id, item_id FROM t JOIN g ON t.grp = g.grp AND t.path IS NOT DISTINCT FROM g.path AND (g.lo IS NULL OR (t.lo <= g.hi AND g.lo <= t.hi))
WHERE src IS NULL OR len(src) = 0 OR list_contains(made, 'lang:de') OR starts_with(made[1], 'tool:src1')""")
def truths_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth matching by path, interval and the producers that a truth admits (JON13)."""
    i, b = F.col("doc_id"), F.col("item_id")
    path = lambda k, n: F.when(k % n != 0, F.concat(F.lit("p"), (k % 11).cast("string"))).alias("path")
    made = F.array(F.concat(F.lit("tool:"), "source"), F.concat(F.lit("lang:"), "lang")).alias("producers")
    t = table(spark, sf_dir, "documents").select((i % 7).alias("grp"), path(i, 5), (i % 100).alias("lo"), (i % 100 + F.col("n_chars") % 9).alias("hi"), "doc_id", made)
    admits = F.when(b % 4 == 1, F.array(F.lit("tool:src1*"), F.lit("lang:de"))).when(b % 4 == 2, F.array().cast("array<string>")).alias("sources")
    g = table(spark, sf_dir, "benchmark").select((b % 7).alias("grp"), path(b, 3), F.when(b % 4 != 0, b).alias("lo"), (b + 5).alias("hi"), "item_id", admits)
    return joins.theta_match(t, g).select("i.doc_id", "t.item_id")


_W = "regexp_extract_all(lower({c}), '{p}')"
_NAMES = """n AS (SELECT *, ' ' || array_to_string(CASE WHEN kind = 'flag' THEN regexp_extract_all(lower(name), '[a-z0-9_-]+') ELSE regexp_extract_all(lower(name), '[a-z0-9]+') END, ' ') || ' ' AS phrase, ' ' || array_to_string(regexp_extract_all(lower(parent), '[a-z0-9]+'), ' ') || ' ' AS above
 FROM (SELECT item_id AS id, CASE item_id % 3 WHEN 0 THEN array_to_string(string_split(text, ' ')[item_id % 5 + 1:item_id % 5 + item_id % 4 + 1], '-') ELSE array_to_string(string_split(text, ' ')[item_id % 5 + 1:item_id % 5 + item_id % 4 + 1], ' ') END AS name, CASE item_id % 3 WHEN 0 THEN 'flag' WHEN 1 THEN 'name' END AS kind, CASE WHEN item_id % 5 = 0 THEN string_split(text, ' ')[1] END AS parent, item_id % 7 < 3 AS hidden FROM benchmark)),
s AS (SELECT doc_id AS doc, k AS section, l[k] AS heading, array_to_string(l[k:k + 3], chr(10)) AS text FROM (SELECT doc_id, string_split(regexp_replace(text, '\n$', ''), chr(10)) AS l FROM documents), range(1, 100000, 4) r(k) WHERE k <= len(l)),
w AS (SELECT *, ' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') || ' ' AS plain, ' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9_-]+'), ' ') || ' ' AS flags, ' ' || array_to_string(regexp_extract_all(lower(heading), '[a-z0-9]+'), ' ') || ' ' AS head FROM s),
f AS (SELECT doc, section, id FROM w JOIN n ON contains(CASE WHEN kind = 'flag' THEN flags ELSE plain END, phrase) WHERE trim(phrase) <> '' AND (parent IS NULL OR trim(above) = '' OR contains(head, above)))"""


def _phrases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    i, w = F.col("item_id"), F.split("text", " ", -1)
    chosen = F.slice(w, (i % 5 + 1).cast("int"), (i % 4 + 1).cast("int"))
    kind = F.when(i % 3 == 0, "flag").when(i % 3 == 1, "name").alias("kind")
    names = table(spark, sf_dir, "benchmark").select(i.alias("id"), F.when(i % 3 == 0, F.array_join(chosen, "-")).otherwise(F.array_join(chosen, " ")).alias("name"), kind, F.when(i % 5 == 0, F.get(w, F.lit(0))).alias("parent"), (i % 7 < 3).alias("hidden"))
    l = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), T.lines(F.col("text")).alias("l"))
    k = l.select("doc", "l", F.explode(F.sequence(F.lit(1), F.size("l"), F.lit(4))).alias("section"))
    return k.select("doc", "section", F.get("l", F.col("section") - 1).alias("heading"), F.array_join(F.slice("l", F.col("section"), 4), "\n").alias("text")), names


@query(f"WITH {_NAMES} SELECT doc, CAST(section AS INTEGER) AS section, id FROM f")
def phrases_by_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of one to four words in the sections of documents, those with a parent only where a heading says it (JON23)."""
    return phrases.phrases_in_texts(*_phrases(spark, sf_dir))


@query(f"WITH {_NAMES} SELECT doc, CAST(section AS INTEGER) AS section, lower(name) AS name, bool_and(hidden) AS rejected FROM f JOIN n USING (id) GROUP BY 1, 2, 3")
def hidden_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What sections name, rejected where all that bear the name are hidden (JON39)."""
    sections, names = _phrases(spark, sf_dir)
    return phrases.hidden_phrases(phrases.phrases_in_texts(sections, names), names)


@query("""
WITH RECURSIVE e AS (SELECT p_partkey // 2 AS parent, p_partkey AS child FROM part WHERE p_partkey > 1 UNION SELECT p_partkey // 3, p_partkey FROM part WHERE p_partkey > 2),
q AS (SELECT c_custkey AS id, c_custkey * 7 % (SELECT max(p_partkey) FROM part) + 1 AS head, c_custkey % 40 + 1 AS recorded, (c_custkey * 7 % (SELECT max(p_partkey) FROM part) + 1) // (2 + c_custkey % 5) AS committed FROM customer),
n AS (SELECT DISTINCT head AS b FROM q UNION SELECT recorded FROM q), u AS (SELECT b, b AS a FROM n UNION SELECT u.b, e.parent FROM u JOIN e ON e.child = u.a),
f AS (SELECT q.*, EXISTS (SELECT 1 FROM u WHERE u.b = head AND u.a = recorded) AS r, EXISTS (SELECT 1 FROM u WHERE u.b = head AND u.a = committed) AS c, EXISTS (SELECT 1 FROM u WHERE u.b = recorded AND u.a = committed) AS o FROM q)
SELECT id, CASE WHEN r AND (NOT c OR (o AND recorded <> committed)) THEN recorded WHEN c THEN committed END AS chosen, CASE WHEN r AND (NOT c OR (o AND recorded <> committed)) THEN 'record' WHEN c THEN 'commit' END AS source FROM f""")
def later_ancestor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two candidates for each customer the later one that is an ancestor of its head, by searches from both sides (GRF04)."""
    p = table(spark, sf_dir, "part").select("p_partkey")
    e = p.where("p_partkey > 1").selectExpr("p_partkey div 2 AS parent", "p_partkey AS child").union(p.where("p_partkey > 2").selectExpr("p_partkey div 3", "p_partkey"))
    top = p.agg(F.max("p_partkey")).first()[0] or 1
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", f"c_custkey * 7 % {top} + 1 AS head", "c_custkey % 40 + 1 AS recorded", f"(c_custkey * 7 % {top} + 1) div (2 + c_custkey % 5) AS committed")
    return graph.later_of_two(e, c)

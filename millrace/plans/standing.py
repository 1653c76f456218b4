"""Queries of priorities with every term, and of references anchored by rank or by owners."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import names, scores
from millrace.plans.registry import query
from millrace.sources.tables import table


@query("""
WITH c AS (SELECT p_partkey, p_size % 6 AS severity, CASE p_partkey % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' WHEN 3 THEN 'D' END AS tier, CASE p_partkey % 4 WHEN 0 THEN 'S' WHEN 1 THEN 'M' WHEN 2 THEN 'L' END AS effort,
 CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_retailprice::DOUBLE END AS hotspot, p_size AS coupling, p_partkey % 23 AS fan_in, CASE p_partkey % 7 WHEN 0 THEN 'anywhere' WHEN 1 THEN NULL ELSE 'import-lines' END AS mode FROM part),
m AS (SELECT max(hotspot) AS h, max(coupling) AS c, max(CASE WHEN coalesce(mode, 'import-lines') = 'import-lines' THEN fan_in END) AS f FROM c),
t AS (SELECT c.*, round(coalesce(hotspot, 0) / m.h, 4) AS "H", round(coupling::DOUBLE / m.c, 4) AS "C", CASE WHEN mode = 'anywhere' THEN 0.0::DOUBLE ELSE round(fan_in::DOUBLE / m.f, 4) END AS "F" FROM c, m),
i AS (SELECT *, round(1 + 1.0::DECIMAL(9,4) * "H"::DECIMAL(9,4) + 0.5::DECIMAL(9,4) * "C"::DECIMAL(9,4) + 0.5::DECIMAL(9,4) * "F"::DECIMAL(9,4), 4)::DOUBLE AS interest, CASE tier WHEN 'A' THEN 1.0::DOUBLE WHEN 'C' THEN 0.35::DOUBLE ELSE 0.7::DOUBLE END AS tier_weight, CASE effort WHEN 'S' THEN 1.0::DOUBLE WHEN 'L' THEN 0.5::DOUBLE ELSE 0.75::DOUBLE END AS tractability FROM t)
SELECT p_partkey, "H", "C", "F", interest, tier_weight, tractability, round(severity::DECIMAL(9,0) * interest::DECIMAL(9,4) * (tier_weight::DECIMAL(9,4) * tractability::DECIMAL(9,4))::DECIMAL(12,8), 4)::DOUBLE AS priority FROM i""")
def priority_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity, interest, tier and effort of parts as findings, each term rounded (FUN05)."""
    k = F.col("p_partkey")
    pick = lambda n, **of: F.expr(f"CASE p_partkey % {n} " + " ".join(f"WHEN {v} THEN '{name}'" for name, v in of.items()) + " END")
    found = table(spark, sf_dir, "part").select(
        k, (F.col("p_size") % 6).alias("severity"), pick(5, A=0, B=1, C=2, D=3).alias("tier"), pick(4, S=0, M=1, L=2).alias("effort"), F.when(k % 11 != 0, F.col("p_retailprice").cast("double")).alias("hotspot"),
        F.col("p_size").alias("coupling"), (k % 23).alias("fan_in"), F.when(k % 7 == 0, "anywhere").when(k % 7 != 1, "import-lines").alias("mode"),
    )
    out = scores.priorities(found, found, {"H": 1.0, "C": 0.5, "F": 0.5}, {"S": 1.0, "M": 0.75, "L": 0.5})
    return out.select("p_partkey", "H", "C", "F", "interest", "tier_weight", "tractability", "priority")


_KINDS = ["module", "function", "class", "sql", "file", "reg", "sqlcol", "literal"]
_DEFINED = "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'n' || (p_partkey % 40) WHEN 1 THEN 'owner' || (p_partkey % 6) ELSE 'm' || (p_partkey % 300) END AS name, p_size % 8 AS k, {a}('own' || (p_partkey % 5), 'own' || (p_size % 7)) AS owners FROM {part}"
_REFERRED = "SELECT c_custkey AS ref, CASE c_custkey % 4 WHEN 0 THEN 'n' || (c_custkey % 60) WHEN 1 THEN 'owner' || (c_custkey % 9) || '.m' || (c_custkey % 400) WHEN 2 THEN 'owner1/y.m' || (c_custkey % 300) ELSE 'm' || (c_custkey % 350) END AS name, c_custkey % 3 <> 0 AS specific, {a}('own' || (c_custkey % 11), 'own' || (c_custkey % 4)) AS context FROM {customer}"


@query(f"""
WITH d AS (SELECT *, CASE k WHEN 5 THEN 1 WHEN 6 THEN 1 WHEN 7 THEN 2 ELSE 0 END AS rank FROM ({_DEFINED.format(a="list_value", part="part")})), r AS ({_REFERRED.format(a="list_value", customer="customer")}),
s AS (SELECT ref, CASE WHEN name NOT IN (SELECT name FROM d) AND contains(name, '.') AND NOT contains(name, '/') AND split_part(name, '.', 1) IN (SELECT name FROM d) THEN split_part(name, '.', 2) ELSE name END AS name FROM r WHERE specific),
c AS (SELECT ref, id FROM s JOIN d USING (name) WHERE d.rank = (SELECT min(rank) FROM d e WHERE e.name = s.name)
 UNION ALL SELECT ref, id FROM r JOIN d USING (name) WHERE NOT specific AND len(list_intersect(owners, context)) > 0),
n AS (SELECT r.ref, specific, count(id) AS n, count(DISTINCT id) FILTER (WHERE id IS NOT NULL) AS m, any_value(r.name) IN (SELECT name FROM d) AS known FROM r LEFT JOIN c ON c.ref = r.ref GROUP BY r.ref, specific),
g AS (SELECT *, n > 0 AND n <= CASE WHEN specific THEN 10 ELSE 3 END AS fine FROM n)
SELECT g.ref, c.id AS definition, NULL AS reason FROM g JOIN c ON c.ref = g.ref WHERE fine
UNION ALL SELECT ref, NULL, CASE WHEN n > 0 OR (NOT specific AND known) THEN 'ambiguous' ELSE 'unknown' END FROM g WHERE NOT fine""")
def anchored_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specific, dotted and bare names anchored to definitions (JON15, AGG14)."""
    table(spark, sf_dir, "part").createOrReplaceTempView("_millrace_part")
    table(spark, sf_dir, "customer").createOrReplaceTempView("_millrace_customer")
    kinds = F.array(*map(F.lit, _KINDS))
    d = spark.sql(_DEFINED.format(a="array", part="_millrace_part")).withColumn("kind", F.get(kinds, F.col("k"))).drop("k")
    return names.anchored(spark.sql(_REFERRED.format(a="array", customer="_millrace_customer")), d)
